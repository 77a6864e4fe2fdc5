"""BPE, near-duplicates, the quality model and language identification against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import ODD_TEXTS, WORDS
from tokenizers import Tokenizer

from trackspark.llm import bpe, langid, minhash, quality

PATH = public_tokenizers.path("word_bpe_49k.json")


def _notes(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "clash", 1) for i, t in enumerate(texts)], "event_id long, notes string, lang string, node string, n long")


def _prose(seed, n, words=WORDS):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) + rng.choice(["", "", "s", ","]) for _ in range(rng.randint(3, 60))) for _ in range(n)]


def test_bpe_equals_the_tokenizers_library(spark):
    reference = Tokenizer.from_file(PATH)
    reference.no_padding()
    reference.no_truncation()
    rng = random.Random(3)
    letters = "aAbBsStT'’ \t\n\x1c\x85\xa0éÉßΣσñ.,!?0123٣½日本İı́​😀<|>_-\x00"
    texts = ODD_TEXTS + ["<|endoftext|>x<|startoftext|>", "ΑΣ ΑΣ. Σ"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    rows = {r["event_id"]: r for r in bpe.encode_notes(_notes(spark, texts), PATH).collect()}
    for i, text in enumerate(texts):
        ids = reference.encode(text or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == ids, repr(text)
        assert rows[i]["decoded"] == reference.decode(ids, skip_special_tokens=False)


def test_forced_cuts_split_words_and_change_nothing():
    vocabulary = bpe.WordBpe(PATH)
    word = "日本語éö"
    assert len(vocabulary.fragments(word)) > 1
    whole = list(word.encode().decode("latin-1").translate(vocabulary.symbol))
    whole[-1] += vocabulary.end
    assert np.frombuffer(vocabulary.word_ids(word), np.int32).tolist() == list(vocabulary.merged(whole))


def _copies(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 12)):
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = f"v{rng.randint(0, 9)}"
            texts.append(" ".join(changed).title() if rng.random() < 0.2 else "\n".join(changed))
    return texts + [None, "", "  ", "a b", "A  b", "c d e f g"] + texts[:3]


def _components(texts, percent=85):
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = _copies(block)
    rows = {r["event_id"]: r for r in minhash.near_duplicates(_notes(spark, texts)).collect()}
    for i, (size, component) in enumerate(_components(texts)):
        assert (rows[i]["n_shingles"], rows[i]["component_id"], rows[i]["kept"]) == (size, component, component == i), i


def test_superminhash_equals_its_definition_and_estimates_similarity():
    rng = np.random.default_rng(5)

    def plain(elements):
        out = [math.inf] * minhash.SLOTS
        for e in elements:
            order = list(range(minhash.SLOTS))
            for rank in range(minhash.SLOTS):
                seed = minhash.mixed(np.array([e + minhash._U(0x9E3779B97F4A7C15 * (2 * rank + 1) & (2**64 - 1))]))[0]
                number = float(seed >> minhash._U(11)) * 2.0**-53
                low = int(minhash.mixed(np.array([seed ^ minhash._U(0xD1B54A32D192ED03)]))[0] >> minhash._U(32))
                pick = rank + (low * (minhash.SLOTS - rank) >> 32)
                order[rank], order[pick] = order[pick], order[rank]
                out[order[rank]] = min(out[order[rank]], number + rank)
        return out

    with np.errstate(over="ignore"):
        for n in (1, 2, 7, 40, 700):
            elements = rng.integers(0, 2**63, n).astype(np.uint64)
            assert minhash.superminhash(elements).tolist() == plain(elements)
    errors = []
    for _ in range(200):
        shared, left, right = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (170, 15, 15))
        a, b = (minhash.superminhash(np.concatenate([shared, x])) for x in (left, right))
        errors.append((a == b).mean() - 0.85)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def _plain_kneser_ney(training, order=quality.ORDER):
    """log2 probability of a character after its context, by the recursive definition over dictionaries."""
    pad = lambda t: [quality.BEGIN] * (order - 1) + [ord(c) for c in t] + [quality.STOP]
    counts = {order: Counter()}
    for t in training:
        x = pad(t)
        counts[order].update(tuple(x[i : i + order]) for i in range(len(x) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    table = {}
    for n, c in counts.items():
        few = [sum(v == i for v in c.values()) for i in range(1, 5)]
        d = quality.KneserNey._discounts(few)
        mass, lost = defaultdict(float), defaultdict(float)
        for g, v in c.items():
            mass[g[:-1]] += v
            lost[g[:-1]] += d[min(v, 3) - 1]
        table[n] = (c, d, mass, lost)
    alphabet = len(counts[1]) + 1

    def probability(gram):
        if not gram:
            return 1 / alphabet
        c, d, mass, lost = table[len(gram)]
        below = probability(gram[1:])
        if not mass.get(gram[:-1]):
            return below
        v = c.get(gram, 0)
        return ((v - d[min(v, 3) - 1] if v else 0) + lost[gram[:-1]] * below) / mass[gram[:-1]]

    def perplexity(text):
        x = pad(text)
        grams = [tuple(x[i : i + order]) for i in range(len(x) - order + 1)]
        return 2 ** (-sum(math.log2(probability(g)) for g in grams) / len(grams))

    return perplexity, probability, [g[0] for g in counts[1]]


def test_perplexity_equals_the_recursive_definition(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_CHARS", 2000)
    training, others = _prose(1, 60), _prose(2, 15) + ["ZZ!! QQ", "é日本", "x", None, ""]
    model = quality.KneserNey(_notes(spark, training))
    rows = {r["event_id"]: r["perplexity"] for r in quality.perplexities(_notes(spark, others), model).collect()}
    expected, probability, alphabet = _plain_kneser_ney(training)
    for i, text in enumerate(others):
        assert rows[i] is None if not text else rows[i] == pytest.approx(expected(text), rel=1e-5), text
    # Probabilities of all characters and the unseen one sum to one.
    for context in ((ord("t"), ord("h"), ord("e")), (quality.BEGIN,) * 3, (1, 2, 3)):
        assert sum(probability((*context, c)) for c in alphabet) + probability((*context, 0)) == pytest.approx(1)


def test_quality_keeps_prose_and_rejects_junk(spark):
    prose, junk = _prose(4, 600), ["#$%& @@ !! ;;" * 5, "QXZJ WVK!! QXZJ" * 9]
    rows = quality.rated_notes(_notes(spark, [*prose, *junk, None, ""]), spark.range(500).withColumnRenamed("id", "event_id")).collect()
    kept = {r["event_id"]: r["kept"] for r in rows}
    assert sum(kept[i] for i in range(600)) >= 597
    assert not any(kept[i] for i in range(600, 604))


def test_quality_bounds_hold_against_odd_rows_small_languages_and_repetition(spark):
    rng = random.Random(8)
    noise = lambda: "".join(rng.choice("#$%&@!;?0123456789QXZJWVK") for _ in range(150))
    held = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % 4 == 0
    names = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    odd = next(i for i in range(800, 900) if held(i))
    rows = [(i, t, "xa") for i, t in enumerate(_prose(9, 800))] + [(odd, noise(), "xa")] + [(1000 + i, t, "xb") for i, t in enumerate(_prose(10, 80, names))]
    trusted = [i for i, *_ in rows]
    assert 10 <= sum(held(i) for i in trusted[801:]) < 100 <= sum(held(i) for i in trusted[:801])
    rows += [(2000 + i, noise(), "xa") for i in range(10)] + [(2100 + i, noise(), "xb") for i in range(10)]
    rows += [(3000 + i, f"{w} " * 200, "xa") for i, w in enumerate(WORDS)]
    rows += [(4000 + i, t, "xa") for i, t in enumerate(_prose(11, 100))] + [(5000 + i, t, "xb") for i, t in enumerate(_prose(12, 100, names)) if len(t) > 60]
    table = spark.createDataFrame(rows, "event_id long, notes string, lang string")
    kept = {r["event_id"]: r["kept"] for r in quality.rated_notes(table, spark.createDataFrame([(i,) for i in trusted], "event_id long")).collect()}
    assert not any(v for i, v in kept.items() if 2000 <= i < 4000)
    assert sum(v for i, v in kept.items() if i < 800) >= 784 and sum(v for i, v in kept.items() if 4000 <= i < 5000) >= 97
    late = [v for i, v in kept.items() if i >= 5000]
    assert sum(late) >= 0.9 * len(late)


def test_variety_is_that_of_the_most_monotonous_window():
    rng = random.Random(13)
    text = "".join(chr(rng.randint(200, 9000)) for _ in range(2000))
    of = lambda t: quality.variety(quality.packed_grams(t))
    assert of("x") == of(text) == 1.0
    assert of("ab " * 300) < 0.02
    assert of(text + "ab " * 200) < 0.02 and of("ab " * 400 + text) < 0.02


def test_languages_are_learned_and_held_out(spark):
    rng = random.Random(6)
    kinds = {"xa": "der die das und ist nicht auch".split(), "xb": "the of and that with from this".split(), "xc": "les des une dans pour avec vous".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randint(4, 40))), k, "x", 9.0) for i in range(600) for k in [rng.choice(list(kinds))]]
    table = spark.createDataFrame([*rows, (900, None, "xa", "x", 1.0), (901, "12 34 !!", "xb", "x", 1.0), (None, "the of", None, None, None)], "event_id long, notes string, lang string, lang_pred string, score double")
    model = langid.train(table.filter(langid.fold(table.event_id) != 2))
    found = langid.predict_languages(table, model)
    assert found.columns == ["event_id", "notes", "lang", "lang_pred", "score"]
    out = {r["event_id"]: r for r in found.collect()}
    assert sum(out[i]["lang_pred"] == k for i, _, k, *_ in rows) >= 595
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == "und" and out[None]["lang_pred"] == "xb"
    assert 0 < np.count_nonzero(model.weights) < model.weights.size / 10


def test_calibration_finds_the_temperature():
    rng = np.random.default_rng(7)
    logits = rng.normal(size=(4000, 4))
    labels = np.array([rng.choice(4, p=p) for p in langid.softmax(logits / 2.5)])
    assert langid.calibrated(logits, labels) == pytest.approx(2.5, rel=0.25)


def test_words_in_use_outlive_a_full_memory(monkeypatch):
    """A full memory becomes the former one: a word that comes again and again is worked out once."""
    vocabulary = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "REMEMBERED_FRAGMENTS", 10)
    asked = []
    monkeypatch.setattr(vocabulary, "fragments", lambda word, plain=vocabulary.fragments: asked.append(word) or plain(word))
    fresh = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(200):
        for word in ("often", "word" + "abcdefghij"[i % 10] + "klmnopqrst"[i // 10 % 10] * (1 + i // 100)):
            assert vocabulary.word_ids(word) == fresh.word_ids(word)
    assert asked.count("often") == 1
    assert len(vocabulary.by_word) <= 10 and len(vocabulary.former_words) <= 10
