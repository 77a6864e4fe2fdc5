"""The pipeline's stages on the given documents and on odd ones, each against its input."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
from llm_helpers import SF, empty_tables, odd_documents
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from trackspark.llm.common import written  # noqa: E402


def _stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        out.append(docs)
    return out


def test_each_stage_does_its_part(spark):
    given, known, good, single, mixed, coded = _stages(spark, SF)
    assert all(d.columns == corpus_pipeline.COLUMNS for d in (known, good, single, mixed))
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    ids = [{r["doc_id"] for r in d.collect()} for d in (known, good, single, mixed)]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] and len(ids[0]) > 0.95 * len(texts)
    # Clean labelled documents stay, most junk goes.
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    clean, junk = ({r["doc_id"] for r in labels if r["quality"] == q and not r["toxic"]} & ids[0] for q in (1, 0))
    assert len(clean - ids[1]) <= 0.02 * len(clean) and len(junk & ids[1]) <= 0.5 * len(junk)

    def shingles(i):
        words = texts[i].encode().lower().split()
        return {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(i) for i in ids[1]}
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)
    kept = sorted(ids[2])
    assert not any(near(sets[a], sets[b]) for n, a in enumerate(kept) for b in kept[:n])
    assert all(any(near(sets[i], sets[j]) for j in ids[1] if j != i) for i in ids[1] - ids[2])
    # Every source takes its target to within its largest document, and nothing more than twice.
    size = {i: len(texts[i].split()) for i in kept}
    source = {r["doc_id"]: r["source"] for r in single.collect()}
    taken = Counter(r["doc_id"] for r in mixed.collect())
    assert max(taken.values()) <= 2
    sums, most = defaultdict(int), defaultdict(int)
    for i in kept:
        sums[source[i]] += taken[i] * size[i]
        most[source[i]] = max(most[source[i]], size[i])
    total, whole = sum(sums.values()), sum(size.values())
    assert abs(total - 1.5 * whole) <= sum(most.values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = coded.collect()
    assert Counter(r["doc_id"] for r in rows) == taken and all(r["decodes"] for r in rows)
    assert all(r["ids"] == tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in rows)


def test_odd_and_empty_documents(spark, tmp_path):
    empty_tables(spark, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd_documents(spark, tmp_path)
    stages = _stages(spark, str(tmp_path))
    assert all(d.columns == corpus_pipeline.COLUMNS for d in stages[1:-1]) and stages[-1].count() > 0
    kept = [r["doc_id"] for r in stages[3].collect()]
    assert len(kept) == len(set(kept))
