"""Ranked notes against SQL and a plain version: several shards, tiles and groups, ties, repeated and odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import ODD_TEXTS, SF, empty_tables, matches_oracle, odd_documents

from trackspark.llm import queries, ranked

SCHEMA = "{} long, notes string, score double, terms string, key int, row long"


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(verdicts, clips, k=10):
    notes = [(i, Counter(t), len(t)) for i, text in verdicts for t in [terms_of(text)] if t]
    n_all, total = len(notes), sum(n for _, _, n in notes)
    df = Counter(t for _, c, _ in notes for t in c)
    smallest = {}
    for clip, text in clips:
        if text is not None and (clip not in smallest or text.encode() < smallest[clip].encode()):
            smallest[clip] = text
    out = []
    for clip, text in smallest.items():
        asked, scored = Counter(terms_of(text)), []
        for i, counts, n in notes:
            m = 25 + 75 * n * n_all // total
            score = sum(times * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m)) for t, times in asked.items() if t in counts)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(clip, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, verdicts, clips, **options):
    v = spark.createDataFrame([(*r, 1.0, "t", 2, 3) for r in verdicts], SCHEMA.format("event_id"))
    c = spark.createDataFrame([(*r, 1.0, "t", 2, 3) for r in clips], SCHEMA.format("clip_id"))
    return sorted(map(tuple, ranked.ranked_notes(v, c, **options).collect()), key=str)


def invented(rng, n, words=60):
    p = 1 / np.arange(1, words + 1)
    return [" ".join(f"w{x}" for x in rng.choice(words, rng.integers(1, 40), p=p / p.sum())) for _ in range(n)]


@pytest.mark.parametrize("limits", [{}, {"SHARD_TERMS": 300, "GROUP_TERMS": 12, "CELLS": 400, "BLOCK": 3}, {"SHARD_TERMS": 2000, "CELLS": 3000, "BLOCK": 4}])
def test_limits_change_nothing(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranked, name, value)
    rng = np.random.default_rng(11)
    texts = invented(rng, 160)
    # A third of all notes are copies of one; some ids and rows repeat; some ids are missing.
    verdicts = [(i % 150 if i % 31 else None, texts[5] if i % 3 == 0 else t) for i, t in enumerate(texts)] + [(3, texts[3])] * 4
    clips = list(enumerate(invented(rng, 12))) + [(0, "w1 w1 w1 w2"), (100, texts[5]), (101, "nothing known here"), (102, None), (103, ""), (None, "w4 w5"), (104, " ".join(f"w{i}" for i in range(60)) * 2)]
    want = plain(verdicts, clips)
    assert len(want) > 100 and found(spark, verdicts, clips) == want
    assert found(spark, verdicts, clips, k=3) == plain(verdicts, clips, 3)


def test_blocks_are_skipped_and_results_stay_exact():
    rng = np.random.default_rng(2)
    topics = rng.integers(0, 20, 3000)
    table = np.zeros((3000, 400), np.int32)
    for i, topic in enumerate(topics):
        own = rng.choice(20, 12) + topic * 20
        table[i, own] = rng.integers(1, 10**6, 12)
    table[:, :3] = rng.integers(0, 10**6, (3000, 3))
    rows, columns = np.nonzero(table)
    index = ranked.GeometricIndex(rows.astype(np.int32), columns, table[rows, columns], 3000, 400)
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for q in range(60):
        asked = np.unique(np.concatenate([rng.choice(20, 6) + (q % 20) * 20, [0, 1]]))
        weights = rng.integers(1, 9000, len(asked))
        scores, found = index.search(asked, weights, 10, empty, 0)
        whole = table[:, asked].astype(np.int64) @ weights
        order = np.lexsort((np.arange(3000), -whole))[:10]
        assert scores.tolist() == whole[order].tolist() and found.tolist() == order.tolist()
    assert index.blocks_opened < 0.5 * index.blocks_seen
    # Weights beyond the doubles' whole numbers.
    scores, found = index.search(np.array([0, 25, 30]), np.array([2**36, 2**36 + 1, 2**35]), 5, empty, 0)
    whole = table[:, [0, 25, 30]].astype(np.int64) @ np.array([2**36, 2**36 + 1, 2**35])
    assert scores.tolist() == sorted(whole.tolist(), reverse=True)[:5]


def test_odd_and_empty_tables(spark, tmp_path):
    empty_tables(spark, tmp_path)
    odd_documents(spark, tmp_path)
    assert queries.QUERIES["op12_geometric_ranking"](spark, str(tmp_path)).collect() == []
    asked = [(i, t, "x") for i, t in enumerate(ODD_TEXTS)] + [(2, "two WORDS", "x"), (None, "the text", "x")]
    spark.createDataFrame(asked, "item_id long, text string, doc_id string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    matches_oracle(spark, queries, "op12_geometric_ranking", str(tmp_path))


def test_query_on_larger_tables(spark):
    matches_oracle(spark, queries, "op12_geometric_ranking", SF.replace("0.001", "0.01"))
