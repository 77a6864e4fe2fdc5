"""Hard negatives against a plain version, over several shards, ties, repeated and broken rows."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import SF, matches_oracle

from trackspark.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, score double, shard string, anchor_id long"


def plain(rows, ask, positives=5, k=10, low=30, high=90):
    """The contract, pair by pair, with Python's integers."""
    kept = sorted({(r[0], r[2], tuple(math.floor(256 * x) for x in r[1])) for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])})
    out = []
    for anchor in {k[0]: k for k in reversed(kept) if ask(k[0])}.values():
        scored = sorted((-sum(a * b for a, b in zip(anchor[2], o[2])), o[0], o[1]) for o in kept if o[0] != anchor[0] and len(o[2]) == len(anchor[2]))
        for s, positive, _ in [x for x in scored if x[2] == anchor[1]][:positives]:
            inside = [(n, i) for n, i, label in scored if label != anchor[1] and low * -s <= 100 * -n <= high * -s][:k]
            out += [(anchor[0], positive, rank, i, -s, -n) for rank, (n, i) in enumerate(inside, 1)]
    return sorted(out)


def found(spark, rows, ask, **options):
    df = spark.createDataFrame([(*r[:3], 1.5, "x", 9) for r in rows], SCHEMA)
    asked = df.filter(df["vec_id"].isin(sorted({r[0] for r in rows if r[0] is not None and ask(r[0])})))
    return sorted(map(tuple, negatives.hard_negatives(df, asked, **options).collect()))


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_many_shards_equal_the_plain_version(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(negatives, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(negatives, "CELLS", 500)
    rng = np.random.default_rng(3)
    # Few distinct values give many equal scores; a third of all rows are copies of one vector.
    rows = [(i, [0.5, 0.25, 1.0] if i % 3 == 0 else rng.integers(-2, 5, 3).astype(float).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    ask = lambda i: i % 20 == 0
    want = plain(rows, ask)
    assert len(want) > 200 and found(spark, rows, ask) == want
    assert found(spark, rows, ask, positives=2, negatives=3, low=50, high=100) == plain(rows, ask, 2, 3, 50, 100)


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    good = [1.0, 2.0]
    rows = [(None, good, 1), (0, good, 1), (1, good, 1), (1, good, 1), (2, good, None), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [], 1), (8, [1.0], 1),
            (9, [0.5, 0.5], 2), (9, [0.5, 0.75], 2), (9, [0.5, 0.5], 1), (10, [0.4, 0.4], 3), (10, [0.4, 0.4], 3), (11, [-1.0, -1.0], 1), (12, [0.0, 0.0], 2), (13, [1e-300, 0.5], -4), (20, [], 2), (20, [0.1, 0.2], 2)]
    for ask in (lambda i: i == 0, lambda i: True, lambda i: False):
        assert found(spark, rows, ask) == plain(rows, ask)
    assert found(spark, [], lambda i: True) == []


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[2**31 + 1, 3]]), np.array([[2**24 + 1, 5], [-(2**40), 1], [2**53, 2**53]])
    assert negatives.inner_products(a[:, :1] * 0 + 2**26, np.array([[2**26 + 1]])).tolist() == [[2**52 + 2**26]]
    assert negatives.inner_products(a, b[:1]).tolist() == [[(2**31 + 1) * (2**24 + 1) + 15]]
    assert negatives.inner_products(np.array([[2**53, 2**53]]), b).tolist() == [[9 * 10**16] * 1 + [-(9 * 10**16)] + [9 * 10**16]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-3, 3), st.booleans()), min_size=6, max_size=6), min_size=1, max_size=5), st.integers(1, 8))
def test_best_of_each_row(cells, k):
    scores, ok = np.array([[c[0] for c in r] for r in cells], np.int64), np.array([[c[1] for c in r] for r in cells])
    want = [(i, j) for i, r in enumerate(cells) for j in sorted((j for j in range(6) if r[j][1]), key=lambda j: (-r[j][0], j))[:k]]
    assert list(zip(*(x.tolist() for x in negatives.best(scores, ok, k)))) == want


def test_query_on_larger_tables(spark):
    matches_oracle(spark, queries, "op11_slot_negatives", SF.replace("0.001", "0.01"))
