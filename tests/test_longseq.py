"""Chunked sequences against plain single-partition windows, with chunks small enough to matter."""

import random

import pytest
from helpers import SF
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark import plans
from trackspark.operators import folds, longseq, quantiles
from trackspark.plans import registry

rng = random.Random(7)
# One key holds most rows, as a hot camera would.
ROWS = [(1 if i % 10 else i % 7 + 2, i, float(rng.randrange(1000)), rng.random() < 0.4) for i in range(700)]


def frame(spark):
    return spark.createDataFrame(ROWS, "k bigint, t bigint, v double, f boolean")


def ordinal(df, bucket=50):
    return longseq.with_ordinal(df, ["k"], ["t"], F.floor(F.col("t") / bucket), "n")


def same(a, b, cols):
    assert sorted(map(tuple, a.select(*cols).collect()), key=str) == sorted(map(tuple, b.select(*cols).collect()), key=str)


def test_ordinal(spark):
    w = Window.partitionBy("k").orderBy("t")
    same(ordinal(frame(spark)), frame(spark).withColumn("n", F.row_number().over(w).cast("bigint")), ["k", "t", "n"])


def test_bounded_and_running(spark):
    w = Window.partitionBy("k").orderBy("t")
    base = ordinal(frame(spark))
    got = longseq.bounded(base, ["k"], "n", lambda c: {"s": F.sum("v").over(c.rowsBetween(-4, 0)), "nxt": F.lead("v", 2).over(c)}, before=4, after=2, size=16)
    want = base.withColumn("s", F.sum("v").over(w.rowsBetween(-4, 0))).withColumn("nxt", F.lead("v", 2).over(w))
    same(got, want, ["k", "t", "s", "nxt"])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    got = longseq.running(base, ["k"], "n", {"m": ("max", F.col("v")), "c": ("sum", F.col("f").cast("int")), "l": ("last", F.when(F.col("f"), F.col("v")))}, size=16)
    want = base.withColumn("m", F.max("v").over(upto)).withColumn("c", F.sum(F.col("f").cast("int")).over(upto)).withColumn("l", F.last(F.when(F.col("f"), F.col("v")), True).over(upto))
    same(got, want, ["k", "t", "m", "c", "l"])


def test_greedy_spacing(spark):
    rows = [(1, float(t), i) for i, t in enumerate(sorted(rng.random() * 400 for _ in range(600)))] + [(2, float(i * 9), i) for i in range(40)]
    df = spark.createDataFrame(rows, "k bigint, t double, i bigint")
    got = {(r.k, r.i) for r in folds.greedy_spacing(df, ["k"], "t", "i", 2.5, 10.0).where("kept").collect()}
    want, last = set(), {}
    for k, t, i in sorted(rows):
        if t >= last.get(k, -1e18) + 2.5:
            want.add((k, i))
            last[k] = t
    assert got == want


def test_order_statistics(spark):
    df = frame(spark)
    got = {r.k: r for r in quantiles.order_statistics(df, ["k"], "v", {"up": quantiles.upper_median, "q9": quantiles.index_quantile(0.9)}, width=40.0).collect()}
    mid = {r.k: r for r in quantiles.quantiles(df, ["k"], "v", {"p50": 0.5}, width=40.0).collect()}
    for k in {r[0] for r in ROWS}:
        xs = sorted(v for key, _, v, _ in ROWS if key == k)
        n = len(xs)
        assert (got[k].n, got[k].up, got[k].q9) == (n, xs[n // 2], xs[int(n * 0.9)])
        assert mid[k].p50 == (xs[(n - 1) // 2] + xs[n // 2]) / 2


@pytest.mark.parametrize("name", ["t14_sessions", "j11_closest_record", "w04_longest_runs", "w05_ever_and_running_max", "w08_release_threshold"])
def test_chained_stages_read_few_tables(spark, name):
    plans.load()
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 3


def test_next_is_last_of_the_reversed_sequence(spark):
    rows = [(k, n, n * 10 if (n * 7 + k) % 5 == 0 else None) for k in (1, 2) for n in range(1, 40)]
    df = spark.createDataFrame(rows, "k int, n bigint, v bigint")
    got = {(r["k"], r["n"]): r["after"] for r in longseq.running(df, ["k"], "n", {"after": ("next", F.col("v"))}, size=4).collect()}
    for k, n, _ in rows:
        assert got[k, n] == next((v for kk, nn, v in rows if kk == k and nn >= n and v is not None), None)
