"""Exact order statistics without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(n: Column) -> Column:
    """Index of xs[n // 2]."""
    return F.floor(n / 2)


def index_quantile(q: float) -> Callable[[Column], Column]:
    """Index of xs[int(n * q)]."""
    return lambda n: F.least(F.floor(n * q), n - 1)


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Callable[[Column], Column]],
                     width: float) -> DataFrame:
    """Per key, the values at 0-based ranks given as functions of the group size n.

    Equal values are counted first (map-side combined), so one repeated value costs one row. A
    histogram of buckets of `width` finds the bucket of each rank; only those buckets are ordered.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_b", F.floor(F.col("_v") / width))
    hist = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    by_bucket = Window.partitionBy(*keys).orderBy("_b")
    sized = hist.withColumn("_end", F.sum("_bn").over(by_bucket)).withColumn("_total", F.sum("_bn").over(Window.partitionBy(*keys)))
    asked = F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("_total")).cast("bigint").alias("rank")) for name, rank in ranks.items()))
    here = F.filter(asked, lambda a: (a["rank"] >= F.col("_end") - F.col("_bn")) & (a["rank"] < F.col("_end")))
    wanted = sized.select(*keys, "_b", "_total", (F.col("_end") - F.col("_bn")).alias("_start"), here.alias("_asked")).where(F.size("_asked") > 0)
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    placed = counted.join(wanted, [*keys, "_b"]).withColumn("_upto", F.col("_start") + F.sum("_n").over(inside))
    hit = placed.withColumn("_a", F.explode("_asked")).where(
        (F.col("_a.rank") < F.col("_upto")) & (F.col("_a.rank") >= F.col("_upto") - F.col("_n")))
    return hit.groupBy(*keys).agg(F.max("_total").alias("n"), *(
        F.max(F.when(F.col("_a.name") == name, F.col("_v"))).alias(name) for name in ranks))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Mapping[str, float], width: float) -> DataFrame:
    """Exact linearly interpolated quantiles, e.g. {"p50": 0.5, "p95": 0.95}."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, q in qs.items():
        ranks[f"_lo_{name}"] = lambda n, q=q: F.floor((n - 1) * q)
        ranks[f"_hi_{name}"] = lambda n, q=q: F.ceil((n - 1) * q)
    stats = order_statistics(df, keys, value, ranks, width)
    out = [F.col(k) for k in keys] + [F.col("n")]
    for name, q in qs.items():
        at = (F.col("n") - 1) * q
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return stats.select(*out)
