"""Training samples from several pools, mixed to time-varying source weights.

The records are those of the training-set builder: one row per labelled sample with its `image`, the
`source` pool it came from, and its `size` (annotation or word count). A schedule gives a pool's weight
over training time; the integral of its schedule is the pool's share of the whole budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackspark.operators.longseq import with_ordinal

from .common import hash60, pieces, written

#: Weights at equally spaced times, linear in between, for the 1st, 2nd, 3rd, 4th (as the 1st) ... source by
#: code point. Their integrals are 5, 2 and 1: the first kind fades out, the third fades in.
SCHEDULES = ((7.0, 5.0, 3.0), (2.0, 2.0, 2.0), (0.5, 1.0, 1.5))
#: Bits of the sample hash that name a bucket: a source's order is cut into 4,096 buckets.
BUCKET_BITS = 12
#: Sources of a range, which one task orders.
RANGE_SOURCES = 10_000


def integral(knots: Sequence[float]) -> float:
    return sum(a + b for a, b in zip(knots, knots[1:])) / 2 / (len(knots) - 1)


def _by_kind(kind: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), kind + 1)


def source_targets(sizes: DataFrame, schedules=SCHEDULES, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: source, kind, weight, source_size, target.

    `budget` times the size of all samples is shared by weight; no target exceeds `most` times its source's
    size, and what is cut off is shared again by weight. With sources ordered by cap per weight, the final
    level is the largest level of "all before me are capped, the rest share what is left". Sources are ordered in
    ranges of about RANGE_SOURCES; windows over all of them have one row per range.
    """
    weights = [integral(k) for k in schedules]
    by_name = F.col("source").asc_nulls_last()
    rows = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    number, total = rows.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    ranges = pieces(number, RANGE_SOURCES)
    # Written, since a range partitioning draws its borders anew each time it runs.
    cut = lambda df, name, *order: written(df.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), name)
    rows = with_ordinal(cut(rows, "sources-by-name", by_name), [], [by_name], F.col("range")).drop("range")
    rows = rows.withColumn("kind", ((F.col("ordinal") - 1) % len(weights)).cast("int")).withColumn("weight", _by_kind(F.col("kind"), weights)).drop("ordinal")
    rows = rows.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = cut(rows, "sources-by-ratio", F.col("ratio"), by_name)
    sums = rows.groupBy("range").agg(F.sum("cap").alias("caps"), F.sum("weight").alias("weights"))
    over = Window.orderBy("range")
    sums = sums.select("range", F.sum("caps").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("caps"), F.sum("weights").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("weights"))
    inside = Window.partitionBy("range").orderBy("ratio", by_name)
    none = F.lit(0.0)
    capped = F.coalesce("caps", none) + F.coalesce(F.sum("cap").over(inside.rowsBetween(Window.unboundedPreceding, -1)), none)
    left = F.coalesce("weights", none) + F.sum("weight").over(inside.rowsBetween(0, Window.unboundedFollowing))
    steps = rows.join(sums, "range").select(((F.lit(budget) * F.lit(total) - capped) / left).alias("step"))
    level = F.lit(steps.agg(F.max("step")).first()[0]).cast("double")
    return rows.select("source", "kind", "weight", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _offsets(sizes: DataFrame) -> DataFrame:
    """`offset`: what precedes a sample in its source, samples in hash order.

    Sums of (source, bucket) are prefixed first, so a source with a third of all rows is thousands of
    independent groups.
    """
    keys = ["source", "bucket"]
    sums = sizes.groupBy(*keys).agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("bucket_offset"))
    joined = sizes.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).drop("_s", "_b")
    inside = F.sum("size").over(Window.partitionBy(*keys).orderBy("h", "image", "size").rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn("offset", F.col("bucket_offset") + F.coalesce(inside, F.lit(0))).drop("bucket_offset", "bucket")


def _position(kind: Column, share: Column, schedules) -> Column:
    """The time at which a source with this schedule has used the given share of its demand."""

    def of(knots) -> Column:
        steps = len(knots) - 1
        whole, at, out = integral(knots), 0.0, None
        for i, (a, b) in enumerate(zip(knots, knots[1:])):
            need = share * F.lit(whole) - F.lit(at)
            slope = (b - a) * steps
            u = F.lit(2.0) * need / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * need, F.lit(0.0))))
            here, end = F.lit(i / steps) + u, at + (a + b) / 2 / steps
            out = F.when(share * F.lit(whole) <= F.lit(end), here) if out is None else out.when(share * F.lit(whole) <= F.lit(end), here)
            at = end
        return out.otherwise(F.lit(1.0))

    out = F.when(kind == 0, of(schedules[0]))
    for i, knots in enumerate(schedules[1:], 1):
        out = out.when(kind == i, of(knots))
    return out


def training_plan(samples: DataFrame, schedules=SCHEDULES, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Which samples a training mix takes, how often, and when.

    Input: image (any type), source (text), size (number; null or negative: 0); other columns are ignored.
    Result, one row per input row: image, source, size, source_size, target, offset, taken_1, taken_2, taken
    (size units of the first and second pass and their sum), position_1, position_2 (training time 0 to 1, null
    for a pass that takes nothing).

    A source's samples follow each other in hash order, once and, where the target is beyond the source's
    size, again. Each takes what fits below the target, so a source's sum is its target rounded down, and the
    one sample at the border is taken in part. The demand reached at a sample's middle, put through the inverse
    of its source's integrated schedule, is its position. Reruns agree: order depends on the id alone. Equal
    rows take neighbouring places; a null source is a source of its own and comes last; an empty table gives no
    rows; sources of size 0 have target 0.
    """
    sizes = samples.select("image", F.col("source").cast("string").alias("source"), F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    sizes = sizes.withColumn("h", hash60(F.col("image"))).withColumn("bucket", F.shiftright("h", 60 - BUCKET_BITS))
    sizes = written(sizes, "mix-sizes")
    targets = source_targets(sizes, schedules, budget, most).withColumnRenamed("source", "_s")
    rows = _offsets(sizes).join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "h")
    room = F.floor("target") - F.col("offset")
    fit = lambda room: F.greatest(F.least(room, F.col("size")), F.lit(0))
    rows = rows.withColumn("taken_1", fit(room)).withColumn("taken_2", fit(room - F.col("source_size")))
    at = lambda start, taken: F.when(taken > 0, _position(F.col("kind"), (start + taken / F.lit(2.0)) / F.col("target"), schedules))
    return rows.select(
        "image", "source", "size", "source_size", "target", "offset", "taken_1", "taken_2", (F.col("taken_1") + F.col("taken_2")).alias("taken"),
        at(F.col("offset"), F.col("taken_1")).alias("position_1"), at(F.col("source_size") + F.col("offset"), F.col("taken_2")).alias("position_2"))


def in_training_order(df: DataFrame, position: str, *ties: str) -> DataFrame:
    """Range-sorted by position: the files in order are the training order. A null position comes last."""
    keys = [F.col(position).asc_nulls_last(), *[F.col(t) for t in ties]]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
