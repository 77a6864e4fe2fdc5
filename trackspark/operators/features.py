"""Per-track features over ticks: motion, votes, runs, running extremes, carried values.

Inputs carry an ordinal per key (see `longseq.with_ordinal`). Frames with a finite reach use
`longseq.bounded`, unbounded ones `longseq.running`, so no window holds a whole track.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.config import Thresholds
from trackspark.functions import geom
from trackspark.functions.geom import Point
from trackspark.operators import folds, longseq
from trackspark.session import written


def min_votes(n: int) -> int:
    return max(2, math.ceil(n / 2.0))


def back(n: int, w):
    """The last n rows including this one."""
    return w.rowsBetween(-(n - 1), 0)


def stationary(now: Point, w, size: Column, cfg: Thresholds, ts: Column | None = None) -> Column:
    """Displacement over the window is small for the object's own size (and in pixels, if capped)."""
    reach = max(2, cfg.stationary_window_frames) - 1

    def earlier(value: Column) -> Column:
        return F.coalesce(*(F.lag(value, k).over(w) for k in range(reach, 0, -1)))

    moved = geom.distance(now, Point(earlier(now.x), earlier(now.y)))
    slack = F.lit(1.0)
    if ts is not None:
        expected = reach / max(1e-6, cfg.analysis_fps)
        slack = F.greatest(F.lit(1.0), F.greatest(F.lit(1e-6), ts - earlier(ts)) / expected)
    still = moved / F.greatest(F.lit(1.0), size) < cfg.stationary_distance_ratio * slack
    if cfg.stationary_max_pixel_step is not None:
        still = still & (moved <= cfg.stationary_max_pixel_step)
    return F.coalesce(still, F.lit(False))


def step(now: Point, w) -> Column:
    return geom.distance(now, Point(F.lag(now.x).over(w), F.lag(now.y).over(w)))


def mean_step(step_column: str, w, k: int) -> Column:
    """Mean of the steps among the last k samples, NULL with fewer than two samples."""
    return F.avg(step_column).over(w.rowsBetween(-(max(2, k) - 2), 0))


def voted(flag: Column, w, n: int) -> Column:
    """Enough of the last n flags are true."""
    return F.sum(flag.cast("int")).over(back(n, w)) >= min_votes(n)


def moves_together(person_step: Column, object_step: Column, still: Column, wrist_near: Column, cfg: Thresholds) -> Column:
    """The object shares the person's motion, or the person stands and holds it."""
    moving = F.coalesce(person_step > cfg.carry_motion_norm_px, F.lit(False))
    follows = ~still & F.coalesce(object_step >= cfg.carry_motion_sync_ratio * person_step, F.lit(False))
    return F.when(moving, follows).otherwise(~(still & ~wrist_near))


def grew(value: str, w, n: int) -> dict[str, Column]:
    """Net growth over the last n samples (three at least), and growth on the last step."""
    frame = back(max(2, n), w)
    return {
        "grew_over_window": (F.count(F.col(value)).over(frame) >= 3) & (F.col(value) > F.first(value).over(frame)),
        "increasing": F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(False))}


def release_threshold(carry_max: Column, cfg: Thresholds) -> Column:
    """Separation a release needs, from the furthest the object was carried."""
    return F.least(F.lit(cfg.release_distance_ratio), F.greatest(
        F.lit(cfg.release_distance_floor), cfg.release_distance_adaptive_ratio * carry_max))


def longest_runs(df: DataFrame, keys: Sequence[str], ordinal: str, flag: Column, tolerance: int = 0) -> DataFrame:
    """Longest run of true flags, and longest count of trues with up to `tolerance` misses between them."""
    base = written(df.withColumn("_flag", F.coalesce(flag, F.lit(False))), "flags")
    marked = longseq.running(base, keys, ordinal, {
        "_broken": ("max", F.when(~F.col("_flag"), F.col(ordinal))), "_seen": ("max", F.when(F.col("_flag"), F.col(ordinal)))}, settled=True)
    marked = marked.withColumn("run", F.col(ordinal) - F.coalesce(F.col("_broken"), F.lit(0))).drop("_broken")
    with_prev = longseq.bounded(marked, keys, ordinal, lambda w: {"_prev": F.lag("_seen").over(w)}, before=1)
    begins = F.col("_flag") & (F.col("_prev").isNull() | (F.col(ordinal) - F.col("_prev") > tolerance + 1))
    grouped = folds.islands(with_prev, keys, ordinal, begins)
    per = grouped.where("_flag").groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n"), F.max("run").alias("run"))
    best = per.groupBy(*keys).agg(F.max("run").alias("longest_run"), F.max("n").alias("longest_tolerant"))
    return base.select(*keys).distinct().join(best, list(keys), "left").na.fill(0, ["longest_run", "longest_tolerant"])


def ever_and_since(df: DataFrame, keys: Sequence[str], ordinal: str, flag: Column, value: Column) -> DataFrame:
    """Has the flag ever been true, the running maximum, and the maximum since the flag first was."""
    base = written(df.withColumn("_value", value).withColumn("_at", F.when(flag, F.col(ordinal))), "flags")
    first = base.groupBy(*keys).agg(F.min("_at").alias("_from"))
    late = base.join(first, list(keys)).withColumn("ever", F.coalesce(F.col(ordinal) >= F.col("_from"), F.lit(False)))
    out = longseq.running(late, keys, ordinal, {"max_ever": ("max", F.col("_value")), "max_since": ("max", F.when(F.col("ever"), F.col("_value")))})
    return out.drop("_from", "_value", "_at")


def changes(df: DataFrame, keys: Sequence[str], ordinal: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before; the first row counts as a change."""
    out = longseq.bounded(df, keys, ordinal, lambda w: {"previous": F.lag(value).over(w)}, before=1)
    return out.where(F.col("previous").isNull() | (F.col("previous") != F.col(value)))


def carried_value(df: DataFrame, keys: Sequence[str], ordinal: str, value: Column, limit: int) -> DataFrame:
    """The last known value, kept for up to `limit` ticks at confidence 0.5."""
    known = longseq.running(df, keys, ordinal, {
        "_value": ("last", value), "_at": ("max", F.when(value.isNotNull(), F.col(ordinal)))})
    gap = F.col(ordinal) - F.col("_at")
    usable = gap <= limit
    return known.withColumn("coasted", F.when(usable, F.col("_value"))).withColumn(
        "fallback", F.coalesce(usable & (gap > 0), F.lit(False))).withColumn(
        "coast_conf", F.when(gap == 0, 1.0).when(usable, 0.5).otherwise(0.0)).drop("_value", "_at")


def median_of(values: Column) -> Column:
    """True median of an array; callers keep the array bounded by a ROWS frame."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def baseline_change(df: DataFrame, keys: Sequence[str], ordinal: str, value: str, n: int, threshold: float) -> DataFrame:
    """Difference from the frozen median of the first n samples and from the rolling median of n."""
    frozen = df.where(F.col(ordinal) <= n).groupBy(*keys).agg(F.median(value).alias("frozen"))
    rolling = longseq.bounded(df, keys, ordinal, lambda w: {
        "rolling": median_of(F.collect_list(value).over(back(n, w)))}, before=n - 1)
    out = rolling.join(frozen, list(keys))
    return out.withColumn("off_frozen", F.abs(F.col(value) - F.col("frozen")) > threshold).withColumn(
        "off_rolling", F.abs(F.col(value) - F.col("rolling")) > threshold)


def skip_after_failure(stages: DataFrame, job: str = "job_id") -> DataFrame:
    """Pending or running stages after the first failed one are skipped.

    A job has a dozen stages, so the window over a job is small by definition.
    """
    failed = F.min(F.when(F.col("status") == "FAILED", F.col("stage_order"))).over(Window.partitionBy(job))
    late = (F.col("stage_order") > failed) & F.col("status").isin("PENDING", "RUNNING")
    return stages.withColumn("final_status", F.when(late, "SKIPPED").otherwise(F.col("status")))
