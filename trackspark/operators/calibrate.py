"""Motion thresholds from the first ticks of a clip or session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.config import Thresholds
from trackspark.functions import geom
from trackspark.functions.geom import Point


def scene_statistics(persons: DataFrame, clip: Sequence[str], track: str, ordinal: Column, depth: int) -> DataFrame:
    """Median person height `med_h` and median step `med_step` over the first `depth` tick ordinals of each clip.

    Persons are followed by `track`; a clip without tall enough persons has a NULL height, one where nobody is
    seen twice a NULL step. The filter on the ordinal comes first, so windows and medians see a few ticks per clip.
    """
    early = persons.where(F.col("is_person") & (ordinal < depth))
    w = Window.partitionBy(*clip, track).orderBy("frame", "det_id")
    c, height = geom.centroid(geom.box()), F.col("y2") - F.col("y1")
    stepped = early.select(*clip, track, "frame", "det_id", height.alias("h"), c.x.alias("cx"), c.y.alias("cy")).withColumn(
        "step", geom.distance(Point(F.col("cx"), F.col("cy")), Point(F.lag("cx").over(w), F.lag("cy").over(w))))
    return stepped.groupBy(*clip).agg(F.median(F.when(F.col("h") > 8, F.col("h"))).alias("med_h"), F.median("step").alias("med_step"))


def _median(values: list) -> float | None:
    """As `F.median`: the mean of the middle two of an even number, NULL of none."""
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    low, high = values[(len(values) - 1) // 2], values[len(values) // 2]
    return low if len(values) % 2 else 0.5 * low + 0.5 * high


class Early:
    """`scene_statistics` of one session while it is played, by depth: known from the tick on that completes a depth."""

    def __init__(self, depths: Sequence[int]) -> None:
        self.depths, self.seen, self.found = depths, [], {}

    def tick(self, at: int | None, heights: list, steps: list) -> dict[int, tuple]:
        """A tick's persons; `at` is its ordinal, None before the first tick of the session."""
        if len(self.found) < len(self.depths):
            self.seen.append((-1 if at is None else at, heights, steps))
            for depth in self.depths:
                if at is not None and at >= depth - 1 and depth not in self.found:
                    early = [(h, s) for ordinal, h, s in self.seen if ordinal < depth]
                    told = _median([x for h, _ in early for x in h if x is not None and x > 8]), _median([x for _, s in early for x in s])
                    # A new one: ticks before keep what was known to them.
                    self.found = {**self.found, depth: told}
        return self.found


def carry_threshold(med_h: Column, med_step: Column, default: Column) -> Column:
    """Pixels a step must have to count as motion: scaled by height, and at most a third of the usual walking step."""
    scale = F.greatest(F.lit(0.5), F.least(F.lit(3.0), med_h / 160.0))
    base = F.when(med_h.isNotNull(), F.greatest(F.lit(2.0), F.least(F.lit(48.0), 8.0 * scale))).otherwise(default)
    return F.when(F.coalesce(med_step > 0, F.lit(False)), F.greatest(F.lit(2.0), F.least(base, med_step / 3.0))).otherwise(base)


def departure_threshold(med_h: Column, med_step: Column, fps: Column) -> Column:
    """Departure ratio from a second of walking, clamped; NULL, which leaves the configured ratio alone, where nobody walks."""
    walked = F.greatest(F.lit(0.30), F.least(F.lit(0.80), med_step / med_h * F.greatest(F.lit(1.0), fps)))
    return F.when(F.coalesce(med_step > 0, F.lit(False)) & med_h.isNotNull(), walked)


def motion_thresholds(det: DataFrame, track: str, cfg: Thresholds) -> DataFrame:
    """Both thresholds of each video whose persons are tall enough, under one config; frames are tick ordinals."""
    found = scene_statistics(det, ["video_id"], track, F.col("frame"), cfg.calibration_frames).where("med_h is not null")
    h, s = F.col("med_h"), F.col("med_step")
    return found.withColumn("carry_motion_norm_px", carry_threshold(h, s, F.lit(cfg.carry_motion_norm_px))).withColumn(
        "departure_motion_ratio", F.coalesce(departure_threshold(h, s, F.lit(cfg.analysis_fps)), F.lit(cfg.departure_motion_ratio)))
