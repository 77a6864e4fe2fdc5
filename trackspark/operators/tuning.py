"""Learning across videos and which learned values a run may use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.config import LEARNING_STEPS


def step_table(spark) -> DataFrame:
    """LEARNING_STEPS as rows: (reason, order, cap, position, knob, value)."""
    rows = [(reason, i, len(steps), pos + 1, knob, float(value)) for i, (reason, steps) in enumerate(LEARNING_STEPS.items())
            for pos, step in enumerate(steps) for knob, value in step.items()]
    return spark.createDataFrame(rows, "reason string, ord int, cap int, pos int, knob string, value double")


def learned_overrides(seen: DataFrame) -> DataFrame:
    """Rows (store, reason, video) -> learned knob values.

    A reason advances once per video and stops at its last step; steps merge in order, so the last
    write of a knob wins. The step table is a fixed handful of rows, hence the broadcast.
    """
    counts = seen.groupBy("store", "reason").agg(F.countDistinct("video").alias("videos"))
    taken = counts.join(F.broadcast(step_table(seen.sparkSession)), "reason").where(F.col("pos") <= F.least(F.col("cap"), F.col("videos")))
    return taken.groupBy("store", "knob").agg(F.max_by("value", F.struct("ord", "pos")).alias("value"))


def override_mode(deterministic: Column, has_pin: Column, asked: Column) -> Column:
    """Pin, none or live. A deterministic run never reads the live store."""
    off = F.coalesce(F.lower(F.trim(asked)).isin("none", "off", "yaml"), F.lit(False))
    pinned = F.when(has_pin, "pin").otherwise("none")
    return (F.when(off, "none").when(deterministic, pinned)
            .when(F.coalesce(F.lower(F.trim(asked)).isin("pin", "live"), F.lit(False)), F.lower(F.trim(asked))).otherwise("live"))
