"""Live status: partial nested updates merged key by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of a status document; what lies deeper is one value.
DEPTH = 4


def entries(updates: DataFrame, keys: Sequence[str], at: str, doc: str, depth: int = DEPTH) -> DataFrame:
    """One row per key of every update: `keys`, `at`, path (its names from the top), value (JSON text), is_object.

    An object is a row of its own without a value, and its keys are rows too; a list is a value. Text that is no JSON object, or
    that names a key twice in one object, is no update.
    """
    kind = "array<struct<path: array<string>, value: variant, is_object: boolean>>"
    rows = updates.select(*keys, at, F.struct(F.array().cast("array<string>").alias("path"), F.try_parse_json(doc).alias("value"), F.lit(False).alias("is_object")).alias("_e"))
    for _ in range(depth + 1):
        # An open object becomes a row that says so, and its keys.
        opened = F.expr(f"CAST(array(named_struct('path', _e.path, 'value', CAST(NULL AS VARIANT), 'is_object', true)) AS {kind})")
        children = F.expr(f"CAST(transform(map_entries(CAST(_e.value AS MAP<STRING, VARIANT>)), x -> named_struct('path', array_append(_e.path, x.key), 'value', x.value, 'is_object', false)) AS {kind})")
        is_open = ~F.col("_e.is_object") & F.coalesce(F.schema_of_variant("_e.value").startswith("OBJECT"), F.lit(False)) & (F.size("_e.path") <= depth - 1)
        rows = rows.select(*keys, at, F.explode(F.when(is_open, F.concat(opened, children)).otherwise(F.array("_e"))).alias("_e"))
    value = F.when(~F.col("_e.is_object"), F.to_json("_e.value"))
    return rows.select(*keys, at, F.col("_e.path").alias("path"), value.alias("value"), F.col("_e.is_object").alias("is_object")).where(F.size("path") > 0)


def latest(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Per path of a key: its last value with its time, and when it was last an object; any order of arrival gives the same.

    This is all that a stream has to keep.
    """
    valued, opened = F.when(~F.col("is_object"), F.col(at)), F.when(F.col("is_object"), F.col(at))
    return rows.groupBy(*keys, "path").agg(F.max_by("value", valued).alias("value"), F.max(valued).alias("value_at"), F.max(opened).alias("object_at"))


def merged(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The status as rows `keys`, path, value: what is left when updates are merged in order of time.

    A value replaces whatever was at its path, an object included with all below it; an object replaces a value, and is merged
    into an object. An object that holds nothing has the value `{}`.
    """
    is_value = F.col("value_at").isNotNull() & F.coalesce(F.col("value_at") > F.col("object_at"), F.lit(True))
    own = state.select(*keys, "path", is_value.alias("_value"), "value", F.when(is_value, F.col("value_at")).otherwise(F.col("object_at")).alias("_at"))
    above = own.where(F.size("path") > 1).withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.slice("path", 1, i))))
    over = state.where("value_at is not null").select(*keys, F.col("path").alias("_up"), F.col("value_at").alias("_over"))
    dead = above.join(over, [*keys, "_up"]).where(F.col("_over") > F.col("_at")).select(*keys, "path").distinct()
    alive = own.join(dead, [*keys, "path"], "left_anti")
    held = alive.where(F.size("path") > 1).select(*keys, F.slice("path", 1, F.size("path") - 1).alias("path")).distinct()
    empty = alive.where(~F.col("_value")).join(held, [*keys, "path"], "left_anti")
    return alive.where("_value").select(*keys, "path", "value").unionByName(empty.select(*keys, "path", F.lit("{}").alias("value")))
