"""Ordered computations over keys that may be arbitrarily long.

A plain `partitionBy(key)` window sends a whole key to one task. Here every sequence is cut into
chunks first, so the largest group a task sees is one chunk even when one key holds most rows:

* `with_ordinal` numbers rows inside a key from per-bucket counts plus a per-bucket row_number;
* `bounded` evaluates ROWS frames with a finite reach, copying only the rows a neighbour needs;
* `running` evaluates unbounded aggregates, forwards or backwards, as chunk totals, a prefix over
  the totals, and an in-chunk window.

The per-key work that remains is over chunk summaries (rows / CHUNK), never over rows. `running` needs
its rows twice, so it writes them once; a chain of such steps reads its source once, not 2^n times.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackspark.session import written

CHUNK = 4096


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column,
                 name: str = "ordinal") -> DataFrame:
    """1-based position of each row inside `keys`.

    `bucket` must not decrease along `order`; it only sets how the work is cut.
    """
    cut = df.withColumn("_b", bucket)
    counts = cut.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    numbered = cut.withColumn("_r", F.row_number().over(inside))
    joined = numbered.join(offsets, [*keys, "_b"])
    return joined.withColumn(name, F.col("_r") + F.col("_off")).drop("_b", "_r", "_off")


def bounded(df: DataFrame, keys: Sequence[str], ordinal: str, make: Callable[[Window], Mapping[str, Column]],
            before: int, after: int = 0, size: int = CHUNK) -> DataFrame:
    """Add window columns whose frames reach at most `before` rows back and `after` rows ahead.

    `make` receives the chunk window (partitioned and ordered) and returns named Columns.
    """
    at = F.col(ordinal) - 1
    own = F.floor(at / size)
    first = F.greatest(F.lit(0), F.floor((at - after) / size))
    last = F.floor((at + before) / size)
    spread = df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_chunk") == own)
    window = Window.partitionBy(*keys, "_chunk").orderBy(ordinal)
    for column, expr in make(window).items():
        spread = spread.withColumn(column, expr)
    return spread.where("_own").drop("_chunk", "_own")


# kind -> (aggregate, how the carry from other chunks and the value inside the chunk combine).
_COMBINE = {
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "last": (None, lambda a, b: F.coalesce(b, a)),
    "next": (None, lambda a, b: F.coalesce(b, a)),
}


def running(df: DataFrame, keys: Sequence[str], ordinal: str, specs: Mapping[str, tuple[str, Column]],
            size: int = CHUNK, settled: bool = False) -> DataFrame:
    """Running max / min / sum / last non-null up to each row, or `next` non-null from it on, the row included.

    `specs` maps an output column to (kind, value). Chunk summaries are computed once for all
    outputs, prefixed per key, and joined back on the chunk. `settled` says that `df` is a table already
    (and its values plain columns), which need not be written again.
    """
    base = df.withColumn("_chunk", F.floor((F.col(ordinal) - 1) / size))
    for name, (_, value) in specs.items():
        base = base.withColumn(f"_v_{name}", value)
    if not settled:
        base = written(base, "sequence")
    totals = base.groupBy(*keys, "_chunk").agg(*(_total(kind, name, ordinal) for name, (kind, _) in specs.items()))
    carry = totals.select(*keys, "_chunk", *(
        _over(kind, F.col(f"_t_{name}"), Window.partitionBy(*keys), "_chunk", 1).alias(f"_c_{name}") for name, (kind, _) in specs.items()))
    local = base
    for name, (kind, _) in specs.items():
        local = local.withColumn(f"_l_{name}", _over(kind, F.col(f"_v_{name}"), Window.partitionBy(*keys, "_chunk"), ordinal, 0))
    out = local.join(carry, [*keys, "_chunk"])
    for name, (kind, _) in specs.items():
        out = out.withColumn(name, _COMBINE[kind][1](F.col(f"_c_{name}"), F.col(f"_l_{name}")))
    helpers = [f"_{tag}_{name}" for name in specs for tag in ("v", "c", "l")]
    return out.drop("_chunk", *helpers)


def _total(kind: str, name: str, ordinal: str) -> Column:
    value = F.col(f"_v_{name}")
    if kind in ("last", "next"):
        pick = F.max_by if kind == "last" else F.min_by
        return pick(value, F.when(value.isNotNull(), F.col(ordinal))).alias(f"_t_{name}")
    return _COMBINE[kind][0](value).alias(f"_t_{name}")


def _over(kind: str, value: Column, window: WindowSpec, order: str, gap: int) -> Column:
    """The aggregate of all rows before (`next`: after) the row; `gap` 0 takes the row itself as well.

    What follows is read backwards: a frame that ends with its partition would be summed up anew for every row.
    """
    upto = window.orderBy(F.col(order).desc() if kind == "next" else F.col(order)).rowsBetween(Window.unboundedPreceding, -gap)
    return F.last(value, ignorenulls=True).over(upto) if kind in ("last", "next") else _COMBINE[kind][0](value).over(upto)


def run_lengths(df: DataFrame, keys: Sequence[str], ordinal: str, flag: Column, name: str = "run") -> DataFrame:
    """Length of the unbroken run of true flags ending at each row (0 where the flag is false)."""
    out = running(df, keys, ordinal, {"_broken": ("max", F.when(~F.coalesce(flag, F.lit(False)), F.col(ordinal)))})
    return out.withColumn(name, F.col(ordinal) - F.coalesce(F.col("_broken"), F.lit(0))).drop("_broken")
