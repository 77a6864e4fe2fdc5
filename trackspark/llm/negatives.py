"""Hard negatives by slot-decomposed selection.

General: the project keeps no vectors. Rows are `vec_id` (long), `embedding` (array of numbers), `label` (a number).

Every positive of an anchor opens a window of negative scores, from a lower to an upper limit. The upper limits of an
anchor's positives cut the scores into disjoint slots. A shard of rows keeps for each slot its best few, slots are combined
over the shards, and what lies in a window is read from its slot downwards: slots in descending order, each sorted, are
one descending list, in which a window's rows are a run that starts at its upper limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pieces, written

#: A component becomes floor(SCALE * x); beyond the limit it saturates, as do scores.
SCALE, MOST, MOST_SCORE = 256.0, 2.0**53, 9 * 10**16
#: Rows of a shard, and cells of the score matrix of one step.
SHARD_ROWS, CELLS = 8_192, 2_000_000
NONE = np.iinfo(np.int64).min


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array of long); rows without an id, a label or a vector, or with a null or non-finite component, take no part; repeated rows count once."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(whole, F.lit(False)))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-MOST)), F.lit(MOST)))))
    return rows.dropDuplicates()


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products as exact 64-bit integers; beyond 9e16 they saturate."""
    most = a.shape[1] * int(max(np.abs(a).max(initial=0), 1)) * int(max(np.abs(b).max(initial=0), 1))
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most <= MOST_SCORE:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -MOST_SCORE, MOST_SCORE).astype(np.int64)


def best(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest allowed scores of each row, ties to the lower column, best first."""
    n = scores.shape[1]
    if n > k:
        masked = np.where(ok, scores, NONE)
        ok = ok & (masked >= np.partition(masked, n - k, axis=1)[:, n - k, None])
    r, c = np.nonzero(ok)
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


class Shard:
    """The rows of a shard, by the length of their vectors, in order of vec_id."""

    def __init__(self, batches: list[tuple[np.ndarray, np.ndarray, pa.Array]]):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for ids, labels, vectors in batches:
            for length, at, values in _by_length(vectors):
                known = self.by_length.get(length)
                new = (ids[at], labels[at], values)
                self.by_length[length] = new if known is None else tuple(np.concatenate(x) for x in zip(known, new))
        for length, (ids, labels, values) in self.by_length.items():
            order = ids.argsort(kind="stable")
            self.by_length[length] = (ids[order], labels[order], values[order])


def _by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sizes, values = vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for length in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == length)
        yield length, at, values[starts[at, None] + np.arange(length)].reshape(len(at), length)


def _steps(n_anchors: int, n_rows: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, n_rows))
    for a in range(0, n_anchors, step):
        yield slice(a, a + step)


def _same_label(shard: Shard, ids: np.ndarray, labels: np.ndarray, vectors: pa.Array, limits: pa.Array, k: int) -> Iterator[tuple]:
    """For each anchor the best rows of its own label."""
    for length, at, values in _by_length(vectors):
        if length not in shard.by_length:
            continue
        others, other_labels, other_values = shard.by_length[length]
        for label in np.unique(labels[at]):
            mine, theirs = np.flatnonzero(labels[at] == label), np.flatnonzero(other_labels == label)
            for step in _steps(len(mine), len(theirs)):
                rows = mine[step]
                scores = inner_products(values[rows], other_values[theirs])
                r, c = best(scores, ids[at[rows], None] != others[theirs], k)
                yield ids[at[rows[r]]], np.zeros(len(r), np.int64), others[theirs[c]], scores[r, c]


def _in_slots(shard: Shard, ids: np.ndarray, labels: np.ndarray, vectors: pa.Array, limits: pa.Array, k: int) -> Iterator[tuple]:
    """For each anchor and slot the best rows of other labels. Limits: the least score of all windows, then the upper limits, descending."""
    sizes, values_of = limits.value_lengths().to_numpy(zero_copy_only=False), limits.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    tops = np.full((len(sizes), int(sizes.max(initial=1)) + 1), NONE)
    for i, (start, size) in enumerate(zip(starts, sizes)):
        tops[i, : size - 1] = values_of[start + 1 : start + size]
    least = values_of[starts]
    for length, at, values in _by_length(vectors):
        if length not in shard.by_length:
            continue
        others, other_labels, other_values = shard.by_length[length]
        for step in _steps(len(at), len(others)):
            rows = at[step]
            scores = inner_products(values[step], other_values)
            ok = (labels[rows, None] != other_labels) & (ids[rows, None] != others) & (scores >= least[rows, None])
            for slot in range(tops.shape[1] - 1):
                inside = ok & (scores <= tops[rows, slot, None]) & (scores > tops[rows, slot + 1, None])
                r, c = best(scores, inside, k)
                yield ids[rows[r]], np.full(len(r), slot), others[c], scores[r, c]


def _met(rows: DataFrame, anchors: DataFrame, n_shards: int, task: Callable, k: int) -> DataFrame:
    """anchor_id, slot, vec_id, score: each shard of rows against all anchors.

    Rows are dealt once into shards of bounded size; anchors are copied to every shard and stream past it.
    """
    kind = lambda n: F.lit(n).alias("kind")
    given = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_shards)).alias("shard"), kind(0), "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("limits"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"), kind(1), "vec_id", "label", "v", "limits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            shards, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shards)]):
                if shards[a] != now:
                    now, held, shard = shards[a], [], None
                ids, labels = (batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i in (2, 3))
                vectors, limits = (batch.column(i).slice(a, b - a) for i in (4, 5))
                if kinds[a] == 0:
                    held.append((ids, labels, vectors))
                    continue
                shard = shard or Shard(held)
                held = []
                for found in task(shard, ids, labels, vectors, limits, k):
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["anchor_id", "slot", "vec_id", "score"])

    dealt = given.unionByName(asked).repartition(n_shards, "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, "anchor_id long, slot long, vec_id long, score long")


def _first(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k).drop("_place")


def _ranked(rows: DataFrame) -> DataFrame:
    """anchor_id and its rows, best first."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("id")))), lambda x: F.struct(x["id"].alias("vec_id"), (-x["s"]).alias("score")))
    return rows.groupBy("anchor_id").agg(listed.alias("ranked"))


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor and each of its positives the best rows of other labels within a share of the positive's score.

    Input of both: vec_id (long), embedding, label; other columns are ignored. A component x becomes floor(256 * x); a
    score is the exact integer inner product with the anchor; higher scores come first, ties go to the smaller vec_id.
    Positives of an anchor: its first `positives` rows of the same label. Result, for each, its first `negatives` rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score, 0 < low <= high:
    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part; repeated rows count
    once. Rows of one id but different content are different rows, none of them a partner of an anchor with that id; of
    anchors that share an id, the one with the smallest label, then vector, asks. Vectors of different length do not meet.
    Components saturate at 2^53, scores at 9e16. No rows or no anchors give no rows.

    Two passes, one for positives and one for slots: every anchor against every row, shard by shard, with no pair leaving
    a task but the best few of each shard. Work is anchors times rows; nothing is sampled.
    """
    rows = written(integer_vectors(vectors), "negatives-rows")
    n_shards = pieces(rows.count(), SHARD_ROWS)
    asking = integer_vectors(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_row")).select("vec_id", "_row.label", "_row.v")
    asking = written(asking, "negatives-anchors")
    near = _first(_met(rows, asking.withColumn("limits", F.lit(None).cast("array<long>")), n_shards, _same_label, positives), positives, "anchor_id")
    # A window with a negative positive score is empty: its lower limit is above its upper one.
    windows = _ranked(near.filter("score >= 0")).withColumnRenamed("ranked", "positives")
    windows = windows.select("anchor_id", F.transform("positives", lambda p: F.struct(p["vec_id"].alias("id"), p["score"].alias("score"), _div(p["score"] * high).alias("top"), (-_div(-(p["score"] * low))).alias("least"))).alias("windows"))
    windows = written(windows, "negatives-windows")
    limits = F.concat(F.array(F.array_min(F.transform("windows", lambda w: w["least"]))), F.reverse(F.array_sort(F.array_distinct(F.transform("windows", lambda w: w["top"])))))
    slotted = asking.join(windows.select(F.col("anchor_id").alias("vec_id"), limits.alias("limits")), "vec_id")
    found = _ranked(_first(_met(rows, slotted, n_shards, _in_slots, negatives), negatives, "anchor_id", "slot"))
    pairs = found.join(windows, "anchor_id").select("anchor_id", "ranked", F.explode("windows").alias("w"))
    inside = F.filter("ranked", lambda x: (x["score"] <= F.col("w.top")) & (x["score"] >= F.col("w.least")))
    pairs = pairs.select("anchor_id", F.col("w.id").alias("positive_id"), F.col("w.score").alias("positive_score"), F.posexplode(F.slice(inside, 1, negatives)).alias("_at", "_n"))
    return pairs.select("anchor_id", "positive_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_n.vec_id").alias("negative_id"), "positive_score", F.col("_n.score").alias("negative_score"))


def _div(value: Column) -> Column:
    """A long divided by 100, rounded down."""
    return F.call_function("div", value - F.pmod(value, F.lit(100)), F.lit(100))
