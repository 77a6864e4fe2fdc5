"""Ranked search of operator notes by per-term geometric blocking; results are exact.

Verdicts (`event_id`, the operator's `notes`) are ranked for labelled clips (`clip_id`, its `notes`).

A term's posting list is clustered into blocks of notes that resemble each other. A block's summary is the largest value of
each term in any of its notes, so a clip's weights times the summary bound the score of every note inside, and a block is
left out only if that bound is below the score of the tenth note found so far. Notes of opened blocks are scored in full.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER_BYTES, pieces, short_batches, written

#: Distinct terms of notes in a shard; terms of clips that are searched together; cells of a table of values.
SHARD_TERMS, GROUP_TERMS, CELLS = 1_000_000, 1_024, 8_000_000
#: Notes of a block, about; numbers that stand for a note when lists are clustered.
BLOCK, SKETCH = 32, 16
#: Texts are coded in slices of so many bytes.
SLICE_BYTES = 2_000_000
LAST = np.iinfo(np.int64).max

_words = re.compile(rb"[a-z0-9\x80-\xff]+").findall


def coded_notes(rows: DataFrame, key: str) -> DataFrame:
    """key, row (a number of its own), n (terms with repeats), terms (distinct, as bytes), counts; null notes have none.

    A term is a maximal run of ASCII letters, digits and characters beyond ASCII; only A-Z is lower-cased.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, start = batch.column(1), 0
            while start < len(texts):
                end, held = start, 0
                terms, counts, sizes, totals = [], [], [0], []
                while end < len(texts) and held < SLICE_BYTES:
                    text = texts[end].as_py() or b""
                    found = Counter(_words(text.translate(LOWER_BYTES)))
                    terms += found.keys()
                    counts += found.values()
                    sizes.append(len(terms))
                    totals.append(sum(found.values()))
                    held += len(text)
                    end += 1
                offsets = pa.array(sizes, pa.int32())
                columns = [batch.column(0).slice(start, end - start), pa.array(range(row, row + end - start), pa.int64()), pa.array(totals, pa.int64())]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "row", "n", "terms", "counts"])
                row += end - start
                start = end

    short_batches(rows.sparkSession)
    rows = rows.select(F.col(key).cast("long").alias(key), F.col("notes").cast("string").cast("binary").alias("notes"))
    return rows.mapInArrow(run, f"{key} long, row long, n long, terms array<binary>, counts array<long>")


def length_terms(n: np.ndarray, notes: int, total: int) -> np.ndarray:
    """m of notes with n terms each; whole numbers of any size on the way."""
    return (25 + 75 * n.astype(object) * notes // max(total, 1)).astype(np.int64)


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a note's score per unit of weight: below a million, and less in longer notes."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Shard:
    """The notes of a shard, in order of event_id, the missing one last."""

    def __init__(self, batches: list[pa.RecordBatch], notes: int, total: int):
        ids, n, terms, counts = (pa.concat_arrays([b.column(i) for b in batches]) for i in range(4))
        keys = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
        order = np.lexsort((ids.is_null().to_numpy(zero_copy_only=False), keys))
        self.event_ids = ids.take(pa.array(order))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
        self.rows = np.repeat(place, sizes).astype(np.int32)
        coded = terms.flatten().dictionary_encode()
        self.terms, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        tf = counts.flatten().to_numpy(zero_copy_only=False)
        m = length_terms(n.to_numpy(zero_copy_only=False), notes, total)
        self.values = gains(tf, np.repeat(m, sizes)).astype(np.int32)


class GeometricIndex:
    """Posting lists in blocks over the terms of some clips, for a run of a shard's notes."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int, n_columns: int):
        self.table = np.zeros((n_rows, n_columns), np.int32)
        self.table[rows, columns] = values
        order = np.lexsort((rows, columns))
        self.rows = rows[order]
        self.starts = np.searchsorted(columns[order], np.arange(n_columns + 1))
        self.most = self.table.max(axis=0, initial=0).astype(np.int64)
        # A note's sketch is a random projection of its values, of length one: near sketches, similar notes.
        signs = np.random.default_rng(n_columns).choice(np.array([-1, 1], np.float32), (n_columns, SKETCH))
        sketch = self.table.astype(np.float32) @ signs
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        self.block = max(BLOCK, -(-len(rows) * n_columns // CELLS))
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.held = self.blocks_seen = self.blocks_opened = 0

    def blocks(self, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A term's notes in order of their block, where each block starts, and the summaries; made when first asked for."""
        found = self.lists.get(column)
        if found is None:
            members = self.rows[self.starts[column] : self.starts[column + 1]]
            n = -(-len(members) // self.block)
            centres = members[np.arange(n) * len(members) // n]
            nearest = np.argmax(self.sketch[members] @ self.sketch[centres].T, axis=1)
            order = np.argsort(nearest, kind="stable")
            starts = np.flatnonzero(np.diff(nearest[order], prepend=-1))
            members = members[order]
            summaries = np.empty((len(starts), self.table.shape[1]), np.int32)
            bounds = [*starts, len(members)]
            step = max(1, CELLS // 4 // max(1, self.table.shape[1]))
            for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                summaries[i] = self.table[members[a : min(b, a + step)]].max(axis=0)
                for c in range(a + step, b, step):
                    np.maximum(summaries[i], self.table[members[c : min(b, c + step)]].max(axis=0), out=summaries[i])
            found = (members, np.array(bounds), summaries)
            if self.held + summaries.size > CELLS:
                self.lists, self.held = {}, 0
            self.lists[column] = found
            self.held += summaries.size
        return found

    def search(self, columns: np.ndarray, weights: np.ndarray, k: int, known: tuple[np.ndarray, np.ndarray], first_row: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, rows) of what is known and of these notes; equal scores by row. Weights are whole numbers above 0."""
        exact = np.float64 if int(weights.sum()) * 10**6 < 2**53 else np.int64
        most = self.most[columns] * weights
        order = np.argsort(-most, kind="stable")
        columns, weights, most = columns[order], weights[order].astype(exact), most[order]
        rest = np.cumsum(most[::-1])[::-1]
        seen = np.zeros(len(self.table), bool)
        scores, rows = known
        least = int(scores[k - 1]) if len(scores) >= k else 1
        for i, column in enumerate(columns.tolist()):
            # Notes that no list before holds have only this and the later terms.
            if rest[i] < least:
                break
            if most[i] == 0:
                continue
            members, starts, summaries = self.blocks(column)
            bounds = summaries[:, columns] @ weights
            ranked = np.argsort(-bounds, kind="stable")
            self.blocks_seen += len(ranked)
            at, step = 0, 4
            while at < len(ranked):
                opened = ranked[at : at + step]
                opened = opened[bounds[opened] >= least]
                if not len(opened):
                    break
                self.blocks_opened += len(opened)
                new = np.concatenate([members[starts[b] : starts[b + 1]] for b in opened])
                new = new[~seen[new]]
                seen[new] = True
                for a in range(0, len(new), 4096):
                    part = new[a : a + 4096]
                    found = (self.table[part[:, None], columns] @ weights).astype(np.int64)
                    good = found >= least
                    if good.any():
                        scores, rows = np.concatenate([scores, found[good]]), np.concatenate([rows, part[good] + first_row])
                        best = np.lexsort((rows, -scores))[:k]
                        scores, rows = scores[best], rows[best]
                        least = int(scores[k - 1]) if len(scores) >= k else 1
                at, step = at + step, step * 2
        return scores, rows


def _groups(terms: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of clips with at most GROUP_TERMS terms in all, or one clip."""
    sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > GROUP_TERMS:
            yield start, i
            start, total = i, 0
        total += size
    yield start, len(sizes)


def searched(shard: Shard, clips: pa.RecordBatch, k: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """For each clip (id, n, terms, weights) the k best notes of a shard: clip_id, event_id, score."""
    for a, b in _groups(clips.column(2)):
        ids, terms, weights = (clips.column(i).slice(a, b - a) for i in (0, 2, 3))
        code = pc.index_in(terms.flatten(), value_set=shard.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        weight = weights.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(b - a), terms.value_lengths().to_numpy(zero_copy_only=False))
        there = (code >= 0) & (weight > 0)
        code, weight, owner = code[there], weight[there], owner[there]
        used, column = np.unique(code, return_inverse=True)
        column_of = np.full(len(shard.terms), -1, np.int64)
        column_of[used] = np.arange(len(used))
        columns = column_of[shard.codes]
        held = np.flatnonzero(columns >= 0)
        rows, columns, values = shard.rows[held], columns[held], shard.values[held]
        tile = max(1, CELLS // max(1, len(used)))
        best = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in np.unique(owner).tolist()}
        bounds = np.searchsorted(owner, np.arange(b - a + 1))
        for first in range(0, len(shard.event_ids), tile):
            inside = (rows >= first) & (rows < first + tile)
            n = min(tile, len(shard.event_ids) - first)
            index = GeometricIndex(rows[inside] - first, columns[inside], values[inside], n, len(used))
            for i, known in best.items():
                x, y = bounds[i], bounds[i + 1]
                best[i] = index.search(column[x:y], weight[x:y], k, known, first)
        for i, (scores, found) in best.items():
            yield ids.take(pa.array([i] * len(found), pa.int64())), shard.event_ids.take(pa.array(found)), scores


def ranked_notes(verdicts: DataFrame, clips: DataFrame, k: int = 10) -> DataFrame:
    """The k best verdicts for every clip, by the words of their notes.

    Input: event_id and clip_id (longs), notes (text); other columns are ignored. N: verdicts with at least one term, L: all
    their terms with repeats, n: a verdict's, df: verdicts that hold a term, tf: its occurrences in a verdict. A term weighs
    floor(1000 * ln((2N + 2) / (2df + 1))); a verdict's m is 25 + (75 n N) div L; its score sums, over the clip's terms with
    repeats, weight * ((10^9 tf) div (1000 tf + 8m)). Result: clip_id, rank (from 1), event_id, score (above 0); equal scores
    by event_id, a missing one last. Every row is a verdict of its own, repeated or not; of clips that share an id, the one
    with the smallest notes asks. Null or empty notes have no terms and are never found; no clips or no verdicts give no rows.

    Statistics cover all verdicts. Notes are coded once and dealt into shards of about a million distinct terms; clips are
    copied to every shard and stream past it; only each shard's best leave it. The index of a shard covers the terms of the
    clips at hand, at most 1,024 of them or one clip's, and as many notes at once as the table of their values has room for.
    """
    notes = written(coded_notes(verdicts, "event_id").filter("n > 0"), "ranked-notes")
    total = notes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    clips = coded_notes(clips.groupBy("clip_id").agg(F.min("notes").alias("notes")), "clip_id")
    asked = written(clips.select("clip_id", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("clip_id", "t.terms", "t.counts"), "ranked-clips")
    vocabulary = asked.select("terms").distinct()
    df = notes.select(F.explode("terms").alias("terms")).join(vocabulary, "terms", "left_semi").groupBy("terms").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * total[0] + 2) / (2.0 * F.col("df") + 1))).cast("long")
    asked = asked.join(df.select("terms", weight.alias("weight")), "terms").filter("weight > 0")
    asked = asked.groupBy("clip_id").agg(F.collect_list(F.struct("terms", (F.col("counts") * F.col("weight")).alias("weight"))).alias("t"))
    n_shards = pieces(total[2], SHARD_TERMS)
    left = notes.select(F.pmod(F.xxhash64("row"), F.lit(n_shards)).alias("shard"), F.lit(0).alias("kind"), F.col("event_id").alias("key"), "n", "terms", F.col("counts").alias("numbers"))
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), F.col("clip_id").alias("key"), F.lit(0).cast("long").alias("n"), F.col("t.terms").alias("terms"), F.col("t.weight").alias("numbers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            shards, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shards)]):
                if shards[a] != now:
                    now, held, shard = shards[a], [], None
                part = pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(2, 6)], names=["key", "n", "terms", "numbers"])
                if kinds[a] == 0:
                    held.append(part)
                    continue
                if shard is None and held:
                    shard, held = Shard(held, total[0], total[1]), []
                for found in searched(shard, part, k) if shard else ():
                    yield pa.RecordBatch.from_arrays([*found[:2], pa.array(found[2])], names=["clip_id", "event_id", "score"])

    dealt = left.unionByName(right).repartition(n_shards, "shard").sortWithinPartitions("shard", "kind")
    rows = dealt.mapInArrow(run, "clip_id long, event_id long, score long")
    order = Window.partitionBy("clip_id").orderBy(F.desc("score"), F.col("event_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("clip_id", "rank", "event_id", "score")
