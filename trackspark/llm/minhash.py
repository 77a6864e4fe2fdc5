"""Near-duplicate operator notes by SuperMinHash.

The record is a verdict: `event_id` and the operator's `notes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, short_batches, sparing, written
from .components import connected_components

#: Words of a shingle.
SHINGLE = 5
#: Least similarity of a link, in percent.
PERCENT = 85
#: A signature has BANDS x ROWS slots. Sets of similarity 0.85 share no band with a chance of (1 - 0.85^4)^16 < 1e-5.
BANDS, ROWS = 16, 4
SLOTS = BANDS * ROWS
#: Slots that must agree before full sets are compared: five standard deviations below what 0.85 gives.
AGREE = 40
#: Rows, and shingles, of a block when members of one bucket are compared.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Remembered word hashes of a Python worker.
REMEMBERED = 100_000

_U = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles; of all its words as one where they are fewer."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : len(h) - width + 1 + i]) * _U(0x9E3779B97F4A7C15) + _U(i + 1)
        out ^= out >> _U(32)
    return np.unique(mixed(out))


def superminhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of a non-empty set.

    Every element has a random permutation of the slots and a random number for each rank; a slot holds the least rank plus
    number over all elements. Ranks are correlated across slots, which is what lowers the variance against independent
    hashes. All elements go through one rank at a time, and once each slot is below the next rank nothing can change:
    a set of many elements stops after a rank or two.
    """
    n, h = len(elements), np.full(slots, np.inf)
    order = None
    for rank in range(slots):
        seed = mixed(elements + _U(0x9E3779B97F4A7C15 * (2 * rank + 1) & (2**64 - 1)))
        number = (seed >> _U(11)).astype(np.float64) * 2.0**-53
        pick = rank + ((mixed(seed ^ _U(0xD1B54A32D192ED03)) >> _U(32)) * _U(slots - rank) >> _U(32)).astype(np.int64)
        if order is None:
            # Before the first swap the picked slot is its own number.
            slot = pick
        else:
            slot = order[rows, pick].astype(np.int64)
        np.minimum.at(h, slot, number + rank)
        if h.max() < rank + 1:
            break
        if order is None:
            order, rows = np.tile(np.arange(slots, dtype=np.uint8), (n, 1)), np.arange(n)
        order[rows, pick] = order[:, rank]
        order[:, rank] = slot
    return h


def _banded(signature: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys (with the band's number mixed in) and one byte for each slot."""
    bits = signature.view(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    for row in bits.reshape(BANDS, ROWS).T:
        keys = mixed(keys ^ row)
    return keys.view(np.int64), (mixed(bits) >> _U(56)).astype(np.uint8).tobytes()


def signatures(verdicts: DataFrame) -> DataFrame:
    """event_id, n_shingles, node, bands, sig of every row; the last three are null for an empty set.

    `node` is a 64-bit hash of the whole set: equal sets are one node.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["notes"]:
                found = shingle_set(text)
                if len(found):
                    node = xxhash.xxh3_64_intdigest(found.tobytes())
                    out.append((len(found), node - (1 << 64) if node >= 1 << 63 else node, *_banded(superminhash(found))))
                else:
                    out.append((0, None, None, None))
            sizes, nodes, bands, sigs = zip(*out) if out else ((), (), (), ())
            # A nullable type of its own: nulls among longs must not turn them into doubles.
            yield pd.DataFrame({"event_id": batch["event_id"].to_numpy(), "n_shingles": sizes, "node": pd.array(nodes, dtype="Int64"), "bands": list(bands), "sig": list(sigs)})

    rows = verdicts.select(F.col("event_id").cast("string").alias("event_id"), F.col("notes").cast("string").alias("notes"))
    out = rows.mapInPandas(sparing(run), "event_id string, n_shingles long, node long, bands array<long>, sig binary")
    return out.withColumn("event_id", F.col("event_id").cast(verdicts.schema["event_id"].dataType))


def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    """In how many slots two signatures agree."""
    left, right = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, SLOTS) for x in (a, b))
    return pd.Series((left == right).sum(axis=1, dtype=np.int32))


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b, agree of the pairs whose sizes and signatures allow a link."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return rows.select("a", "b", F.pandas_udf(_agreeing, "int")("sig_a", "sig_b").alias("agree")).filter(F.col("agree") >= AGREE)


def _full_sets(verdicts: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles of the wanted nodes, from the whole texts."""
    chosen = rows.join(wanted.hint("shuffle_hash"), "node", "left_semi").groupBy("node").agg(F.min("event_id").alias("event_id"))
    texts = verdicts.select("event_id", F.col("notes").cast("string").alias("notes")).join(chosen.select("event_id").distinct().hint("shuffle_hash"), "event_id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for text in batch["notes"]:
                found = shingle_set(text)
                if len(found):
                    node = xxhash.xxh3_64_intdigest(found.tobytes())
                    out.append((node - (1 << 64) if node >= 1 << 63 else node, found.view(np.int64)))
                    held += len(found)
                if held > 500_000:
                    yield pd.DataFrame(out, columns=["node", "shingles"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["node", "shingles"])

    # Rows that repeat an id may have other texts; a node's set is the same whichever row it comes from.
    sets = texts.select("notes").mapInPandas(sparing(run), "node long, shingles array<long>")
    return written(sets.join(wanted.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, verdicts: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """a, b, linked: whether the full sets meet the similarity."""
    pairs = written(pairs.select("a", "b"), "pairs")
    sets = _full_sets(verdicts, rows, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return written(both.select("a", "b", (common * 100 >= (F.size("set_a") + F.size("set_b") - common) * percent).alias("linked")), "confirmed")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that come sorted by `keys`; a group may begin in one batch and end in a later one."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        values = rows[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1)]
        for start, end in zip(cuts, cuts[1:]):
            yield rows.iloc[start:end]
        held = rows.iloc[cuts[-1] :]
    if held is not None and len(held):
        yield held


def _in_blocks(members: DataFrame, *more: str) -> DataFrame:
    """The members of buckets with several components, dealt into groups (key, low, high) and sorted by them.

    A bucket is cut into blocks of about BLOCK rows or BLOCK_SHINGLES shingles, and each pair of blocks is a group of its own, so
    that no task holds a whole bucket. `own` is a row's block.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("all"), F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int")
    rows = members.join(sizes.select("key", blocks.alias("blocks")), "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "component", "n_shingles", *more)
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")


def _others(group: pd.DataFrame, percent: int):
    """For row i of a group: the later rows of other components and fitting size; of the other block, where there are two."""
    n, own, crossing = group["n_shingles"].to_numpy(), group["own"].to_numpy(), group["low"].iloc[0] != group["high"].iloc[0]

    def of(i: int, component: np.ndarray) -> np.ndarray:
        j = np.arange(i + 1, len(n))
        j = j[(component[j] != component[i]) & (np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * percent)]
        return j[own[j] != own[i]] if crossing else j

    return of


def _promising(members: DataFrame, percent: int) -> DataFrame:
    """key, node of the members whose signature agrees with that of a member of another component; members: key, node, component, n_shingles, sig."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["key", "low", "high"]):
            sig, component, others = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(-1, SLOTS), group["component"].to_numpy(), _others(group, percent)
            good = np.zeros(len(group), bool)
            for i in range(len(group) - 1):
                j = others(i, component)
                j = j[(sig[j] == sig[i]).sum(axis=1) >= AGREE]
                good[j] = True
                good[i] |= len(j) > 0
            yield group.loc[good, ["key", "node"]]

    return _in_blocks(members, "sig").mapInPandas(sparing(run), "key long, node long").distinct()


def _joined_across(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different components, by full sets; members: key, node, component, n_shingles, bands, shingles.

    A pair is compared in the first band that it shares. Each row is marked in a table of the group's shingles and counted
    against all other rows at once; joined components are one from then on, so a group of m rows gives at most m - 1 links
    however many of its pairs are similar.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["key", "low", "high"]):
            bands, component, node, others = np.stack(group["bands"].to_numpy()), group["component"].to_numpy().copy(), group["node"].to_numpy(), _others(group, percent)
            sizes = group["n_shingles"].to_numpy()
            band = int(np.flatnonzero(bands[0] == group["key"].iloc[0])[0])
            shingle = np.unique(np.concatenate(group["shingles"].to_numpy()), return_inverse=True)[1]
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            marked, out = np.zeros(shingle.max() + 1, np.int32), []
            for i in range(len(group) - 1):
                j = others(i, component)
                j = j[(bands[j] == bands[i]).argmax(axis=1) == band]
                if not len(j):
                    continue
                own = shingle[starts[i] : starts[i] + sizes[i]]
                marked[own] = 1
                common = np.add.reduceat(marked[shingle[starts[j[0]] :]], starts[j[0] :] - starts[j[0]])[j - j[0]]
                marked[own] = 0
                for other in j[common * 100 >= (sizes[j] + sizes[i] - common) * percent]:
                    if component[other] != component[i]:
                        component[component == component[other]] = component[i]
                        out.append((node[i], node[other]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return _in_blocks(members, "bands", "shingles").mapInPandas(sparing(run), "a long, b long").distinct()


def near_duplicates(verdicts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Groups of verdicts whose notes nearly agree.

    Input: event_id (any type), notes (text); other columns are ignored. Result, one row per input row: event_id, n_shingles,
    component_id (the smallest event_id reachable over links, itself included), kept (event_id = component_id).

    Equal sets are one node. Nodes meet in the buckets of their bands. First each is paired with the best-agreeing smallest
    node of its buckets; full sets confirm the pair. Then, in the buckets that still hold several components, all members
    whose signatures allow a link are compared across components by full sets, so that each pair that shares a bucket is
    decided or joined already. No bucket, group of copies or component is ever held by one task or the
    driver. Null notes, and notes without words, have an empty set and are linked with nothing; repeated rows are linked; a
    null event_id takes part, but is never a component's id unless there is no other; an empty table gives no rows.
    """
    if percent < PERCENT:
        raise ValueError(f"bands and signatures are laid out for {PERCENT} percent or more")
    short_batches(verdicts.sparkSession)
    rows = written(signatures(verdicts), "signatures")
    nodes = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("event_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = written(nodes, "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = written(keyed.join(pivots, "key"), "buckets")
    first = _plausible(members.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), nodes, percent)
    best = first.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    links = _confirmed(best, verdicts, rows, percent)
    labels = connected_components(links.filter("linked"))

    component = F.coalesce("label", "node").alias("component")
    known = nodes.join(labels, "node", "left").select("node", component, "n_shingles", "bands", "sig")
    held = members.select("key", "node").join(known.drop("bands"), "node")
    promising = written(_promising(held, percent), "promising")
    sets = _full_sets(verdicts, rows, promising.select("node").distinct())
    across = _joined_across(promising.join(known.drop("sig"), "node").join(sets, "node"), percent)
    labels = connected_components(links.filter("linked").select("a", "b").unionByName(written(across, "across")))

    named = nodes.join(labels, "node", "left").select("node", "first_id", component)
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select(F.col("node").alias("_node"), "component_id")
    # Rows without a set get keys of their own, so that nulls do not gather.
    own = F.coalesce("node", F.xxhash64("event_id"))
    out = rows.select("event_id", "n_shingles", own.alias("_node")).join(named, "_node", "left")
    found = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("event_id"))
    return out.select("event_id", "n_shingles", found.alias("component_id"), F.col("event_id").eqNullSafe(found).alias("kept"))
