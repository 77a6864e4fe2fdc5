"""Quality of operator notes by a language model of trusted ones.

The record is a verdict: `event_id`, the operator's `notes`, and `verdict` (`confirm` marks text to trust). The project
records no language, so `lang`, which only groups thresholds, is the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, hash60, pieces, short_batches, sparing, written

#: Characters of an n-gram; four packed code points are a long.
ORDER = 4
BITS = 16
BEGIN, STOP = 0xFFFF, 0xFFFE
#: Characters of a block of notes that is scored with one slice of the model.
BLOCK_CHARS = 8_000_000
#: Characters handled at once.
SLICE_CHARS = 1_000_000
#: Ids of trusted notes up to this number are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Quantiles of trusted perplexity (and the lower one of variety) that bound what is kept, and the part by which bounds give way.
#: Farther out, a quantile of a few hundred notes is their extreme, which one odd note sets.
QUANTILES = (0.01, 0.99)
MARGIN = 0.1
#: Held-out notes from which on a language has quantiles of its own, and from which on it has a median.
LEAST_HELD, LEAST_MEDIAN = 100, 10
#: N-grams of a window whose distinct ones are counted.
WINDOW = 512


def codes(text: str) -> np.ndarray:
    """16-bit code points; those beyond share the 2,048 values that text never uses."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(points > 0xFFFF, 0xD800 + (points & 0x7FF), points).astype(np.uint64)


def packed_grams(text: str) -> np.ndarray:
    """The n-grams of a text as longs: one that ends in each character, and one in the end mark."""
    padded = np.concatenate([np.full(ORDER - 1, BEGIN, np.uint64), codes(text), np.full(1, STOP, np.uint64)])
    out = np.zeros(len(padded) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(BITS)) | padded[i : i + len(out)]
    return out.view(np.int64)


def variety(grams: np.ndarray) -> float:
    """The part of n-grams that are distinct, in the window of WINDOW of them (the last one ends the text) where it is least."""
    size = min(WINDOW, len(grams))
    whole = len(grams) // size * size
    windows = grams[:whole].reshape(-1, size)
    if whole < len(grams):
        windows = np.concatenate([windows, grams[None, -size:]])
    windows = np.sort(windows, axis=1)
    return float((1 + (windows[:, 1:] != windows[:, :-1]).sum(axis=1)).min() / size)


def _slices(texts) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def gram_counts(notes: DataFrame) -> DataFrame:
    """gram, n over all notes; each slice of a task is added up before rows leave it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for texts in _slices(batch["notes"].dropna()):
                gram, n = np.unique(np.concatenate([packed_grams(t) for t in texts]), return_counts=True)
                yield pd.DataFrame({"gram": gram, "n": n})

    return notes.select("notes").mapInPandas(sparing(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _suffix(gram: Column, order: int) -> Column:
    """The last `order` characters."""
    return gram.bitwiseAND(F.lit((1 << (BITS * order)) - 1)) if order < ORDER else gram


def _context(gram: Column) -> Column:
    """All characters but the last."""
    return F.shiftrightunsigned(gram, BITS)


class KneserNey:
    """Interpolated modified Kneser-Ney: for each order the counts of its n-grams and the mass and back-off of its contexts.

    The highest order counts occurrences, each lower one the distinct characters that precede an n-gram. All are
    tables in the shared folder, keyed by packed n-gram and as large as the trusted text makes them; only twelve discounts and
    the alphabet's size are values of the driver.
    """

    def __init__(self, notes: DataFrame):
        self.counts: dict[int, DataFrame] = {}
        self.contexts: dict[int, DataFrame] = {}
        self.discounts: dict[int, tuple[float, float, float]] = {}
        for order in range(ORDER, 0, -1):
            if order == ORDER:
                counts = gram_counts(notes)
            else:
                counts = self.counts[order + 1].groupBy(_suffix(F.col("gram"), order).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
            counts = self.counts[order] = written(counts, f"grams-{order}")
            few = {r["n"]: r["k"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
            self.discounts[order] = self._discounts([few.get(i, 0) for i in range(1, 5)])
            lost = self._discount(order)
            grouped = counts.groupBy(_context(F.col("gram")).alias("context")).agg(F.sum("n").alias("mass"), F.sum(lost).alias("lost"))
            self.contexts[order] = written(grouped, f"contexts-{order}")
        # Unseen characters share one place of the alphabet.
        self.alphabet = self.counts[1].count() + 1

    @staticmethod
    def _discounts(few: list[int]) -> tuple[float, float, float]:
        """From how many n-grams occur once to four times; the usual halves where one of them is missing."""
        if not all(few):
            return 0.5, 1.0, 1.5
        y = few[0] / (few[0] + 2 * few[1])
        d = [i - (i + 1) * y * few[i] / few[i - 1] for i in (1, 2, 3)]
        return tuple(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))

    def _discount(self, order: int) -> Column:
        one, two, more = self.discounts[order]
        return F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)

    def log_probabilities(self, grams: DataFrame) -> DataFrame:
        """gram, bits (minus the binary logarithm of the last character's probability): a chain of joins with the count tables."""
        rows = grams.select("gram").withColumn("p", F.lit(1.0 / self.alphabet))
        for order in range(1, ORDER + 1):
            own = _suffix(F.col("gram"), order)
            counts = self.counts[order].select(F.col("gram").alias("_gram"), (F.col("n") - self._discount(order)).alias("_kept"))
            contexts = self.contexts[order].select(F.col("context").alias("_context"), "mass", "lost")
            rows = rows.withColumn("_gram", own).join(counts, "_gram", "left").withColumn("_context", _context(own)).join(contexts, "_context", "left")
            inner = (F.coalesce("_kept", F.lit(0.0)) + F.col("lost") * F.col("p")) / F.col("mass")
            rows = rows.select("gram", F.coalesce(inner, F.col("p")).alias("p"))
        return rows.select("gram", (-F.log2("p")).cast("float").alias("bits"))


def perplexities(verdicts: DataFrame, model: KneserNey) -> DataFrame:
    """event_id, lang, n_chars, perplexity (per character) and variety (both null where notes are null or empty) of every row.

    Rows are dealt into blocks of bounded size by the hash of their id. Each block asks for the n-grams it holds, once;
    these, without repeats, meet the count tables by shuffle joins; and each block gets its slice of the answers. So
    what crosses the network is the compressed text, once, and a bounded number of n-grams for each block, and no task
    ever holds the model.
    """
    rows = verdicts.select(F.col("event_id").cast("string").alias("event_id"), F.col("lang").cast("string").alias("lang"), F.col("notes").cast("string").alias("notes"))
    blocks = pieces(rows.agg(F.sum(F.length("notes"))).first()[0], BLOCK_CHARS)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("event_id", F.length("notes")), F.lit(blocks)).cast("int"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            batch["notes"] = [None if t is None else press.compress(t.encode("utf-8", "replace")) for t in batch["notes"]]
            yield batch

    def unpacked(column) -> Iterator[str]:
        press = zstandard.ZstdDecompressor()
        return (press.decompress(p).decode() for p in column if p is not None)

    dealt = rows.mapInPandas(sparing(pack), "event_id string, lang string, notes binary, block int").repartition(blocks, "block")

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(np.concatenate([packed_grams(t) for t in texts])) for texts in _slices(unpacked(pdf["notes"])))]))
        give_back()
        return pd.DataFrame({"block": pdf["block"].iloc[0], "gram": gram})

    asked = written(dealt.groupBy("block").applyInPandas(ask, "block int, gram long"), "asked")
    answers = written(model.log_probabilities(asked.select("gram").distinct()), "answers")

    def score(pdf: pd.DataFrame, slice_: pd.DataFrame) -> pd.DataFrame:
        order = slice_["gram"].to_numpy().argsort()
        gram, bits = slice_["gram"].to_numpy()[order], slice_["bits"].to_numpy(np.float64)[order]
        press, sizes, found, varied = zstandard.ZstdDecompressor(), [], [], []
        for packed in pdf["notes"]:
            text = "" if packed is None else press.decompress(packed).decode()
            sizes.append(len(text))
            own = packed_grams(text)
            found.append(2.0 ** bits[np.searchsorted(gram, own)].mean() if text else None)
            varied.append(variety(own) if text else None)
        give_back()
        numbers = {"perplexity": pd.Series(found, index=pdf.index, dtype=float), "variety": pd.Series(varied, index=pdf.index, dtype=float)}
        return pd.DataFrame({"event_id": pdf["event_id"], "lang": pdf["lang"], "n_chars": sizes, **numbers})

    slices = asked.join(answers, "gram")
    out = dealt.groupBy("block").cogroup(slices.groupBy("block")).applyInPandas(score, "event_id string, lang string, n_chars long, perplexity double, variety double")
    out = out.withColumn("event_id", F.col("event_id").cast(verdicts.schema["event_id"].dataType))
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("perplexity", "variety")})


def _held_out(event_id: Column) -> Column:
    """A quarter of the trusted notes sets thresholds and is not counted."""
    return hash60(event_id) % 4 == 0


def thresholds(scored: DataFrame, quantiles=QUANTILES, margin: float = MARGIN) -> DataFrame:
    """lang, lowest, highest, least_variety from held-out trusted notes; the row with a null lang is for languages without one.

    A language with LEAST_HELD notes has quantiles of its own. One with fewer, down to LEAST_MEDIAN, has its own median times
    the quantiles, over all notes of such languages and larger ones, of a note's value divided by its language's median.
    """
    at = lambda c: F.percentile_approx(c, [quantiles[0], 0.5, quantiles[1]], 10000)
    rows = scored.filter("perplexity IS NOT NULL").select("lang", "perplexity", "variety")
    own = rows.filter("lang IS NOT NULL").groupBy("lang").agg(at("perplexity").alias("p"), at("variety").alias("v"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_MEDIAN)
    every = rows.agg(at("perplexity").alias("p"), at("variety").alias("v")).select(F.lit(None).cast("string").alias("lang"), "p", "v")
    medians = own.select("lang", F.col("p")[1].alias("_p"), F.col("v")[1].alias("_v"))
    parts = rows.join(F.broadcast(medians), "lang").agg(at(F.col("perplexity") / F.col("_p")).alias("part_p"), at(F.col("variety") / F.col("_v")).alias("part_v"))
    scaled = lambda c: F.transform(f"part_{c}", lambda x: x * F.col(c)[1])
    each = own.crossJoin(F.broadcast(parts)).select("lang", *[F.when(F.col("n") >= LEAST_HELD, F.col(c)).otherwise(scaled(c)).alias(c) for c in "pv"])
    low = lambda c: F.col(c)[0] * (1 - margin)
    return each.unionByName(every).select("lang", low("p").alias("lowest"), (F.col("p")[2] * (1 + margin)).alias("highest"), low("v").alias("least_variety"))


def rated_notes(verdicts: DataFrame, trusted: DataFrame, quantiles=QUANTILES, margin: float = MARGIN) -> DataFrame:
    """Perplexity of every verdict's notes under a model of the trusted ones, and whether they are kept.

    Input: verdicts with event_id (any type), notes and lang (text); trusted with the event_id of each verdict whose notes are to
    be trusted. Result, one row per verdict: event_id, lang, n_chars, perplexity, variety, lowest, highest, least_variety, kept.

    Three quarters of the trusted notes train a character model, the rest gives each language its bounds (see `thresholds`).
    Garbled text is above the upper one. Repeated text may have any perplexity, by what it repeats: its variety, the part
    of distinct n-grams in the most monotonous window, is below that of trusted notes. Kept are the notes within all bounds. Null and empty notes have a null perplexity and are not kept. Without
    trusted notes there are no bounds, and all that have a perplexity are kept. Repeated rows are rated alike.
    """
    short_batches(verdicts.sparkSession)
    ids = trusted.select("event_id").filter("event_id IS NOT NULL").distinct()
    counted = ids.filter(~_held_out(F.col("event_id")))
    if counted.count() <= BROADCAST_IDS:
        counted = F.broadcast(counted)
    model = KneserNey(verdicts.select("event_id", F.col("notes").cast("string").alias("notes")).join(counted, "event_id", "left_semi"))
    scored = written(perplexities(verdicts, model), "perplexities")
    bounds = thresholds(scored.join(ids.filter(_held_out(F.col("event_id"))), "event_id", "left_semi"), quantiles, margin)
    names = ["lowest", "highest", "least_variety"]
    own = {r["lang"]: [r[x] for x in names] for r in bounds.collect()}
    chosen = [F.lit(x).cast("double") for x in own.pop(None)]
    for lang, values in sorted(own.items()):
        chosen = [F.when(F.col("lang") == lang, x).otherwise(c) for x, c in zip(values, chosen)]
    rows = scored.withColumns(dict(zip(names, chosen)))
    within = F.col("perplexity").between(F.coalesce("lowest", F.lit(0.0)), F.coalesce("highest", F.lit(float("inf"))))
    within = within & (F.col("variety") >= F.coalesce("least_variety", F.lit(0.0)))
    return rows.withColumn("kept", F.coalesce(within, F.lit(False)))
