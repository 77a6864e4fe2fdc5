"""Token ids of operator notes in binary files of patched frame-of-reference blocks.

The record is a verdict: `event_id` (a long) and the operator's `notes`. A file holds whole verdicts, in order:

    head        magic, part, number in its part, verdicts, ids, blocks (longs)
    index       event_id of each verdict, whether it is null, its first id; a last entry closes the list
    blocks      minimum, width, first word of packed data, first exception; a last entry closes the lists
    packed      of every id the low bits of its difference to the block's minimum, at the block's width
    exceptions  place in the block and the high bits, where the width is too small
    tail        CRC-32 of all before, a line break

A block is 128 ids. Its width is the number of bits that the 90th percentile of its differences needs, so at most
a tenth of it are exceptions. Block starts are in the index: a reader unpacks only the blocks it needs.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .common import short_batches, written

MAGIC = b"TKPF0001"
BLOCK, LANES = 128, 32
PERCENTILE = 0.9
#: A file ends with the verdict that fills it; ids handed to Spark at once.
FILE_IDS, BATCH_IDS = 2_000_000, 1_000_000
#: Follows every verdict's ids.
END_ID = 0
#: Fixed value: how a byte-level vocabulary file with `use_regex` cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids of a tokenizers vocabulary file, without special tokens around it; read once per Python worker.

    A plain byte-level vocabulary whose ids are in the order of its merges is encoded by ranks, which gives the same
    ids about five times as fast; any other goes through the tokenizers library itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cutter, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    plain = model["type"] == "BPE" and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space") and spec.get("normalizer") is None
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added) and all(c in byte_of for t in model["vocab"] for c in t)
    if plain:
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        plain = made == sorted(set(made)) and len(made) + len(byte_of) == len(model["vocab"])
    if plain:
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items()}
        special = {t["content"]: t["id"] for t in added}
        coding = tiktoken.Encoding("notes", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: np.asarray(coding.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 needs none."""
    return np.frexp(values.astype(np.float64))[1]


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Blocks x 128 values under 2^width as blocks x 4 width words: each run of 32 values fills width words."""
    lanes = np.ascontiguousarray(low.reshape(-1, LANES).T)
    words = np.zeros((width, lanes.shape[1]), np.uint32)
    for j, lane in enumerate(lanes):
        word, shift = divmod(j * width, 32)
        words[word] |= lane << np.uint32(shift)
        if shift + width > 32:
            words[word + 1] |= lane >> np.uint32(32 - shift)
    return np.ascontiguousarray(words.T).reshape(len(low), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(packed.reshape(-1, width).T)
    lanes = np.empty((LANES, words.shape[1]), np.uint32)
    for j in range(LANES):
        word, shift = divmod(j * width, 32)
        lane = words[word] >> np.uint32(shift)
        if shift + width > 32:
            lane = lane | words[word + 1] << np.uint32(32 - shift)
        lanes[j] = lane if width == 32 else lane & np.uint32((1 << width) - 1)
    return np.ascontiguousarray(lanes.T).reshape(len(packed), BLOCK)


def token_file(event_ids: list[int | None], ids: list[np.ndarray], part: int, number: int) -> bytes:
    """The bytes of one file."""
    starts = np.cumsum([0, *map(len, ids)], dtype="<i8")
    stream = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    if len(stream) % BLOCK:
        stream = np.append(stream, np.full(-len(stream) % BLOCK, stream[-1], np.uint32))
    blocks = stream.reshape(-1, BLOCK)
    least = blocks.min(axis=1) if len(blocks) else np.zeros(0, np.uint32)
    over = blocks - least[:, None]
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    widths = _bits(np.partition(over, at, axis=1)[:, at]) if len(blocks) else np.zeros(0, np.int64)
    first_word = np.concatenate(([0], np.cumsum(widths * (BLOCK // 32)))).astype("<i8")
    packed = np.zeros(first_word[-1], "<u4")
    high = over >> widths.astype(np.uint32)[:, None] % 32
    high[widths == 32] = 0
    for width in np.unique(widths[widths > 0]):
        these = np.flatnonzero(widths == width)
        low = over[these] if width == 32 else over[these] & np.uint32((1 << int(width)) - 1)
        packed[first_word[these, None] + np.arange(width * (BLOCK // 32))] = _pack(low, int(width))
    where = np.nonzero(high)
    first_exception = np.concatenate(([0], np.cumsum(np.bincount(where[0], minlength=len(blocks))))).astype("<i8")
    head = np.array([part, number, len(event_ids), starts[-1], len(blocks)], "<i8")
    missing = np.array([e is None for e in event_ids], np.uint8)
    keys = np.array([0 if e is None else e for e in event_ids], "<i8")
    pieces = [head, keys, missing, starts, least.astype("<u4"), widths.astype(np.uint8), first_word, first_exception, packed, where[1].astype(np.uint8), high[where].astype("<u4")]
    body = MAGIC + b"".join(p.tobytes() for p in pieces)
    return body + zlib.crc32(body).to_bytes(4, "little") + b"\n"


class TokenFile:
    """A file's index, and the ids of any stretch of it. A file cut short or changed raises ValueError."""

    def __init__(self, content: bytes):
        if len(content) < len(MAGIC) + 45 or content[: len(MAGIC)] != MAGIC or zlib.crc32(memoryview(content)[:-5]) != int.from_bytes(content[-5:-1], "little"):
            raise ValueError("no whole token file")
        at = len(MAGIC)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(content, kind, n, at)
            at += found.nbytes
            return found

        self.part, self.number, n_verdicts, self.n_ids, n_blocks = take("<i8", 5).tolist()
        keys, missing = take("<i8", n_verdicts), take("u1", n_verdicts)
        self.event_ids = pa.array(keys, mask=missing.astype(bool))
        self.starts = take("<i8", n_verdicts + 1)
        self.least, self.widths = take("<u4", n_blocks), take("u1", n_blocks)
        self.first_word, self.first_exception = take("<i8", n_blocks + 1), take("<i8", n_blocks + 1)
        self.packed = take("<u4", int(self.first_word[-1]))
        self.places, self.high = take("u1", int(self.first_exception[-1])), take("<u4", int(self.first_exception[-1]))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from start to before end; only the blocks that hold them are unpacked."""
        a, b = start // BLOCK, -(-end // BLOCK)
        if end <= start:
            return np.zeros(0, np.uint32)
        widths = self.widths[a:b]
        over = np.zeros((b - a, BLOCK), np.uint32)
        for width in np.unique(widths[widths > 0]).tolist():
            these = np.flatnonzero(widths == width)
            over[these] = _unpack(self.packed[self.first_word[a:b][these, None] + np.arange(width * (BLOCK // 32))], width)
        x, y = self.first_exception[a], self.first_exception[b]
        owner = np.repeat(np.arange(b - a), np.diff(self.first_exception[a : b + 1]))
        over[owner, self.places[x:y]] |= self.high[x:y] << widths[owner].astype(np.uint32)
        return (over + self.least[a:b, None]).reshape(-1)[start - a * BLOCK : end - a * BLOCK]


def write_token_files(verdicts: DataFrame, path: str, folder: str) -> None:
    """Encode every verdict's notes and write the ids to files below a new folder, in ascending order of event_id.

    Input: event_id (long), notes (text; null is empty); other columns are ignored. `path` is a vocabulary file of the
    tokenizers library, present on every machine; strings of its added tokens inside notes are those tokens. Every
    verdict ends with id 0, so empty notes are one id. Verdicts without an id come last; equal ids are ordered by a
    hash of their notes, then the notes; repeated rows are written as often as they come. No verdict gives no file.

    Rows are dealt into ranges of event_id, so one shuffle moves the texts, and each task encodes its range in order
    and holds at most one file's ids, 2,000,000 and the verdict that crosses them. An id that many rows share is
    dealt over several ranges.
    """
    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = encoder(path), TaskContext.get().partitionId(), 0
        keys, ids, total = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = encode(text) if text else np.zeros(0, np.uint32)
                keys.append(key)
                ids.append(np.append(found, np.uint32(END_ID)))
                total += len(found) + 1
                if total >= FILE_IDS:
                    # The text writer ends each value with a line break: a file's last byte.
                    yield pa.RecordBatch.from_arrays([pa.array([token_file(keys, ids, part, number)[:-1]], pa.binary())], names=["value"])
                    keys, ids, total, number = [], [], 0, number + 1
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([token_file(keys, ids, part, number)[:-1]], pa.binary())], names=["value"])

    short_batches(verdicts.sparkSession)
    rows = verdicts.select(F.col("event_id").cast("long").alias("event_id"), F.col("notes").cast("string").alias("notes"))
    order = [F.col("event_id").asc_nulls_last(), F.xxhash64("notes")]
    rows = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order, "notes")
    values = rows.mapInArrow(files, "value binary").select(F.col("value").cast("string").alias("value"))
    values.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every verdict in the files below a folder: event_id, part, number, first (its place among its file's ids), n_tokens,
    ids (bytes: unsigned 32-bit little-endian integers, with the end id). A broken file is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = TokenFile(content.as_py())
                starts, a = file.starts, 0
                while a < len(starts) - 1:
                    b = max(a + 1, int(np.searchsorted(starts, starts[a] + BATCH_IDS, side="right")) - 1)
                    data = file.ids(int(starts[a]), int(starts[b])).astype("<u4", copy=False)
                    n = b - a
                    bounds = ((starts[a : b + 1] - starts[a]) * 4).astype(np.int32)
                    ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
                    same = lambda x: pa.array(np.full(n, x, np.int64))
                    columns = [file.event_ids.slice(a, n), same(file.part), same(file.number), pa.array(starts[a:b]), pa.array(np.diff(starts[a : b + 1])), ids]
                    yield pa.RecordBatch.from_arrays(columns, names=["event_id", "part", "number", "first", "n_tokens", "ids"])
                    a = b

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, "event_id long, part long, number long, first long, n_tokens long, ids binary")


def with_starts(rows: DataFrame) -> DataFrame:
    """Rows of read_token_files, or some of their columns, with `start`: the ids of all verdicts before, over all files.

    Needs part, number, first and n_tokens, and every verdict. Sums go up in two steps: the files of a part, then the parts.
    """
    rows = written(rows, "token-index")
    files = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("_ids"))
    before = lambda w: F.coalesce(F.sum("_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("_ids").alias("_ids")).select("part", before(Window.orderBy("part")).alias("_part_start"))
    files = files.select("part", "number", before(Window.partitionBy("part").orderBy("number")).alias("_file_start"))
    starts = files.join(parts, "part").select("part", "number", (F.col("_part_start") + F.col("_file_start")).alias("_start"))
    return rows.join(starts, ["part", "number"]).withColumn("start", F.col("_start") + F.col("first")).drop("_start")
