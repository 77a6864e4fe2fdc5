"""Web-archive records of evidence files: writing with segments and revisits, reading back with reassembly.

The record is an evidence file of an event: `event_id`, its `path`, and its bytes `data`.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, sparing, written

#: Payloads from this size on are stored once.
SHARED_BYTES = 100
#: A record's block beyond this size is cut into segments.
SEGMENT_BYTES = 64 * 1024
CHUNK_BYTES = 8 * 1024
#: Records of one archive file.
RECORDS_PER_FILE = 2000
#: Bytes of records that a task hands on at once.
HELD_BYTES = 8_000_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: application/octet-stream\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [payload[i : i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload inside chunked framing; chunk extensions and trailers are ignored. ValueError where the framing breaks."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP head")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(kind: str, record_id: str, date: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _text(value: str | None) -> str | None:
    """A header value without line breaks; `unquote` gives the text back."""
    return None if value is None else quote(value, safe="/:?&=#+,;@!$'()*~[]")


def with_first(evidence: DataFrame) -> DataFrame:
    """event_id, path, data, digest, and first_event_id where the bytes are those of an earlier event.

    The smallest event_id with the same bytes, from SHARED_BYTES on, keeps them (nulls are the largest; rows that
    repeat that id all keep them). Small payloads get join keys of their own, so that nothing gathers on a common one.
    """
    rows = evidence.select("event_id", F.col("path").cast("string").alias("path"), F.coalesce(F.col("data").cast("binary"), F.lit(b"")).alias("data"))
    rows = rows.withColumn("digest", F.sha2("data", 256)).withColumn("size", F.octet_length("data"))
    firsts = rows.filter(F.col("size") >= SHARED_BYTES).groupBy("digest").agg(F.min("event_id").alias("first_event_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("_key"), "first_event_id")
    key = F.when(F.col("size") >= SHARED_BYTES, F.col("digest")).otherwise(F.md5(F.coalesce(F.col("event_id").cast("string"), F.col("path"), F.lit(""))))
    joined = rows.withColumn("_key", key).join(firsts, "_key", "left")
    later = F.col("first_event_id").isNotNull() & ~F.col("event_id").eqNullSafe(F.col("first_event_id"))
    return joined.select("event_id", "path", F.when(~later, F.col("data")).alias("data"), "digest", F.when(later, F.col("first_event_id")).alias("first_event_id"))


def write_archives(evidence: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one response or revisit record per row as gzipped archives below `folder`.

    Input: event_id (any type), path (text), data (bytes or text; null is empty); other columns are ignored. A block
    longer than `segment_bytes` becomes a first segment and continuation records. Record ids come from the writing
    task, whose file counts only once it is whole, so a lost executor leaves no half of a record. Event ids are kept in
    the extension fields WARC-Event-ID and WARC-Refers-To-Event-ID.
    """
    write_id = uuid.uuid4().hex

    def handed(out: list[bytes]) -> pa.RecordBatch:
        # The text writer ends each value with a line break: the last byte of a record.
        return pa.RecordBatch.from_arrays([pa.array([r[:-1] for r in out], pa.binary())], names=["record"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, n = f"{write_id}-{TaskContext.get().partitionId()}", 0
        for batch in batches:
            out: list[bytes] = []
            held = 0
            # Row by row: a batch is not held a second time as Python values.
            for i in range(batch.num_rows):
                event_id, path, data, digest, first = (c[i].as_py() for c in batch.columns)
                held += len(data or b"")
                if held > HELD_BYTES:
                    yield handed(out)
                    out, held = [], len(data or b"")
                own = f"<urn:evidence:{prefix}-{n}>"
                n += 1
                fields = [("WARC-Target-URI", _text(path)), ("WARC-Event-ID", None if event_id is None else quote(event_id)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
                if first is not None:
                    out.append(_record("revisit", own, date, [*fields, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Event-ID", quote(first))], HTTP_HEAD))
                    continue
                block = HTTP_HEAD + chunked(data)
                if len(block) <= segment_bytes:
                    out.append(_record("response", own, date, fields, block))
                    continue
                out.append(_record("response", own, date, [*fields, ("WARC-Segment-Number", "1")], block[:segment_bytes]))
                starts = range(segment_bytes, len(block), segment_bytes)
                for number, at in enumerate(starts, 2):
                    more = [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(number))]
                    if at == starts[-1]:
                        more.append(("WARC-Segment-Total-Length", str(len(block))))
                    out.append(_record("continuation", f"<urn:evidence:{prefix}-{n}>", date, more, block[at : at + segment_bytes]))
                    n += 1
            yield handed(out)

    short_batches(evidence.sparkSession)
    rows = with_first(evidence).select(F.col("event_id").cast("string"), "path", "data", "digest", F.col("first_event_id").cast("string"))
    lines = rows.mapInArrow(sparing(records), "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").option("lineSep", "\n").text(folder)


def _unzipped(content: bytes) -> Iterator[bytes]:
    """Pieces of at most 1 MB of a file of one or more gzip members."""
    while content:
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(content, 1 << 20)
            content = member.unconsumed_tail
            if piece:
                yield piece
            elif not content and not member.eof:
                raise ValueError("the archive ends early")
        content = member.unused_data


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record; the field `version` is its first line."""
    held = bytearray()

    def need(size: int) -> bool:
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        end = -1
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not need(len(held) + 1):
                if bytes(held).strip():
                    raise ValueError("the archive ends inside a record's head")
                return
        first, *lines = bytes(held[:end]).decode().split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)} | {"version": first}
        size = int(fields["content-length"])
        if not need(end + 8 + size):
            raise ValueError("the archive ends inside a record")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]
        yield fields, block


def _described(fields: dict[str, str]) -> list[str | None]:
    text = lambda k: None if fields.get(k) is None else unquote(fields[k])
    return [text("warc-event-id"), text("warc-target-uri"), fields.get("warc-type"), text("warc-refers-to-event-id"), (fields.get("warc-payload-digest") or "").removeprefix("sha256:") or None]


DESCRIBED = "event_id string, path string, record_type string, refers_to string, digest string"


def _scan(spark: SparkSession, folder: str, segments: bool) -> DataFrame:
    """Whole records with their payload, or the segments of the others, as they lie in the archives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parsed(_unzipped(content.as_py())):
                    number = fields.get("warc-segment-number")
                    if (number is not None) != segments:
                        continue
                    if segments:
                        row = (*_described(fields), fields.get("warc-segment-origin-id") or fields["warc-record-id"], int(number), int(fields.get("warc-segment-total-length", 0)), block)
                    else:
                        payload, problem = _opened(block, fields.get("warc-type"))
                        row = (*_described(fields), payload, problem)
                    rows.append(row)
                    held += len(block)
                    if held > HELD_BYTES:
                        yield _batch(rows, kinds)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds)

    texts = [pa.string()] * 5
    kinds = [*texts, pa.string(), pa.int32(), pa.int64(), pa.binary()] if segments else [*texts, pa.binary(), pa.string()]
    schema = DESCRIBED + (", origin_id string, number int, total long, block binary" if segments else ", payload binary, problem string")
    short_batches(spark)
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(sparing(run), schema)


def _batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f"c{i}" for i in range(len(kinds))])


def _opened(block: bytes, kind: str | None) -> tuple[bytes | None, str | None]:
    if kind == "revisit":
        return None, None
    try:
        return http_payload(block), None
    except ValueError as e:
        return None, str(e)


def _reassembled(parts: pd.DataFrame) -> pd.DataFrame:
    """One record of its segments: all numbers from 1 on, and the length that the last one states."""
    parts = parts.sort_values("number")
    first, block = parts.iloc[0], b"".join(parts["block"])
    payload, problem = None, None
    if list(parts["number"]) != list(range(1, len(parts) + 1)):
        problem = "segments are missing or repeated"
    elif int(parts["total"].iloc[-1]) != len(block):
        problem = "the segments' length is not the stated total"
    else:
        payload, problem = _opened(block, first["record_type"])
    return pd.DataFrame([[*(first[c] for c in ("event_id", "path", "record_type", "refers_to", "digest")), payload, problem]], columns=["event_id", "path", "record_type", "refers_to", "digest", "payload", "problem"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives below a folder.

    Result: event_id, path, record_type, refers_to (an event_id), digest (as stated), payload (bytes; null for revisits and
    broken records), problem (null, or why there is no payload). Whole records are opened where they are read; only the
    segments of cut ones are shuffled, grouped by the first one's id. A group is one record.
    """
    cut = _scan(spark, folder, True).groupBy("origin_id").applyInPandas(_reassembled, DESCRIBED + ", payload binary, problem string")
    return _scan(spark, folder, False).unionByName(cut)


def resolved(records: DataFrame) -> DataFrame:
    """event_id, path, record_type, refers_to, payload_bytes, payload_digest, problem; a revisit has the figures of the record it refers to.

    A revisit whose target is not there, or has another digest, has null figures and a problem.
    """
    rows = records.select("event_id", "path", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "problem")
    rows = rows.withColumn("problem", F.coalesce("problem", F.when(F.col("payload_digest") != F.col("digest"), F.lit("the payload's digest is not the stated one"))))
    rows = written(rows, "warc-records")
    held = rows.filter("record_type = 'response' AND payload_digest IS NOT NULL").groupBy(F.col("event_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("_bytes"))
    again = rows.filter("record_type = 'revisit'").join(held, ["refers_to", "digest"], "left")
    again = again.select("event_id", "path", "record_type", "refers_to", F.col("_bytes").alias("payload_bytes"), F.when(F.col("_bytes").isNotNull(), F.col("digest")).alias("payload_digest"), F.when(F.col("_bytes").isNull(), F.lit("no such record to refer to")).alias("problem"))
    return rows.filter("record_type IS DISTINCT FROM 'revisit'").drop("digest").unionByName(again)
