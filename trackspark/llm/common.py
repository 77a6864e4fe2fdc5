"""What the operators of this subpackage share: shared-folder tables, word rules, stable hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from trackspark.session import written  # noqa: F401

#: Words end at ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same two rules for bytes.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


#: Rows and bytes of whole texts that go to Python at once.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def short_batches(spark: SparkSession) -> None:
    """Rows of whole texts go to Python in batches of at most 2,000 rows and 8 MB, where the session allows more."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(str(spark.conf.get(key)).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return freed memory to the machine: Python workers outlive a stage and would keep it beside the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def sparing(task: Callable) -> Callable:
    """A task over batches that gives its memory back when it is through."""
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def hash60(value: Column) -> Column:
    """60 bits of the MD5 of a value's text as a long; SQL engines compute the same."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def pieces(total: float | None, each: float, least: int = 1) -> int:
    """How many parts of a given size a total needs."""
    return max(least, int(-(-(total or 0) // each)))
