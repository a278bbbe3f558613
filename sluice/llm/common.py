"""Shared pieces of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters as bytes.split() and str.split(None) on ASCII text separate by.
SPACES = " \t\n\r\x0b\x0c"
#: Texts are handed to vectorised code in chunks of about so many characters.
CHUNK = 1_000_000


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not use yet."""
    used = {c.lower() for c in df.columns}
    name = base
    while name.lower() in used:
        name = f"_{name}"
    return name


def trim() -> None:
    """Give freed memory back: Python workers outlive their tasks, and an executor's limit counts what they hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a function of one batch that yields batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        trim()

    return df.mapInArrow(run, schema)


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` characters each; a longer text is a chunk of its own."""
    return _ranges((len(text) if text else 0 for text in texts), limit)


def _ranges(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    start, size, end = 0, 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
        end = i + 1
    if start < end:
        yield start, end


def slices(batch: pa.RecordBatch, at: int, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """All rows of a batch, in slices whose texts (column `at`) hold about `limit` bytes each; nothing is copied, so a batch's texts need never be Python strings all at once."""
    for a, b in _ranges(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), limit):
        yield batch.slice(a, b - a)


def sample_texts(docs: DataFrame, text: str, rows: int, size: int) -> list[str]:
    """The whole texts with the `rows` smallest distinct hashes over all rows, as far as they hold `size` bytes together; no layout of the rows changes them."""
    hashed = docs.select(docs[text].alias("t")).where(F.col("t") != "").withColumn("h", F.xxhash64("t"))
    least = hashed.groupBy("h").agg(F.max(F.octet_length("t")).alias("n")).orderBy("h").limit(rows).collect()
    taken, left = [], size
    for r in least:
        if r["n"] <= left:
            taken.append(r["h"])
            left -= r["n"]
    if not taken:
        return []
    found = hashed.where(F.col("h").isin(taken)).groupBy("h").agg(F.min("t").alias("t")).collect()
    return [r["t"] for r in sorted(found, key=lambda r: r["h"])]


def word_count(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
