"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.scale import c, materialize  # noqa: F401  (re-exported)

#: A word of a text: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, *cols: Column) -> Column:
    """A non-negative 63-bit pseudo-random number fixed by the seed and the values."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; the keys appear once, from the left."""
    other = right.select(*[c(k).alias(f"__r_{k}") if k in keys else c(k) for k in right.columns])
    on = None
    for k in keys:
        term = c(k).eqNullSafe(c(f"__r_{k}"))
        on = term if on is None else on & term
    return left.join(other, on, how).drop(*[f"__r_{k}" for k in keys])


def boxed(docs: DataFrame, **extra: Column) -> DataFrame:
    """The rows as one struct ``row`` beside columns of our own, whose names then clash with none of theirs."""
    return docs.select(F.struct(*[c(k) for k in docs.columns]).alias("row"), *[v.alias(k) for k, v in extra.items()])


def unboxed(df: DataFrame, columns: Sequence[str], *more: str) -> DataFrame:
    """The columns of boxed rows again, and ``more`` of the others."""
    return df.select(*[F.col("row").getField(k).alias(k) for k in columns], *more)


def ranked(df: DataFrame, keys: Sequence[str], h: str, ties: Sequence[str], name: str, bucket_rows: int = 256) -> DataFrame:
    """Add the 0-based rank by (``h``, ``ties``) within ``keys``; no key's rows meet in one task.

    ``h`` is a pseudo-random 63-bit number (``seeded``). A key's rows fall into consecutive value ranges of about
    ``bucket_rows`` rows, as many as its size asks for; ranks are counted inside a range and shifted by the sizes of the
    ranges before it. ``df`` is read three times, so pass a stored table.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    buckets = F.ceil(F.col("__n") / bucket_rows)
    at = F.least(F.floor(c(h).cast("double") / F.lit(float(2**63)) * buckets), buckets - 1)
    placed = join_null_safe(df, sizes, keys).withColumn("__b", at.cast("long")).drop("__n")
    counts = placed.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__m"))
    before = Window.partitionBy(*[c(k) for k in keys]).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__b", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(*[c(k) for k in keys], F.col("__b")).orderBy(c(h), *[c(t) for t in ties])
    rows = placed.withColumn("__i", F.row_number().over(inside) - 1)
    return join_null_safe(rows, offsets, [*keys, "__b"]).withColumn(name, (F.col("__o") + F.col("__i")).cast("long")).drop("__b", "__i", "__o")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row starts and ends; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``most_bytes`` of text at most (a longer text is a slice of its own).

    Between slices the allocators give back what is free, so a worker holds what one slice needs, not the most so far.
    """
    for batch in batches:
        _, starts, ends = text_bytes(batch.column(column))
        slot = (np.cumsum(ends - starts) - (ends - starts)) // most_bytes
        cut = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        for a, b in zip(cut, np.append(cut[1:], len(slot))):
            yield batch.slice(int(a), int(b - a))
            release_memory()


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
