"""Shared helpers: table access, bounded Arrow batches, vectorised words and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.session import materialize

__all__ = [
    "DOCUMENTS", "bounded_batches", "documents", "materialize", "rolling_hash", "sampled_labels",
    "slices", "table", "tasks_for", "train_labels", "word_spans",
]

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts are worked on in slices of about so many bytes, whatever the batch holds.
SLICE_BYTES = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches small, so that long texts cannot fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def tasks_for(n_rows: int, per_task: int) -> int:
    return max(1, -(-n_rows // per_task))


def train_labels(labels: DataFrame, column: str) -> DataFrame:
    """Labels that may be learnt from: crc32 of the id as text, mod 5, is not 0.

    Repeated ids with the same label collapse; ids with contradicting labels are left out.
    """
    return (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .groupBy("doc_id")
        .agg(F.min(column).cast("int").alias("label"), F.max(column).cast("int").alias("_top"))
        .where(F.col("label") == F.col("_top"))
        .drop("_top")
    )


def slices(
    batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi of a batch with their UTF-8 bytes and offsets from 0; null counts as empty."""
    array = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    n = len(array)
    if not n:
        return
    _, at, raw = array.buffers()
    ends = np.frombuffer(at, np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def word_spans(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes for which the 256-entry table is true.

    Runs end at row borders.
    """
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = is_word[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:]
    begin = np.flatnonzero(start)
    end = np.flatnonzero(stop) + 1
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    global _powers
    if _powers is None or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def rolling_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span begin..end of the bytes, equal for equal spans anywhere."""
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    value = (total[end] - total[begin]) * down[begin]
    value ^= value >> np.uint64(32)
    value *= _MIX
    value ^= value >> np.uint64(29)
    return value


def sampled_labels(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """About ``bound`` training labels at most, chosen by a hash of the id; small enough to send."""
    known = train_labels(labels, column)
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < bound)
    return F.broadcast(known)
