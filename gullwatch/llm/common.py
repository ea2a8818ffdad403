"""Small helpers the operators of this folder share: text as byte arrays, word hashes, lineage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gullwatch.session import scratch_path

#: Bytes of text handled at once inside a task; one longer text is handled alone.
CHUNK_BYTES = 1 << 20


def settings(spark: SparkSession) -> SparkSession:
    """Arrow batches of few rows, so that a task holds little text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: later steps neither recompute nor depend on executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # nothing waits for the marker of a finished write, which costs the driver a file and, on a local disk, a forked process
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_fold(key: Column, folds: int) -> Column:
    return F.crc32(key.cast("string")) % F.lit(folds)


def bounded_sample(df: DataFrame, turn: Column, rows: int, most: int) -> DataFrame:
    """At most ``most`` of ``rows`` rows, drawn by the hash ``turn``.

    About twice as many pass the filter, whatever the number of partitions, so no task
    gathers more than it needs.
    """
    share = min(1.0, 2 * most / max(rows, 1))
    return df.where(F.pmod(turn, F.lit(1 << 31)) < F.lit(int(share * (1 << 31)))).limit(most)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offset of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def long_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


# ---- words as numbers -------------------------------------------------------------------

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.RandomState(20240229).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n, kept for the next call."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, CHUNK_BYTES + 2)
        table = np.empty(size, np.uint64)
        table[0] = 1
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            table[filled : filled + step] = table[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
        _powers[base] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower_table() -> np.ndarray:
    """Byte to byte, A-Z to lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()
#: Words between white space, and words of letters, digits and bytes from 0x80.
NOT_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
WORD_BYTES = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A for b in range(256)])


def word_bounds(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the number of words before it (one more entry)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    is_word = inside[data]
    before, after = np.empty_like(is_word), np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    after[-1], after[:-1] = False, is_word[1:]
    edges = at[(at > 0) & (at < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal ranges have equal hashes wherever they lie."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _power_table(_BASE, len(data))[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power_table(_INVERSE, len(data) + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """:func:`range_hashes` of the ``n`` bytes from each place on."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _power_table(_BASE, len(data))[: len(data)], out=sums[1:])
    raw = sums[n:] - sums[:m]
    raw *= _power_table(_INVERSE, len(data) + 1)[:m]
    raw += np.uint64(n * 0xD6E8FEB86659FD93 & _MASK)
    return mix(raw)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; positions too near the end are left out."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += words[j : j + m] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64))
    return mix(total)


def row_starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
