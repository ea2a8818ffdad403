"""Benchmark decontamination: a set of normalised test n-grams is scanned over training token windows.

The windows of the benchmark are hashed. Up to ``MAX_WINDOWS`` of them, of ``MAX_BYTES`` in all,
are broadcast as one sorted array, each with its words, so that every hit is verified word by
word in the task that found it. Beyond that a bitmap of fixed size of their hashes is
broadcast: only document windows that it holds, the true ones and some by chance, are joined
with the benchmark on hash and words; the result is the same.

Defined results: a null or empty text has no words, is never hit and never an item; an item
of fewer words than the window is one window of its own length; an item without an id is
not read; rows without a doc_id are judged like others; equal windows of several
items count for each of them; repeated documents are judged one by one; extra columns of
either table are ignored by ``scan`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gullwatch.llm.common import LOWER, WORD_BYTES, gram_hashes, kept_table, long_column, pieces, range_hashes, utf8, word_bounds

#: Words of a window, and the most benchmark windows that are broadcast, and bytes of their words.
WINDOW = 10
MAX_WINDOWS, MAX_BYTES = 200_000, 64 << 20
#: Bits of the bitmap that stands for more windows.
BITMAP_BITS = 1 << 28

_SCAN = "doc_id long, n_words long, spans binary, items array<long>"


def _normal(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each distinct window of each item: its hash, length in words and words."""
    for batch in pieces(batches, "text"):
        ids = long_column(batch, "item_id")
        data, at = utf8(batch.column(batch.schema.get_field_index("text")))
        data = _normal(data)
        starts, ends, first = word_bounds(data, at, WORD_BYTES)
        codes, raw = range_hashes(data, starts, ends), data.tobytes()
        out: list[tuple] = []
        for i, item in enumerate(ids):
            a, b = int(first[i]), int(first[i + 1])
            n = min(window, b - a)
            if n == 0:
                continue
            seen = set()
            for j, h in enumerate(gram_hashes(codes[a:b], n)):
                words = b" ".join(raw[starts[a + j + k] : ends[a + j + k]] for k in range(n))
                if words not in seen:
                    seen.add(words)
                    out.append((int(h.view(np.int64)), n, words, int(item)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.int64()))],
            names=["hash", "n", "words", "item_id"],
        )


def _windows(data: np.ndarray, at: np.ndarray, sizes: list[int]):
    """Word bounds of the rows, and for each window length the hash and row of every window."""
    starts, ends, first = word_bounds(data, at, WORD_BYTES)
    codes = range_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return starts, ends, first, row, codes, {n: gram_hashes(codes, n) for n in sizes}


def scan_batches(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """Hit words and items of each document, from the broadcast windows."""
    hashes, by_hash, sizes = table.value
    for batch in pieces(batches, "text"):
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        data, at = utf8(batch.column(batch.schema.get_field_index("text")))
        data = _normal(data)
        starts, ends, first, row, _, grams = _windows(data, at, sizes)
        found: dict[int, tuple[list, set]] = {}
        for n, grown in grams.items():
            if not len(grown):
                continue
            place = np.searchsorted(hashes[n], grown)
            place[place == len(hashes[n])] = 0
            hits = np.flatnonzero(hashes[n][place] == grown)
            for j in hits[row[hits] == row[hits + n - 1]]:
                words = b" ".join(data[starts[j + k] : ends[j + k]].tobytes() for k in range(n))
                items = by_hash.get((n, words))
                if items is not None:
                    spans, of = found.setdefault(int(row[j]), ([], set()))
                    spans.append((int(j), n))
                    of.update(items)
        spans, items = [], []
        for i in range(batch.num_rows):
            hit, of = found.get(i, ((), ()))
            marks = np.zeros(int(first[i + 1] - first[i]), bool) if hit else None
            for j, n in hit:
                marks[j - first[i] : j - first[i] + n] = True
            spans.append(_byte_spans(marks, starts[first[i] : first[i + 1]] - at[i], ends[first[i] : first[i + 1]] - at[i]) if hit else b"")
            items.append(sorted(of))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(np.diff(first)), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.int64()))],
            names=["doc_id", "n_words", "spans", "items"],
        )


def _byte_spans(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Runs of hit words as (first byte, end byte, words) in 64-bit numbers."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return np.stack([starts[a], ends[b - 1], b - a], 1).astype(np.int64).tobytes()


def benchmark_windows(spark: SparkSession, benchmark: DataFrame, window: int, max_windows: int):
    """The table of windows, and their broadcast if there are at most ``max_windows``."""
    windows = kept_table(
        benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            lambda batches: item_windows(batches, window), "hash long, n int, words binary, item_id long"
        ),
        "windows",
    )
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("bytes")).first()
    if size.n > max_windows or size.bytes > MAX_BYTES:
        return windows, None
    rows = windows.collect()
    by_hash: dict = {}
    for r in rows:
        by_hash.setdefault((r.n, bytes(r.words)), []).append(r.item_id)
    sizes = sorted({r.n for r in rows})
    hashes = {n: np.unique(np.array([r.hash for r in rows if r.n == n], np.int64).view(np.uint64)) for n in sizes}
    return windows, spark.sparkContext.broadcast((hashes, by_hash, sizes))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, spans (hit byte ranges, packed) and items of every document.

    Up to ``max_windows`` benchmark windows are broadcast; beyond it ``scan_joined`` takes over.
    """
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows, table = benchmark_windows(docs.sparkSession, benchmark, window, max_windows)
    if table is None:
        return scan_joined(taken, windows)
    return taken.mapInArrow(lambda batches: scan_batches(batches, table), _SCAN)


def scan_joined(taken: DataFrame, windows: DataFrame) -> DataFrame:
    """The same rows for any number of benchmark windows: document windows are joined on their hash and words.

    Equal windows are joined once for all their items; the items come back by document.
    """
    per_doc = _joined_hits(taken, windows).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("j", "n", "a", "b")).alias("hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    counts = taken.mapInArrow(lambda batches: _document_words(batches), "doc_id long, row_key long, n_words long")
    per_doc = per_doc.select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"), "hit", "items")
    merged = counts.join(per_doc, counts["doc_id"].eqNullSafe(per_doc["_doc"]) & (counts["row_key"] == per_doc["_key"]), "left").select("doc_id", "n_words", "hit", "items")
    return merged.mapInArrow(_merge_hits, _SCAN)


def _joined_hits(taken: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window of a document (by id and row key) that is a benchmark window, once for every item."""
    return candidate_windows(taken, windows).join(windows, ["hash", "n", "words"])


def candidate_windows(taken: DataFrame, windows: DataFrame) -> DataFrame:
    """The document windows whose hash may be that of a benchmark window."""
    sizes = [r.n for r in windows.select("n").distinct().collect()]  # at most the window length
    bitmap = hash_bitmap(windows)
    return taken.mapInArrow(lambda batches: _document_windows(batches, sizes, bitmap), "doc_id long, row_key long, j int, hash long, n int, words binary, a int, b int")


def hash_bitmap(windows: DataFrame):
    """A broadcast bit for every hash modulo ``BITMAP_BITS``, whatever the number of windows."""
    bit = F.pmod(F.col("hash"), F.lit(BITMAP_BITS))
    made = windows.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in made.toLocalIterator():  # BITMAP_BITS in all
        at = (r.bucket - 1) * 4096
        bitmap[at : at + 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return windows.sparkSession.sparkContext.broadcast((BITMAP_BITS, bitmap))


def _held(hashes: np.ndarray, bitmap) -> np.ndarray:
    bits, own = bitmap.value
    at = (hashes & np.uint64(bits - 1)).astype(np.int64)  # a power of two: the remainder of the signed number too
    return (own[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _row_key(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return range_hashes(data, at[:-1], at[1:]).view(np.int64)


def _document_windows(batches: Iterator[pa.RecordBatch], sizes: list[int], bitmap) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        raw, at = utf8(batch.column(batch.schema.get_field_index("text")))
        data, keys = _normal(raw), _row_key(raw, at)
        starts, ends, first, row, _, grams = _windows(data, at, sizes)
        for n, grown in grams.items():
            ok = np.flatnonzero((row[: len(grown)] == row[n - 1 : n - 1 + len(grown)]) & _held(grown, bitmap))
            for part in np.array_split(ok, max(1, len(ok) // 20_000)):
                words = [b" ".join(data[starts[j + k] : ends[j + k]].tobytes() for k in range(n)) for j in part]
                own = row[part]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(own)), pa.array(keys[own]), pa.array((part - first[own]).astype(np.int32)), pa.array(grown[part].view(np.int64)), pa.array(np.full(len(part), n, np.int32)), pa.array(words, pa.binary()), pa.array((starts[part] - at[own]).astype(np.int32)), pa.array((ends[part + n - 1] - at[own]).astype(np.int32))],
                    names=["doc_id", "row_key", "j", "hash", "n", "words", "a", "b"],
                )


def _keyed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows as they are, and their row key."""
    for batch in batches:
        keys = [_row_key(*utf8(piece.column(piece.schema.get_field_index("text")))) for piece in pieces(iter([batch]), "text")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))], names=[*batch.schema.names, "_row_key"])


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        raw, at = utf8(batch.column(batch.schema.get_field_index("text")))
        _, _, first = word_bounds(raw, at, WORD_BYTES)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(_row_key(raw, at)), pa.array(np.diff(first))], names=["doc_id", "row_key", "n_words"])


def _merge_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for hit in batch.column(batch.schema.get_field_index("hit")).to_pylist():
            runs: list[list[int]] = []
            for h in sorted(hit or (), key=lambda x: x["j"]):
                if runs and h["j"] <= runs[-1][3]:
                    if h["j"] + h["n"] > runs[-1][3]:
                        runs[-1][1], runs[-1][3] = h["b"], h["j"] + h["n"]
                else:
                    runs.append([h["a"], h["b"], h["j"], h["j"] + h["n"]])
            spans.append(np.array([(a, b, w - v) for a, b, v, w in runs], np.int64).tobytes())
        items = [x or [] for x in batch.column(batch.schema.get_field_index("items")).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("n_words")), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.int64()))],
            names=["doc_id", "n_words", "spans", "items"],
        )


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
        items = batch.column(batch.schema.get_field_index("items")).to_pylist()
        hit = [int(np.frombuffer(s, np.int64).reshape(-1, 3)[:, 2].sum()) if s else 0 for s in spans]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("doc_id")),
                batch.column(batch.schema.get_field_index("n_words")),
                pa.array(hit, pa.int64()),
                pa.array([len(x or ()) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(map(str, x or ()))).encode()).hexdigest() for x in items], pa.string()),
                pa.array([h > 0 for h in hit], pa.bool_()),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: its words, hit words and occurring items."""
    return scan(docs, benchmark, window).mapInArrow(digest_batches, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _clean_batches(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """The rows without a hit, every column as it is."""
    for batch in pieces(batches, "text"):
        own = batch.select(["doc_id", "text"])
        hit = [size for scanned in scan_batches(iter([own]), table) for size in scanned.column(3).value_lengths().to_pylist()]
        yield batch.filter(pa.array([not n for n in hit], pa.bool_()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Drop documents with a hit; the others keep every column. Without a shuffle while the windows are bounded.

    Beyond that rows are told apart by id and text, so rows of one id are judged one by one too.
    """
    windows, table = benchmark_windows(docs.sparkSession, benchmark, window, max_windows)
    if table is not None:
        return docs.mapInArrow(lambda batches: _clean_batches(batches, table), docs.schema)
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hit = _joined_hits(taken, windows).select(F.col("doc_id").alias("_hit"), F.col("row_key").alias("_hit_key")).distinct()
    keyed = docs.mapInArrow(_keyed_batches, StructType([*docs.schema, StructField("_row_key", LongType())]))
    clean = keyed.join(hit, keyed["doc_id"].cast("long").eqNullSafe(hit["_hit"]) & (keyed["_row_key"] == hit["_hit_key"]), "left_anti")
    return clean.drop("_row_key")
