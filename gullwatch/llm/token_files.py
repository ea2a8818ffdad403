"""Token-id files: one zstandard frame per document, one shared dictionary.

A token file is a Parquet folder that Spark writes and reads, so that lost tasks leave no
half files. A row is one block of at most ``BLOCK_BYTES`` of frames: its shard and number,
the token count of its shard before it, the dictionary's hash, and the offset index (ids of
the documents, token counts, frame offsets) beside the frames. The index columns are read
without the frames, and one document needs its own frame only. Blocks lie in ascending
doc_id order; a shard is one range of ids. The dictionary is trained on the serialized ids
of ``SAMPLE`` documents at most, drawn by hashes of their ids.

Defined results: null and empty texts hold the end id only; a null doc_id comes first;
documents with one id stand in the order of their text hash; an empty table gives empty
files and no dictionary; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gullwatch.llm.common import bounded_sample, pieces
from gullwatch.llm.tokens import encoded
from gullwatch.session import scratch_path

SAMPLE = 2_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
BLOCK_BYTES = 1 << 20
#: Ids are stored in two bytes, for vocabularies of up to 65,536 ids.
STORED = np.dtype("<u2")

_FRAMES = "doc_id long, tie long, n_tokens long, frame binary"
_BLOCKS = "shard long, block long, start long, dictionary string, doc_ids array<long>, counts array<long>, offsets array<long>, frames binary"


def _at(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _serialized(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        ids, bounds = encoded(batch, path, end_id)
        if len(ids) and int(ids.max()) > np.iinfo(STORED).max:
            raise ValueError("an id does not fit the stored width")
        raw = [ids[a:b].astype(STORED).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([_at(batch, "doc_id"), _at(batch, "tie"), pa.array(np.diff(bounds)), pa.array(raw, pa.binary())], names=["doc_id", "tie", "n_tokens", "frame"])


def _compressed(batches: Iterator[pa.RecordBatch], path: str, end_id: int, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    compress = _compressor(dictionary)
    for batch in _serialized(batches, path, end_id):
        frames = [compress(x) for x in _at(batch, "frame").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(frames, pa.binary())], names=batch.schema.names)


def _compressor(dictionary: bytes):
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_dict_id=False).compress


def _decompressor(dictionary: bytes):
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=own).decompress


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()[:16]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary of the samples; empty when they are too few or too small to train on."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), samples, k=256, d=8).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def _blocks(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Sorted frames of one shard, gathered into blocks."""
    shard, block, start = TaskContext.get().partitionId(), 0, 0
    ids, counts, offsets, frames = [], [], [0], []

    def row() -> pa.RecordBatch:
        values = [[shard], [block], [start], [name], [ids], [counts], [offsets], [b"".join(frames)]]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["shard", "block", "start", "dictionary", "doc_ids", "counts", "offsets", "frames"])

    for batch in batches:
        for doc, n, frame in zip(*(_at(batch, c).to_pylist() for c in ("doc_id", "n_tokens", "frame"))):
            if ids and offsets[-1] + len(frame) > BLOCK_BYTES:
                yield row()
                block, start = block + 1, start + sum(counts)
                ids, counts, offsets, frames = [], [], [0], []
            ids.append(doc)
            counts.append(n)
            frames.append(frame)
            offsets.append(offsets[-1] + len(frame))
    if ids:
        yield row()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, shards: int | None = None) -> None:
    """Encode every text and write ``folder``/blocks, /dictionary and /shards.

    Frames are made where the texts are read; only they are dealt out by ranges of doc_id.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    chosen = bounded_sample(own, F.xxhash64("doc_id"), docs.count(), SAMPLE)
    samples = [bytes(r.frame) for r in chosen.mapInArrow(lambda b: _serialized(b, tokenizer, end_id), _FRAMES).select("frame").collect()]
    dictionary = train_dictionary(samples)
    name = dictionary_hash(dictionary)
    spark.createDataFrame([(name, bytearray(dictionary))], "hash string, bytes binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    own.mapInArrow(lambda b: _compressed(b, tokenizer, end_id, dictionary), _FRAMES).write.parquet(f"{folder}/unsorted")
    frames = spark.read.schema(_FRAMES).parquet(f"{folder}/unsorted")
    ordered = frames.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    ordered.mapInArrow(lambda b: _blocks(b, name), _BLOCKS).write.parquet(f"{folder}/blocks")
    totals = _read_blocks(spark, folder).select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before, bases = 0, []
    for r in totals.orderBy("shard").collect():  # one row a shard
        bases.append((r.shard, before))
        before += r.n
    spark.createDataFrame(bases, "shard long, base long").coalesce(1).write.parquet(f"{folder}/shards")


def _read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")


def _opened(spark: SparkSession, folder: str) -> tuple[bytes, dict[int, int]]:
    (row,) = spark.read.schema("hash string, bytes binary").parquet(f"{folder}/dictionary").collect()
    dictionary = bytes(row.bytes)
    if dictionary_hash(dictionary) != row.hash:
        raise ValueError("the dictionary does not match its hash")
    return dictionary, {r.shard: r.base for r in spark.read.schema("shard long, base long").parquet(f"{folder}/shards").collect()}


def _read_back(batches: Iterator[pa.RecordBatch], dictionary: bytes, bases: dict[int, int], with_ids: bool, only: frozenset | None) -> Iterator[pa.RecordBatch]:
    decompress, name = _decompressor(dictionary), dictionary_hash(dictionary)
    for batch in batches:
        for row in batch.to_pylist():
            if row["dictionary"] != name:
                raise ValueError("a block was written with another dictionary")
            at, out = bases[row["shard"]] + row["start"], []
            for doc, n, a, b in zip(row["doc_ids"], row["counts"], row["offsets"], row["offsets"][1:]):
                if only is None or doc in only:
                    ids = np.frombuffer(decompress(row["frames"][a:b]), STORED).astype("<u4")
                    out.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else None))
                at += n
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x[k] for x in out], pa.int64()) for k in range(4)), *([pa.array([x[4].astype(np.int32) for x in out], pa.list_(pa.int32()))] if with_ids else [])],
                names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])],
            )


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the files alone."""
    dictionary, bases = _opened(spark, folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return _read_blocks(spark, folder).mapInArrow(lambda b: _read_back(b, dictionary, bases, with_ids, None), schema)


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a few documents: blocks without them are skipped by their index, other frames are not opened."""
    dictionary, bases = _opened(spark, folder)
    wanted = frozenset(doc_ids)
    blocks = _read_blocks(spark, folder).where(F.arrays_overlap("doc_ids", F.array(*map(F.lit, sorted(wanted)))))
    return blocks.mapInArrow(lambda b: _read_back(b, dictionary, bases, True, wanted), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files to a new folder of the shared place and read them back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, end_id, folder)
    return read_token_files(docs.sparkSession, folder)
