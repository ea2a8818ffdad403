"""Order-preserving packing of documents into windows of tokens.

The documents of an input partition form one token stream. Windows are cut from it, in
order, at document ends, sentence ends or, where a sentence runs on, every ``STRIDE``
tokens. Dynamic programming over these cuts minimises padding plus a penalty for cutting a
document at a sentence end (``SENTENCE``) or inside a sentence (``INSIDE``): with
f(b) = penalty(b) + L - b + min(f(a) + a) over L > b - a, a monotone queue keeps the
minimum of the sliding range, so each cut enters and leaves it once. A stream is solved in
pieces of bounded size; the last window of a piece is carried into the next, and only the
last window of a partition ends early. There is no shuffle, and a retried task makes the
same windows.

Defined results: a null or empty text is its end id alone; a document longer than a window
is cut; repeated ids are packed one by one; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gullwatch.llm.common import pieces
from gullwatch.llm.tokens import encoded, encoder

SENTENCE, INSIDE, STRIDE = 2, 8, 16

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
_stops: dict[str, np.ndarray] = {}


def sentence_ends(path: str) -> np.ndarray:
    """For each id whether its text ends a sentence or a line."""
    if path not in _stops:
        tokenizer = encoder(path).tokenizer
        table = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for text, i in tokenizer.get_vocab(with_added_tokens=True).items():
            table[i] = text[-1] in ".!?Ċ"  # the last is the newline of byte-level vocabularies
        _stops[path] = table
    return _stops[path]


def choose_cuts(at: list[int], penalty: list[int], window: int) -> list[int]:
    """Positions of the best cuts; ``at`` ascends from 0, with gaps of at most ``window``."""
    cost, back = [0] * len(at), [0] * len(at)
    queue = deque([(0, 0)])  # (f(a) + a, index), ascending in both
    for i in range(1, len(at)):
        b = at[i]
        while at[queue[0][1]] < b - window:
            queue.popleft()
        best, back[i] = queue[0]
        cost[i] = f = best + window - b + penalty[i]
        key = f + b
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    cuts, i = [], len(at) - 1
    while i:
        cuts.append(at[i])
        i = back[i]
    return cuts[::-1]


def _candidates(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> tuple[list[int], list[int]]:
    """Cut positions from 0 to the last, and their penalties."""
    total = int(ends[-1])
    penalty = np.full(total + 1, -1, np.int64)
    penalty[1:][stops[ids]] = SENTENCE
    penalty[ends] = 0
    penalty[0] = penalty[total] = 0
    at = np.flatnonzero(penalty >= 0)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > STRIDE)
    if len(wide):
        more = np.concatenate([np.arange(at[k] + STRIDE, at[k + 1], STRIDE) for k in wide])
        penalty[more] = INSIDE
        at = np.flatnonzero(penalty >= 0)
    return at.tolist(), penalty[at].tolist()


def pack_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, window: int) -> Iterator[pa.RecordBatch]:
    """Pieces of every document of this partition."""
    stops = sentence_ends(path)
    sequence = TaskContext.get().partitionId() << 36
    open_ids = np.zeros(0, np.uint32)
    open_docs: list[tuple] = []  # (doc_id, start, length, doc_tokens) of what is carried

    def solve(ids: np.ndarray, docs: list[tuple], last: bool):
        nonlocal sequence
        ends = np.cumsum([d[2] for d in docs])
        at, penalty = _candidates(ids, ends, stops)
        cuts = choose_cuts(at, penalty, window)
        if not last:
            cuts.pop()
        rows, left, k, used = [], 0, 0, 0
        for cut in cuts:
            size = cut - left
            padded = size if size & (size - 1) == 0 else window
            offset = 0
            while left < cut:
                doc, start, length, whole = docs[k]
                take = min(length - used, cut - left)
                rows.append((doc, start + used, take, zlib.crc32(ids[left : left + take].tobytes()), whole, sequence, offset, padded))
                left, used, offset = left + take, used + take, offset + take
                if used == length:
                    k, used = k + 1, 0
            sequence += 1
        rest = docs[k:]
        if rest and used:
            doc, start, length, whole = rest[0]
            rest[0] = (doc, start + used, length - used, whole)
        out = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(8)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"])
        return out, ids[left:], rest

    for batch in pieces(batches, "text"):
        ids, bounds = encoded(batch, path, end_id)
        sizes = np.diff(bounds).tolist()
        docs = [(d, 0, n, n) for d, n in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), sizes)]
        out, open_ids, open_docs = solve(np.concatenate([open_ids, ids]), [*open_docs, *docs], False)
        yield out
    if open_docs:
        yield solve(open_ids, open_docs, True)[0]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024) -> DataFrame:
    """One row per piece: its place in the document and in its sequence."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lambda batches: pack_batches(batches, tokenizer, end_id, window), _PIECES)
