"""Ranked lexical search by the Best Position Algorithm over impact lists.

The items are searched in blocks of bounded size, one block after the other; a block's terms
are broadcast. One pass over the documents writes a row for each document with a term: its
length and the counts of the block's terms in it. N, L and the document frequencies are sums
over these rows. The rows are then searched where they lie, in shards of bounded size: a
shard's impact lists hold each term's documents by falling impact, and a table of its
documents and terms gives direct access to a document's place in every list.

For an item the lists are read from the top in steps. Each document met is scored through
direct accesses, which also marks its places in all lists. A list's best position is the last
one up to which all are marked. The impacts at the best positions add up to a threshold that
no unmarked document can pass; an exhausted list adds nothing. The search of a shard stops
once the threshold is strictly below the kth score, so that equal scores are all met. A task
carries its k best of each item from shard to shard, the shards of all tasks meet as k rows
an item and task.

Words are found by 64-bit hashes and compared byte by byte. No document's text is shuffled
and no list spans shards, so a term of a third of all documents is no large group.

Defined results: null or empty texts have no term, count for nothing and match nothing; items
without a term have no row; items with equal id and text are one item, those with equal id
and other text are ranked apart; repeated documents each count and are listed each; documents
without an id come after others of equal score; empty tables give an empty result; extra
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gullwatch.llm.common import CHUNK_BYTES, LOWER, WORD_BYTES, kept_table, pieces, range_hashes, row_starts, utf8, word_bounds

#: Bytes of item texts searched at once, and cells of a shard's table of documents and terms.
BLOCK_BYTES = 1 << 18
SHARD_CELLS = 1 << 23
#: Places first read from each list; every later step reads twice as many.
STEP = 16

_POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
_HITS = "item int, item_id long, doc_id long, score long"
_LAST = 1 << 62


class Terms(NamedTuple):
    """Words of a block of items, ordered by hash."""

    hashes: np.ndarray
    words: np.ndarray  # bytes, one after the other
    at: np.ndarray


class Items(NamedTuple):
    """Each item's distinct terms and their weights times their repeats."""

    ids: list[int | None]
    terms: list[np.ndarray]
    weights: list[np.ndarray]


def text_words(raw: bytes) -> list[bytes]:
    data = LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), WORD_BYTES)
    folded = data.tobytes()
    return [folded[a:b] for a, b in zip(starts, ends)]


def block_terms(texts: list[bytes]) -> tuple[Terms, list[Counter]]:
    """The terms of some item texts, and for each text its term numbers with their repeats."""
    bags = [Counter(text_words(t)) for t in texts]
    words = sorted({w for bag in bags for w in bag})
    data, at = np.frombuffer(b"".join(words), np.uint8), row_starts(np.array([len(w) for w in words], np.int64))
    hashes = range_hashes(data, at[:-1], at[1:])
    order = np.argsort(hashes, kind="stable")
    number = {words[j]: i for i, j in enumerate(order)}
    by_hash = [words[j] for j in order]
    terms = Terms(hashes[order], np.frombuffer(b"".join(by_hash), np.uint8), row_starts(np.array([len(w) for w in by_hash], np.int64)))
    return terms, [Counter({number[w]: n for w, n in bag.items()}) for bag in bags]


def find_terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, terms: Terms) -> np.ndarray:
    """Number of the term that each word is, -1 for other words."""
    found = np.full(len(starts), -1, np.int32)
    if not len(terms.hashes) or not len(starts):
        return found
    codes = range_hashes(data, starts, ends)
    first = np.minimum(np.searchsorted(terms.hashes, codes), len(terms.hashes) - 1)
    open_words = np.flatnonzero(terms.hashes[first] == codes)
    number = first[open_words]
    while len(open_words):  # once, or again for terms of equal hash
        size = ends[open_words] - starts[open_words]
        same = np.diff(terms.at)[number] == size
        for length in np.unique(size[same]):
            mine = np.flatnonzero(same & (size == length))
            ahead = np.arange(length)
            same[mine] = (data[starts[open_words[mine]][:, None] + ahead] == terms.words[terms.at[number[mine]][:, None] + ahead]).all(axis=1)
        found[open_words[same]] = number[same]
        follows = ~same & (number + 1 < len(terms.hashes))
        open_words, number = open_words[follows], number[follows] + 1
        again = terms.hashes[number] == range_hashes(data, starts[open_words], ends[open_words]) if len(open_words) else np.zeros(0, bool)
        open_words, number = open_words[again], number[again]
    return found


def word_slices(data: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    """Slices of about ``size`` bytes that end between words."""
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and WORD_BYTES[data[end]]:
            ahead = np.flatnonzero(~WORD_BYTES[data[end : end + size]])
            end = end + int(ahead[0]) if len(ahead) else min(end + size, len(data))
        yield data[start:end]
        start = end


def _counted(data: np.ndarray, at: np.ndarray, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row, and the distinct (row, term) keys with their counts."""
    width = max(len(terms.hashes), 1)
    if len(at) == 2:  # one row, which may be long
        n, keys = 0, np.zeros(width, np.int64)
        for part in word_slices(data):
            starts, ends, _ = word_bounds(part, np.array([0, len(part)]), WORD_BYTES)
            number = find_terms(part, starts, ends, terms)
            n += len(starts)
            keys += np.bincount(number[number >= 0], minlength=width)
        met = np.flatnonzero(keys)
        return np.array([n]), met, keys[met]
    starts, ends, first = word_bounds(data, at, WORD_BYTES)
    number = find_terms(data, starts, ends, terms)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    met = number >= 0
    keys, counts = np.unique(row[met] * width + number[met], return_counts=True)
    return np.diff(first), keys, counts


def postings(docs: DataFrame, terms: Terms) -> DataFrame:
    """A row for each document with a word: its length, and its terms of the block with their counts."""
    table = docs.sparkSession.sparkContext.broadcast(terms)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(len(table.value.hashes), 1)
        for batch in pieces(batches, "text"):
            data, at = utf8(batch.column(1))
            n, keys, counts = _counted(LOWER[data], at, table.value)
            offsets = np.searchsorted(keys, np.arange(len(at)) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (keys % width, counts)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, _POSTINGS)


def _frequencies(index: DataFrame, width: int) -> np.ndarray:
    """Documents that hold each term; a task passes on one row a term."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=width)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["term", "df"])

    df = np.zeros(width, np.int64)
    for r in index.select("terms").mapInArrow(sums, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]  # at most one row a term of the block
    return df


class Shard:
    """Impact lists of some documents, and a table for direct access to them."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray, width: int, n_docs: int, n_words: int):
        self.ids = ids
        size = 25 + (75 * n * n_docs) // max(n_words, 1)
        impact = (1_000_000_000 * count) // (1000 * count + 8 * size[row])
        order = np.lexsort((row, -impact, term))
        self.row, self.impact = row[order], impact[order]
        self.at = np.searchsorted(term[order], np.arange(width + 1))
        self.place = np.full((len(ids), width), -1, np.int32)
        self.place[self.row, term[order]] = np.arange(len(order))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) of this shard and of ``best``."""
        first, last = self.at[terms], self.at[terms + 1]
        held = last > first
        terms, weights, first, last = terms[held], weights[held], first[held], last[held]
        marked = np.zeros(int(last.max(initial=0)) + 1, bool)  # over the shard's places
        scored = np.zeros(len(self.ids), bool)
        position, depth = first.copy(), 0  # position: the first place that is not marked
        while True:
            left = position < last
            at_best = np.maximum(position - 1, first)
            threshold = int((weights * self.impact[at_best])[left].sum())
            if not left.any() or (len(best[0]) == k and threshold < best[0][-1]):
                return best
            met = [self.row[a + depth : min(a + depth + step, b)] for a, b in zip(first, last) if a + depth < b]
            rows = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
            rows = rows[~scored[rows]]
            scored[rows] = True
            places = self.place[rows[:, None], terms]
            inside = places >= 0
            scores = (np.where(inside, self.impact[places], 0) * weights).sum(axis=1)
            marked[places[inside]] = True
            best = best_of(k, best, (scores, self.ids[rows]))
            depth, step = depth + step, 2 * step
            for j in np.flatnonzero(left):
                ahead = marked[position[j] : last[j]]
                stop = int(ahead.argmin()) if len(ahead) else 0
                position[j] = last[j] if len(ahead) and ahead[stop] else position[j] + stop


def best_of(k: int, *parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    scores, ids = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    keep = scores > 0
    scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _shards(batches: Iterator[pa.RecordBatch], width: int, n_docs: int, n_words: int, cells: int) -> Iterator[Shard]:
    most = max(1, cells // width)
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            part = batch.slice(start, most)
            ids = part.column(0).fill_null(_LAST).to_numpy()
            terms, counts = part.column(2), part.column(3)
            row = np.repeat(np.arange(part.num_rows), np.diff(terms.offsets.to_numpy()))
            flat = [x.flatten().to_numpy().astype(np.int64) for x in (terms, counts)]
            yield Shard(ids, part.column(1).to_numpy(), row, *flat, width, n_docs, n_words)


def _search_block(docs: DataFrame, items: list[tuple[int | None, bytes]], k: int, cells: int, step: int) -> DataFrame:
    spark = docs.sparkSession
    terms, bags = block_terms([text for _, text in items])
    width = max(len(terms.hashes), 1)
    index = kept_table(postings(docs, terms), "postings")
    sizes = index.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_words")).first()
    n_docs, n_words = sizes["n_docs"], sizes["n_words"]
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in _frequencies(index, width)]
    numbers = [np.array(sorted(bag), np.int64) for bag in bags]
    block = spark.sparkContext.broadcast(Items([i for i, _ in items], numbers, [np.array([bag[t] * weight[t] for t in own], np.int64) for bag, own in zip(bags, numbers)]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, weights = block.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        for shard in _shards(batches, width, n_docs, n_words, cells):
            best = [shard.search(t, w, k, b, step) for t, w, b in zip(own, weights, best)]
        count = [len(b[0]) for b in best]
        doc = np.concatenate([b[1] for b in best]) if best else np.zeros(0, np.int64)
        columns = [
            pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), count)),
            pa.array([i for i, c in zip(ids, count) for _ in range(c)], pa.int64()),
            pa.array(doc, mask=doc == _LAST),
            pa.array(np.concatenate([b[0] for b in best]) if best else doc),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "doc_id", "score"])

    return index.mapInArrow(rows, _HITS)


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """The distinct items in blocks of about ``BLOCK_BYTES`` of text, each read when it is its turn."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).distinct()
    total = own.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    n = -(-total // BLOCK_BYTES)
    for block in range(n):
        mine = own if n == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        yield sorted(((r["item_id"], bytes(r["text"])) for r in mine.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def search(docs: DataFrame, items: DataFrame, k: int = 10, cells: int = SHARD_CELLS, step: int = STEP) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents; ties by doc_id."""
    found = [_search_block(docs, block, k, cells, step).withColumn("block", F.lit(b)) for b, block in enumerate(item_blocks(items))]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("block", "item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
