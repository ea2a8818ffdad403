"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is a chain of lower-cased words and one end. Frequent words are symbols; another word
is spelled by its bytes and a word end. A Huffman code over all symbols turns the chain into
binary decisions. Three predictors give each decision a log odds: the node's own counts, and
the counts of two hashed contexts: the node after the last symbol and after the last two,
or, inside a spelled word, after its last two bytes and its last four. Their counts over all
training rows lie in tables of fixed size, added up in a tree of bounded fan-in. A gate, how
often both contexts were seen, chooses the weights that mix the log odds. They are learned in
the same pass: a task predicts each slice of its rows from the rows before it, moves its
weights by damped Newton steps (from every decision of every text), and the
weights of all tasks are averaged by their curvature. Inside a text the weights are refined
from its start: after each ``ADAPT`` decisions they move along the gradient of all before
them. Every text starts anew, so its score does not depend on where it lies.

The long-range predictor grows with the input. Words and the words before them choose where a
text is cut into chunks of about ``CHUNK_WORDS`` words; the counts of each chunk after the
chunk before it, over all training rows, are rows of a table. A chunk's probability mixes its
share among the chunks that followed there (its own occurrence taken out, if its row was
trained on) with the product of its bits, by a gate learned as the share of training chunks
that such a prediction covers.

The plain unigram score uses exact counts of all words: the most frequent ones (at most
``KNOWN``) are broadcast, the others are joined by their hash.

Defined results: null and empty texts are the end alone; repeated rows are scored one by
one; without training rows every symbol is equally likely; extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gullwatch.llm.common import _BASE, _INVERSE, LOWER, NOT_SPACE, _power_table, kept_table, mix, pieces, range_hashes, utf8, word_bounds

#: Words whose counts are broadcast, and words that are symbols (at most).
KNOWN, SYMBOLS = 1 << 19, 1 << 17
#: Slots of the two context tables.
ONE_BITS, TWO_BITS = 20, 21
SLOTS = (1 << ONE_BITS) + (1 << TWO_BITS)
#: Decisions whose counters lie side by side, in ``1 << GROUP`` slots.
GROUP = 4
#: Counters in a row of a table on its way, and tables added up in one step.
BLOCK, FAN_IN = 1 << 14, 16
#: Curvature added to each gate, and the furthest move of its weights.
DAMPING, FURTHEST = 16.0, 1.0
#: Decisions that are predicted from the same counts while the weights are learned.
LEAST_PART, MOST_PART = 1 << 11, 1 << 16
#: Mean length of a chunk in words, a power of two.
CHUNK_WORDS = 16
#: Decisions of a block within a text, and those from which moves get smaller with the root of their number.
ADAPT, ADAPT_FULL = 64, 2_048
ADAPT_RATE, ADAPT_MOST, PRIOR = 0.002, 0.3, 0.4
#: Texts are worked on in smaller slices than elsewhere: each byte becomes about two decisions.
SLICE = 1 << 17

WORD_END, DOC_END, FIRST_WORD = 256, 257, 258
_END_HASH = np.uint64(0x3C6EF372FE94F82A)
_FLUSH = 1_000_000


# ---- words ---------------------------------------------------------------------------------


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, ends, hashes, and the words before each row."""
    data, at = utf8(batch.column(batch.schema.get_field_index("text")))
    data = LOWER[data]
    starts, ends, first = word_bounds(data, at, NOT_SPACE)
    return data, starts, ends, range_hashes(data, starts, ends), first


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, counts, minlength=len(unique)).astype(np.int64)


def chunks(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash of the chunk after the one before it, and hash of the one before, of every chunk.

    The hash before the first chunk of a row is 0, as is its own: nothing predicts it.
    """
    n, rows = len(hashes), len(first) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    before = np.concatenate([[np.uint64(0)], hashes[:-1]])
    cut = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + before * np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(CHUNK_WORDS - 1) == 0
    row_first = first[:-1][np.diff(first) > 0]
    cut[row_first] = True
    begin = np.flatnonzero(cut)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _power_table(_BASE, n)[:n], out=sums[1:])
    end = np.append(begin[1:], n)
    own = mix((sums[end] - sums[begin]) * _power_table(_INVERSE, n + 1)[begin] + (end - begin).astype(np.uint64))
    closing = np.isin(end, first[1:])
    own[closing] = mix(own[closing] + _END_HASH)  # the end is part of a text's last chunk
    past = np.concatenate([[np.uint64(0)], own[:-1]])
    lead = np.isin(begin, row_first, assume_unique=True)
    past[lead] = 0
    pair = mix(past * np.uint64(0xD6E8FEB86659FD93) + own)
    pair[lead] = 0
    return begin, pair, past


_COUNTED = "kind int, h long, past long, c long"


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (kind 0: a word's hash, kind 1: a byte of words, kind 2: a chunk after ``past``)."""

    def rows(keys: np.ndarray, counts: np.ndarray, kind: int, past: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        past = np.zeros(len(keys), np.uint64) if past is None else past
        for a in range(0, len(keys), 50_000):
            k, p, c = (x[a : a + 50_000] for x in (keys, past, counts))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(p.view(np.int64)), pa.array(c)], names=["kind", "h", "past", "c"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, seen = 0, np.zeros(256, np.int64)
    for batch in pieces(batches, "text"):
        data, _, _, hashes, first = _tokens(batch)
        seen += np.bincount(data[NOT_SPACE[data]], minlength=256)
        _, pair, past = chunks(hashes, first)
        pair, where, times = np.unique(pair[past != 0], return_index=True, return_counts=True)
        yield from rows(pair, times.astype(np.int64), 2, past[past != 0][where])
        held.append(_merged([(hashes, np.ones(len(hashes), np.int64)), (np.array([_END_HASH]), np.array([batch.num_rows]))]))
        size += len(held[-1][0])
        if size > 2 * _FLUSH:
            held = [_merged(held)]
            size = len(held[0][0])
            if size > _FLUSH:
                yield from rows(*held[0], 0)
                held, size = [], 0
    if held:
        yield from rows(*_merged(held), 0)
    yield from rows(np.arange(256).astype(np.uint64), seen, 1)


class Lookup:
    """Place of a hash in a list of distinct hashes, by open addressing; -1 where absent."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.slots = np.full(1 << self.BITS, -1, np.int32)
        rest, at = np.arange(len(hashes)), self._home(hashes)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            lost = self.slots[at] != rest
            rest, at = rest[lost], (at[lost] + 1) & ((1 << self.BITS) - 1)

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        at = self._home(hashes)
        out = self.slots[at]
        rest = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes))
        at = at[rest]
        while len(rest):
            at = (at + 1) & ((1 << self.BITS) - 1)
            out[rest] = self.slots[at]
            open_ = (out[rest] >= 0) & (self.hashes[out[rest]] != hashes[rest])
            rest, at = rest[open_], at[open_]
        return out


# ---- code ----------------------------------------------------------------------------------


@dataclass
class Code:
    """Huffman code: each symbol's nodes and bits, and each node's log odds of a one.

    The path of a symbol is cut into groups of ``GROUP`` decisions. A group's context counters
    lie side by side: its first node chooses where, the way from there on which of them.
    """

    begin: np.ndarray
    size: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    odds: np.ndarray
    packed: np.ndarray = field(init=False)  # node, place of the counter within its group, and bit of each decision
    group_begin: np.ndarray = field(init=False)
    groups: np.ndarray = field(init=False)  # of each symbol
    group_size: np.ndarray = field(init=False)
    group_lead: np.ndarray = field(init=False)  # first node of each group, scrambled

    def __post_init__(self):
        depth = np.arange(len(self.node)) - np.repeat(self.begin, self.size)
        inner = np.ones(len(self.node), np.uint8)
        for step in range(1, GROUP):
            deep = np.flatnonzero(depth % GROUP == step)
            inner[deep] = inner[deep - 1] * 2 + self.bit[deep - 1]
        self.packed = (self.node.astype(np.uint32) << np.uint32(GROUP + 1)) | (inner.astype(np.uint32) << np.uint32(1)) | self.bit
        self.groups = -(-self.size // GROUP)
        self.group_begin = np.cumsum(self.groups) - self.groups
        lead = np.flatnonzero(depth % GROUP == 0)
        self.group_lead = (self.node[lead].astype(np.uint32) + np.uint32(1)) * np.uint32(0x27D4EB2F)
        self.group_size = np.diff(np.append(lead, len(self.node)))


def huffman(counts: np.ndarray) -> Code:
    n = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts.tolist())]
    heapq.heapify(heap)
    parent, side = [0] * (2 * n - 1), [0] * (2 * n - 1)
    odds = np.zeros(n - 1, np.float32)
    for new in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y], side[y] = new, new, 1
        odds[new - n] = math.log(b / a)
        heapq.heappush(heap, (a + b, new))
    nodes, bits, sizes = [], [], []
    for i in range(n):
        path, way, at = [], [], i
        while at != 2 * n - 2:
            way.append(side[at])
            at = parent[at]
            path.append(at - n)
        nodes += path[::-1]
        bits += way[::-1]
        sizes.append(len(path))
    size = np.array(sizes, np.int64)
    return Code(np.cumsum(size) - size, size, np.array(nodes, np.int32), np.array(bits, np.uint8), odds)


@dataclass
class Model:
    hashes: np.ndarray  # of the known words
    counts: np.ndarray
    symbols: np.ndarray  # symbol of each known word, or -1
    tokens: int  # N
    kinds: int  # V
    code: Code
    table: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # log odds of each slot, its gate class in the last two bits
    weights: np.ndarray = field(default_factory=lambda: np.zeros((16, 3), np.float32))
    chunk_gate: float = 0.5  # share of training chunks that the chunk counts predict
    lookup: Lookup | None = None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if self.lookup is None:
            self.lookup = Lookup(self.hashes)
        return self.lookup(hashes)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))


# ---- decisions -----------------------------------------------------------------------------


def symbol_chain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all rows, one after the other, where each row begins (one more entry), and each word."""
    size = np.where(symbols >= 0, 1, ends - starts + 1)
    after = np.concatenate([[0], np.cumsum(size)])
    rows = len(first) - 1
    bounds = after[first] + np.arange(rows + 1)  # one end for each row before
    shift = np.repeat(np.arange(rows), np.diff(first))
    at = after[:-1] + shift
    out = np.empty(int(bounds[-1]), np.int32)
    plain = symbols >= 0
    out[at[plain]] = symbols[plain]
    spelled = np.flatnonzero(~plain)
    if len(spelled):
        length = ends[spelled] - starts[spelled]
        step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(at[spelled], length) + step] = data[np.repeat(starts[spelled], length) + step]
        out[at[spelled] + length] = WORD_END
    out[bounds[1:] - 1] = DOC_END
    return out, bounds, at


def decisions(chain: np.ndarray, bounds: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Node, bit and both slots of every decision, and the decisions before each row."""
    last = [np.full(len(chain), DOC_END, np.int32) for _ in range(4)]  # symbols one to four places back
    for k, x in enumerate(last):
        x[k + 1 :] = chain[: -k - 1]
    for k in range(1, 4):  # a row starts anew after the end before it; a spelled word at its first byte
        stop = np.where(last[0] < WORD_END, WORD_END, DOC_END)
        cut = (last[k - 1] == DOC_END) | ((last[0] < WORD_END) & ((last[k - 1] >= WORD_END) | (last[k] >= WORD_END)))
        last[k] = np.where(cut, stop, last[k])
    spelling = last[0] < WORD_END
    back = [x.astype(np.uint32) + np.uint32(1) for x in last]
    one = back[0] * np.uint32(0x9E3779B1)
    pair = (one ^ (one >> np.uint32(15))) * np.uint32(0x85EBCA77) + back[1] * np.uint32(0xC2B2AE3D)
    four = (pair ^ (pair >> np.uint32(15))) * np.uint32(0x85EBCA77) + back[2] * np.uint32(0x27D4EB2F) + back[3] * np.uint32(0x165667B1)
    one, two = np.where(spelling, pair, one), np.where(spelling, four ^ np.uint32(0x5BD1E995), pair)
    size = code.size[chain]
    after = np.cumsum(size)
    at = np.repeat(code.begin[chain] - (after - size), size) + np.arange(int(after[-1]))
    packed = code.packed.take(at)
    bit, inner, node = (packed & np.uint32(1)).astype(np.uint8), (packed >> np.uint32(1)) & np.uint32((1 << GROUP) - 1), (packed >> np.uint32(GROUP + 1)).view(np.int32)
    groups = code.groups[chain]
    group_at = np.repeat(code.group_begin[chain] - (np.cumsum(groups) - groups), groups) + np.arange(int(groups.sum()))
    lead, group_size = code.group_lead[group_at], code.group_size[group_at]

    def slot(context: np.ndarray, bits: int) -> np.ndarray:
        x = np.repeat(context, groups)
        x ^= lead
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x >>= np.uint32(32 - bits + GROUP)
        x <<= np.uint32(GROUP)
        return np.add(np.repeat(x, group_size), inner, dtype=np.int64)

    before = np.concatenate([[0], after])[bounds]
    return node, bit, slot(one, ONE_BITS), slot(two, TWO_BITS) + (1 << ONE_BITS), before


def _row_decisions(batch: pa.RecordBatch, model: Model):
    data, starts, ends, hashes, first = _tokens(batch)
    known = model.find(hashes)
    symbols = np.where(known >= 0, model.symbols[known], -1) if len(model.symbols) else np.full(len(known), -1)
    chain, bounds, word_at = symbol_chain(data, starts, ends, symbols, first)
    return (hashes, known, first, np.concatenate([[0], np.cumsum(model.code.size[chain])])[word_at]), decisions(chain, bounds, model.code)


def _counted_odds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and gate class of counts, zeros in the low half and ones in the high half of each."""
    both = counts.view(np.uint32).astype(np.float32)
    return _odds(both[0::2], both[1::2])


class Learner:
    """Weights of each gate, moved by damped Newton steps slice by slice."""

    def __init__(self):
        self.weights = np.tile(np.array([0.5, 0.3, 0.3]), (16, 1))
        self.weights[0] = 1, 0, 0
        self.bend = np.tile(np.eye(3) * DAMPING, (16, 1, 1))

    def learn(self, inputs: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> None:
        order = np.argsort(gate.astype(np.uint8, copy=False), kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=16))])
        inputs, bit = inputs.take(order, axis=1), bit.take(order)
        for g in np.flatnonzero(np.diff(edges)):
            x = inputs[:, edges[g] : edges[g + 1]]
            share = np.clip(-self.weights[g].astype(np.float32) @ x, -12, 12)
            np.exp(share, out=share)
            share += 1
            np.divide(1, share, out=share)
            self.bend[g] += (x * (share * (1 - share))) @ x.T
            self.weights[g] += np.clip(np.linalg.solve(self.bend[g], x @ (bit[edges[g] : edges[g + 1]] - share)), -FURTHEST, FURTHEST)

    def sums(self) -> np.ndarray:
        """Curvature, and curvature times weights, of every gate."""
        return np.concatenate([self.bend.reshape(-1), (self.bend @ self.weights[:, :, None]).reshape(-1)])


def averaged(sums: np.ndarray) -> np.ndarray:
    """The weights of all tasks, averaged by their curvature."""
    bend, moved = sums[: 16 * 9].reshape(16, 3, 3), sums[16 * 9 :].reshape(16, 3, 1)
    return np.linalg.solve(bend, moved)[:, :, 0].astype(np.float32)


def _table_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Counts of zeros and ones of every slot over this partition, in compressed blocks, and the sums of its weights."""
    table, learner = np.zeros(2 * SLOTS, np.uint32), Learner()
    pairs = table.view(np.uint64)  # both counts of a slot in one number
    step, seen = np.array([1, 1 << 32], np.uint64), 0  # what a zero and a one add
    for batch in pieces(batches, "text", SLICE):
        _, (node, bit, first, second, _) = _row_decisions(batch, model.value)
        a = 0
        while a < len(node):  # each part is predicted from all before it; the first ones are short
            b = a + min(max(seen, LEAST_PART), MOST_PART)
            some = slice(a, b)
            (x1, k1), (x2, k2) = _counted_odds(pairs.take(first[some])), _counted_odds(pairs.take(second[some]))
            learner.learn(np.stack([model.value.code.odds.take(node[some]), x1, x2]), k1 * 4 + k2, bit[some])
            more = step.take(bit[some])
            np.add.at(pairs, first[a:b], more)
            np.add.at(pairs, second[a:b], more)
            seen, a = seen + len(node[a:b]), b
    compress, part = zstandard.ZstdCompressor(level=1).compress, TaskContext.get().partitionId()

    def row(block: int, counts: bytes | None, sums: np.ndarray | None) -> pa.RecordBatch:
        columns = [pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([counts], pa.binary()), pa.array([sums], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["block", "part", "counts", "sums"])

    yield row(-1, None, learner.sums())
    for k in range(len(table) // BLOCK):
        own = table[k * BLOCK : (k + 1) * BLOCK]
        if own.any():
            yield row(k, compress(own.tobytes()), None)


def _add_tables(table: pa.Table) -> pa.Table:
    decompress, total = zstandard.ZstdDecompressor().decompress, np.zeros(BLOCK, np.uint64)
    for x in table.column("counts").to_pylist():
        total += np.frombuffer(decompress(x), np.uint32)
    small = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
    part = pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int32())
    return pa.table({"block": table.column("block")[:1], "part": part, "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(small.tobytes())], pa.binary())})


def _odds(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of counts and their gate class (bytes): unseen, up to 3, up to 15, more."""
    seen = zeros + ones
    kind = (seen > 0).view(np.int8) + (seen > 3).view(np.int8) + (seen > 15).view(np.int8)
    odds = ones + np.float32(PRIOR)
    odds /= zeros + np.float32(PRIOR)
    return np.log(odds, out=odds), kind


def _packed(counts: np.ndarray) -> np.ndarray:
    odds, kind = _odds(counts[0::2].astype(np.float32), counts[1::2].astype(np.float32))
    return ((odds.view(np.int32) & ~3) | kind.astype(np.int32)).view(np.float32)


# ---- training ------------------------------------------------------------------------------


def _cut_off(histogram: dict[int, int], most: int) -> int:
    """Smallest class of counts such that at most ``most`` words lie in it or above."""
    total, cut = 0, 1 << 30
    for kind in sorted(histogram, reverse=True):
        total += histogram[kind]
        if total > most:
            break
        cut = kind
    return cut


class Counted(NamedTuple):
    """Exact counts over all training rows: words (h, c), and chunks (h, past, c), those counted more than once also apart."""

    words: DataFrame
    chunks: DataFrame
    repeated: DataFrame


def train(docs: DataFrame, learn: Column) -> tuple[Model, Counted]:
    """The model, and the counts of all training tokens and chunks."""
    spark = docs.sparkSession
    own = docs.where(learn).select(F.col("text").cast("string").alias("text"))
    both = kept_table(own.mapInArrow(_count_batches, _COUNTED).groupBy("kind", "h", "past").agg(F.sum("c").alias("c")), "counts")
    counts = both.where("kind = 0").select("h", "c")
    kind = F.floor(F.log2("c") * 16).cast("int")
    histogram = {r.kind: r.n for r in counts.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()}  # about a thousand classes at most
    follow = both.where("kind = 2").select("h", "past", "c")
    again = kept_table(follow.where("c > 1"), "chunks")
    covered = follow.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("hits"), F.coalesce(F.sum("c"), F.lit(0)).alias("all")).first()
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    seen = np.zeros(256)
    for r in both.where("kind = 1").collect():  # 256 bytes
        seen[r.h] = r.c
    known = counts.where(kind >= _cut_off(histogram, KNOWN)).toArrow()
    hashes, number = known.column("h").to_numpy().view(np.uint64), known.column("c").to_numpy()
    order = np.argsort(hashes)
    hashes, number = hashes[order], number[order]
    frequent = max(_cut_off(histogram, SYMBOLS), 16)  # words seen once teach how to spell
    is_symbol = (np.floor(np.log2(np.maximum(number, 1)) * 16) >= frequent) & (hashes != _END_HASH)
    symbols = np.where(is_symbol, FIRST_WORD + np.cumsum(is_symbol) - 1, -1).astype(np.int32)
    ends = int(number[hashes == _END_HASH].sum())
    tokens = int(totals.n or 0)
    rest = max(tokens - ends - int(number[is_symbol].sum()), 0) + 1
    spelled = seen / max(seen.sum(), 1) * rest * max(seen.sum() / max(tokens - ends, 1), 1) + 1
    code = huffman(np.concatenate([spelled.astype(np.int64), [rest, ends + 1], number[is_symbol]]))
    model = Model(hashes, number, symbols, tokens, int(totals.v), code, chunk_gate=(covered["hits"] + 0.5) / (covered["all"] + 1))
    shared = spark.sparkContext.broadcast(model)
    tables = kept_table(own.mapInArrow(lambda b: _table_batches(b, shared), "block int, part int, counts binary, sums array<double>"), "tables")
    sums = np.zeros(16 * 12)
    for r in tables.where("block < 0").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("v")).collect():  # 16 gates of twelve numbers
        sums[r.pos] = r.v
    tables = tables.where("block >= 0").drop("sums")
    parts = tables.agg(F.max("part")).first()[0]
    while parts is not None:
        tables = tables.groupBy("block", F.floor(F.col("part") / FAN_IN).alias("to")).applyInArrow(_add_tables, "block int, part int, counts binary")
        parts = parts // FAN_IN or None
    total = np.zeros(2 * SLOTS, np.uint32)
    for r in tables.collect():  # a table of fixed size
        total[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.counts)), np.uint32)
    model.weights = averaged(sums) if sums.any() else Learner().weights.astype(np.float32)
    model.table = _packed(total)
    model.lookup = None
    return model, Counted(counts, follow, again)


# ---- scoring -------------------------------------------------------------------------------


def log_probabilities(node: np.ndarray, bit: np.ndarray, first: np.ndarray, second: np.ndarray, before: np.ndarray, model: Model) -> np.ndarray:
    """Natural log probability of each row's decisions."""
    return np.add.reduceat(decision_logs(node, bit, first, second, before, model), before[:-1], dtype=np.float64)


def decision_logs(node: np.ndarray, bit: np.ndarray, first: np.ndarray, second: np.ndarray, before: np.ndarray, model: Model) -> np.ndarray:
    """Natural log probability of each decision."""
    x1, x2 = model.table.take(first), model.table.take(second)
    # one index type for all lookups by gate
    gate = ((x1.view(np.int32) & 3) * 4 + (x2.view(np.int32) & 3)).astype(np.intp)
    inputs = (model.code.odds.take(node), x1, x2)
    dot = model.weights[:, 0].take(gate, mode="clip")
    dot *= inputs[0]
    for k, x in ((1, x1), (2, x2)):
        own = model.weights[:, k].take(gate, mode="clip")
        own *= x
        dot += own
    sizes = np.diff(before)
    blocks = -(-sizes // ADAPT)
    if (blocks > 1).any():
        block_first = np.cumsum(blocks) - blocks
        row = np.repeat(np.arange(len(sizes)), blocks)
        begin = before[:-1][row] + (np.arange(len(row)) - block_first[row]) * ADAPT
        length = np.diff(np.append(begin, before[-1]))
        wrong = np.clip(dot, -12, 12)
        np.negative(wrong, out=wrong)
        np.exp(wrong, out=wrong)
        wrong += 1
        np.divide(-1, wrong, out=wrong)
        wrong += bit
        slower = np.sqrt(np.maximum((begin - before[:-1][row]) / ADAPT_FULL, 1))
        for x in inputs:
            gain = np.cumsum(np.add.reduceat(wrong * x, begin), dtype=np.float64)
            past = np.concatenate([[0], gain])[:-1]
            moved = np.clip(ADAPT_RATE * (past - past[block_first][row]) / slower, -ADAPT_MOST, ADAPT_MOST)
            own = np.repeat(moved.astype(np.float32), length)
            own *= x
            dot += own
    # log odds of the bit that is there
    dot *= 1 - 2 * bit.astype(np.float32)
    np.clip(dot, -12, 12, out=dot)
    np.exp(dot, out=dot)
    np.log1p(dot, out=dot)
    return np.negative(dot, out=dot)


def _score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model, number = shared.value, TaskContext.get().partitionId() << 36
    base = model.base(model.counts)
    end = model.find(np.array([_END_HASH]))[0]
    end_base = base[end] if end >= 0 else float(model.base(np.zeros(1))[0])
    escape = math.log(1 - model.chunk_gate)
    for batch in pieces(batches, "text", SLICE):
        (hashes, known, first, word_at), parts = _row_decisions(batch, model)
        logs = decision_logs(*parts, model)
        rows, sizes = batch.num_rows, np.diff(utf8(batch.column(batch.schema.get_field_index("text")))[1])
        # a row's bits are those up to its second chunk, and those of every chunk from there on
        begin, pair, past = chunks(hashes, first)
        follows = past != 0
        chunk_row = np.searchsorted(first, begin, side="right") - 1
        starts = np.concatenate([parts[-1][:-1], word_at[begin[follows]]])
        order = np.argsort(starts, kind="stable")
        sums = np.empty(len(starts))
        sums[order] = np.add.reduceat(logs, starts[order], dtype=np.float64)
        bits = sums[rows:]
        score = sums[:rows] + np.bincount(chunk_row[follows], bits, minlength=rows)
        score += escape * np.bincount(chunk_row[follows], minlength=rows)
        chunk_offsets = pa.array(np.searchsorted(chunk_row[follows], np.arange(rows + 1)).astype(np.int32))
        own = np.where(known >= 0, base[known], 0.0) if len(base) else np.zeros(len(known))
        sums, seen = np.concatenate([[0], np.cumsum(own)]), np.concatenate([[0], np.cumsum(known >= 0)])
        row = np.repeat(np.arange(rows), np.diff(first))[known < 0]
        rest = hashes[known < 0]
        order = np.lexsort((rest, row))
        row, rest = row[order], rest[order]
        fresh = np.ones(len(rest), bool)
        fresh[1:] = (rest[1:] != rest[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(fresh)
        times = np.diff(np.append(begin, len(rest)))
        offsets = pa.array(np.searchsorted(row[begin], np.arange(rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (rest[begin].view(np.int64), times)]
        lists += [pa.ListArray.from_arrays(chunk_offsets, pa.array(x)) for x in (pair[follows].view(np.int64), bits.astype(np.float32))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(number + np.arange(rows)), batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes), pa.array(np.diff(first) + 1), pa.array(np.diff(seen[first]) + int(end >= 0)), pa.array(np.diff(sums[first]) + end_base), pa.array(score / math.log(10)), batch.column(batch.schema.get_field_index("trained")), *lists],
            names=["row", "doc_id", "n_bytes", "n_tokens", "n_known", "base", "score", "trained", "rest", "times", "pairs", "bits"],
        )
        number += rows


def score(docs: DataFrame, model: Model, counts: Counted, trained: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_token and bits_per_byte (null without bytes) of every row.

    ``trained`` tells the rows that the model was trained on; their own occurrences do not predict them.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    mine = F.coalesce(F.lit(False) if trained is None else trained, F.lit(False))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mine.alias("trained"))
    scored = kept_table(
        own.mapInArrow(
            lambda b: _score_batches(b, shared),
            "row long, doc_id long, n_bytes long, n_tokens long, n_known long, base double, score double, trained boolean, rest array<long>, times array<long>, pairs array<long>, bits array<float>",
        ),
        "scored",
    )
    rare = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("h"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    below = model.tokens + 0.5 * (model.kinds + 1)
    added = (
        rare.join(counts.words, "h", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(below))).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("found"))
    )
    # chunks that training rows hold after the same chunk: their share there, mixed with their bits
    met = scored.select("row", "trained", F.explode(F.arrays_zip("pairs", "bits")).alias("x")).select("row", "trained", F.col("x.pairs").alias("h"), F.col("x.bits").cast("double").alias("bits"))
    # a chunk of a training row is predicted by other occurrences only, so it needs two
    met = met.where("trained").join(counts.repeated, "h").unionAll(met.where("NOT trained").join(counts.chunks, "h"))
    met = kept_table(met.select("row", "past", "bits", "c", F.col("trained").cast("long").alias("less")), "met")
    met = met.join(counts.chunks.join(met.select("past").distinct(), "past", "left_semi").groupBy("past").agg(F.sum("c").alias("n")), "past")
    predicted = F.log((F.col("c") - F.col("less")) / (F.col("n") - F.col("less"))) + math.log(model.chunk_gate)
    spelled = F.col("bits") + math.log(1 - model.chunk_gate)
    high, low = F.greatest(predicted, spelled), F.least(predicted, spelled)
    gained = met.groupBy("row").agg(F.sum(high + F.log1p(F.exp(low - high)) - spelled).alias("gained"))
    joined = scored.drop("rest", "times", "pairs", "bits").join(added, "row", "left").join(gained, "row", "left")
    joined = joined.withColumn("score", F.col("score") + F.coalesce("gained", F.lit(0.0)) / math.log(10))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / F.col("n_tokens")).alias("bits_per_token"),
        F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
