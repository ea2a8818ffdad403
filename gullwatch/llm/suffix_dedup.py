"""Removal of repeated byte strings by a sparse suffix array, sorted deep-shallow.

A byte is removed if it lies in a string of ``length`` bytes that also starts earlier. Every
such string holds an anchor: the gram of ``GRAM`` bytes with the least hash among those
inside it, so equal strings have equal anchors at equal places. Only the suffixes at anchors
that occur more than once can repeat; each is taken with the bytes before it that its
strings reach. They are dealt out by anchor and sorted there, to the right from the anchor
and to the left from it. Sorting is deep-shallow: multikey partitioning by eight bytes at a
time to a depth of ``SHALLOW`` bytes, then a blind trie (a Patricia tree that compares one
branching byte a node, and one leaf in full) for each group that is still tied. The longest
common prefixes of neighbours in both orders say which strings are equal: at each distance
between string start and anchor, strings are equal whose left and right parts fall in the
same classes. All but the first of each class are repeats, and the bytes they cover go.

Texts are read for anchors, once to count and once to place them; for the parts around
repeated ones; and for what is left of texts with repeats. The last two read only rows that
may be needed, by a bitmap of fixed size over their ids, before any shuffle; the exact join
follows. An anchor with more
than ``HOT`` occurrences would gather that many suffixes in one task: its strings are dealt
out one by one by their own hash instead. Each task passes on only the first of equal ones
to be compared (up to ``_HOT_SEEN`` strings are told apart at a time); the others are repeats
already and go on as runs, dealt by their own places.

Defined results: null text is empty; texts below ``length`` bytes lose nothing; order is
(doc_id, text hash, start), null ids first; rows with one id and one text count as one text,
and each gets its result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gullwatch.llm.common import kept_table, pieces, row_starts, utf8, window_hashes

LENGTH, GRAM = 100, 24
SHALLOW = 40
HOT = 20_000
#: Bits of the row bitmap (as bytes it is an eighth), and of anchor hashes.
BITMAP_BITS, HASH_BITS = 1 << 24, 48
_HOT_SEEN = 1 << 20
#: Bytes of text read for anchors at once, parts cut out of texts at once, and parts compared at once (one anchor's at least).
SLICE, CUT_PARTS, SORTED_PARTS = 1 << 17, 1 << 13, 1 << 15

_ROW = "doc_id long, tie long, "


def _col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return (batch.column(name) if isinstance(batch, pa.Table) else _col(batch, name)).to_numpy(zero_copy_only=False)


# ---- anchors -------------------------------------------------------------------------------


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, hash, first string start, number of strings and distance to the anchor of each anchor.

    The strings of an anchor start one after the other; ties go to the leftmost gram.
    """
    n = len(data) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0 or (np.diff(at) < length).all():
        return empty, empty, empty, empty, empty
    place_bits = 28
    hashes = window_hashes(data, gram)
    least = (hashes & ~np.uint64((1 << place_bits) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    span, width = 1, length - gram + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    least = least[:n]
    anchor = (least & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    valid = np.arange(n) + length <= at[row + 1]
    begins = valid.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(begins)
    counts = np.add.reduceat(valid.astype(np.int64), first) if len(first) else empty
    # valid strings of one anchor are contiguous: what follows them up to the next begin is invalid
    return row[first], (hashes[anchor[first]] >> np.uint64(64 - HASH_BITS)).astype(np.int64), first - at[row[first]], counts, anchor[first] - first


def _packed_place(first: np.ndarray, counts: np.ndarray, lead: np.ndarray) -> np.ndarray:
    return (first << 16) | (counts << 8) | lead


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", SLICE):
        data, at = utf8(_col(batch, "text"))
        row, hashes, first, counts, lead = anchors(data, at)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([_col(batch, "doc_id").take(take), _col(batch, "tie").take(take), pa.array(hashes), pa.array(_packed_place(first, counts, lead))], names=["doc_id", "tie", "h", "place"])


# ---- sorting -------------------------------------------------------------------------------


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of the strings by a blind trie: inner nodes hold a depth and branches by one byte.

    An end of string sorts before any byte and is branch -1.
    """
    leaves: list[list[int]] = []  # equal strings share a leaf

    def byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    root: list | int | None = None  # an inner node is [depth, {byte: node}], a leaf its number
    for i, s in enumerate(strings):
        if root is None:
            leaves.append([i])
            root = 0
            continue
        node = root
        while not isinstance(node, int):  # blind: only branching bytes are looked at
            node = node[1].get(byte(s, node[0]), next(iter(node[1].values())))
        other = strings[leaves[node][0]]
        if other == s:
            leaves[node].append(i)
            continue
        low, high = 0, min(len(s), len(other))
        while low < high:  # longest common prefix with the one leaf
            mid = (low + high + 1) // 2
            low, high = (mid, high) if s[:mid] == other[:mid] else (low, mid - 1)
        leaves.append([i])
        node, above = root, None
        while not isinstance(node, int) and node[0] < low:
            above, node = node, node[1][byte(s, node[0])]
        if not isinstance(node, int) and node[0] == low:
            node[1][byte(s, low)] = len(leaves) - 1
            continue
        new = [low, {byte(other, low): node, byte(s, low): len(leaves) - 1}]
        if above is None:
            root = new
        else:
            above[1][byte(s, above[0])] = new
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, int):
            out += leaves[node]
        else:
            todo += (node[1][b] for b in sorted(node[1], reverse=True))
    return out


def deep_shallow_order(group: np.ndarray, table: np.ndarray, sizes: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of byte strings (rows of ``table``, zero beyond their sizes) within ascending groups."""
    order = np.argsort(group, kind="stable")
    tied = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]])[: len(order)])
    open_ = np.arange(len(order))
    words = table[:, :shallow].copy().view(">u8")
    for k in range(words.shape[1]):  # multikey partitioning, eight bytes at a time, of the groups still tied
        alone = np.ones(len(open_) + 1, bool)
        alone[1:-1] = tied[open_[1:]] != tied[open_[:-1]]
        open_ = open_[~(alone[1:] & alone[:-1])]
        if not len(open_):
            return order
        own = order[open_]
        reach = np.minimum(sizes[own], 8 * (k + 1))  # an end sorts before a zero byte
        rank = np.lexsort((reach, words[own, k], tied[open_]))
        order[open_] = own[rank]
        key, size, before = words[own[rank], k], reach[rank], tied[open_]
        fresh = np.zeros(len(open_), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (before[1:] != before[:-1])
        tied = _names(tied, open_, fresh)
    starts = np.flatnonzero(np.diff(tied, prepend=-1))
    ends = np.append(starts[1:], len(order))
    # a trie of one leaf, or of two leaves, is one comparison for each string: all such at once
    several = np.flatnonzero(ends - starts > 1)
    rows = np.concatenate([np.arange(a, b) for a, b in zip(starts[several], ends[several])]) if len(several) else several
    lead = order[np.repeat(starts[several], (ends - starts)[several])]
    unlike = np.zeros(len(rows), bool)
    for k in range(0, len(rows), 65_536):
        x, y = order[rows[k : k + 65_536]], lead[k : k + 65_536]
        unlike[k : k + 65_536] = (table[x] != table[y]).any(1) | (sizes[x] != sizes[y])
    group = np.repeat(several, (ends - starts)[several])
    several = np.unique(group[unlike])
    pairs = several[(ends - starts)[several] == 2]
    if len(pairs):
        x, y = order[starts[pairs]], order[starts[pairs] + 1]
        apart = table[x] != table[y]
        at = apart.argmax(1)
        swap = np.where(apart.any(1), table[x, at] > table[y, at], sizes[x] > sizes[y])
        first = starts[pairs][swap]
        order[first], order[first + 1] = y[swap], x[swap]
    for g in several[(ends - starts)[several] > 2]:
        own = order[starts[g] : ends[g]]
        order[starts[g] : ends[g]] = own[blind_trie_order([table[i, : sizes[i]].tobytes() for i in own])]
    return order


def _names(tied: np.ndarray, open_: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Group numbers after the open rows at ``fresh`` began groups of their own."""
    begin = np.zeros(len(tied), bool)
    begin[1:] = tied[1:] != tied[:-1]
    begin[open_[fresh]] = True
    return np.cumsum(begin)


def neighbour_prefixes(table: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each string in order with the one before it."""
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 65_536):
        rows = np.arange(a, min(a + 65_536, len(order)))
        x, y = order[rows - 1], order[rows]
        unlike = table[x] != table[y]
        out[rows] = np.minimum(np.where(unlike.any(1), unlike.argmax(1), table.shape[1]), np.minimum(sizes[x], sizes[y]))
    return out


def repeats(key: np.ndarray, rank: np.ndarray, counts: np.ndarray, lead: np.ndarray, text: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(part, string) of every string that starts earlier in another part of its key.

    A part's bytes are ``text[at[i]:at[i + 1]]``: its ``counts`` strings one after the other,
    the anchor ``lead`` bytes after the first. ``rank`` is the order of the parts.
    """
    n = len(key)
    right_size, left_size = np.diff(at) - lead, lead
    right, left = _gathered(text, at[:-1] + lead, right_size, length), _gathered(text, at[:-1] + lead - 1, left_size, length, -1)
    orders, prefixes = [], []
    for table, sizes in ((right, right_size), (left, left_size)):
        order = deep_shallow_order(key, table, sizes)
        prefix = neighbour_prefixes(table, sizes, order)
        prefix[1:][key[order[1:]] != key[order[:-1]]] = -1
        orders.append(order)
        prefixes.append(prefix)
    del right, left
    parts, strings = [], []
    by_rank, width = np.argsort(rank, kind="stable"), max(n, 1).bit_length()
    for away in range(int(lead.max()) + 1 if n else 0):  # distance from a string's start to the anchor
        owns = (lead >= away) & (lead - counts < away)
        if owns.sum() < 2:
            continue
        classes = []
        for order, prefix, need in zip(orders, prefixes, (length - away, away)):
            name = np.empty(n, np.int64)
            name[order] = np.cumsum(prefix < need)
            classes.append(name)
        own = by_rank[owns[by_rank]]
        if 3 * width < 64:  # both classes and the place by rank, sorted as one number
            both = (classes[0][own] << (2 * width)) | (classes[1][own] << width) | np.arange(len(own))
            both.sort()
            own, both = own[both & ((1 << width) - 1)], both >> width
            same = np.zeros(len(own), bool)
            same[1:] = both[1:] == both[:-1]
        else:
            own = own[np.lexsort((classes[1][own], classes[0][own]))]
            same = np.zeros(len(own), bool)
            same[1:] = (classes[0][own][1:] == classes[0][own][:-1]) & (classes[1][own][1:] == classes[1][own][:-1])
        later = own[same]
        parts.append(later)
        strings.append(lead[later] - away)
    return (np.concatenate(parts), np.concatenate(strings)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _gathered(text: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Bytes from each start in one direction, one row each, zero beyond the size."""
    width = -(-width // 8) * 8
    out = np.zeros((len(first), width), np.uint8)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        has = sizes > k
        out[has, k] = text[first[has] + step * k]
    return out


# ---- steps ---------------------------------------------------------------------------------


def _part_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around each wanted anchor (``wanted``: its hash, place and whether it is hot), or hot strings one by one.

    Rows come in order, repeated ones next to each other. A hot string seen before in this
    task is a repeat already: a run of such goes on as ``again``, without bytes and dealt by
    its own place, so that a string meets only the first of each task.
    """
    seen: set[bytes] = set()
    before: tuple | None = None
    for batch in pieces(batches, "text"):
        docs, ties, texts, lists = _col(batch, "doc_id"), _numbers(batch, "tie"), _col(batch, "text"), _col(batch, "wanted")
        keys = list(zip(docs.to_pylist(), ties.tolist()))
        fresh = np.array([key != last for key, last in zip(keys, [before, *keys])])  # one id and one text: one text
        before = keys[-1]
        wanted = lists.flatten()
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        hashes, place = (pc.struct_field(wanted, name).to_numpy() for name in ("h", "place"))
        hot = pc.struct_field(wanted, "hot").to_numpy(zero_copy_only=False)
        data, at = utf8(texts)
        plain = np.flatnonzero(fresh[row] & ~hot)
        for k in range(0, len(plain), CUT_PARTS):
            own = plain[k : k + CUT_PARTS]
            begin, size = at[row[own]] + (place[own] >> 16), ((place[own] >> 8) & 255) - 1 + LENGTH
            bounds = row_starts(size)
            flat = data[np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1])]
            cut = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat)])
            take = pa.array(row[own])
            yield pa.RecordBatch.from_arrays([docs.take(take), pa.array(ties[row[own]]), pa.array(hashes[own]), pa.array(place[own]), cut, pa.array(np.zeros(len(own), bool))], names=_PART)
        crowded = np.flatnonzero(fresh[row] & hot)
        crowded = crowded[np.lexsort((place[crowded], row[crowded]))]
        if len(crowded):
            yield _hot_parts(crowded, row, place, keys, data, at, seen)


_PART = ["doc_id", "tie", "h", "place", "bytes", "again"]


def _hot_parts(crowded: np.ndarray, row: np.ndarray, place: np.ndarray, keys: list[tuple], data: np.ndarray, at: np.ndarray, seen: set[bytes]) -> pa.RecordBatch:
    """The strings of hot anchors one by one, those in ``seen`` as runs."""
    rows: list[list] = [[] for _ in _PART]
    for w in crowded.tolist():
        (doc, tie), raw = keys[row[w]], data[at[row[w]] : at[row[w] + 1]]
        first, count, lead = int(place[w]) >> 16, (int(place[w]) >> 8) & 255, int(place[w]) & 255
        found, begin = [], None
        for k in range(count + 1):
            own = raw[first + k : first + k + LENGTH].tobytes()
            digest = hashlib.blake2b(own, digest_size=16).digest() if k < count else b""
            if digest in seen:
                begin = k if begin is None else begin
                continue
            if begin is not None:
                found.append((hash((doc or 0, tie, first + begin)), _packed(first + begin, k - begin, 0), b"", True))
                begin = None
            if k < count:
                if len(seen) >= _HOT_SEEN:  # a string is passed on once more after that
                    seen.clear()
                seen.add(digest)
                found.append((int.from_bytes(digest[:8], "little", signed=True) | 1 << 62, _packed(first + k, 1, max(lead - k, 0)), own, False))
        for x in found:
            for column, value in zip(rows, (doc, tie, *x)):
                column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=_PART)


def _packed(first: int, count: int, lead: int) -> int:
    return (first << 16) | (count << 8) | lead


def _repeat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs of bytes (a, b) from the parts of this partition's anchors, in order of anchor; those known as repeats pass through.

    The parts of whole anchors are compared together, about ``SORTED_PARTS`` at a time.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        again = _col(batch, "again")
        if again.true_count:
            known, batch = batch.filter(again), batch.filter(pc.invert(again))
            place = _numbers(known, "place")
            a = place >> 16
            yield pa.RecordBatch.from_arrays([_col(known, "doc_id"), _col(known, "tie"), pa.array(a), pa.array(a + ((place >> 8) & 255) - 1 + LENGTH)], names=["doc_id", "tie", "a", "b"])
        if not batch.num_rows:
            continue
        if size >= SORTED_PARTS:
            key = _numbers(batch, "h")
            end = int(np.searchsorted(key, _col(held[-1], "h")[-1].as_py(), side="right"))
            if end < batch.num_rows:  # the last anchor held ends here
                yield from _repeated_runs(pa.Table.from_batches([*held, batch.slice(0, end)]))
                held, size, batch = [], 0, batch.slice(end)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield from _repeated_runs(pa.Table.from_batches(held))


def _repeated_runs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Repeated runs of bytes (a, b) from the parts of whole anchors."""
    known = table.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    doc = table.column("doc_id").fill_null(0).to_numpy()
    tie, key, place = (table.column(c).to_numpy(zero_copy_only=False) for c in ("tie", "h", "place"))
    first, counts, lead = place >> 16, (place >> 8) & 255, place & 255
    text, at = utf8(table.column("bytes"))
    order = np.lexsort((first, tie, doc, known))
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([x[order][1:] != x[order][:-1] for x in (first, tie, doc, known)], axis=0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    use = np.sort(order[fresh])  # repeated rows of one id and text are one
    flat, bounds = _slices(text, at, use)
    parts, start = repeats(key[use], rank[use], counts[use], lead[use], flat, bounds)
    part = use[parts]
    if not len(part):
        return
    order = np.lexsort((start, part))
    part, start = part[order], start[order]
    begin = np.ones(len(part), bool)
    begin[1:] = (part[1:] != part[:-1]) | (start[1:] != start[:-1] + 1)
    a, last = np.flatnonzero(begin), np.append(np.flatnonzero(begin)[1:], len(part)) - 1
    for k in range(0, len(a), 50_000):
        x, y = a[k : k + 50_000], last[k : k + 50_000]
        rows = part[x]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[rows], mask=~known[rows]), pa.array(tie[rows]), pa.array(first[rows] + start[x]), pa.array(first[rows] + start[y] + LENGTH)], names=["doc_id", "tie", "a", "b"]
        )


def _slices(text: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(rows) == len(at) - 1:  # all, in order
        return text, at
    sizes = at[rows + 1] - at[rows]
    bounds = row_starts(sizes)
    return text[np.repeat(at[rows] - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the merged runs leave of each text."""
    for batch in pieces(batches, "text"):
        removed, spans, digests = [], [], []
        for text, runs in zip(_col(batch, "text").to_pylist(), _col(batch, "runs").to_pylist()):
            raw, kept, end, n = text.encode(), [], 0, 0
            gone = 0
            for r in sorted((r["a"], r["b"]) for r in runs):
                if n == 0 or r[0] > end:
                    kept.append(raw[end : r[0]])
                    n, gone, end = n + 1, gone + r[1] - r[0], r[1]
                elif r[1] > end:
                    gone, end = gone + r[1] - end, r[1]
            rest = b"".join([*kept, raw[end:]])
            removed.append(gone)
            spans.append(n)
            digests.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [_col(batch, "doc_id"), _col(batch, "tie"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "tie", "n_removed", "n_spans", "kept_sha256"]
        )


def _bit_of(doc: Column, tie: Column) -> Column:
    return F.pmod(F.xxhash64(doc, tie), F.lit(BITMAP_BITS))


def rows_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` that may be in ``keys`` by (doc_id, tie): a bitmap of fixed size, so some others too."""
    bit = _bit_of(F.col("doc_id"), F.col("tie"))
    made = keys.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in made.collect():  # BITMAP_BITS in all
        own = np.frombuffer(bytes(r.bits), np.uint8)
        at = (r.bucket - 1) * 4096
        bitmap[at : at + 4096] = own[: len(bitmap) - at]
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    names = rows.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _numbers(batch, "_bit")
            yield batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)).select(names)

    return rows.withColumn("_bit", bit).mapInArrow(keep, rows.schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    twice = not own.groupBy("doc_id").count().where("count > 1").isEmpty()
    own = own.select("doc_id", (F.xxhash64("text") if twice else F.lit(0).cast("long")).alias("tie"), "text")  # texts of one id are told apart
    found = own.mapInArrow(_anchor_batches, _ROW + "h long, place long")  # made twice: less than writing them down
    # written down, so that the join below has plain shuffles on both sides and hot anchors are split
    repeated = kept_table(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > HOT).alias("hot")), "repeated")
    gathered = F.collect_set if twice else F.collect_list  # repeated rows have the same anchors
    wanted = kept_table(found.join(repeated, "h").groupBy("doc_id", "tie").agg(gathered(F.struct("h", "place", "hot")).alias("wanted")), "wanted")
    names = ["doc_id", "tie"]
    ask = wanted.select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), "wanted")

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, left["doc_id"].eqNullSafe(right["_doc"]) & (left["tie"] == right["_tie"])).drop("_doc", "_tie")

    parts = joined(rows_in(own, wanted.select(names)), ask).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").mapInArrow(_part_batches, _ROW + "h long, place long, bytes binary, again boolean")
    dealt = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h").sortWithinPartitions("h")
    runs = kept_table(dealt.mapInArrow(_repeat_batches, _ROW + "a long, b long").groupBy(names).agg(F.collect_list(F.struct("a", "b")).alias("runs")), "runs")
    have = runs.select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), "runs")
    cut = joined(rows_in(own, runs.select(names)), have).mapInArrow(_cut_batches, _ROW + "n_removed long, n_spans long, kept_sha256 string").dropDuplicates(names)
    cut = cut.select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), "n_removed", "n_spans", F.col("kept_sha256").alias("_kept"))
    whole = own.select("doc_id", "tie", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("_whole"))
    both = whole.join(cut, whole["doc_id"].eqNullSafe(cut["_doc"]) & (whole["tie"] == cut["_tie"]), "left")
    zero = F.lit(0).cast("long")
    return both.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("_kept", "_whole").alias("kept_sha256"))
