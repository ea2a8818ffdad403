"""Prefix trie of conversations in balanced parentheses, built shard by shard.

Every conversation becomes a path: 16 zero bytes for the root and the 16-byte digest of each
turn. Equal paths collapse to one row with the number and smallest id of its conversations.
The paths are range-partitioned in sorted order, so that a shard's paths form a connected part
of the trie. A shard writes its part as balanced parentheses with the excess of the sequence in
blocks, each block with its least and greatest excess. ``close`` skips the blocks that cannot
hold the excess sought and so delimits every subtree; the rank of leaf pairs counts its leaves;
cumulative arrays over the opening parentheses give its conversations and savings. These
figures are final except on the shard's first and last path, its spines, which neighbours may
share. The spines go on as paths that carry the sums of what hangs on them, are partitioned
again into fewer shards, and merge there, until one shard holds them all.

A path is at most ``LEVEL`` turns long. Longer conversations go on as paths of a further
level, below the node where they were cut; levels are built from the deepest, and the totals
of a cut node enter the level above as part of it. Turns are numbered by range partitions, so
a conversation of any length is spread over tasks. The ids that end at one node are hashed in
their order by one task, which gets them as texts of up to ``CHUNK_IDS`` ids and keeps none.

Defined results: null role or text is empty; null turns come first; turns of equal number
come in the order of their digests; repeated rows are turns of their own; rows without a
conv_id belong to no conversation; a conversation without turns ends at the root; an empty
table has no node, not even a root; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gullwatch.llm.common import kept_table
from gullwatch.operators.ordering import number_rows

#: Turns of a path, nodes of a shard, excess values of a block, ids of a text that is hashed.
LEVEL = 1 << 15
SHARD_NODES = 1 << 14
BLOCK = 64
CHUNK_IDS = 4096

_KEY = 16
_ROOT = bytes(_KEY)
_NONE = np.iinfo(np.int64).max
_NO_ENDS = hashlib.sha256(b"").hexdigest()
#: What a node has beside its own subtree in the shard: conversations, smallest of them, children, leaves, savings.
ENDS, LOW, KIDS, LEAVES, SAVED = range(5)

_BUILT = (
    "kind string, id binary, parent_id binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, ends_sha256 string, key binary, chars binary, sums binary, hashes binary"
)
_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


class Parens:
    """Balanced parentheses: True opens, False closes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        n = -(-len(bits) // BLOCK)
        padded = np.concatenate([self.excess, np.repeat(self.excess[-1:], n * BLOCK - len(bits))])
        self.blocks = padded.reshape(n, BLOCK)
        # least and greatest excess of 1, 2, 4, ... blocks from each block on
        self.least, self.greatest = [self.blocks.min(axis=1)], [self.blocks.max(axis=1)]
        while 2 ** len(self.least) <= n:
            half = 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))
            self.greatest.append(np.maximum(self.greatest[-1][:-half], self.greatest[-1][half:]))

    def close(self, opens: np.ndarray) -> np.ndarray:
        """Position of the parenthesis that closes each of ``opens``: the next place of an excess one less."""
        sought = self.excess[opens] - 1
        block = opens // BLOCK
        here = (self.blocks[block] == sought[:, None]) & (np.arange(BLOCK) > (opens % BLOCK)[:, None])
        far = np.flatnonzero(~here.any(axis=1))
        after = block[far] + 1
        for k in range(len(self.least) - 1, -1, -1):
            fits = after < len(self.least[k])
            at = np.minimum(after, len(self.least[k]) - 1)
            skip = fits & ((self.least[k][at] > sought[far]) | (self.greatest[k][at] < sought[far]))
            after = after + np.where(skip, 2**k, 0)
        block[far] = after
        here[far] = self.blocks[after] == sought[far][:, None]
        return block * BLOCK + here.argmax(axis=1)

    def leaf_rank(self) -> np.ndarray:
        """Number of pairs () that open before each position, one more entry."""
        pair = self.bits & ~np.append(self.bits[1:], True)
        return np.concatenate([[0], np.cumsum(pair)])


class Path(NamedTuple):
    key: bytes
    chars: np.ndarray  # code points of each node's last text
    sums: np.ndarray  # for each node: ENDS, LOW, KIDS, LEAVES, SAVED
    hashes: bytes  # 32 bytes a node, zeros for none
    goes_on: bool  # the last node has paths of a further level


def _first_paths(batch: pa.RecordBatch) -> Iterator[Path]:
    for r in batch.to_pylist():
        n = len(r["key"]) // _KEY
        sums = np.zeros((n, 5), np.int64)
        sums[:, LOW] = _NONE
        lows = [x for x in (r["ends_low"], r["below_low"]) if x is not None]
        sums[-1] = (r["ends"] or 0) + (r["below"] or 0), min(lows, default=_NONE), r["below_kids"] or 0, r["below_leaves"] or 0, r["below_saved"] or 0
        own = bytes.fromhex(r["ends_sha256"]) if r["ends_sha256"] else bytes(32)
        yield Path(r["key"], np.array([0, *r["chars"]], np.int64), sums, bytes(32 * (n - 1)) + own, r["below"] is not None)


def _spine_paths(batch: pa.RecordBatch) -> Iterator[Path]:
    for r in batch.select(["key", "chars", "sums", "hashes"]).to_pylist():
        yield Path(r["key"], np.frombuffer(r["chars"], np.int64), np.frombuffer(r["sums"], np.int64).reshape(-1, 5), r["hashes"], False)


def node_id(key: bytes) -> bytes:
    return key if len(key) == _KEY else hashlib.md5(key).digest()


class Shard:
    """The trie of some sorted paths."""

    def __init__(self):
        self.paths: list[Path] = []
        self.made: list[tuple[int, int, int]] = []  # path, index in it and parent of each node, in preorder
        self.bits: list[bool] = []
        self.stack: list[int] = []
        self.first: list[int] = []
        self.added: list[tuple[int, int, int]] = []  # node, path, index

    def add(self, path: Path) -> None:
        p, n, shared = len(self.paths), len(path.key) // _KEY, 0
        if p:
            before = self.paths[-1].key
            most = min(len(before) // _KEY, n)
            while shared < most and before[shared * _KEY : (shared + 1) * _KEY] == path.key[shared * _KEY : (shared + 1) * _KEY]:
                shared += 1
        self.bits += [False] * (len(self.stack) - shared)
        del self.stack[shared:]
        for i in range(shared, n):
            self.stack.append(len(self.made))
            self.made.append((p, i, self.stack[i - 1] if i else -1))
            self.bits.append(True)
        self.paths.append(path)
        if not p:
            self.first = self.stack[:]
        carrying = np.flatnonzero((path.sums[:, LOW] != _NONE) | path.sums[:, [ENDS, KIDS, LEAVES, SAVED]].any(axis=1))
        self.added += [(self.stack[i], p, i) for i in carrying]

    def build(self, depth: int, last: bool, name_all: bool) -> Iterator[dict]:
        """Rows of the nodes that are final, and of the spines unless this is the last shard; paths start ``depth`` turns deep."""
        m = len(self.made)
        path, index, parent = np.array(self.made, np.int64).T
        parens = Parens(np.array(self.bits + [False] * len(self.stack)))
        opens = np.flatnonzero(parens.bits)
        close = parens.close(opens)
        end = np.arange(m) + (close - opens + 1) // 2  # a subtree is a range of opening parentheses
        sums, hashes = np.zeros((m, 5), np.int64), [None] * m
        sums[:, LOW] = _NONE
        for node, p, i in self.added:
            own = self.paths[p].sums[i]
            low = min(sums[node, LOW], own[LOW])
            sums[node] += own
            sums[node, LOW] = low
            digest = self.paths[p].hashes[32 * i : 32 * i + 32]
            if any(digest):
                hashes[node] = digest
        for node in range(m - 1, 0, -1):
            if parent[node] >= 0 and sums[node, LOW] < sums[parent[node], LOW]:
                sums[parent[node], LOW] = sums[node, LOW]
        chars = np.array([self.paths[p].chars[i] for p, i in zip(path, index)], np.int64)
        spine = np.zeros(m, bool)
        if not last:
            spine[self.first] = spine[self.stack] = True

        def below(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[end] - total[:m]

        convs = below(sums[:, ENDS])
        # a pair () is no leaf where it has children elsewhere or may have them in another shard
        no_leaf = (opens + 1 == close) & (spine | (sums[:, KIDS] > 0))
        rank = parens.leaf_rank()
        leaves = rank[close] - rank[opens] + below(sums[:, LEAVES] - no_leaf)
        saved = below(sums[:, SAVED] + np.where(spine, 0, (convs - 1) * chars))
        inner = (parent >= 0) & ~spine
        kids = sums[:, KIDS] + np.bincount(parent[inner], minlength=m)

        def named(node: int) -> bytes:
            return node_id(self.paths[path[node]].key[: _KEY * (int(index[node]) + 1)])

        names = {int(node): named(node) for node in np.flatnonzero(spine)}
        cut = {node for node, p, i in self.added if self.paths[p].goes_on}
        for node in np.flatnonzero(~spine):
            up = int(parent[node])
            row = {"conv_id": sums[node, LOW], "depth": depth + index[node], "n_convs": convs[node], "n_children": kids[node], "n_leaves": leaves[node], "saved_tokens": saved[node]}
            if depth and not index[node]:
                yield {"kind": "total", "id": named(node), **row}
                continue
            row["ends_sha256"] = hashes[node].hex() if hashes[node] else _NO_ENDS
            if name_all or node in cut:
                row["id"] = named(node)
            if up >= 0 and (spine[up] or (depth and not index[up])):
                row["parent_id"] = names.get(up) or named(up)
            elif up >= 0:
                row["parent_conv_id"] = sums[up, LOW]
            yield {"kind": "node", **row}
        if not last:
            yield from self._spines(np.stack([convs, sums[:, LOW], kids, leaves, saved], axis=1), parent, spine, chars, hashes)

    def _spines(self, totals: np.ndarray, parent: np.ndarray, spine: np.ndarray, chars: np.ndarray, hashes: list) -> Iterator[dict]:
        hanging = totals.copy()
        for node in np.flatnonzero(spine & (parent >= 0)):
            hanging[parent[node], [ENDS, LEAVES, SAVED]] -= totals[node, [ENDS, LEAVES, SAVED]]
        told: set[int] = set()
        for p, nodes in {0: self.first, len(self.paths) - 1: self.stack}.items():
            sums = np.zeros((len(nodes), 5), np.int64)
            sums[:, LOW] = _NONE
            digests = []
            for i, node in enumerate(nodes):
                fresh = node not in told
                digests.append(hashes[node] if fresh and hashes[node] else bytes(32))
                if fresh:
                    sums[i] = hanging[node]
            told.update(nodes)
            yield {"kind": "spine", "key": self.paths[p].key, "chars": chars[nodes].tobytes(), "sums": sums.tobytes(), "hashes": b"".join(digests)}


def _built_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([None if (x := r.get(f.name)) is None else (int(x) if pa.types.is_int64(f.type) else x) for r in rows], f.type) for f in schema], schema=schema)


_ARROW = pa.schema([(name, {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[kind]) for name, kind in (part.split() for part in _BUILT.split(","))])


def _build(paths: DataFrame, depth: int, shard_nodes: int, first: bool, last: bool) -> DataFrame:
    read = _first_paths if first else _spine_paths

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for path in read(batch):
                if not last and len(shard.made) > 2 * shard_nodes and len(shard.paths) > 3:
                    yield _built_batch(list(shard.build(depth, last, not first)), _ARROW)
                    shard = Shard()
                shard.add(path)
        if shard.paths:
            yield _built_batch(list(shard.build(depth, last, not first)), _ARROW)

    return paths.sortWithinPartitions("key").mapInArrow(shards, _BUILT)


def _trie(paths: DataFrame, depth: int, shard_nodes: int) -> list[DataFrame]:
    """Written tables of the nodes and totals of one level."""
    out, first = [], True
    while True:
        size = paths.agg(F.count(F.lit(1)).alias("paths"), F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("bytes")).first()
        nodes, n = size["bytes"] // _KEY, size["paths"]
        if n <= 8 or nodes <= shard_nodes:  # at most eight paths, or one shard
            out.append(kept_table(_build(paths.coalesce(1), depth, shard_nodes, first, True), "trie"))
            return out
        # four paths a shard at least, of which two go on
        built = kept_table(_build(paths.repartitionByRange(min(-(-nodes // shard_nodes), n // 4), "key"), depth, shard_nodes, first, False), "trie")
        out.append(built)
        paths, first = built.where(F.col("kind") == "spine"), False


# ---- paths ------------------------------------------------------------------------------


def turn_paths(conversations: DataFrame, level_turns: int = LEVEL, family: int = 100, shared: int = 6) -> DataFrame:
    """conv_id, total, level, path and chars: the rebuilt turns of every conversation in pieces of ``level_turns`` turns.

    The first h turns of a conversation are those of the first of its family of ``family`` ids,
    h being the remainder of its id's crc32 by ``shared``.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    turns = number_rows(turns, ["conv_id", "turn", "digest"], "number")
    c = F.col("conv_id")
    convs = turns.groupBy("conv_id").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("n_own"))
    convs = kept_table(convs.select("conv_id", "start", "n_own", (c - c % family).alias("donor"), (F.crc32(c.cast("string").cast("binary")) % shared).alias("h")), "conversations")
    placed = turns.join(convs, "conv_id").withColumn("at", F.col("number") - F.col("start"))
    lent = placed.where((c % family == 0) & (F.col("at") < shared - 1)).groupBy(c.alias("donor")).agg(F.array_sort(F.collect_list(F.struct("at", "digest", "chars"))).alias("lent"))
    none = F.array().cast("array<struct<at:bigint,digest:string,chars:bigint>>")
    rebuilt = convs.join(lent, "donor", "left").withColumn("lent", F.slice(F.coalesce("lent", none), F.lit(1), F.col("h").cast("int")))
    rebuilt = rebuilt.select("conv_id", "h", "lent", "start", (F.size("lent") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("total"), F.size("lent").alias("n_lent"))
    rebuilt = kept_table(rebuilt, "rebuilt")
    head = rebuilt.select("conv_id", "total", F.explode("lent").alias("t")).select("conv_id", "total", "t.at", "t.digest", "t.chars")
    own = turns.join(rebuilt.select("conv_id", "h", "start", "n_lent", "total"), "conv_id").withColumn("at", F.col("number") - F.col("start") - F.col("h"))
    own = own.where(F.col("at") >= 0).select("conv_id", "total", (F.col("at") + F.col("n_lent")).alias("at"), "digest", "chars")
    level = F.floor(F.col("at") / level_turns).cast("int")
    pieces = head.unionAll(own).groupBy("conv_id", "total", level.alias("level")).agg(F.array_sort(F.collect_list(F.struct("at", "digest", "chars"))).alias("turns"))
    paths = pieces.select("conv_id", "total", "level", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.col("turns.chars").alias("chars"))
    empty = rebuilt.where(F.col("total") == 0).select("conv_id", "total", F.lit(0).alias("level"), F.lit(b"").alias("path"), F.array().cast("array<bigint>").alias("chars"))
    return paths.unionAll(empty)


def _node_id(key: Column) -> Column:
    return F.when(F.length(key) == _KEY, key).otherwise(F.unhex(F.md5(key)))


def _levels(paths: DataFrame, level_turns: int) -> list[DataFrame]:
    """conv_id, key, end, chars and goes_on of each level; the key starts with the node above."""
    paths = kept_table(paths, "paths")
    deepest = paths.agg(F.max("level").alias("level")).first()["level"]
    levels: list[DataFrame] = []
    for i in range(0 if deepest is None else deepest + 1):
        own = paths.where(F.col("level") == i)
        if i:
            above = levels[-1].where("goes_on").select("conv_id", F.col("end").alias("top"))
            own = own.join(above, "conv_id")
        key = F.concat(F.col("top") if i else F.lit(_ROOT), "path")
        own = own.select("conv_id", key.alias("key"), "chars", (F.col("total") > (i + 1) * level_turns).alias("goes_on")).withColumn("end", _node_id(F.col("key")))
        levels.append(kept_table(own, "level"))
    return levels


def end_hashes(ends: DataFrame) -> DataFrame:
    """end, ends, ends_low and ends_sha256: the conversations that end at a node, hashed in the order of their ids."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            end, ids = batch.column(0), batch.column(1).to_numpy()
            names = end.to_pylist()
            starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1] or not i % CHUNK_IDS]
            rows = list(zip(starts, [*starts[1:], len(names)]))
            columns = [[names[a] for a, _ in rows], [int(ids[a]) for a, _ in rows], [b - a for a, b in rows], [",".join(map(str, ids[a:b].tolist())) for a, b in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["end", "low", "n", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []
        for batch in batches:
            for end, low, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != end:
                    if state is not None:
                        done.append((state[0], state[1], state[2], state[3].hexdigest()))
                    state = [end, 0, low, hashlib.sha256()]
                else:
                    state[3].update(b",")
                state[1] += n
                state[3].update(ids.encode())
            yield _hashed_batch(done)
            done = []
        if state is not None:
            yield _hashed_batch([(state[0], state[1], state[2], state[3].hexdigest())])

    chunks = ends.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(texts, "end binary, low long, n long, ids string")
    return chunks.repartition("end").sortWithinPartitions("end", "low").mapInArrow(hashed, "end binary, ends long, ends_low long, ends_sha256 string")


def _hashed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["end", "ends", "ends_low", "ends_sha256"])


def nodes(conversations: DataFrame, level_turns: int = LEVEL, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row a node of the trie of all rebuilt conversations."""
    levels = _levels(turn_paths(conversations, level_turns), level_turns)
    built: list[DataFrame] = []
    below = None
    for i in range(len(levels) - 1, -1, -1):
        rows = levels[i]
        ends = end_hashes(rows.where(~F.col("goes_on")))
        paths = rows.groupBy("end").agg(F.first("key").alias("key"), F.first("chars").alias("chars")).join(ends, "end", "left")
        if below is None:
            paths = paths.select("*", *(F.lit(None).cast("long").alias(c) for c in ("below", "below_low", "below_kids", "below_leaves", "below_saved")))
        else:
            paths = paths.join(below, "end", "left")
        tables = _trie(kept_table(paths.drop("end"), "ends"), i * level_turns, shard_nodes)
        built += tables
        totals = reduce(DataFrame.unionAll, [t.where(F.col("kind") == "total") for t in tables])
        below = totals.select(F.col("id").alias("end"), F.col("n_convs").alias("below"), F.col("conv_id").alias("below_low"), F.col("n_children").alias("below_kids"), F.col("n_leaves").alias("below_leaves"), F.col("saved_tokens").alias("below_saved"))
    if not built:
        return conversations.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in _NODE))
    found = reduce(DataFrame.unionAll, built).where(F.col("kind") == "node")
    parents = found.where(F.col("id").isNotNull()).select(F.col("id").alias("parent_id"), F.col("conv_id").alias("known"))
    direct = found.where(F.col("parent_id").isNull()).select(*_NODE)
    waiting = found.where(F.col("parent_id").isNotNull()).drop("parent_conv_id").join(parents, "parent_id").withColumnRenamed("known", "parent_conv_id").select(*_NODE)
    return direct.unionAll(waiting)
