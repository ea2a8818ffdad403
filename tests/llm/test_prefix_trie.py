import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gullwatch.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {c: [t[2] for t in sorted(x, key=lambda t: t[:2])] for c, x in own.items()}
    nodes = defaultdict(list)
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
        for d in range(len(rebuilt[c]) + 1):
            nodes[rebuilt[c][:d]].append(c)
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + (len(nodes[path]) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if rebuilt[c] == path))
        up = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), up, len(members), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def talks():
    rng = random.Random(5)
    rows = []
    for c in [*range(60), *range(100, 150), *range(203, 240), 400, 517]:
        for t in range(rng.choice((1, 2, 3, 4, 6, 9))):
            rows.append((c, t, rng.choice(("user", None)), rng.choice(("a", "é😀", "ccc", None, ""))))
    for c in range(600, 700):  # copies
        rows += [(c, t, "user", "same" * t) for t in range(8)]
    return rows + [(c, t, "user", "long") for c in (720, 733) for t in range(40 + c % 7)]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("level_turns, shard_nodes", [(prefix_trie.LEVEL, prefix_trie.SHARD_NODES), (prefix_trie.LEVEL, 20), (4, 30)])
def test_equals_brute_force(spark, level_turns, shard_nodes):
    rows = talks()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(prefix_trie.nodes(df, level_turns, shard_nodes)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (1, 2, "user", "x" * 100_000), (1, 2, "user", "x"), (None, 0, "user", "y"), (-7, 0, "a", "b"), (-7, 0, "a", "b"), (3, 0, "a", "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS end", "'x' AS key", "'x' AS number", "'x' AS level", "'x' AS digest", "'x' AS start")
    out = prefix_trie.nodes(df)
    assert got(out) == brute(rows)
    none = prefix_trie.nodes(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == out.columns and none.dtypes == out.dtypes


def test_parentheses():
    rng = random.Random(9)
    bits = []
    open_now = 0
    for _ in range(3000):
        up = open_now < 2 or rng.random() < 0.52
        bits.append(up)
        open_now += 1 if up else -1
    bits = [True, *bits, *[False] * (open_now + 1)]
    want, stack = {}, []
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    parens = prefix_trie.Parens(np.array(bits))
    opens = np.flatnonzero(parens.bits)
    assert parens.close(opens).tolist() == [want[i] for i in opens]
    assert parens.leaf_rank()[-1] == sum(a and not b for a, b in zip(bits, bits[1:]))


def test_many_ends_are_hashed_in_order(spark):
    ids = list(range(5, 30_000))
    ends = spark.createDataFrame([(b"k" * 16, i) for i in random.Random(1).sample(ids, len(ids))] + [(b"a" * 16, 3)], "end binary, conv_id long").repartition(5)
    rows = {bytes(r.end): (r.ends, r.ends_low, r.ends_sha256) for r in prefix_trie.end_hashes(ends).collect()}
    assert rows[b"k" * 16] == (len(ids), 5, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert rows[b"a" * 16] == (1, 3, hashlib.sha256(b"3").hexdigest())
