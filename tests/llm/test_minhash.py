import random

import numpy as np
from helpers import SCHEMA, no_documents, odd_documents, rows_of

from gullwatch.llm import minhash


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """Size, component and flag of each row; the rows of one id are one document."""
    sets, parent = {}, {}
    for doc, text, *_ in rows:
        sets.setdefault(doc, set()).add(shingles(text))
        parent[doc] = doc

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def linked(x, y):
        shared = len(x & y)
        return shared and 100 * shared >= 85 * (len(x) + len(y) - shared)

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            if any(linked(x, y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((doc, len(shingles(text)), root(doc), root(doc) == doc) for doc, text, *_ in rows)


def family(rng, n, length, edits, mark):
    base = [f"{mark}{i}" for i in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_components_of_a_large_family_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rng = random.Random(3)
    texts = family(rng, 400, 150, 9, "w") + family(rng, 60, 60, 3, "v") + ["a b", "A  B", "a b c", "", None] + ["one two three four five six"] * 40
    rows = rows_of(texts)
    rng.shuffle(rows)
    assert sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())) == brute(rows)


def test_repeated_ids_join_their_sets(spark):
    x, y, z = (" ".join(f"{m}{i}" for i in range(40)) for m in "xyz")
    cases = [
        [(3, x), (5, x), (5, y), (7, y)],
        [(3, x), (5, y), (5, x), (7, y), (7, ""), (2, None), (2, z), (9, z + " tail"), (9, z + " tail"), (1, "")],
        [(5, x), (5, y), (5, z), (5, None), (6, z)] + [(8, y + " more")] * 4 + [(4, "a b")],
    ]
    for rows in cases:
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted(map(tuple, got)) == brute(rows)
    assert {r.component_id for r in minhash.near_duplicates(spark.createDataFrame(cases[0], "doc_id long, text string")).collect()} == {3}


def test_estimate_is_corrected_for_chance():
    rng = np.random.RandomState(2)
    common = rng.randint(0, 1 << 62, 800).astype(np.uint64)
    for share in (0.0, 0.5, 0.9):
        both = int(800 * 2 * share / (1 + share))
        other = np.concatenate([common[:both], rng.randint(0, 1 << 62, 800 - both).astype(np.uint64)])
        minima = minhash.signatures([np.unique(common), np.unique(other)])
        signs = minhash.packed(minima)
        assert abs(minhash.estimate(signs[0], signs[1]) - share) < 0.2


def test_deduplicate_keeps_columns_and_first(spark):
    docs = odd_documents(spark)
    named = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    rows = minhash.near_duplicates(docs).collect()
    assert sorted(tuple(r) for r in rows if r.doc_id is not None) == brute(named)
    assert [(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is None] == [(2, None, True)]
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    copies = spark.createDataFrame(rows_of(["one two three four five six"] * 5 + ["other"]), SCHEMA)
    assert sorted(r.doc_id for r in minhash.deduplicate(copies).collect()) == [0, 5]
    assert minhash.near_duplicates(no_documents(spark)).count() == 0


def test_deduplicate_keeps_one_row_of_an_id(spark):
    text, near = "one two three four five six seven", " ".join(f"w{i}" for i in range(200))
    rows = [(1, text)] * 6 + [(2, text)] * 3 + [(3, near), (3, near + " tail"), (3, None), (None, "x y"), (None, "x y"), (4, "alone"), (5, near)] + [(6, "")] * 2
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", None) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(4)
    kept = minhash.deduplicate(docs)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "x y"), (0, "x y"), (1, text), (3, near), (4, "alone"), (6, "")] and kept.columns == docs.columns
    assert minhash.deduplicate(docs.where("doc_id IN (1, 6)")).count() == 2
