import math
import random
import re
from collections import Counter

import numpy as np
from helpers import LOWER, babble, no_documents, odd_documents

from gullwatch.llm import search
from gullwatch.llm.common import WORD_BYTES, word_bounds

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def brute(docs, items, k=10):
    own = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n_docs, n_words = sum(n > 0 for *_, n in own), sum(n for *_, n in own)
    df = Counter(w for _, bag, _ in own for w in bag)
    out = []
    for item, text in items:
        scores = []
        for doc, bag, n in own:
            m = 25 + (75 * n * n_docs) // max(n_words, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 8 * m)) for w in words(text) if bag[w])
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


def tables():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ab", "é", "the", "the", "the", "the"]
    texts = [babble(rng, rng.choice((1, 3, 20, 60)), vocabulary) for _ in range(150)]
    docs = list(enumerate(texts + texts[:20] + [texts[3]] * 40 + [None, "", "..."]))
    items = [(i, babble(rng, rng.choice((1, 2, 8, 30)), vocabulary + ["unheard"])) for i in range(12)] + [(50, "THE the ab"), (51, None), (52, ""), (53, "unheard")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_equals_brute_force(spark):
    docs, items = tables()
    assert rows(search.search(*frames(spark, docs, items))) == sorted(brute(docs, items))


def test_small_shards_and_blocks_give_the_same(spark, monkeypatch):
    docs, items = tables()
    monkeypatch.setattr(search, "BLOCK_BYTES", 400)
    assert rows(search.search(*frames(spark, docs, items), cells=300, step=1)) == sorted(brute(docs, items))


def test_slices_end_between_words():
    raw = np.frombuffer(("ab, é12 " * 50 + "x" * 90 + " . " + "y" * 30).encode(), np.uint8)
    parts = list(search.word_slices(raw, 16))
    assert b"".join(p.tobytes() for p in parts) == raw.tobytes() and len(parts) > 20
    assert [w for p in parts for w in search.text_words(p.tobytes())] == search.text_words(raw.tobytes())


def test_stops_before_the_end_of_the_lists():
    rng = np.random.RandomState(3)
    n, read = 4000, []
    counts = np.ones(2 * n, np.int64)
    counts[:20] = 50
    row, term = np.concatenate([rng.permutation(n), rng.permutation(n)]), np.repeat([0, 1], n)
    shard = search.Shard(np.arange(n), np.full(n, 100), row, term, counts, 2, n, 100 * n)
    met = search.best_of
    search.best_of = lambda k, *parts: read.append(len(parts[1][0])) or met(k, *parts)
    try:
        scores, ids = shard.search(np.array([0, 1]), np.array([900, 10]), 10, (np.zeros(0, np.int64),) * 2)
    finally:
        search.best_of = met
    assert set(ids) <= set(row[:20]) and sum(read) < 300


def test_words_of_equal_hash_are_told_apart():
    own = [b"aa", b"bb", b"abc"]
    terms = search.Terms(np.full(3, 7, np.uint64), np.frombuffer(b"".join(own), np.uint8), np.array([0, 2, 4, 7]))
    data = np.frombuffer(b"bb abc zz aa", np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), WORD_BYTES)
    hashes = search.range_hashes
    search.range_hashes = lambda d, s, e: np.full(len(s), 7, np.uint64)
    try:
        assert search.find_terms(data, starts, ends, terms).tolist() == [1, 2, -1, 0]
    finally:
        search.range_hashes = hashes


def test_odd_rows(spark):
    docs = odd_documents(spark).selectExpr("*", "'x' AS n", "'x' AS terms", "'x' AS item", "'x' AS score")
    items = spark.createDataFrame([(1, "A word x"), (1, "A word x"), (1, "b"), (None, "a"), (3, None)], "item_id long, text string").selectExpr("*", "'x' AS doc_id")
    own = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(own, [(1, "A word x"), (1, "b"), (None, "a")])
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] is None, r[2] or 0)
    got = [tuple(r) for r in search.search(docs, items).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert search.search(no_documents(spark), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0


