import hashlib
import random

import numpy as np
from helpers import SCHEMA, babble, no_documents, odd_documents, rows_of

from gullwatch.llm import fingerprints


def texts_of(n=40):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    return [". ".join(babble(rng, rng.randint(3, 30), words) for _ in range(rng.randint(1, 40))) for _ in range(n)] + ["", "same", "same", "é" * 9]


def test_rows_equal_plain_python(spark):
    texts = texts_of()
    got = {r.doc_id: r for r in fingerprints.compare_with_edits(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(5)).collect()}
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        assert got[i].near_edited == share(text, edited) and got[i].near_next == share(text, after)
    assert got[41].fingerprint == got[42].fingerprint and got[41].near_next == 1.0


def share(a, b):
    """Common length of digests by counting, without sketches."""
    sides = [fingerprints.paragraph_digests([x])[0] for x in (a, b)]
    size = lambda d: int((d & np.uint64(0xFFFF)).astype(np.int64).sum())
    apart = size(np.setxor1d(*sides))
    return 1 - apart / max(size(sides[0]) + size(sides[1]), 1)


def test_peeling_recovers_differences_and_failure_grows():
    rng = np.random.RandomState(1)
    a, b = (rng.randint(1, 1 << 62, n).astype(np.uint64) for n in (300, 7))
    sign = np.array([1] * 4 + [-1] * 3)
    found, of, done = fingerprints.peel(*fingerprints.sketches(b, np.zeros(7, np.int64), sign, 1, 24), 1, 24)
    assert done.all() and sorted(found.tolist()) == sorted(b.tolist()) and (of == 0).all()
    many = fingerprints.peel(*fingerprints.sketches(a, np.zeros(300, np.int64), np.ones(300, np.int64), 1, 24), 1, 24)
    assert not many[2].any()
    bounds = np.array([0, 300])
    assert fingerprints.likeness((a, bounds), (np.concatenate([a[:299], b[:1]]), bounds))[0] > 0.95


def test_equal_digests_on_one_side_are_counted():
    a = np.array([70000, 70000, 70000], np.uint64)
    assert fingerprints.likeness((a, np.array([0, 3])), (a[:1], np.array([0, 1])))[0] == 0.5


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = fingerprints.compare_with_edits(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.compare_with_edits(no_documents(spark)).count() == 0
    (one,) = fingerprints.compare_with_edits(spark.createDataFrame(rows_of(["abcd"]), SCHEMA)).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
