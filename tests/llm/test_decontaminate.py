import hashlib
import random
import re

from helpers import LOWER, SCHEMA, babble, no_documents, odd_documents, rows_of

from gullwatch.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        own = words(text)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[i : i + n]), set()).add(item)
    out = {}
    for doc, text, *_ in docs:
        own, hit, of = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in windows:
                    of |= windows[tuple(own[i : i + n])]
                    hit.update(range(i, i + n))
        out[doc] = (len(own), len(hit), len(of), hashlib.sha256(",".join(sorted(map(str, of))).encode()).hexdigest(), bool(hit))
    return out


def tables(spark):
    rng = random.Random(6)
    vocabulary = ["Ab", "cd", "é1", "X9", "zz", "q"]
    items = [(i, babble(rng, n, vocabulary)) for i, n in enumerate([12, 10, 30, 3, 1, 0])] + [(9, None), (10, "Ab cd-é1"), (11, "Ab, cd! é1?")]
    texts = [babble(rng, n, vocabulary + [f"w{k}" for k in range(8)]) for n in (0, 5, 40, 90, 200)]
    texts += [f"before {items[2][1]} after {items[1][1].upper()}", items[0][1], "ab cd é1 ab cd é1", None, ""]
    return rows_of(texts), items, spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force_either_way(spark):
    docs, items, df, benchmark = tables(spark)
    want = brute(docs, items)
    columns = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    for most in (decontaminate.MAX_WINDOWS, 3):
        rows = decontaminate.scan(df, benchmark, max_windows=most).mapInArrow(decontaminate.digest_batches, columns).collect()
        assert {r[0]: tuple(r[1:]) for r in rows} == want
        kept = decontaminate.decontaminate(df, benchmark, max_windows=most)
        assert {r.doc_id for r in kept.collect()} == {d for d, w in want.items() if not w[4]} and kept.columns == df.columns


def test_large_benchmarks_shuffle_candidates_only(spark):
    rng = random.Random(15)
    items = [(i, babble(rng, 730, [f"w{k}" for k in range(900)])) for i in range(290)]
    texts = [babble(rng, 400, [f"w{k}" for k in range(900)]) for _ in range(60)]
    planted = [items[k][1].split()[100 + k : 125 + k] for k in range(8)]
    texts += ["x " + " ".join(p) + " y" for p in planted] + [babble(rng, 30, ["a", "b"])]
    docs, benchmark = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    windows, table = decontaminate.benchmark_windows(spark, benchmark, 10, decontaminate.MAX_WINDOWS)
    assert table is None and windows.count() > 200_000
    assert decontaminate.candidate_windows(docs.select("doc_id", "text"), windows).count() < 8 * 16 + 200  # of 24,000
    got = {r.doc_id: r.n_hit for r in decontaminate.report(docs, benchmark).collect()}
    assert got == {i: 25 if 60 <= i < 68 else 0 for i in range(len(texts))}


def test_long_words_count_in_bytes(spark, monkeypatch):
    docs, items, df, benchmark = tables(spark)
    monkeypatch.setattr(decontaminate, "MAX_BYTES", 50)
    assert decontaminate.benchmark_windows(spark, benchmark, 10, decontaminate.MAX_WINDOWS)[1] is None
    assert {r.doc_id: r.n_hit for r in decontaminate.report(df, benchmark).collect()} == {d: w[1] for d, w in brute(docs, items).items()}


def test_odd_rows(spark):
    _, _, _, benchmark = tables(spark)
    docs = odd_documents(spark)
    rows = decontaminate.report(docs, benchmark).collect()
    assert len(rows) == docs.count()
    for r in rows:
        texts = [x.text for x in docs.collect() if x.doc_id == r.doc_id]
        assert r.n_words in {len(words(t)) for t in texts} and r.contaminated == (r.n_hit > 0) and (r.n_hit == 0) == (r.n_items == 0)
    assert decontaminate.report(no_documents(spark), benchmark).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == docs.count()
    assert {r.n_hit for r in decontaminate.report(docs, benchmark.limit(0)).collect()} == {0}


def test_rows_of_one_id_are_judged_one_by_one_either_way(spark):
    item = "benchmark item words come here and they are ten words long"
    rows = [(None, f"a {item} b"), (None, "clean one"), (None, None), (7, f"c {item}"), (7, "clean two"), (7, "clean two"), (8, ""), (8, item), (9, "clean one")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA).repartition(3)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    want = sorted((str(i), str(t)) for i, t in rows if item not in (t or ""))
    for most in (decontaminate.MAX_WINDOWS, 0):
        kept = decontaminate.decontaminate(docs, benchmark, max_windows=most)
        assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == want and kept.columns == docs.columns
