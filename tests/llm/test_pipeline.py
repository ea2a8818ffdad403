import random

import corpus_pipeline
from helpers import CLASHING, SCHEMA, no_documents, odd_documents, rows_of

from gullwatch.llm import minhash, queries


def test_stages_take_effect(spark, tmp_path):
    line = "the water of the house and the people there were with that in from have this"
    item = "benchmark item words come here and they are ten words long indeed"
    texts = [f"{line} {k} {line} alpha{k} {line} beta{k}" for k in range(30)]
    texts += [texts[3], texts[3] + " tail", "... 123 !!!", None, f"{line} {item} {line}", f"{line} password = hunter2hunter2 {line}"]
    spark.createDataFrame(rows_of(texts), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, seen = [n for n, _ in corpus_pipeline.STAGES], {}
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in docs.collect()}
        assert name == names[-1] or docs.columns == columns
    first, second, third, fourth, last = (seen[n] for n in names)
    assert {32, 33} & first == set() and len(first) == len(texts) - 2
    assert {30, 31} & second == set() and third == second - {34} and fourth == third == last
    assert "[SECRET]" in spark.read.parquet(str(tmp_path / "secret_scan")).where("doc_id = 35").first().text
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in run.collect()} == last


def written(spark, folder, docs, items=()):
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_odd_rows(spark, tmp_path):
    line = "the water of the house and the people there were with that in from have this"
    more = [(40, line + " one", "en", None, None), (40, line + " one", "en", None, None), (41, line + " one", None, None, 3), (42, None, None, None, None), (None, line + " two", "en", None, None)]
    odd = odd_documents(spark)
    for name in odd.columns[5:]:
        assert name in CLASHING
    own = spark.createDataFrame(more, SCHEMA)
    for name in CLASHING:
        own = own.selectExpr("*", f"'x' AS {name}")
    folder = written(spark, tmp_path, odd.unionByName(own), [(1, "word one two three four five"), (None, "x"), (2, None)])
    docs = queries.read_table(spark, folder, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.kept_table(stage(spark, docs, folder), name)
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
        assert set(docs.columns) == {*odd.columns}
    assert all(text and any(c.isalpha() for c in text) for _, text in kept["language_id"])
    ids = [i for i, _ in kept["minhash_near_dedup"] if i is not None]
    assert len(ids) == len(set(ids)) and 40 in ids and 41 not in ids and 42 not in ids
    # the null id keeps its rows but for the one that is a benchmark item
    assert (None, line + " two") in kept["benchmark_decontamination"] and all("word one two" not in t for _, t in kept["benchmark_decontamination"])
    assert sorted(map(str, kept["secret_scan"])) == sorted(map(str, kept["benchmark_decontamination"]))
    packed = corpus_pipeline.pack(spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in kept["secret_scan"]}


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, no_documents(spark))).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.queries()) | {"pipeline"} <= names
    assert set(__spark_entry__.oracle_sql()) <= names


def shared(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_dedup_links_from_four_fifths(spark):
    rng, texts, near = random.Random(8), [], []
    for k in range(60):
        words = [f"w{k}x{i}" for i in range(rng.randint(200, 400))]
        other, gone = list(words), rng.sample(range(5, len(words) - 5), 20)
        for i in gone:
            if shared(" ".join(words), " ".join(other)) < 0.845:
                break
            other[i] = f"y{k}x{i}"
        texts += [" ".join(words), " ".join(other)]
        near.append(shared(*texts[-2:]))
    assert sum(0.81 <= x < 0.845 for x in near) > 40
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows_of(texts), SCHEMA), "").collect()}
    assert kept == {2 * k for k in range(60)} | {2 * k + 1 for k, x in enumerate(near) if x < 0.8}


def test_bands_and_slack_follow_the_threshold():
    assert (minhash.band_count(85), minhash.slack(85)) == (20, 0.19)
    assert (1 - 0.8**minhash.ROWS) ** minhash.band_count(80) <= minhash.MISS and minhash.slack(80) == 0.22
