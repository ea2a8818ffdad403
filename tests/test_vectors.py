import math
import random

import pytest
from pyspark.sql import functions as F

from gullwatch.functions import vectors as V
from gullwatch.operators.distances import set_mean_cosine, set_mean_manhattan, set_mean_sqdist
from gullwatch.operators.exemplars import centroids, cluster_diff, exemplars
from gullwatch.operators.features import (
    doc_vector_concat,
    doc_vector_mean,
    document_frequency,
    drop_stopwords,
    padded_vector,
    term_counts,
    universal_terms,
)
from gullwatch.operators.ordering import number_rows


def test_scalars(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    got = row.select(V.sqdist(a, b), V.manhattan(a, b), V.cosine(a, b), V.cosine(a, z)).first()
    assert got[0] == 13.0 and got[1] == 5.0 and got[3] is None
    assert got[2] == pytest.approx(1 / math.sqrt(50))


def test_set_means_against_double_loops(spark):
    rng = random.Random(1)
    groups = {g: [[rng.choice([0.25, 0.5, rng.random()]) for _ in range(3)] for _ in range(n)] for g, n in (("a", 9), ("hot", 40), ("one", 1))}
    groups["hot"] += [groups["hot"][0]] * 20  # copies
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, vector array<double>")

    def brute(fn):
        return {g: sum(fn(x, y) for x in vs for y in vs) / len(vs) ** 2 for g, vs in groups.items()}

    sq = brute(lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y)))
    man = brute(lambda x, y: sum(abs(p - q) for p, q in zip(x, y)))
    got = {r.g: r.mean_sqdist for r in set_mean_sqdist(df, ["g"]).collect()}
    assert got == pytest.approx(sq, abs=1e-9)
    for n in (1, 7):
        spread = {r.g: r.mean_manhattan for r in set_mean_manhattan(df.repartition(n), ["g"]).collect()}
        assert spread == pytest.approx(man)
    cos = brute(lambda x, y: sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y)))
    got = {r.g: r.mean_cosine for r in set_mean_cosine(df, ["g"]).collect()}
    assert got == pytest.approx(cos)


def test_exemplar_ties_take_the_smallest_id(spark):
    df = spark.createDataFrame([("a", "2", [0.0]), ("a", "1", [2.0]), ("b", "9", [5.0])], "cluster string, id string, vector array<double>")
    got = {r.cluster: r.exemplar_id for r in exemplars(df, centroids(df)).collect()}
    assert got == {"a": "1", "b": "9"}


def test_cluster_diff(spark):
    a = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3")], "cluster string, id string")
    b = spark.createDataFrame([("x", "2"), ("x", "1"), ("y", "4")], "cluster string, id string")
    assert {r.cluster: r.equal for r in cluster_diff(a, b).collect()} == {"x": True, "y": False}


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(9)
    got = number_rows(df, ["k"], "n").collect()
    assert all(r.n == r.k + 1 for r in got) and len(got) == 1000


def test_terms(spark):
    df = spark.createDataFrame([("1", ["a", "b", "a", ""]), ("2", ["a"]), ("3", ["c", "a"])], "id string, words array<string>")
    tf = {(r.id, r.term): r.tf for r in term_counts(df).collect()}
    assert tf == {("1", "a"): 2, ("1", "b"): 1, ("2", "a"): 1, ("3", "c"): 1, ("3", "a"): 1}
    assert {r.term: r.df for r in document_frequency(term_counts(df)).collect()} == {"a": 3, "b": 1, "c": 1}
    assert universal_terms(df) == ["a"]
    stop = spark.createDataFrame([("a",)], "word string")
    assert {r.id: r.words for r in drop_stopwords(df, stop).collect()} == {"1": ["b", ""], "2": [], "3": ["c"]}


def test_document_vectors(spark):
    words = spark.createDataFrame([("1", ["a", "b", "a"]), ("2", ["zz"])], "id string, words array<string>")
    dictionary = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [4.0, 3.0]), ("<UNK>", [9.0, 9.0])], "token string, vector array<double>"
    )
    mean = {r.id: list(r.vector) for r in doc_vector_mean(words, dictionary).collect()}
    assert mean["1"] == pytest.approx([2.0, 1.0]) and mean["2"] == [9.0, 9.0]
    wide = doc_vector_concat(words, dictionary, 2)
    assert {r.id: (r.size, r["values"]) for r in wide.collect()} == {"1": (6, [1.0, 0.0, 4.0, 3.0, 1.0, 0.0]), "2": (6, [9.0, 9.0])}
    full = wide.filter("id = '2'").select(padded_vector(6, F.col("values")).alias("v")).first().v
    assert list(full) == [9.0, 9.0, 0.0, 0.0, 0.0, 0.0]


def test_held_and_joined_dictionaries_agree(spark):
    """Ids and tokens that repeat, nulls, and no shuffle of vectors."""
    rows = [("1", ["a", "b", "a"]), ("2", ["z", ""]), ("3", []), ("4", None), ("5", ["b"]), ("5", ["a", None, "c"]), (None, ["a"])]
    words = spark.createDataFrame(rows, "id string, words array<string>")
    vectors = [("a", [1.0, 0.0]), ("b", [4.0, 3.0]), ("b", [2.0, 5.0]), ("c", None), (None, [7.0, 7.0]), ("<UNK>", [9.0, 9.0])]
    dictionary = spark.createDataFrame(vectors, "token string, vector array<float>")
    results = []
    for most in (1 << 20, 0):
        wide = doc_vector_concat(words, dictionary, 2, most_bytes=most)
        mean = doc_vector_mean(words, dictionary, most_bytes=most)
        results.append(({r.id: (r.size, r["values"]) for r in wide.collect()}, {r.id: list(map(float, r.vector)) for r in mean.collect()}))
    (held_wide, held_mean), (joined_wide, joined_mean) = results
    assert held_wide == joined_wide and held_wide["5"] == (6, [1.0, 0.0, 2.0, 5.0, 4.0, 3.0, 9.0, 9.0, 9.0, 9.0])
    assert held_mean.keys() == joined_mean.keys()
    assert all(held_mean[k] == pytest.approx(joined_mean[k]) for k in held_mean)
    plan = doc_vector_concat(words, dictionary, 2)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan


def test_listed_words_are_joined_without_moving_each_token(spark):
    """Rows of one id, null ids, null lists and null words; only whole lists and the listed words found are grouped."""
    rows = [("1", ["b", "a", None, ""]), ("1", ["a", "d"]), (None, ["b"]), ("2", None), ("3", []), ("4", ["x", "a", "x"])]
    df = spark.createDataFrame(rows, "id string, words array<string>")
    out = drop_stopwords(df, spark.createDataFrame([("a",), (None,)], "word string"), max_literal=0)
    got = sorted(((r.id, r.words) for r in out.collect()), key=str)
    assert got == sorted([("1", ["b", "d", None, ""]), ("1", ["b", "d", None, ""]), (None, []), ("2", None), ("3", []), ("4", ["x", "x"])], key=str)
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
