"""No post, token, center or digit is lost, and settings take effect."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gullwatch.functions.text import numbers_to_words
from gullwatch.operators.classify import Spec, train
from gullwatch.operators.features import doc_vector_concat, doc_vector_mean, drop_stopwords, linear_score, token_vectors
from gullwatch.operators.kmeans import assign
from gullwatch.operators.weeks import week_buckets, weekly_counts
from gullwatch.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame([("a", [1.0, 0.0]), ("<UNK>", [9.0, 9.0])], "token string, vector array<double>")


def test_posts_without_tokens_stay(spark, dictionary):
    posts = spark.createDataFrame([("1", ["a"]), ("2", []), ("3", [""]), ("4", None)], "id string, words array<string>")
    assert {r.id: list(r.vector) for r in doc_vector_mean(posts, dictionary).collect()} == {"1": [1.0, 0.0], "2": [0, 0], "3": [0, 0], "4": [0, 0]}
    wide = {r.id: (r.size, r["values"]) for r in doc_vector_concat(posts, dictionary, 2).collect()}
    assert wide == {"1": (2, [1.0, 0.0]), "2": (2, []), "3": (2, [9.0, 9.0]), "4": (2, [])}
    long = spark.createDataFrame([("1", "a", 2.0), ("3", "b", 1.0)], "id string, term string, weight double")
    weights = spark.createDataFrame([("a", 0.5)], "term string, w double")
    assert {r.id: r.margin for r in linear_score(posts, long, weights).collect()} == {"1": 1.0, "2": 0.0, "3": 0.0, "4": 0.0}


def test_a_token_of_every_post(spark, dictionary):
    tokens = spark.range(5_000).select(F.col("id").cast("string"), F.lit("a").alias("token"))
    joined = token_vectors(tokens, dictionary)
    assert joined.count() == 5_000 and joined.filter("vector = array(1.0D, 0.0D)").count() == 5_000
    assert joined.select("id").distinct().count() == 5_000


def test_undated_posts_stay(spark):
    rows = spark.createDataFrame([("1", "2016-04-04"), ("2", None), ("3", "2016-04-12")], "id string, d string").withColumn("day", F.to_date("d"))
    assert {r.id: r.week_bucket for r in week_buckets(rows).collect()} == {"1": 1, "2": None, "3": 2}
    assert {r.week_bucket: r.n_posts for r in weekly_counts(week_buckets(rows)).collect()} == {1: 1, 2: 1, None: 1}


@pytest.mark.parametrize(
    ("number", "words"),
    [
        ("1000000000000", "one trillion "),
        ("999999999999", "nine hundred ninety nine billion nine hundred ninety nine million nine hundred ninety nine thousand nine hundred ninety nine "),
        ("2000000000000000000000003", "two trillion trillion three "),
        ("0001002003004005006", "one thousand two trillion three billion four million five thousand six "),
    ],
)
def test_long_numbers(spark, number, words):
    assert spark.range(1).select(numbers_to_words(F.lit(number)).alias("t")).first().t == words


def test_stop_words_of_any_length(spark):
    posts = spark.createDataFrame([("1", ["a", "b", "a", ""]), ("2", []), ("3", None), ("4", ["c"])], "id string, words array<string>")
    stop = spark.createDataFrame([("a",), ("c",), ("x",)], "word string")
    found = [{r.id: r.words for r in drop_stopwords(posts, stop, max_literal=n).collect()} for n in (10, 1)]
    assert found[0] == found[1] == {"1": ["b", ""], "2": [], "3": None, "4": []}


def test_any_number_of_centers(spark):
    rng = np.random.RandomState(3)
    rows, centers = rng.randn(200, 3), np.round(rng.randn(90, 3), 1)
    centers = np.concatenate([centers, centers[:5]])  # ties: the first cluster wins
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, vector array<double>")
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cluster int, centroid array<double>").repartition(4)
    want = {i: int(((r - centers) ** 2).sum(1).argmin()) for i, r in enumerate(rows)}
    for size in (1 << 20, 20 * 24):
        assert {r.id: r.cluster for r in assign(df, table, block_bytes=size).collect()} == want


def test_the_step_counts_and_both_solvers_are_saved(spark, tmp_path):
    rows = [(i, float(i % 2), "attack code leak" if i % 2 else "sunny calm day") for i in range(40)]
    posts = spark.createDataFrame(rows, "id long, label double, processedTweet string")
    weights = []
    for name, spec in {"a": Spec(num_features=30, reg=0.1, step=0.5, max_iter=5), "b": Spec(num_features=30, reg=0.1, step=5.0, max_iter=5), "c": Spec(num_features=30, reg=0.1, max_iter=5)}.items():
        scorer = train(posts, spec)
        save_model(scorer, str(tmp_path / name))
        fitted = {r.id: r.prediction for r in scorer.transform(posts).collect()}
        assert {r.id: r.prediction for r in load_model(str(tmp_path / name), spec).transform(posts).collect()} == fitted
        weights.append(fitted[1])
    assert len(set(weights)) == 3
    with pytest.raises(ValueError):
        Spec(step=1.0, solver="ml")
