import pytest
from pyspark.sql import functions as F

from gullwatch.operators.classify import Spec, keyword_classify, train
from gullwatch.operators.metrics import classification_metrics, confusion
from gullwatch.plans import experiments as E
from gullwatch.plans.clustering import with_features
from gullwatch.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(str(i), 1, f"exploit heap overflow w{i % 7}") for i in range(40)]
    rows += [(str(100 + i), 0, f"sunny weather today w{i % 7}") for i in range(40)]
    return spark.createDataFrame(rows, "id string, label int, processedTweet string").persist()


def test_folds_and_split_partition_the_ids(labelled):
    folds = E.assign_folds(labelled, 10)
    assert folds.select("fold").distinct().count() <= 10 and folds.count() == 80
    parts = E.hash_split(labelled)
    assert {r.part for r in parts.select("part").distinct().collect()} == {"train", "test"}
    again = E.hash_split(labelled.repartition(7))
    assert sorted(map(tuple, parts.select("id", "part").collect())) == sorted(map(tuple, again.select("id", "part").collect()))


def test_one_pass_cross_validation_equals_the_loop(labelled):
    loop = E.cross_validate(labelled, E.keyword_fit, 4)
    once = E.cross_validate_keyword(labelled, 4).select(*loop.columns)
    assert sorted(map(tuple, loop.collect())) == sorted(map(tuple, once.collect()))


@pytest.mark.parametrize(
    "spec",
    [
        Spec("SVM", 64, reg=0.1, max_iter=15),
        Spec("SVM", 64, reg=0.1, step=1.0, solver="sgd", max_iter=15),
        Spec("MLP", 64, hidden_layers=1, width=4, max_iter=30),
    ],
)
def test_models_separate_two_topics(labelled, spec):
    scored = train(labelled, spec).transform(labelled)
    m = classification_metrics(confusion(scored)).first()
    assert m.accuracy == 1.0 and m.tp + m.fp + m.tn + m.fn == 80
    assert "prediction" in scored.columns


def test_saved_model_scores_alike(labelled, tmp_path):
    scorer = train(labelled, Spec("SVM", 64, reg=0.1, max_iter=5))
    for _ in range(2):  # overwrites
        save_model(scorer, str(tmp_path / "m"))
    loaded = load_model(str(tmp_path / "m"), scorer.spec)
    a = {r.id: r.prediction for r in scorer.transform(labelled).collect()}
    assert a == {r.id: r.prediction for r in loaded.transform(labelled).collect()}


def test_ensemble_scores_every_post_once(labelled):
    number = F.col("id").cast("int")
    df = labelled.withColumn("dataset", F.when(number % 2 == 0, "A").otherwise("B")).withColumn(
        "period", F.when(number % 3 == 0, "d1").otherwise("d2")
    )
    spec = Spec("SVM", 64, reg=0.1, max_iter=5)
    scored = E.ensemble(df, {"A": spec, "B": spec})
    assert sorted(r.id for r in scored.collect()) == sorted(r.id for r in labelled.collect())
    assert {r.period for r in E.ensemble_metrics(scored).collect()} == {"d1", "d2"}


def test_grid(spark, labelled, tmp_path):
    runs = E.grid(spark.createDataFrame([("A",), ("B",)], "dataset string"))
    assert runs.count() == 2 * 11 * (9 * 6 + 8 * 7)
    assert runs.select("run").distinct().count() == runs.count()
    names = {r.run for r in runs.filter("num_features = 30").collect()}
    assert "TF-IDF_30_SVM_0.01_0.1_A" in names and "TF-IDF_30_MLP_2_5_B" in names
    few = runs.filter("run = 'TF-IDF_30_SVM_0.1_1.0_A'")
    posts, path = labelled.withColumn("dataset", F.lit("A")), str(tmp_path / "results")
    row = E.run_grid(posts, few, path, k=2).first()
    assert E.run_grid(posts, few, path, k=2).collect() == [row]  # nothing pending the second time
    assert row.run == "TF-IDF_30_SVM_0.1_1.0_A" and 0.0 <= row.f_measure <= 1.0
    best = E.best_run(spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)], "run string, f_measure double")).first()
    assert (best.run, best.f_measure) == ("a", 0.5)


def test_train_and_test_clusters_the_scored_posts(labelled):
    metrics, scored, clusters, members = E.train_and_test(labelled, Spec("SVM", 64, reg=0.1, max_iter=5))
    assert members.count() == scored.count() == clusters.agg(F.sum("n")).first()[0]


def test_keyword_rule(labelled):
    assert confusion(keyword_classify(labelled)).first().tp == 40


def test_dense_rows_of_a_perceptron_lie_in_bounded_partitions(spark, monkeypatch):
    from gullwatch.operators import classify

    seen = []

    class Fitted(Exception):
        pass

    class Stub:
        def fit(self, rows):
            seen.append((rows.count(), rows.rdd.getNumPartitions()))
            raise Fitted

    monkeypatch.setattr(classify, "mlp", lambda *_: Stub())
    monkeypatch.setattr(classify, "DENSE_BYTES", 8 * 30 * 50)
    rows = spark.createDataFrame([(str(i), i % 2, f"w{i % 7} x") for i in range(1_000)], "id string, label int, processedTweet string").coalesce(1)
    with pytest.raises(Fitted):
        train(rows, Spec("MLP", 30))
    assert seen == [(1_000, 20)]  # of 50 rows


@pytest.fixture
def counted_texts(spark):
    """Posts whose text is counted each time it is computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    text = F.udf(count, "string").asNondeterministic()(F.concat(F.lit("word w"), F.col("id") % 7))
    rows = spark.range(40).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).cast("int").alias("label"), text.alias("processedTweet"))
    return rows, seen


@pytest.mark.parametrize("spec", [Spec("SVM", 16, max_iter=3), Spec("SVM", 16, step=0.5, max_iter=3), Spec("MLP", 16, hidden_layers=1, width=2, max_iter=3)])
def test_training_computes_each_text_once(counted_texts, spec):
    rows, seen = counted_texts
    train(rows, spec)
    assert seen.value == 40


def test_features_compute_each_text_once(counted_texts):
    rows, seen = counted_texts
    with_features(rows, num_features=16).count()
    assert seen.value == 40


def test_folds_count_each_text_once(counted_texts):
    rows, seen = counted_texts
    E.cross_validate(rows, E.model_fit(Spec("SVM", 16, max_iter=2)), 2).collect()
    assert seen.value == 40
