import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gullwatch.operators import sparse, steps
from gullwatch.operators.classify import Spec, train
from gullwatch.operators.features import hashed_tfidf_pipeline
from gullwatch.plans import experiments as E


@pytest.fixture(scope="module")
def posts(spark):
    rng = random.Random(4)
    good, bad = ["exploit", "heap", "patch", "leak"], ["sun", "rain", "cake", "song"]
    rows = []
    for i in range(120):
        own = good if i % 3 else bad
        rows.append((str(i), None if i % 17 == 0 else int(i % 3 > 0), " ".join(rng.choices(own + ["the", "a", f"w{i % 11}"], k=rng.randint(1, 9)))))
    return spark.createDataFrame([*rows, ("e", 1, "")], "id string, label int, processedTweet string").repartition(3).persist()


def featured(posts, dims=48):
    rows = posts.filter("label is not null")
    return hashed_tfidf_pipeline(dims).fit(rows).transform(rows).withColumn("label", F.col("label").cast("double"))


def entries(df):
    return df.select("label", F.lit(0).alias("fold"), *sparse.entries("features"))


def test_weights_equal_the_library(posts):
    from pyspark.mllib.classification import SVMWithSGD
    from pyspark.mllib.regression import LabeledPoint
    from pyspark.mllib.util import MLUtils

    df = featured(posts)
    points = MLUtils.convertVectorColumnsFromML(df.select("label", "features"), "features").rdd.map(lambda r: LabeledPoint(r[0], r[1]))
    for reg, step, n in ((0.1, 1.0, 20), (2.0, 5.0, 10), (0.01, 0.1, 100)):
        want = SVMWithSGD.train(points, iterations=n, step=step, regParam=reg).weights.toArray()
        got = steps.fit(entries(df), 48, [steps.Setting(reg, step)], max_iter=n)[:, 0]
        assert np.allclose(got, want, atol=1e-9)


def test_settings_do_not_touch_each_other(posts):
    rows = entries(featured(posts))
    settings = [steps.Setting(r, s) for r in (0.01, 1.0) for s in (0.1, 2.0)]
    together = steps.fit(rows, 48, settings, max_iter=12)
    for i, s in enumerate(settings):
        assert np.allclose(together[:, i], steps.fit(rows, 48, [s], max_iter=12)[:, 0])


def test_grid_in_one_pass_equals_fits_one_by_one(posts, monkeypatch):
    specs = [Spec("SVM", 48, reg=r, step=s, max_iter=8) for r in (0.05, 0.5) for s in (0.5, 1.5)]
    once = E.cross_validate_steps(posts, specs, 3)
    monkeypatch.setattr(steps, "WEIGHT_BYTES", 48 * 8 * 5)  # three runs of at most five fits
    in_parts = E.cross_validate_steps(posts, specs, 3)
    key = lambda r: (r.fold, r.part)
    for i, spec in enumerate(specs):
        alone = sorted(E.cross_validate(posts, E.model_fit(spec), 3).collect(), key=key)
        for many in (once, in_parts):
            assert sorted(many.filter(F.col("setting") == i).drop("setting").collect(), key=key) == alone


def test_single_model_scores_by_its_weights(posts):
    scorer = train(posts, Spec("SVM", 48, reg=0.1, step=1.0, max_iter=10))
    scored = scorer.transform(posts)
    weights = scorer.model.stages[-1].getScalingVec().toArray()
    for r in scored.collect():
        assert r.prediction == pytest.approx(float(r.features.dot(weights)))


def test_small_matrices_give_the_same(posts):
    batch = entries(featured(posts)).toArrow().combine_chunks().to_batches()[0]
    whole, small = (list(sparse.slices(batch, cells)) for cells in (1 << 20, 30))
    assert len(small) > len(whole)
    full = [np.zeros((batch.num_rows, 48)) for _ in range(2)]
    for target, parts in zip(full, (whole, small)):
        for p in parts:
            target[p.start : p.end, p.columns] = p.matrix
    assert (full[0] == full[1]).all() and [p.start for p in small[1:]] == [p.end for p in small[:-1]]


def test_dense_vectors_and_rows_without_entries(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(1.0, Vectors.dense([1.0, 0.0, 2.0])), (0.0, Vectors.sparse(3, {})), (0.0, Vectors.sparse(3, {1: 4.0}))]
    df = spark.createDataFrame(rows, ["label", "features"])
    w = steps.fit(entries(df), 3, [steps.Setting(0.0, 1.0)], max_iter=1)[:, 0]
    assert np.allclose(w, [1 / 3, -4 / 3, 2 / 3])
    assert (steps.fit(entries(df.limit(0)), 3, [steps.Setting(0.0, 1.0)]) == 0).all()


def test_run_grid_on_every_axis(spark, posts, tmp_path):
    runs = E.grid(spark.createDataFrame([("A",)], "dataset string")).filter("num_features in (30, 50)")
    few = runs.filter("classifier = 'SVM' or params = '2_5'")
    path = str(tmp_path / "results")
    own = posts.withColumn("dataset", F.lit("A"))
    got = E.run_grid(own, few, path, k=2, max_iter=3).collect()
    assert len(got) == few.count() == 2 * (54 + 1) and len({r.run for r in got}) == len(got)
    again = E.run_grid(own, few, path, k=2, max_iter=3)
    assert again.count() == len(got)
