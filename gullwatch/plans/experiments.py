"""Evaluation flows: splits, cross-validation, per-source ensembles, parameter grids."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gullwatch.operators import steps
from gullwatch.operators.classify import Scorer, Spec, count_terms, keyword_classify, train
from gullwatch.operators.features import hashed_tfidf_stages
from gullwatch.operators.metrics import METRICS, classification_metrics, confusion, fold_summary
from gullwatch.operators.sparse import entries
from gullwatch.plans.clustering import cluster_posts
from gullwatch.plans.concurrent import side_by_side
from gullwatch.session import cut_lineage, kept_rows
from gullwatch.sources.models import load_model, save_model
from gullwatch.sources.posts import packed
from gullwatch.sources.sinks import pending_runs, run_name, write_quadrants

# Train share and number of folds.
SPLIT_RATIO = 0.6
FOLDS = 10

# Per-source settings of the ensembles and of the mixed best models.
ENSEMBLE_SVM = {
    "A": Spec("SVM", 3000, reg=0.5, step=0.5),
    "B": Spec("SVM", 3000, reg=0.05, step=1.5),
    "C": Spec("SVM", 3000, reg=0.2, step=5.0),
    "D": Spec("SVM", 3000, reg=0.01, step=1.5),
}
ENSEMBLE_MLP = {
    "A": Spec("MLP", 1500, hidden_layers=4, width=5),
    "B": Spec("MLP", 3000, hidden_layers=7, width=20),
    "C": Spec("MLP", 3000, hidden_layers=3, width=10),
    "D": Spec("MLP", 3000, hidden_layers=7, width=20),
}
BEST_PER_SOURCE = {
    "A": ENSEMBLE_SVM["A"],
    "B": ENSEMBLE_MLP["B"],
    "C": ENSEMBLE_SVM["C"],
    "D": ENSEMBLE_SVM["D"],
}

# Axes of the parameter grid.
GRID_FEATURES = [30, 50, 80, 100, 200, 300, 500, 750, 1000, 1500, 3000]
GRID_REG = [0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0]
GRID_STEPS = [0.1, 0.5, 1.0, 1.5, 2.0, 5.0]
GRID_WIDTHS = [5, 7, 10, 12, 14, 16, 18, 20]
GRID_LAYERS = [2, 3, 4, 5, 6, 7, 8]

_TRAIN, _TEST = "train", "test"
Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def _hash(id_col: Column) -> Column:
    return F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("bigint")


def hash_split(df: DataFrame, ratio: float = SPLIT_RATIO) -> DataFrame:
    """Add ``part`` train/test by a hash of the id: the same rows on every run and layout."""
    share = F.pmod(_hash(F.col("id")), F.lit(10000)) / 10000
    return df.withColumn("part", F.when(share < ratio, _TRAIN).otherwise(_TEST))


def assign_folds(df: DataFrame, k: int = FOLDS) -> DataFrame:
    return df.withColumn("fold", F.pmod(_hash(F.col("id")), F.lit(k)).cast("int"))


def keyword_fit(_training: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return keyword_classify


@dataclass(frozen=True)
class ModelFit:
    """Trains ``spec``; a loop may count the terms of its posts once, before any fold."""

    spec: Spec

    def prepared(self, df: DataFrame) -> DataFrame:
        return kept_rows(count_terms(df.select("id", "label", "processedTweet"), self.spec.num_features).select("id", "label", "rawFeatures"))

    def __call__(self, training: DataFrame) -> Callable[[DataFrame], DataFrame]:
        counted = "rawFeatures" in training.columns
        return partial(train(training, self.spec, counted).transform, counted=counted)


def model_fit(spec: Spec) -> Fit:
    return ModelFit(spec)


def cross_validate(df: DataFrame, fit: Fit, k: int = FOLDS) -> DataFrame:
    """``(fold, part, tp, fp, tn, fn, metrics...)`` for train and test rows of each fold.

    Features and classifier are fitted on the training rows only; folds run side by side.
    """
    folds = assign_folds(fit.prepared(df) if isinstance(fit, ModelFit) else df, k)

    def one(i: int) -> DataFrame:
        score = fit(folds.filter(F.col("fold") != i))
        part = F.when(F.col("fold") == i, _TEST).otherwise(_TRAIN)
        scored = score(folds.drop("part")).select("label", "prediction", part.alias("part"))
        return confusion(scored, ["part"]).select(F.lit(i).alias("fold"), "*")

    counts = reduce(DataFrame.unionByName, side_by_side(one, range(k)))
    return classification_metrics(counts)


def cross_validate_keyword(df: DataFrame, k: int = FOLDS) -> DataFrame:
    """Same result table for the rule classifier, which needs no fit: one pass over the posts.

    A post is a test row of its own fold and a training row of all others.
    """
    scored = assign_folds(keyword_classify(df), k).select("label", "prediction", "fold")
    own = confusion(scored, ["fold"])
    parts = own.select(
        F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"), "fold", "tp", "fp", "tn", "fn"
    )
    part = F.when(F.col("i") == F.col("fold"), _TEST).otherwise(_TRAIN)
    counts = parts.groupBy(F.col("i").alias("fold"), part.alias("part")).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]
    )
    return classification_metrics(counts)


def cross_validation_summary(results: DataFrame) -> DataFrame:
    return fold_summary(results, ["part"])


def ensemble(
    df: DataFrame, specs: dict[str, Spec], by: str = "dataset", period: str = "period", first: str = "d1"
) -> DataFrame:
    """Posts scored by the model of their own source, trained on that source's first period."""

    def one(source: str) -> DataFrame:
        own = df.filter(F.col(by) == source)
        return train(own.filter(F.col(period) == first), specs[source]).transform(own)

    columns = [*df.columns, "prediction"]
    scored = side_by_side(one, sorted(specs))
    return reduce(DataFrame.unionByName, [s.select(*columns) for s in scored])


def ensemble_metrics(scored: DataFrame, period: str = "period") -> DataFrame:
    return classification_metrics(confusion(scored, [period]))


def train_and_test(df: DataFrame, spec: Spec, ratio: float = SPLIT_RATIO, **options):
    """Train on one part, score the other, and cluster the scored posts.

    Returns ``(metrics, scored, clusters, members)``.
    """
    parts = hash_split(df, ratio)
    scorer = train(parts.filter(F.col("part") == _TRAIN), spec)
    scored = scorer.transform(parts.filter(F.col("part") == _TEST))
    clusters, members = cluster_posts(
        scored.select("id", "processedTweet"), num_features=spec.num_features, **options
    )
    return classification_metrics(confusion(scored)), scored, clusters, members


def train_model(df: DataFrame, spec: Spec, path: str) -> Scorer:
    scorer = train(df, spec)
    save_model(scorer, path)
    return scorer


def classify_saved(df: DataFrame, spec: Spec, model_path: str, out_path: str) -> DataFrame:
    """Score with saved models, write the four quadrants, return the metrics."""
    scored = load_model(model_path, spec).transform(df)
    write_quadrants(scored, out_path)
    return classification_metrics(confusion(scored))


def grid(datasets: DataFrame, extractor: str = "TF-IDF") -> DataFrame:
    """All runs for ``datasets(dataset)``: features x (C x step, layers x width)."""

    def axis(values: Sequence) -> Column:
        return F.explode(F.array(*[F.lit(v) for v in values]))

    sized = datasets.select("dataset", axis(GRID_FEATURES).alias("num_features"))
    svm = (
        sized.select("*", axis(GRID_REG).alias("a"))
        .select("*", axis(GRID_STEPS).alias("b"))
        .select("dataset", "num_features", F.lit("SVM").alias("classifier"), F.concat_ws("_", "a", "b").alias("params"))
    )
    mlp = (
        sized.select("*", axis(GRID_LAYERS).alias("a"))
        .select("*", axis(GRID_WIDTHS).alias("b"))
        .select("dataset", "num_features", F.lit("MLP").alias("classifier"), F.concat_ws("_", "a", "b").alias("params"))
    )
    runs = svm.unionByName(mlp)
    name = run_name(F.lit(extractor), F.col("num_features"), F.col("classifier"), F.col("params"), F.col("dataset"))
    return runs.withColumn("run", name)


def spec_of_run(classifier: str, num_features: int, params: str) -> Spec:
    a, b = params.split("_")
    if classifier == "SVM":
        return Spec("SVM", num_features, reg=float(a), step=float(b))
    return Spec("MLP", num_features, hidden_layers=int(a), width=int(b))


def cross_validate_steps(df: DataFrame, specs: Sequence[Spec], k: int = FOLDS) -> DataFrame:
    """``(setting, fold, part, tp, fp, tn, fn, metrics...)`` of SVMs by steps that share their number of features.

    All settings and folds are trained together over one matrix of hashed term counts: the
    IDF of a fold's training rows scales its weights, so the matrix itself does not depend
    on the fold. ``setting`` is the place in ``specs``.
    """
    (dims,) = {s.num_features for s in specs}
    (max_iter,) = {s.max_iter or 100 for s in specs}
    counted = Pipeline(stages=hashed_tfidf_stages(dims)[:2]).fit(df).transform(assign_folds(df, k))
    rows = cut_lineage(counted.select(F.col("label").cast("double").alias("label"), "fold", *entries("rawFeatures")))
    # iterations read the rows again and again; few rows need few tasks
    rows = packed(rows, rows.count())
    sizes, held = steps.fold_frequencies(rows, dims, k)
    idf = np.log((sizes.sum() - sizes + 1) / (held.sum(axis=1, keepdims=True) - held + 1))
    fits = [(i, steps.Setting(s.reg, s.step or 1.0, f)) for i, s in enumerate(specs) for f in range(k)]
    parts = []
    for start in range(0, len(fits), steps.shared_fits(dims)):
        own = [setting for _, setting in fits[start : start + steps.shared_fits(dims)]]
        scale = idf[:, [s.fold for s in own]]
        weights = steps.fit(rows, dims, own, scale, max_iter)
        parts.append(steps.confusions(rows, scale * weights, own).withColumn("setting", F.col("setting") + start))
    fit, fold = F.col("setting"), F.col("setting") % k  # fits are numbered setting by setting
    counts = reduce(DataFrame.unionByName, parts).select(F.floor(fit / k).cast("int").alias("setting"), fold.alias("fold"), "part", "tp", "fp", "tn", "fn")
    return classification_metrics(counts)


def _mean_test(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    summary = fold_summary(results.filter(F.col("part") == _TEST), by)
    return summary.groupBy(*by).pivot("metric", METRICS).agg(F.first("avg"))


def run_grid(df: DataFrame, runs: DataFrame, path: str, k: int = FOLDS, by: str = "dataset", max_iter: int | None = None) -> DataFrame:
    """Cross-validate the runs that ``path`` holds no result of; append their mean test metrics.

    All SVM runs of a dataset and number of features are trained together, so the jobs grow
    with the steps, not with the runs. MLP runs follow one by one; each fit is distributed.
    Results are written as they come, so an interrupted grid goes on where it stopped.
    Returns all results of ``path``.
    """
    spark = df.sparkSession
    schema = "run string, " + ", ".join(f"{m} double" for m in METRICS)
    spark.createDataFrame([], schema).write.mode("append").parquet(path)  # a folder to read from
    groups: dict[tuple, list] = {}
    for r in pending_runs(runs, spark.read.schema(schema).parquet(path)).collect():  # the grid's size
        alone = r.run if r.classifier != "SVM" else ""
        groups.setdefault((r.dataset, r.classifier, r.num_features, alone), []).append(r)
    for (dataset, classifier, _, _), own in sorted(groups.items()):
        own.sort(key=lambda r: r.run)
        posts = df.filter(F.col(by) == dataset)
        specs = [spec_of_run(r.classifier, r.num_features, r.params).with_(max_iter=max_iter) for r in own]
        if classifier == "SVM":
            results = cross_validate_steps(posts, specs, k)
        else:
            results = cross_validate(posts, model_fit(specs[0]), k).withColumn("setting", F.lit(0))
        names = spark.createDataFrame([(i, r.run) for i, r in enumerate(own)], "setting int, run string")
        _mean_test(results, ["setting"]).join(names, "setting").select("run", *METRICS).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def best_run(results: DataFrame, metric: str = "f_measure", by: Sequence[str] = ()) -> DataFrame:
    """Run with the highest metric per group, smallest name on ties: one partial aggregate."""
    key = F.struct((-F.col(metric)).alias("score"), F.col("run").alias("run"))
    top = results.groupBy(*by).agg(F.min(key).alias("top"))
    return top.select(*by, F.col("top.run").alias("run"), (-F.col("top.score")).alias(metric))
