"""Relevance classifiers: linear SVM, multilayer perceptron, keyword rule."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gullwatch.functions.text import keyword_score
from gullwatch.functions.vectors import array_sum
from gullwatch.operators import steps
from gullwatch.operators.features import hashed_tfidf_stages
from gullwatch.operators.sparse import entries
from gullwatch.session import cut_lineage
from gullwatch.sources.posts import dealt, packed

#: Bytes of dense rows that the perceptron holds in a partition.
DENSE_BYTES = 64 << 20


@dataclass(frozen=True)
class Spec:
    """One classifier setting. Defaults are the established configuration."""

    classifier: str = "SVM"
    num_features: int = 3000
    reg: float = 2.0
    step: float | None = None
    hidden_layers: int = 7
    width: int = 14
    max_iter: int | None = None
    solver: str | None = None

    def __post_init__(self):
        if self.solver == "ml" and self.step is not None:
            raise ValueError("only the step-size solver takes a step")

    @property
    def by_steps(self) -> bool:
        """Whether the SVM is trained by gradient steps of a given size: a step asks for it."""
        return self.classifier == "SVM" and (self.solver == "sgd" or self.step is not None)

    @property
    def params(self) -> str:
        if self.classifier == "SVM":
            return f"{self.reg}_{self.step}"
        return f"{self.hidden_layers}_{self.width}"

    def with_(self, **changes) -> "Spec":
        return replace(self, **changes)


def svm(reg: float, max_iter: int = 100) -> LinearSVC:
    """Hinge loss, L2 penalty, no intercept; the raw margin is the prediction."""
    return LinearSVC(
        regParam=reg, maxIter=max_iter, fitIntercept=False, standardization=False,
        predictionCol="predicted_class", rawPredictionCol="raw",
    )


def mlp(num_features: int, hidden_layers: int, width: int, max_iter: int = 200):
    return MultilayerPerceptronClassifier(
        layers=[num_features, *[width] * hidden_layers, 2],
        blockSize=128, seed=1234, maxIter=max_iter,
        predictionCol="predicted_class", rawPredictionCol="raw", probabilityCol="probability",
    )


def fit_by_steps(df: DataFrame, num_features: int, reg: float, step: float, max_iter: int = 100) -> ElementwiseProduct:
    """Weights by gradient steps of a given size, as a stage that weights the features."""
    rows = cut_lineage(df.select("label", F.lit(0).alias("fold"), *entries("features")))
    (weights,) = steps.fit(rows, num_features, [steps.Setting(reg, step)], max_iter=max_iter).T
    return ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="features", outputCol="weighted")


class Scorer:
    """Fitted features and classifier; ``transform`` adds features and ``prediction``."""

    def __init__(self, spec: Spec, model: PipelineModel):
        self.spec, self.model = spec, model

    def transform(self, df: DataFrame, counted: bool = False) -> DataFrame:
        """``counted`` posts bring the counts of :func:`count_terms`, so their text is not read."""
        model = PipelineModel(self.model.stages[2:]) if counted else self.model
        scored = model.transform(df)
        if self.spec.by_steps:
            return scored.withColumn("prediction", array_sum(vector_to_array("weighted"))).drop("weighted")
        if self.spec.classifier == "SVM":
            prediction = vector_to_array("raw")[1]
        else:
            prediction = F.col("predicted_class")
        scored = scored.withColumn("prediction", prediction)
        return scored.drop("raw", "predicted_class", "probability")


def count_terms(df: DataFrame, num_features: int) -> DataFrame:
    """Posts with ``rawFeatures``, the hashed counts of their terms, which need no training."""
    return Pipeline(stages=hashed_tfidf_stages(num_features)[:2]).fit(df).transform(df)


def train(df: DataFrame, spec: Spec, counted: bool = False) -> Scorer:
    """Fit features and classifier on labelled, normalised posts; ``counted`` ones bring :func:`count_terms`."""
    rows = df.filter(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("double"))
    if spec.by_steps:
        classifier, share = None, 20_000
    elif spec.classifier == "SVM":
        classifier, share = svm(spec.reg, spec.max_iter or 100), 4_000
    elif spec.classifier == "MLP":
        classifier = mlp(spec.num_features, spec.hidden_layers, spec.width, spec.max_iter or 200)
        share = 500  # dense layers: far more arithmetic per row
    else:
        raise ValueError(f"unknown classifier {spec.classifier}")
    *counting, weighting = hashed_tfidf_stages(spec.num_features)
    # the texts are read once: the IDF and every solver start from these counts
    counts = Pipeline(stages=counting).fit(rows)
    held = (rows if counted else counts.transform(rows)).select("label", "rawFeatures").persist()
    try:
        n = held.count()
        idf = weighting.fit(held)
        rows = packed(idf.transform(held).select("label", "features"), n, share)
        if spec.classifier == "MLP":  # it keeps its rows dense and reads them in every iteration
            rows = dealt(rows, n, max(1, DENSE_BYTES // (8 * spec.num_features)))
        fitted = classifier.fit(rows) if classifier else fit_by_steps(rows, spec.num_features, spec.reg, spec.step or 1.0, spec.max_iter or 100)
    finally:
        held.unpersist()
    return Scorer(spec, PipelineModel([*counts.stages, idf, fitted]))


def keyword_classify(df: DataFrame, text: str = "processedTweet") -> DataFrame:
    return df.withColumn("prediction", keyword_score(F.col(text)))
