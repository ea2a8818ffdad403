"""Confusion counts, classification metrics and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric order of result files.
METRICS = ["tpr", "tnr", "fpr", "fnr", "avg_tp_tn", "accuracy", "precision", "recall", "f_measure", "g_mean"]


def with_quadrant(df: DataFrame) -> DataFrame:
    """``tps/fps/tns/fns`` from ``label > 0`` and ``prediction > 0``."""
    actual, predicted = F.col("label") > 0, F.col("prediction") > 0.0
    return df.withColumn(
        "quadrant",
        F.when(actual & predicted, "tps")
        .when(predicted, "fps")
        .when(actual, "fns")
        .otherwise("tns"),
    )


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Four counts per group in one pass. A null label counts as negative."""
    actual = F.coalesce(F.col("label") > 0, F.lit(False))
    predicted = F.coalesce(F.col("prediction") > 0.0, F.lit(False))
    return df.groupBy(*by).agg(
        F.count_if(actual & predicted).alias("tp"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(~actual & ~predicted).alias("tn"),
        F.count_if(actual & ~predicted).alias("fn"),
    )


def _rate(numerator: Column, denominator: Column, decimals: int = 5) -> Column:
    return F.round(F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0)), decimals)


def classification_metrics(counts: DataFrame, legacy_names: bool = False) -> DataFrame:
    """Ten metrics from :func:`confusion`, half-up rounded (accuracy 2, others 5 places).

    Empty denominators give 0. ``legacy_names=True`` reproduces the column meanings of
    old result files, where false positives and false negatives are exchanged and the
    F-measure is the harmonic mean of the exchanged precision and the TPR.
    """
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    df = counts.select(
        "*",
        _rate(tp, tp + fn).alias("tpr"),
        _rate(tn, tn + fp).alias("tnr"),
        _rate(fp, fp + tn).alias("fpr"),
        _rate(fn, fn + tp).alias("fnr"),
        _rate(tp + tn, tp + tn + fp + fn, 2).alias("accuracy"),
        _rate(tp, tp + fp).alias("precision"),
        _rate(tp, tp + fn).alias("recall"),
    )
    if legacy_names:
        df = df.withColumns(
            {
                "fpr": F.col("fnr"),
                "fnr": F.col("fpr"),
                "precision": F.col("recall"),
                "recall": F.col("precision"),
            }
        )
    other = F.col("tpr") if legacy_names else F.col("recall")
    harmonic = 2 * F.col("precision") * other
    return df.withColumns(
        {
            "avg_tp_tn": F.round((F.col("tpr") + F.col("tnr")) / 2, 5),
            "f_measure": _rate(harmonic, F.col("precision") + other),
            "g_mean": F.round(F.sqrt(F.col("tpr") * F.col("tnr")), 5),
        }
    ).select(*counts.columns, *METRICS)


def fold_summary(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, minimum and maximum of each metric over its rows."""
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    long = metrics.select(*by, F.expr(f"stack({len(METRICS)}, {pairs}) as (metric, value)"))
    # the metrics carry five decimals, so an exact decimal mean has no rounding noise
    mean = F.sum(F.col("value").cast("decimal(18,5)")) / F.count("value")
    return long.groupBy(*by, "metric").agg(
        F.round(mean.cast("double"), 5).alias("avg"),
        F.round(F.stddev_pop("value"), 5).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def basic_statistics(df: DataFrame, column: str, by: Sequence[str] = (), decimals: int = 5) -> DataFrame:
    return df.groupBy(*by).agg(
        F.round(F.avg(column), decimals).alias("mean"),
        F.round(F.var_pop(column), decimals).alias("variance"),
        F.round(F.stddev_pop(column), decimals).alias("std"),
        F.round(F.min(column), decimals).alias("min"),
        F.round(F.max(column), decimals).alias("max"),
    )
