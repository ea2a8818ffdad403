"""Mean distance over all ordered pairs of a set, self-pairs included.

Each is a closed form over per-group sums; no pair is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gullwatch.functions.vectors import dot


def set_mean_sqdist(df: DataFrame, by: Sequence[str], vector: str = "vector") -> DataFrame:
    """``2 * (mean |x|^2 - |mean x|^2)`` per group."""
    v = F.col(vector)
    sums = df.withColumn("_v", array_to_vector(v.cast("array<double>"))).groupBy(*by).agg(
        F.avg(dot(v, v)).alias("mean_square"),
        vector_to_array(Summarizer.mean(F.col("_v"))).alias("mean"),
    )
    value = 2 * (F.col("mean_square") - dot(F.col("mean"), F.col("mean")))
    return sums.select(*by, value.alias("mean_sqdist"))


def set_mean_cosine(df: DataFrame, by: Sequence[str], vector: str = "vector") -> DataFrame:
    """``|mean of unit vectors|^2`` per group; zero vectors have no direction and are left out."""
    v = F.col(vector)
    units = df.withColumn("_norm", F.sqrt(dot(v, v))).filter(F.col("_norm") > 0)
    unit = F.transform(v, lambda x: x.cast("double") / F.col("_norm"))
    sums = units.withColumn("_v", array_to_vector(unit)).groupBy(*by).agg(
        vector_to_array(Summarizer.mean(F.col("_v"))).alias("mean")
    )
    return sums.select(*by, dot(F.col("mean"), F.col("mean")).alias("mean_cosine"))


def set_mean_manhattan(df: DataFrame, by: Sequence[str], vector: str = "vector") -> DataFrame:
    """``sum over dimensions of 2 * sum_{i<j} (x_j - x_i) / n^2`` per group.

    Equal values are counted together, then sorted by ranges: a large group spreads over
    many tasks, each forms its inner sum, and the ordered pieces of a dimension combine
    from their counts and sums alone.
    """
    keys = [*by, "dim"]
    values = (
        df.select(*by, F.posexplode(vector).alias("dim", "x"))
        .select(*keys, F.col("x").cast("double").alias("x"))
        .groupBy(*keys, "x")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    ranged = values.repartitionByRange(*keys, "x").withColumn("piece", F.spark_partition_id())
    inside = Window.partitionBy("piece", *keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    mass = F.col("copies") * F.col("x")
    pieces = (
        ranged.withColumn("n_below", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .withColumn("x_below", F.coalesce(F.sum(mass).over(inside), F.lit(0.0)))
        .groupBy("piece", *keys)
        .agg(
            F.sum("copies").alias("n"),
            F.sum(mass).alias("x"),
            F.sum(mass * F.col("n_below") - F.col("copies") * F.col("x_below")).alias("inner"),
        )
    )
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    dims = (
        pieces.withColumn("n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("x_before", F.coalesce(F.sum("x").over(earlier), F.lit(0.0)))
        .groupBy(*keys)
        .agg(
            F.sum(F.col("inner") + F.col("x") * F.col("n_before") - F.col("n") * F.col("x_before")).alias("s"),
            F.sum("n").alias("n"),
        )
    )
    return dims.groupBy(*by).agg(
        F.sum(2 * F.col("s") / (F.col("n").cast("double") * F.col("n"))).alias("mean_manhattan")
    )


