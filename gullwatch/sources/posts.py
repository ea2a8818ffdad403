"""Post tables, stop words and embedding dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POST_SCHEMA = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("tweet", T.StringType()),
        T.StructField("id", T.StringType()),
    ]
)


def spread(df: DataFrame) -> DataFrame:
    """Deal out rows when the input has fewer splits than the cluster has cores.

    Small or single-row-group files would leave text work on one core. Inputs with
    enough splits, as any large table has, are returned as they are. Apply it to a plain
    scan: asking a plan with shuffles for its partitions would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores + 1 else df


def packed(df: DataFrame, rows: int, rows_per_partition: int = 20_000) -> DataFrame:
    """Merge partitions of an input known to be small.

    Iterative solvers run a job per step; on a few thousand rows the tasks cost more than
    the arithmetic. Never raises the number of partitions.
    """
    return df.coalesce(max(1, -(-rows // rows_per_partition)))


def dealt(df: DataFrame, rows: int, most: int) -> DataFrame:
    """At most about ``most`` of the ``rows`` rows in a partition; never lowers the number of partitions."""
    wanted = -(-rows // most)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def read_posts(spark: SparkSession, path: str, label_type: str = "int") -> DataFrame:
    """Headerless tab-separated posts; labels that are not numbers become null."""
    df = spark.read.schema(POST_SCHEMA).option("sep", "\t").csv(path)
    if label_type == "string":
        return df
    return df.withColumn("label", F.col("label").try_cast(label_type))


def nonempty(df: DataFrame, column: str = "tweet") -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def removed_counts(df: DataFrame, column: str = "tweet") -> DataFrame:
    """One row: lines read, kept and removed by :func:`nonempty`."""
    kept = F.count_if(F.col(column).isNotNull() & (F.col(column) != ""))
    return df.agg(
        F.count(F.lit(1)).alias("n_read"),
        kept.alias("n_kept"),
        (F.count(F.lit(1)) - kept).alias("n_removed"),
    )


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("word"))


def stopword_list(words: DataFrame) -> list[str]:
    """Words as Python strings, for short lists; ``drop_stopwords`` takes the table itself."""
    return sorted(r.word for r in words.select("word").distinct().collect())


def read_embeddings_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``token: [f, f, ...]`` as ``(token, vector array<double>)``."""
    parts = F.split(F.col("value"), ": ")
    return spark.read.text(path).select(
        F.get(parts, 0).alias("token"),
        F.from_json(F.get(parts, 1), T.ArrayType(T.DoubleType())).alias("vector"),
    )


def write_embeddings_text(df: DataFrame, path: str) -> None:
    numbers = F.transform(F.col("vector"), lambda x: x.cast("double").cast("string"))
    line = F.concat(F.col("token"), F.lit(": ["), F.array_join(numbers, ", "), F.lit("]"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def posts_distinct(df: DataFrame) -> DataFrame:
    """One row per id, the smallest row winning; copies combine before the shuffle."""
    rest = [c for c in df.columns if c != "id"]
    best = df.groupBy("id").agg(F.min(F.struct(*rest)).alias("row"))
    return best.select("id", *[F.col(f"row.{c}").alias(c) for c in rest])


def preview(df: DataFrame, n: int, order_by: str = "id") -> DataFrame:
    """First ``n`` rows by key: a bounded top-n, not a global sort."""
    return df.orderBy(order_by).limit(n)
