"""Views of the test tables that the registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gullwatch.functions.dates import post_day
from gullwatch.functions.text import normalise, tokenise
from gullwatch.operators.features import UNKNOWN, weighted_term_sets
from gullwatch.session import kept_rows
from gullwatch.sources.posts import spread

STOPWORDS = "the of and to in is that a de la".split()
FIRST_DAY = "2016-03-20"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as posts ``(id, date, day, tweet, source, dataset, period, lang)``."""
    doc = F.col("doc_id")
    day = F.date_add(F.to_date(F.lit(FIRST_DAY)), F.pmod(doc, F.lit(120)).cast("int"))
    number = F.substring("source", 4, 10).cast("int")
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        doc.cast("string").alias("id"),
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.col("text").alias("tweet"),
        "source",
        F.substring(F.lit("ABCD"), number % 4 + 1, F.lit(1)).alias("dataset"),
        F.concat(F.lit("d"), (F.pmod(doc, F.lit(3)) + 1).cast("string")).alias("period"),
        "lang",
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return rows.select(F.col("doc_id").cast("string").alias("id"), F.col("quality").alias("label"), "toxic")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(documents(spark, sf_dir))


def with_blanks(df: DataFrame) -> DataFrame:
    """Every Spanish post a second time without text: rows whose token lists are empty."""
    blank = df.filter(F.col("lang") == "es").withColumn("id", F.concat("id", F.lit("-blank")))
    return df.unionByName(blank.withColumn("tweet", F.lit("")))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled posts."""
    return texts(spark, sf_dir).join(labels(spark, sf_dir), "id")


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", post_day(F.col("date")))


def processed(df: DataFrame) -> DataFrame:
    return normalise(df)


def worded(df: DataFrame) -> DataFrame:
    return processed(df).withColumn("words", tokenise(F.col("processedTweet")))


def lead_term(words: Column) -> Column:
    """Longest token, first in order among equals: groups near copies of a post."""
    ranked = F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))
    return F.array_min(ranked)["w"]


def term_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents grouped by lead term: ``(cluster, id, words, terms)``."""
    rows = worded(texts(spark, sf_dir)).select(lead_term(F.col("words")).alias("cluster"), "id", "words")
    rows = kept_rows(rows)  # written once: the flows below read it several times, each its own columns
    return weighted_term_sets(rows).filter(F.col("cluster") != "")


def listed_clusters(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("cluster").alias("cluster_id")).agg(F.min("id").alias("exemplar_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as cluster members ``(cluster, id, vector)``."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("label").alias("cluster"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors: every token of the benchmark texts, and ``<UNK>``, gets an embedding."""
    tokens = (
        worded(table(spark, sf_dir, "benchmark").withColumnRenamed("text", "tweet"))
        .select(F.explode("words").alias("token"))
        .filter(F.col("token") != "")
        .distinct()
    )
    vecs = table(spark, sf_dir, "embeddings")
    n = F.lit(vecs.count())
    code = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("bigint")
    known = tokens.join(vecs, F.pmod(code, n) == F.col("vec_id"))
    unknown = vecs.filter(F.col("vec_id") == 0).select(F.lit(UNKNOWN).alias("token"), "embedding")
    return known.select("token", "embedding").unionByName(unknown).withColumnRenamed("embedding", "vector")
