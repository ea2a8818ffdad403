"""Week buckets: runs of days with the same week number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gullwatch.functions.dates import week_of_year


def week_buckets(
    df: DataFrame, day: str = "day", week_start: int = 1, min_days: int = 4, strict: bool = False
) -> DataFrame:
    """Add ``week`` and dense ``week_bucket`` (from 1) in date order.

    Posts without a day stay, without a week and bucket. A bucket starts whenever the week number differs from that of the previous day
    present. The year is part of the key unless ``strict``, which merges equal week
    numbers of adjacent years as the original rule does. The ordered pass runs over the
    distinct days: the calendar bounds them (3.7 million DATE values in all, a few
    thousand in practice), which is also why they may be broadcast back to the posts.
    """
    ordered = Window.orderBy(day)
    week = week_of_year(F.col(day), week_start, min_days)
    key = F.struct("week") if strict else F.struct("week", F.year(day).alias("year"))
    days = (
        df.select(day)
        .filter(F.col(day).isNotNull())
        .distinct()
        .withColumn("week", week)
        .withColumn("_key", key)
        .withColumn("_starts", ~F.col("_key").eqNullSafe(F.lag("_key").over(ordered)))
        .withColumn("week_bucket", F.sum(F.col("_starts").cast("int")).over(ordered))
        .select(day, "week", "week_bucket")
    )
    return df.join(F.broadcast(days), day, "left")


def weekly_counts(buckets: DataFrame) -> DataFrame:
    """Posts per bucket; those without a day are counted under a null bucket."""
    return buckets.groupBy("week_bucket").agg(
        F.min("week").alias("week"), F.count(F.lit(1)).alias("n_posts")
    )
