import datetime as dt

from pyspark.sql import functions as F

from gullwatch.functions.dates import post_day, week_of_year
from gullwatch.operators.weeks import week_buckets, weekly_counts


def test_week_edges(spark):
    days = spark.createDataFrame([("2016-01-01",), ("2016-04-03",), ("2017-01-01",), ("junk",)], "d string")
    day = post_day(F.col("d"))
    rows = days.select("d", week_of_year(day, 7, 1).alias("us"), week_of_year(day).alias("iso")).collect()
    assert [(r.us, r.iso) for r in rows] == [(1, 0), (15, 13), (1, 0), (None, None)]


def test_buckets_are_dense_and_split_years(spark):
    days = [dt.date(2016, 4, 4), dt.date(2016, 4, 5), dt.date(2016, 4, 18), dt.date(2017, 4, 17)]
    rows = spark.createDataFrame([(d, str(i)) for i, d in enumerate(days)], "day date, id string")
    got = {r.id: r.week_bucket for r in week_buckets(rows).collect()}
    assert got == {"0": 1, "1": 1, "2": 2, "3": 3}
    strict = {r.id: r.week_bucket for r in week_buckets(rows, strict=True).collect()}
    assert strict == {"0": 1, "1": 1, "2": 2, "3": 2}
    assert weekly_counts(week_buckets(rows)).agg(F.sum("n_posts")).first()[0] == 4
