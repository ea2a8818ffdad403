"""Day, week and timestamp expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLUSTER_TIME_FORMAT = "yyyy/MM/dd HH:mm:ss"


def post_day(c: Column) -> Column:
    """First ten characters as a date; null when they are not one."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def week_of_year(day: Column, week_start: int = 1, min_days: int = 4) -> Column:
    """Week of the calendar year for a first weekday (1 Monday .. 7 Sunday) and the
    fewest days week one may have. Days before week one are in week 0."""
    dow = F.pmod(F.weekday(day) + 1 - week_start, F.lit(7)) + 1
    doy = F.dayofyear(day)
    week_begin = F.pmod(doy - dow, F.lit(7))
    offset = F.when(week_begin + 1 > min_days, 7 - week_begin).otherwise(-week_begin)
    return F.floor((7 + offset + doy - 1) / 7).cast("int")


def cluster_time(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit(CLUSTER_TIME_FORMAT))


def format_cluster_time(c: Column) -> Column:
    return F.date_format(c, CLUSTER_TIME_FORMAT)
