"""Consecutive numbers in a total order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gullwatch.session import cut_lineage

_ROWS_BITS = 33  # monotonically_increasing_id keeps the row offset in the low 33 bits


def number_rows(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    """Add ``name`` = 1..n in the order of ``order_by``.

    Range partitions are sorted in place; the row count of each partition, one row per
    partition, gives the offset of the next.
    """
    seq = F.monotonically_increasing_id()
    ranged = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_seq", seq)
        .withColumn("_part", F.shiftright("_seq", _ROWS_BITS))
        .withColumn("_row", F.col("_seq") - F.shiftleft("_part", _ROWS_BITS))
    )
    # written once, so both uses below see the same range bounds
    ranged = cut_lineage(ranged)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        ranged.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, F.col("_offset") + F.col("_row") + 1)
        .drop("_part", "_seq", "_row", "_offset")
    )
