"""Dense numbers in sorted order without one task seeing all rows (SURVEY: F1, K21, S1).

A window over everything, or over a key that holds most rows, sorts in one task. Here rows are
cut into sorted ranges, written with the number of their range, counted per range (one row
each), and numbered inside it; a row's number is its place plus the rows of the ranges before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number(df: DataFrame, keys: list[str], order: str, name: str, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` (distinct in ``keys`` and ``order``) with ``name``: 0..N-1 per ``keys`` in the order of
    ``order``. ``store`` writes a table and reads it back: the ranges come from a sample, so they
    must not be computed twice."""
    ranged = store(df.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(order)) - 1
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before).drop("_n")  # a row per range and key
    return ranged.withColumn("_place", place).join(sizes, ["_range", *keys]).withColumn(name, (F.col("_place") + F.col("_before")).cast("int")).select(*df.columns, name)
