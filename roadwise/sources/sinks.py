"""Sinks.

A stored table has one folder, partitioned by local date. Every task of the plan that feeds it writes a
file per date, its rows sorted by time and freeway, in row groups of ``ROW_GROUP`` bytes: a date predicate
then prunes folders, a time predicate prunes row groups. Rows are not dealt anew for the write: a shuffle
of whole rows costs more than all others of the chain together, and the chain's last shuffle
has dealt them evenly.

Nothing samples the input to find ranges, so the plan that feeds a table runs once per write and
observed counts (``operators.quality``) count every row once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Layout:
    """Where rows of a table go: date folders, and inside a file the order, first of ``window_of``."""

    partition: str | None = "reading_date"
    window_of: str | None = "bucket_idx"
    sort: tuple[str, ...] = ("time_bucket", "freeway")


FACTS = Layout()
DIMENSION = Layout(partition=None, window_of=None, sort=("freeway", "station_id"))


ROW_GROUP = 16 << 20


def _arranged(df: DataFrame, layout: Layout) -> DataFrame:
    order = [c for c in (layout.partition, layout.window_of, *layout.sort) if c]
    return df.sortWithinPartitions(*order) if order else df


def write_table(df: DataFrame, path: str, layout: Layout = FACTS, only_dates_present: bool = False) -> DataFrame:
    """A4 + A5: write ``df`` in full and read it back. With ``only_dates_present`` the dates
    that ``df`` holds are replaced and all others stay (a date may be refreshed again and again,
    also after a failure); otherwise the table is replaced."""
    w = _arranged(df, layout).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic" if only_dates_present else "static").option(
        "parquet.block.size", ROW_GROUP)
    (w.partitionBy(layout.partition) if layout.partition else w).parquet(path)
    return open_table(df.sparkSession, path, df)


def open_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored table with the columns and types of ``like`` (no inference over its files)."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def append_history(df: DataFrame, path: str, run_id: str) -> None:
    """Add one run's rows to a history. The run is a partition of its own, replaced when
    the same run writes again, so a retry leaves one copy."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_history(spark: SparkSession, path: str, like: DataFrame, latest: bool = False) -> DataFrame:
    """The history, or its latest run (the largest id; found from the folder names alone)."""
    h = spark.read.schema(like.withColumn("run_id", F.lit("")).schema).parquet(path)
    return h.join(h.agg(F.max("run_id").alias("run_id")), "run_id") if latest else h
