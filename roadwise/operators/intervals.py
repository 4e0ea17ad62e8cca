"""Point-in-interval joins as equi-joins on coarse time buckets.

A range predicate alone plans as a nested-loop join. Here each interval is exploded into
the ``width``-sized buckets it overlaps (bounded by its length / width), points are keyed
by their bucket, and the join is an ordinary equi-join on (keys, bucket) with the exact
range test as a residual. A hot key is spread over many buckets, and the planner or AQE
choose broadcast or shuffle from real sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str,
                  start: str, end: str, width: int, how: str = "left") -> DataFrame:
    """Rows of ``points`` joined to every interval of the same ``keys`` with
    ``start <= point < end`` (integer coordinates). Overlapping intervals fan out, as a
    plain range join would."""
    iv = intervals.withColumn(
        "_bk", F.explode(F.sequence(F.floor(F.col(start) / width),
                                    F.floor((F.col(end) - 1) / width))))
    iv = iv.select(*[F.col(k).alias(f"_i_{k}") for k in keys], "_bk",
                   *[F.col(c).alias(c) for c in intervals.columns if c not in keys])
    pt = points.withColumn("_bk", F.floor(F.col(point) / width))
    cond = [pt[k] == iv[f"_i_{k}"] for k in keys] + [pt["_bk"] == iv["_bk"],
                                                     iv[start] <= pt[point], pt[point] < iv[end]]
    out = pt.join(iv, cond, how)
    return out.drop("_bk", *[f"_i_{k}" for k in keys])
