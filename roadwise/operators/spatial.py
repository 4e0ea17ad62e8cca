"""Neighbour joins without nested loops.

Both joins put points in buckets at least as wide as the search radius, replicate one side
into the neighbouring buckets, and equi-join on the bucket key; the exact distance test is
a residual. Pairs examined are bounded by a constant factor of the true neighbour pairs.

Few points make many pairs, so the left side is dealt by bucket to as many tasks as asked for: the adaptive
planner sees only the points' bytes and would gather the join in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .. import constants as K
from ..functions import geo
from ..functions.numeric import E, lit


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def grid_band_join(left: DataFrame, right: DataFrame, max_dist_m: float, max_abs_lat: float = K.CA_MAX_LAT,
                   lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Pairs (l_*, r_*) of points within ``max_dist_m`` metres (haversine ``dist_m``).

    Grid cells are ``max_dist_m`` tall and wide at latitude ``max_abs_lat`` (the widest
    degrees needed for points up to that latitude), so every neighbour lies in the 3 x 3
    block around a point's cell. The box is derived from the distance, never fixed."""
    m_per_deg = math.pi / 180.0 * K.EARTH_RADIUS_M
    dlat = max(max_dist_m, 1.0) / m_per_deg
    dlon = max(max_dist_m, 1.0) / (m_per_deg * math.cos(math.radians(max_abs_lat)))
    cell = (f"CAST(FLOOR({lat} / {lit(dlat)}) AS BIGINT) AS gy", f"CAST(FLOOR({lon} / {lit(dlon)}) AS BIGINT) AS gx")
    L = left.selectExpr("*", *cell).selectExpr(*[f"{c} AS l_{c}" for c in left.columns], "gy", "gx")
    R = (right.selectExpr("*", *cell)
              .selectExpr(*[f"{c} AS r_{c}" for c in right.columns],
                          "explode(sequence(gy - 1, gy + 1)) AS gy", "gx")
              .selectExpr("*", "explode(sequence(gx - 1, gx + 1)) AS gx2").drop("gx").withColumnRenamed("gx2", "gx"))
    j = _dealt(L, "gy", "gx").join(R, ["gy", "gx"]).drop("gy", "gx")
    j = j.withColumn("dist_m", E(geo.haversine_m(f"l_{lat}", f"l_{lon}", f"r_{lat}", f"r_{lon}")))
    return j.filter(f"dist_m <= {lit(max_dist_m)}")


def range_band_join(left: DataFrame, right: DataFrame, keys: list[str], pos: str, width: float) -> DataFrame:
    """Pairs with equal ``keys`` and |l_pos - r_pos| <= width, via buckets of ``width``."""
    b = f"CAST(FLOOR({pos} / {lit(width)}) AS BIGINT) AS _b"
    L = left.selectExpr("*", b).selectExpr(*[f"{c} AS l_{c}" for c in left.columns], *keys, "_b")
    R = (right.selectExpr("*", b)
              .selectExpr(*[f"{c} AS r_{c}" for c in right.columns], *keys, "explode(sequence(_b - 1, _b + 1)) AS _b"))
    j = _dealt(L, *keys, "_b").join(R, keys + ["_b"]).drop("_b", *keys)
    return j.filter(f"ABS(r_{pos} - l_{pos}) <= {lit(width)}")
