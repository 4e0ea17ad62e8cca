"""Network geometry over the station dimension (SURVEY: F2, F2b, F3, D8-D10, J1, J5, J6,
J9-J11, S6).

All of it is computed on the station dimension (bounded by the detector count), with
windows partitioned by carriageway and neighbour joins on bucket keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K
from ..functions import geo
from ..functions.numeric import E, lit, rnd, rnd_signed
from ..operators.spatial import grid_band_join, range_band_join
from ..sources import tables as S
from . import medallion as MD
from .memo import plan

CARRIAGEWAY = "PARTITION BY freeway, direction ORDER BY postmile, station_id"


@plan
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 + F3: per station the postmile-Voronoi segment length (half gaps to both
    neighbours, full gap at the ends, 0.5 mi alone; clamped to [0.05, 12]) and the local
    bearing from its neighbours; F2b's alternative length (mean of valid gaps 0 < g < 20,
    min 0.1, default 0.5) beside it."""
    st = MD.stations_geo_table(spark, sf_dir).select("station_id", "station_num", "freeway", "direction", "postmile", "latitude",
                                                     "longitude", "num_lanes")
    w = f"OVER ({CARRIAGEWAY})"
    s = st.selectExpr("*", f"lead(postmile) {w} AS pm_next", f"lag(postmile) {w} AS pm_prev",
                      f"lead(latitude) {w} AS lat_next", f"lag(latitude) {w} AS lat_prev",
                      f"lead(longitude) {w} AS lon_next", f"lag(longitude) {w} AS lon_prev")
    seg = (f"LEAST({lit(K.SEGMENT_LEN_MAX_MI)}, GREATEST({lit(K.SEGMENT_LEN_MIN_MI)}, COALESCE("
           f"(pm_next - pm_prev) / 2e0, pm_next - postmile, postmile - pm_prev, {lit(K.SEGMENT_LEN_DEFAULT_MI)})))")
    gaps = "filter(array(pm_next - postmile, postmile - pm_prev), g -> g IS NOT NULL AND g > 0 AND g < 20)"
    alt = (f"CASE WHEN size({gaps}) = 0 THEN {lit(K.SEGMENT_LEN_DEFAULT_MI)} ELSE GREATEST(1e-1,"
           f" aggregate({gaps}, 0e0, (a, g) -> a + g) / size({gaps})) END")
    bearing = geo.bearing_deg("latitude", "COALESCE(lat_next, latitude) - COALESCE(lat_prev, latitude)",
                              "COALESCE(lon_next, longitude) - COALESCE(lon_prev, longitude)")
    return s.selectExpr("station_id", "station_num", "freeway", "direction", "postmile", "latitude", "longitude", "num_lanes",
                        f"{seg} AS seg_len_mi", f"{alt} AS seg_len_alt_mi", f"{bearing} AS bearing_deg")


@plan
def candidates(spark: SparkSession, sf_dir: str, max_dist_m: float = K.PARALLEL_MAX_DIST_M,
               max_bearing_deg: float = K.PARALLEL_MAX_BEARING_DEG) -> DataFrame:
    """D8/J5 + D9/J6 + S6: diversion pairs (src, dst, w_dist, kind).

    parallel: other freeway, within ``max_dist_m`` and ``max_bearing_deg`` heading,
    w = 1/(1 + km); same_corridor: same carriageway, other station, |d postmile| <= 2,
    w = 0.5/(1 + |d postmile|)."""
    seg = segments(spark, sf_dir).select("station_id", "freeway", "direction", "postmile", "latitude",
                                         "longitude", "bearing_deg")
    par = grid_band_join(seg, seg, max_dist_m).filter(
        f"r_freeway <> l_freeway AND {geo.bearing_diff('l_bearing_deg', 'r_bearing_deg')} <= {lit(max_bearing_deg)}")
    par = par.selectExpr("l_station_id AS src", "r_station_id AS dst", "1e0 / (1e0 + dist_m / 1e3) AS w_dist",
                         "'parallel' AS kind")
    same = range_band_join(seg, seg, ["freeway", "direction"], "postmile", K.SAME_CORRIDOR_MAX_PM).filter(
        "r_station_id <> l_station_id")
    same = same.selectExpr("l_station_id AS src", "r_station_id AS dst",
                           "5e-1 / (1e0 + ABS(r_postmile - l_postmile)) AS w_dist", "'same_corridor' AS kind")
    return par.unionByName(same)


@plan
def corridor_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polyline length (haversine miles) and vertex count per freeway."""
    v = S.vertices(spark, sf_dir)
    w = "OVER (PARTITION BY freeway ORDER BY seq)"
    seg = v.selectExpr("freeway", "seq", "lat", "lon", f"lead(lat) {w} AS lat2", f"lead(lon) {w} AS lon2")
    return seg.groupBy("freeway").agg(
        E(rnd(f"sum(CASE WHEN lat2 IS NOT NULL THEN {geo.haversine_mi('lat', 'lon', 'lat2', 'lon2')} ELSE 0e0 END)",
              6)).alias("length_mi"),
        E("CAST(count(1) AS INT)").alias("vertices"))


@plan
def linear_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each station's postmile located on its freeway polyline: point by linear
    interpolation along the segment holding that distance (clamped at the last vertex),
    urban value blended, city, district and county of the nearer vertex (t < 0.5 -> start).
    J12: ``side_lat`` and ``side_lon`` set the two carriageways apart for drawing."""
    v = S.vertices(spark, sf_dir)
    own, named = ["lat", "lon", "urban"], ["city", "district", "county"]
    w = "OVER (PARTITION BY freeway ORDER BY seq)"
    seg = v.selectExpr("freeway", "seq", *own, *named, *[f"lead({c}) {w} AS {c}2" for c in [*own, *named]])
    seg = seg.withColumn("len", E(f"CASE WHEN lat2 IS NULL THEN 0e0 ELSE {geo.haversine_mi('lat', 'lon', 'lat2', 'lon2')} END"))
    seg = seg.selectExpr("*", "sum(len) OVER (PARTITION BY freeway ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING"
                              " AND CURRENT ROW) - len AS d0", "sum(len) OVER (PARTITION BY freeway) AS total")
    # the five drawn freeways give the shape of every block of five
    seg = seg.withColumnRenamed("freeway", "shape")
    st = S.stations(spark, sf_dir).selectExpr("station_id", "freeway", "direction", "GREATEST(0e0, postmile) AS d",
                                              "concat('F', CAST(CAST(substring(freeway, 2) AS BIGINT) % 5 AS STRING)) AS shape")
    # distance range join: segments replicated into the 1-mile buckets they span
    inner = (seg.filter("lat2 IS NOT NULL AND len > 0")
                .selectExpr("*", "explode(sequence(CAST(FLOOR(d0) AS BIGINT), CAST(FLOOR(d0 + len) AS BIGINT))) AS _b"))
    on_seg = (st.selectExpr("*", "CAST(FLOOR(d) AS BIGINT) AS _b").join(inner, ["shape", "_b"])
                .filter("d >= d0 AND d < d0 + len AND d < total").withColumn("t", E("LEAST(1e0, (d - d0) / len)")).drop("_b"))
    past = st.join(seg.filter("lat2 IS NULL"), "shape").filter("d >= total").withColumn("t", E("0e0"))
    at = on_seg.unionByName(past).selectExpr(
        "station_id", "freeway", "direction", "d AS distance_mi", *[f"CASE WHEN lat2 IS NULL THEN {c} ELSE {c} + ({c}2 - {c}) * t END AS {c}" for c in own],
        *[f"CASE WHEN t >= 5e-1 THEN {c}2 ELSE {c} END AS {c}" for c in named])
    side = [f"{rnd_signed(geo.carriageway_offset(c, 'direction'), 6)} AS side_{c}" for c in ("lat", "lon")]
    return at.selectExpr("station_id", "freeway", "distance_mi", *own, *named, *side)


@plan
def corridor_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each carriageway's station points in postmile order, as one ordered array."""
    st = MD.stations_geo_table(spark, sf_dir)
    return st.groupBy("freeway", "direction").agg(
        E("transform(array_sort(collect_list(struct(postmile, station_id, longitude, latitude))),"
          " x -> struct(x.station_id AS station_id, x.longitude AS lon, x.latitude AS lat))").alias("path"))
