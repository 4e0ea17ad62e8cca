"""Dashboard queries over the frame table (SURVEY: E5, E21, K21, D4, F1, S1, C6-C8, B22,
E19, H15, H16, D1, D7, J3, J7, J8, E22, K17, K19).

Every query runs over all days and, where the reference takes a corridor parameter, over
every scope at once: ``scope`` is 'ALL' plus each freeway (C6 as data, not a parameter),
and every 24-bucket window of the day (K17) is produced in the same job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import E
from ..operators.packing import pack_dense, pack_ordered, unpack_all
from ..sources import tables as S
from . import gold as GO
from . import medallion as MD
from .memo import plan

WINDOW_STARTS = tuple(range(0, K.BUCKETS_PER_DAY, K.WINDOW_BUCKETS))


@plan
def day_catalogue(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """Per local date: day of week, weekend flag as INT, day name, station count."""
    return MD.frames_table(spark, sf_dir, day).groupBy("reading_date").agg(
        E("CAST(max(day_of_week) AS INT)").alias("day_of_week"),
        E("CAST(max(CASE WHEN is_weekend THEN 1 ELSE 0 END) AS INT)").alias("is_weekend"),
        E("CAST(count(DISTINCT station_id) AS INT)").alias("station_count"),
    ).selectExpr("reading_date AS day", "day_of_week", "is_weekend",
                 "date_format(reading_date, 'EEE') AS day_name", "station_count")


@plan
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: every date of the weeks that the frames span (Monday to Sunday), from a range of day
    offsets, with whether it has frames: what a date picker offers and greys out."""
    days = MD.days_table(spark, sf_dir)
    first, n = days.selectExpr("trunc(min(reading_date), 'week') AS first",
                               "datediff(date_add(trunc(max(reading_date), 'week'), 7), trunc(min(reading_date), 'week')) AS n").first()
    dates = S.day_range(spark, n or 0).selectExpr(f"date_add(DATE '{first or '1970-01-01'}', CAST(day_offset AS INT)) AS day")
    return dates.join(days.selectExpr("reading_date AS day", "true AS seen"), "day", "left").selectExpr(
        "day", "CAST(dayofweek(day) AS INT) AS day_of_week", "dayofweek(day) IN (1, 7) AS is_weekend", "COALESCE(seen, false) AS has_frames")


@plan
def corridor_options(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """E5: stations with frames per freeway."""
    return MD.frames_table(spark, sf_dir, day).groupBy("freeway").agg(
        E("CAST(count(DISTINCT station_id) AS INT)").alias("station_count"))


@plan
def station_geometry(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """Attributes of stations that have frames, with the dense station index
    the payloads use (0..N-1 in station_id order) as a column instead of a sort."""
    geo = MD.stations_geo_table(spark, sf_dir)
    if day is None:
        order = GO.table(spark, sf_dir, "station_order")
    else:
        order = GO.table(spark, sf_dir, "station_index", day).where("scope = 'ALL'").select("station_id", "station_idx")
    return geo.join(order, "station_id").select(
        "station_id", "freeway", "direction", "postmile", "latitude", "longitude", "num_lanes", "station_type",
        F.col("cell_r7_str").alias("cell_r7"), F.col("cell_r8_str").alias("cell_r8"), "baseline_capacity_vph", "baseline_lanes", "station_idx")


def scoped(df: DataFrame) -> DataFrame:
    """C6 as data: each row once under scope 'ALL' and once under its own freeway."""
    return df.withColumn("scope", E("explode(array('ALL', freeway))"))


@plan
def station_index(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """dense 0..N-1 index per (reading_date, scope) over the stations with frames that
    day, in station_id order, as stored by the refresh (no window over all stations of a scope)."""
    return GO.table(spark, sf_dir, "station_index", day)


#: The integer-scaled payload values of a frame; a missing one is -1 (incident 0).
CELL_VALUES = {
    "flow": "COALESCE(CAST(avg_flow_vph AS INT), -1)",
    "speed_half": "COALESCE(CAST(FLOOR(avg_speed_mph * 2e0 + 5e-1) AS INT), -1)",
    "vc_pct": "COALESCE(CAST(FLOOR(vc_ratio * 1e2 + 5e-1) AS INT), -1)",
    "incident": "COALESCE(CAST(CASE WHEN incident_active THEN COALESCE(max_incident_severity, 1) ELSE 0 END AS INT), 0)"}


@plan
def time_matrix_cells(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """D1 + B22: the dense (date, scope, bucket, station_idx) grid of all 96 buckets of a
    day times its station index, with the integer-scaled payload values; a station without a
    frame in a bucket carries -1 (flow, speed, v/c) and 0 (incident)."""
    f = scoped(MD.frames_table(spark, sf_dir, day)).selectExpr(
        "reading_date", "scope", "bucket_idx", "station_id", *[f"{v} AS {k}" for k, v in CELL_VALUES.items()])
    # every bucket of the day, so positions in a window are always bucket-major and complete
    buckets = f.select("reading_date", "scope").distinct().selectExpr(
        "reading_date", "scope", f"explode(sequence(0, {K.BUCKETS_PER_DAY - 1})) AS bucket_idx")
    grid = station_index(spark, sf_dir, day=day).join(buckets, ["reading_date", "scope"])
    cells = grid.join(f, ["reading_date", "scope", "bucket_idx", "station_id"], "left")
    return cells.selectExpr(
        "reading_date", "scope", "bucket_idx", "station_id", "station_idx",
        f"CAST(bucket_idx DIV {K.WINDOW_BUCKETS} * {K.WINDOW_BUCKETS} AS INT) AS from_bucket",
        "COALESCE(flow, -1) AS flow", "COALESCE(speed_half, -1) AS speed_half",
        "COALESCE(vc_pct, -1) AS vc_pct", "COALESCE(incident, 0) AS incident")


@plan
def time_matrix(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """The packed animation payload, one row per (date, scope, 24-bucket window): the dense grid of
    ``time_matrix_cells``, packed from the frames alone."""
    idx = station_index(spark, sf_dir, day=day)
    f = MD.frames_table(spark, sf_dir, day).selectExpr("reading_date", "bucket_idx", "station_id", *[f"{v} AS {k}" for k, v in CELL_VALUES.items()])
    cells = f.join(idx, ["reading_date", "station_id"])  # once for each scope of the station
    return pack_dense(cells, scope_widths(idx), ["reading_date", "scope"], "bucket_idx", "station_idx", {"flow": -1, "speed_half": -1, "vc_pct": -1, "incident": 0},
                      K.BUCKETS_PER_DAY, K.WINDOW_BUCKETS)


def scope_widths(index: DataFrame) -> DataFrame:
    """Number of stations of each date and scope."""
    return index.groupBy("reading_date", "scope").agg(E("CAST(max(station_idx) + 1 AS INT) AS width"))


@plan
def time_matrix_decoded(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """H15 + H16: unpack the payload back to (date, scope, bucket, station) values; the
    -1 no-data sentinel becomes NULL, speed is halved, v/c divided by 100."""
    out = unpack_all(time_matrix(spark, sf_dir, day=day), ["reading_date", "scope"], ["flow", "speed_half", "vc_pct", "incident"], "stations", "station_idx")
    out = out.join(station_index(spark, sf_dir, day=day), ["reading_date", "scope", "station_idx"])
    return out.selectExpr(
        "reading_date", "scope", "bucket_idx", "station_id",
        "NULLIF(flow, -1) AS flow_vph",
        "CASE WHEN speed_half = -1 THEN NULL ELSE speed_half / 2e0 END AS speed_mph",
        "CASE WHEN vc_pct = -1 THEN NULL ELSE vc_pct / 1e2 END AS vc_ratio",
        "incident")


@plan
def cell_congestion(spark: SparkSession, sf_dir: str, parent_res: int = 5, day: str | None = None) -> DataFrame:
    """J3 + J7 + J8 + D7 + E22: per (date, scope, window): the hexagon dictionary and the
    dense bucket x hexagon congestion and speed payload (-1 = no stations in the cell)."""
    if parent_res != 5:
        raise ValueError("the station dimension carries resolution-5 parents of the r7 cells")
    cells = MD.stations_geo_table(spark, sf_dir).select("station_id", "cell_r7_p5")
    f = MD.frames_table(spark, sf_dir, day).select(
        "station_id", "reading_date", "freeway", "bucket_idx", "congestion_index", "avg_speed_mph").join(
        cells, "station_id")
    f = scoped(f).withColumn("hex_id", E("lower(hex(cell_r7_p5))"))
    agg = f.groupBy("reading_date", "scope", "bucket_idx", "hex_id").agg(
        E("CAST(FLOOR(SUM(CAST(FLOOR(congestion_index * 1e4 + 5e-1) AS BIGINT)) / (COUNT(congestion_index) * 1e2)"
          " + 5e-1) AS INT)").alias("congestion_pct"),
        E("CAST(FLOOR(SUM(CAST(FLOOR(avg_speed_mph * 1e1 + 5e-1) AS BIGINT)) / (COUNT(avg_speed_mph) * 5e0)"
          " + 5e-1) AS INT)").alias("speed_half"))
    w = Window.partitionBy("reading_date", "scope").orderBy("hex_id")
    hex_dim = (agg.select("reading_date", "scope", "hex_id").distinct()
                  .withColumn("hex_idx", (F.row_number().over(w) - 1).cast("int")))
    buckets = agg.select("reading_date", "scope").distinct().selectExpr(
        "reading_date", "scope", f"explode(sequence(0, {K.BUCKETS_PER_DAY - 1})) AS bucket_idx")
    dense = (buckets.join(hex_dim, ["reading_date", "scope"])
                    .join(agg, ["reading_date", "scope", "bucket_idx", "hex_id"], "left")
                    .selectExpr("reading_date", "scope", "bucket_idx", "hex_idx",
                                f"CAST(bucket_idx DIV {K.WINDOW_BUCKETS} * {K.WINDOW_BUCKETS} AS INT) AS from_bucket",
                                "COALESCE(congestion_pct, -1) AS congestion_pct", "COALESCE(speed_half, 0) AS speed_half"))
    keys = ["reading_date", "scope", "from_bucket"]
    packed = pack_ordered(dense, keys, "bucket_idx", "hex_idx", ["congestion_pct", "speed_half"],
                          max_of="congestion_pct")
    dict_ = hex_dim.groupBy("reading_date", "scope").agg(
        E("CAST(count(1) AS INT)").alias("hex_count"),
        E("array_join(transform(array_sort(collect_list(struct(hex_idx, hex_id))), x -> x.hex_id), ',')").alias("hex_ids"))
    return (packed.join(dict_, ["reading_date", "scope"])
                  .select(*keys, "hex_count", "first_bucket", "max_congestion_pct", "hex_ids", "congestion_pct",
                          "speed_half"))


@plan
def cell_congestion_decoded(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """The hexagon payload back as (date, scope, bucket, hexagon) values; a hexagon without
    stations (-1) has neither congestion nor speed. ``max_so_far`` is the largest congestion of the
    day up to the cell's window, by which a client scales heights."""
    p = cell_congestion(spark, sf_dir, day=day).withColumn("max_so_far", E(
        "max(max_congestion_pct) OVER (PARTITION BY reading_date, scope ORDER BY from_bucket)"))
    out = unpack_all(p, ["reading_date", "scope", "hex_ids", "max_so_far"], ["congestion_pct", "speed_half"], "hex_count", "hex_idx")
    seen = "congestion_pct <> -1"
    return out.selectExpr(
        "reading_date", "scope", "bucket_idx", "element_at(split(hex_ids, ','), hex_idx + 1) AS hex_id",
        f"CASE WHEN {seen} THEN congestion_pct / 1e2 END AS congestion", f"CASE WHEN {seen} THEN speed_half / 2e0 END AS speed_mph",
        "max_so_far / 1e2 AS max_so_far")


def check_alignment(payload: DataFrame, frames: DataFrame) -> DataFrame:
    """Whether a payload can be read against the stations of its day. Stations are counted from
    the frames, not from the index that laid the payload out, and values from the packed text
    itself, so a lost or extra value shows. ``aligned`` false marks a payload to reject."""
    stations = scoped(frames.select("reading_date", "freeway", "station_id")).groupBy("reading_date", "scope").agg(
        E("CAST(count(DISTINCT station_id) AS INT)").alias("index_stations"))
    size = "size(split({}, ','))"
    texts = ("flow", "speed_half", "vc_pct", "incident")
    p = payload.selectExpr("reading_date", "scope", "from_bucket", "stations",
                           f"CAST({size.format('flow')} AS INT) AS n_values",
                           " AND ".join(f"{size.format('flow')} = {size.format(t)}" for t in texts[1:]) + " AS even")
    return p.join(stations, ["reading_date", "scope"], "left").selectExpr(
        "reading_date", "scope", "from_bucket", "stations", "index_stations", "n_values",
        f"COALESCE(even AND stations = index_stations AND n_values = index_stations * {K.WINDOW_BUCKETS}, false) AS aligned")


@plan
def alignment_check(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """K19 over the time matrix of every date, scope and window."""
    return check_alignment(time_matrix(spark, sf_dir, day=day), MD.frames_table(spark, sf_dir, day))
