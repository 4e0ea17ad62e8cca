"""Sources and the derived input tables.

The driver's parquet tables are TPC-H shaped. The derived tables below give them the
shapes of the traffic model (detectors, incident windows, 5-minute readings, scenario
levers, polyline vertices, model responses). Each is a projection / join over the base
tables, so its size grows with the data and every filter and column list reaches the
parquet scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K
from ..functions import clock
from ..functions import measures as M
from ..functions.numeric import E
from ..plans.memo import plan

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Local (Pacific) midnight of fixture day 0: a Saturday, so day 0-1 are a weekend and
# day 2 a Monday.
FIXTURE_START_LOCAL = _dt.datetime(2026, 6, 6, 0, 0, 0)
FIXTURE_START_DATE = _dt.date(2026, 6, 6)


_READERS: dict[tuple[str, str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A1: scan one table, keeping only ``columns`` (pruned in the parquet reader).

    The unresolved reader is kept per (session, folder, table) so file listing and footer
    schema inference happen once per session rather than once per use in a plan; it holds
    no data."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    df = _READERS.get(key)
    if df is None:
        df = _READERS[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def day_range(spark: SparkSession, n: int, name: str = "day_offset") -> DataFrame:
    """A3: integer range source 0..n-1."""
    return spark.range(0, n).withColumnRenamed("id", name)


@plan
def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector dimension: one station per supplier. Positions repeat in blocks of 10,000
    suppliers inside the bounding box; every block has five freeways of its own, so the
    number of freeways grows with the table and no carriageway is longer than 600 miles."""
    return read_table(spark, sf_dir, "supplier", ["s_suppkey"]).selectExpr(
        "s_suppkey AS station_num",
        "concat('ST', CAST(s_suppkey AS STRING)) AS station_id",
        "concat('F', CAST(s_suppkey % 5 + 5 * CAST(FLOOR(s_suppkey / 10000) AS BIGINT) AS STRING)) AS freeway",
        "CASE WHEN CAST(FLOOR(s_suppkey / 5) AS BIGINT) % 2 = 0 THEN 'N' ELSE 'S' END AS direction",
        "CAST(CAST(FLOOR(s_suppkey / 10) AS BIGINT) % 1000 AS DOUBLE) * 6e-1 + CAST(s_suppkey % 7 AS DOUBLE) * 1e-2 AS postmile",
        "34e0 + CAST(CAST(FLOOR(s_suppkey / 10) AS BIGINT) % 1000 AS DOUBLE) * 8e-3 AS latitude",
        "-118e0 + CAST(s_suppkey % 5 AS DOUBLE) * 3e-2 + CAST(CAST(FLOOR(s_suppkey / 10) AS BIGINT) % 1000 AS DOUBLE) * 2e-3"
        " - CAST(CAST(FLOOR(s_suppkey / 10000) AS BIGINT) % 300 AS DOUBLE) * 2e-2 AS longitude",
        "CAST(2 + s_suppkey % 4 AS INT) AS num_lanes",
        "CAST(1950 + (s_suppkey * 37) % 151 AS INT) AS lane_capacity_vph",
        "CASE s_suppkey % 9 WHEN 0 THEN 'HV' WHEN 1 THEN 'OR' WHEN 2 THEN 'FR' ELSE 'ML' END AS station_type",
        "CAST((s_suppkey * 13) % 101 AS DOUBLE) / 1e2 AS urban_intensity",
        "CASE WHEN s_suppkey % 31 = 7 THEN 'dark' WHEN s_suppkey % 11 = 3 THEN 'degraded' ELSE 'healthy' END"
        " AS detector_health",
    )


@plan
def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident windows [start_slot, end_slot) in 5-minute slots of day ``day_no``.

    Every order is one; its priority sets the severity (urgent: 4). An end slot past 288 runs into the next day, as real incidents cross midnight."""
    st = stations(spark, sf_dir)
    n_sup = read_table(spark, sf_dir, "supplier", ["s_suppkey"]).selectExpr("count(1) AS n_sup")
    o = (read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"])
         .crossJoin(n_sup)   # one-row aggregate: a scalar, not a data cross product
         .selectExpr("*", "o_custkey % n_sup AS station_num"))
    j = o.join(st.select("station_num", "station_id", "freeway", "direction", "num_lanes"), "station_num")
    return j.selectExpr(
        "concat_ws('-', 'INC', station_id, CAST(o_custkey % 3 AS STRING), CAST(o_orderkey AS STRING)) AS incident_id",
        "station_id", "freeway", "direction", "num_lanes",
        "CAST(o_custkey % 3 AS INT) AS day_no",
        "CAST(o_orderkey % 288 AS INT) AS start_slot",
        "CAST(o_orderkey % 288 + 2 + o_custkey % 12 AS INT) AS end_slot",
        "CAST(GREATEST(1, 5 - CAST(substring(o_orderpriority, 1, 1) AS INT)) AS INT) AS severity",
        "CAST(LEAST(num_lanes - 1, 1 + o_orderkey % 2) AS INT) AS lanes_blocked",
    )


@plan
def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw 5-minute detector samples (one per lineitem) before the capacity model."""
    st = stations(spark, sf_dir)
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount"])
    j = li.join(st.withColumnRenamed("station_num", "l_suppkey"), "l_suppkey")
    cap = M.base_capacity("num_lanes", "lane_capacity_vph", M.station_type_scale("station_type"))
    return j.selectExpr(
        "station_id", "l_orderkey AS src_order", "l_linenumber AS src_line",
        "CAST(l_partkey % 3 AS INT) AS day_no",
        "CAST((l_orderkey * 7 + l_linenumber) % 288 AS INT) AS slot5",
        "CAST(((l_orderkey * 7 + l_linenumber) % 288) DIV 3 AS INT) AS bucket_idx",
        f"{cap} AS base_capacity_vph",
        f"CAST(FLOOR({cap} * (2e-1 + l_quantity / 45e0) + 5e-1) AS INT) AS demanded_flow_vph",
        "7e1 - 5e0 * urban_intensity AS free_flow_speed_mph",
        "1e0 + 5e-1 * (l_discount - 5e-2) AS speed_jitter",
        "CASE detector_health WHEN 'dark' THEN 0e0 WHEN 'degraded' THEN 35e0 + 4e0 * CAST(l_linenumber AS DOUBLE)"
        " ELSE 96e0 + 4e1 * l_discount END AS observed_pct",
    )


#: Levers of the named scenarios, one each (A2). ``amount`` is lanes closed, demand percent, lanes
#: blocked or lanes added; ``scale`` multiplies capacity; ``absolute_vph`` > 0 overrides it.
NAMED_LEVERS = [
    ("noop", 0, "none", "", "", 0.0, 0.0, 0, 95, 0.0, 1.0, -1.0, 0),
    ("closure", 0, "closure", "F1", "N", 0.0, 3.0, 0, 95, 1.0, 1.0, -1.0, 0),
    ("demand", 0, "demand", "ALL", "", 0.0, 0.0, 0, 95, 20.0, 1.0, -1.0, 0),
    ("incident", 0, "incident", "F2", "", 0.0, 5.0, 30, 40, 1.0, 1.0, -1.0, 3),
    ("capacity", 0, "capacity", "F3", "S", 0.0, 9.0, 0, 95, 1.0, 1.1, -1.0, 0),
]
LEVER_SCHEMA = ("scenario_id string, lever_no int, kind string, freeway string, direction string, pm_from double, pm_to double,"
                " bucket_from int, bucket_to int, amount double, scale double, absolute_vph double, severity int")


@plan
def levers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario levers, one row per lever in the order ``lever_no``: the named ones, and a
    scenario per region whose nations are levers of two kinds each, so that kinds stack. Regions
    differ in what folds: same road, several roads (demand widens), both directions (refused)."""
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    kind = "element_at(array('closure', 'demand', 'incident', 'capacity'), CAST((n_regionkey + n_nationkey % 2) % 4 + 1 AS INT))"
    stacked = n.withColumn("kind", E(kind)).selectExpr(
        "concat('region-', CAST(n_regionkey AS STRING)) AS scenario_id", "CAST(n_nationkey AS INT) AS lever_no", "kind",
        "concat('F', CAST(CASE WHEN kind = 'demand' AND n_regionkey % 2 = 1 THEN n_nationkey % 5 ELSE n_regionkey END AS STRING)) AS freeway",
        "CASE WHEN n_regionkey = 4 AND n_nationkey % 4 = 2 THEN 'S' ELSE 'N' END AS direction",
        "CAST(n_nationkey % 9 AS DOUBLE) * 6e-1 AS pm_from", "CAST(n_nationkey % 9 AS DOUBLE) * 6e-1 AS pm_to",
        "CAST(n_nationkey * 4 - 8 AS INT) AS bucket_from", "CAST(n_nationkey * 4 + 27 AS INT) AS bucket_to",
        "CASE WHEN kind <> 'demand' THEN CAST(1 + n_nationkey % 2 + n_nationkey % 3 AS DOUBLE) ELSE"
        " element_at(array(-20e0, 10e0, 25e0, 5e0), CAST(n_nationkey % 4 + 1 AS INT)) END AS amount",
        "1e0 AS scale", "CASE WHEN kind = 'capacity' THEN CAST(3000 + 100 * n_nationkey AS DOUBLE) ELSE -1e0 END AS absolute_vph",
        "CAST(CASE WHEN kind = 'incident' THEN 1 + n_nationkey % 4 ELSE 0 END AS INT) AS severity")
    return spark.createDataFrame(NAMED_LEVERS, LEVER_SCHEMA).unionByName(stacked)


@plan
def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corridor polyline vertices (freeway, seq, lat, lon, urban, city, district, county)."""
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"]).withColumnRenamed("r_regionkey", "n_regionkey")
    return n.join(r, "n_regionkey", "left").selectExpr(
        "concat('F', CAST(n_nationkey % 5 AS STRING)) AS freeway",
        "CAST(n_nationkey DIV 5 AS INT) AS seq",
        "34e0 + CAST(n_nationkey DIV 5 AS DOUBLE) * 2e-1 AS lat",
        "-118e0 + CAST(n_nationkey % 5 AS DOUBLE) * 3e-2 AS lon",
        "CAST((n_nationkey * 17) % 101 AS DOUBLE) / 1e2 AS urban",
        "n_name AS city", "CAST(n_regionkey + 1 AS INT) AS district", "r_name AS county",
    )


@plan
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with an appended advice block, some of them malformed."""
    c = read_table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.selectExpr(
        "conv_id", "turn", "role", "CAST((conv_id * 7 + turn * 13) % 96 AS INT) AS bucket_idx",
        "concat(text, chr(10), '[advice]', chr(10), '[{\"action\":\"',"
        " CASE conv_id % 3 WHEN 0 THEN 'Ramp Metering' WHEN 1 THEN 'shoulder-running' ELSE 'unknown thing' END,"
        " '\",\"target\":\"', CASE turn % 2 WHEN 0 THEN 'I-405 S' ELSE 'US-101 northbound' END,"
        " '\",\"magnitude\":\"', CAST(turn AS STRING), '\",\"lanes\":', CAST(turn % 4 AS STRING), '}',"
        " CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN ',]' ELSE ']' END,"
        " CASE conv_id % 4 WHEN 0 THEN '' ELSE concat(chr(10), '[/advice]') END) AS response",
    )


@plan
def advice_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario runs built from an advice: (conv_id, turn of the advice). A user's turn answers
    the advice before it; every third one is a run."""
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role"]).filter("role = 'user' AND (conv_id + turn) % 3 = 0")
    return c.selectExpr("conv_id", "turn - 1 AS turn").distinct()


def slot_local_ts(abs_slot: str) -> str:
    """Local wall-clock time of an absolute 5-minute slot counted from fixture day 0."""
    return clock.add_minutes(f"TIMESTAMP_NTZ '{FIXTURE_START_LOCAL:%Y-%m-%d %H:%M:%S}'",
                             f"({abs_slot}) * {K.INTERVAL_MINUTES}")


def events(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return read_table(spark, sf_dir, "events", columns)
