"""Scenario levers (SURVEY: A2, D13, K16): the lever table, its fold to one lever per scenario and
kind with typed warnings, and the match of folded levers to stations.

A scenario may stack several levers of a kind; the engine applies one per kind. The fold takes
levers in their order: closures and incidents widen to the hull of their postmiles and keep the
most lanes, demand changes multiply, the last capacity wins. What the fold changes or cannot
express becomes a warning row; a kind spread over carriageways refuses its scenario.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import E, lit, rnd_signed
from ..sources import tables as S
from .memo import plan

KINDS = ("closure", "demand", "incident", "capacity")
LAST_BUCKET = K.BUCKETS_PER_DAY - 1


@plan
def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (scenario, kind). Bucket windows are cut to the day; a demand change of
    nothing and the kind 'none' stay as rows that match no station."""
    return fold(S.levers(spark, sf_dir))


@plan
def folded_levers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded levers as a report, amounts rounded."""
    return folded(spark, sf_dir).drop("widened", "last_bucket", "cancelled").withColumn("amount", E(rnd_signed("amount", 6)))


def fold(levers: DataFrame) -> DataFrame:
    pad = lit(K.LEVER_PM_PAD_MI)
    g = levers.groupBy("scenario_id", "kind").agg(
        E("CAST(count(1) AS INT) AS levers"),
        E("count(DISTINCT freeway, direction) AS carriageways"),
        E("min_by(freeway, lever_no) AS first_freeway"), E("min_by(direction, lever_no) AS first_direction"),
        E(f"min(pm_from) - {pad} AS pm_from"), E(f"max(pm_to) + {pad} AS pm_to"),
        E("GREATEST(0, min(bucket_from)) AS bucket_from"), E("max(bucket_to) AS last_bucket"),
        E("max(amount) AS most"), E("max(severity) AS severity"), E("max_by(amount, lever_no) AS last_amount"),
        E("max_by(scale, lever_no) AS scale"), E("max_by(absolute_vph, lever_no) AS absolute_vph"),
        # the order of the product is that of the levers
        E("array_sort(collect_list(struct(lever_no, amount))) AS changes"))
    product = "(aggregate(changes, 1e0, (acc, c) -> acc * (1e0 + c.amount / 1e2)) - 1e0) * 1e2"
    g = g.selectExpr("*", f"CASE WHEN kind <> 'demand' THEN NULL WHEN levers = 1 THEN most ELSE {product} END AS percent",
                     "kind = 'demand' AND carriageways > 1 AS widened",
                     "kind IN ('closure', 'incident', 'capacity') AND carriageways > 1 AS refused")
    g = g.selectExpr(
        "scenario_id", "kind", "levers",
        "CASE WHEN widened THEN 'ALL' ELSE first_freeway END AS freeway",
        "CASE WHEN widened THEN '' ELSE first_direction END AS direction",
        *[f"CASE WHEN kind IN ('closure', 'incident', 'capacity') THEN {c} END AS {c}" for c in ("pm_from", "pm_to")],
        "CASE WHEN kind = 'incident' THEN bucket_from END AS bucket_from",
        f"CASE WHEN kind = 'incident' THEN LEAST({LAST_BUCKET}, last_bucket) END AS bucket_to",
        "CASE kind WHEN 'demand' THEN percent WHEN 'capacity' THEN last_amount WHEN 'none' THEN NULL ELSE most END AS amount",
        "CASE WHEN kind = 'capacity' THEN scale END AS scale",
        "CASE WHEN kind = 'capacity' AND absolute_vph > 0 THEN absolute_vph END AS absolute_vph",
        "CASE WHEN kind = 'incident' THEN severity END AS severity",
        "refused", "widened", "last_bucket",
        "COALESCE(ABS(percent) < 1e-9, false) AS cancelled")
    return g


@plan
def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, kind, rule, message) of everything the fold changed or refused."""
    return explain(folded(spark, sf_dir))


def explain(f: DataFrame) -> DataFrame:
    note = lambda when, rule, message: f"CASE WHEN {when} THEN named_struct('rule', '{rule}', 'message', {message}) END"
    notes = ", ".join([
        note("refused", "refused", "concat(kind, ' levers lie on several carriageways; run them as separate scenarios')"),
        note("kind IN ('closure', 'incident') AND levers > 1 AND NOT refused", "hull", "concat(levers, ' ', kind, ' levers became one stretch of road')"),
        note("kind = 'capacity' AND levers > 1 AND NOT refused", "last_wins", "concat('of ', levers, ' capacity levers the last one holds for the whole stretch')"),
        note("kind = 'demand' AND levers > 1", "product", "concat(levers, ' demand levers were multiplied')"),
        note("widened", "widened", "'demand levers of several corridors apply to all corridors'"),
        note("cancelled AND levers > 1", "cancelled", "'demand levers cancel each other; none is applied'"),
        note(f"kind = 'incident' AND last_bucket > {LAST_BUCKET} AND NOT refused", "cut_at_midnight",
             f"concat('the incident would last to bucket ', last_bucket, '; the day ends at {LAST_BUCKET}')"),
        note("kind = 'incident' AND NOT refused", "severity_unused", "'severity is kept as a label; the effect comes from the lanes blocked'"),
    ])
    return f.selectExpr("scenario_id", "kind", f"explode(array_compact(array({notes}))) AS w").selectExpr(
        "scenario_id", "kind", "w.rule AS rule", "w.message AS message")


def running(f: DataFrame) -> DataFrame:
    """The folded levers of scenarios that no kind refuses."""
    refused = f.where("refused").select("scenario_id").distinct()
    return f.join(refused, "scenario_id", "left_anti")


def touched_stations(f: DataFrame, runs: DataFrame, stations: DataFrame) -> DataFrame:
    """(run, station_num, the parameters of each kind, window) of every station that a
    lever reaches, once for each 24-bucket window of the day in which it does.

    Levers and stations meet by equality: a lever with postmiles has a key for each mile it
    covers, one without has the key of its whole freeway, and a station carries the four keys it
    can be met by (its freeway or ALL, its mile or the whole road)."""
    mile = "CAST(FLOOR({}) AS INT)"
    keys = f.join(runs, "scenario_id").where("kind <> 'none' AND NOT cancelled AND freeway <> ''").selectExpr(
        "*", f"explode(CASE WHEN pm_from IS NULL THEN array(-1000000) ELSE sequence({mile.format('pm_from')}, {mile.format('pm_to')}) END) AS mile")
    st = stations.selectExpr("station_num", "freeway AS own_freeway", "direction AS own_direction", "postmile", "explode(array(freeway, 'ALL')) AS freeway",
                             f"array({mile.format('postmile')}, -1000000) AS miles").withColumn("mile", F.explode("miles")).drop("miles")
    hit = st.join(keys, ["freeway", "mile"]).where(
        "(direction IS NULL OR direction = '' OR direction = own_direction) AND (pm_from IS NULL OR postmile BETWEEN pm_from AND pm_to)")
    of = lambda kind, col, name: E(f"max(CASE WHEN kind = '{kind}' THEN {col} END) AS {name}")
    per = hit.groupBy("run", "station_num").agg(
        of("closure", "amount", "c_lanes"), of("demand", "amount", "d_pct"), of("incident", "amount", "i_lanes"),
        of("incident", "bucket_from", "i_from"), of("incident", "bucket_to", "i_to"), of("capacity", "amount", "k_add"),
        of("capacity", "scale", "k_scale"), of("capacity", "absolute_vph", "k_abs"),
        E("bool_or(kind <> 'incident') AS all_day"))
    w = K.WINDOW_BUCKETS
    return per.withColumn("window", E(f"explode(CASE WHEN all_day THEN sequence(0, {LAST_BUCKET // w}) ELSE sequence(i_from DIV {w}, i_to DIV {w}) END)")).withColumn(
        "window", F.col("window").cast("int"))
