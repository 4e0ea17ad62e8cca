"""Snapshot rollups and frame KPIs (SURVEY: E10-E12, E16-E18, S3, F4, B8, B24, B25, H21,
H22, D12).

Every (local date, bucket, scope) snapshot is computed in one pass instead of one query per
request; top-k lists are row_number windows partitioned by snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K
from ..functions import clock
from ..functions import measures as M
from ..functions.numeric import E, mean_rounded, rnd
from . import medallion as MD
from .dashboard import scoped
from .memo import plan

SNAP = ["reading_date", "scope", "bucket_idx"]


def _frames(spark, sf_dir, day=None) -> DataFrame:
    return scoped(MD.frames_table(spark, sf_dir, day))


@plan
def snapshot_network(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """The twelve network measures of every snapshot."""
    return _frames(spark, sf_dir, day).groupBy(*SNAP).agg(
        E("CAST(count(1) AS INT)").alias("station_count"),
        E(mean_rounded("avg_speed_mph", 1, 1)).alias("mean_speed_mph"),
        E("min(min_speed_mph)").alias("min_speed_mph"),
        E(mean_rounded("free_flow_speed_mph", 1, 1)).alias("mean_free_flow_mph"),
        E(mean_rounded("vc_ratio", 4, 3)).alias("mean_vc"),
        E(rnd("max(vc_ratio)", 2)).alias("max_vc"),
        E("CAST(count_if(vc_ratio > 1) AS INT)").alias("stations_over_capacity"),
        E("CAST(count_if(is_congested) AS INT)").alias("stations_congested"),
        E("CAST(count_if(incident_active) AS INT)").alias("stations_with_incident"),
        E("CAST(sum(avg_flow_vph) AS BIGINT)").alias("total_served_flow_vph"),
        E("CAST(sum(avg_demanded_flow_vph) AS BIGINT)").alias("total_demanded_flow_vph"),
        E(mean_rounded("delay_vs_freeflow_min_per_mi", 4, 3)).alias("mean_delay_min_per_mi"))


@plan
def snapshot_corridors(spark: SparkSession, sf_dir: str, limit: int = K.WORST_CORRIDOR_LIMIT, day: str | None = None) -> DataFrame:
    """E11 + F4: per snapshot the ``limit`` worst corridor-directions by mean delay."""
    g = _frames(spark, sf_dir, day).groupBy(*SNAP, "freeway", "direction").agg(
        E("CAST(count(1) AS INT)").alias("station_count"),
        E(mean_rounded("avg_speed_mph", 1, 1)).alias("mean_speed_mph"),
        E(mean_rounded("free_flow_speed_mph", 1, 1)).alias("free_flow_mph"),
        E(mean_rounded("vc_ratio", 4, 2)).alias("mean_vc"),
        E(rnd("max(vc_ratio)", 2)).alias("max_vc"),
        E("CAST(count_if(vc_ratio > 1) AS INT)").alias("stations_over_capacity"),
        E(mean_rounded("delay_vs_freeflow_min_per_mi", 4, 3)).alias("mean_delay_min_per_mi"),
        E("CAST(count_if(incident_active) AS INT)").alias("incident_count"),
        E("CAST(COALESCE(max(lanes_blocked), 0) AS INT)").alias("max_lanes_blocked"),
        E("CAST(sum(avg_demanded_flow_vph) AS BIGINT)").alias("demanded_flow_vph"),
        E("CAST(sum(avg_flow_vph) AS BIGINT)").alias("served_flow_vph"))
    r = g.withColumn("rank", E("CAST(row_number() OVER (PARTITION BY reading_date, scope, bucket_idx"
                               " ORDER BY mean_delay_min_per_mi DESC, freeway, direction) AS INT)"))
    return r.filter(f"rank <= {limit}")


@plan
def snapshot_los(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """Grade histogram and share of each snapshot."""
    g = _frames(spark, sf_dir, day).groupBy(*SNAP, "level_of_service").agg(E("CAST(count(1) AS INT)").alias("station_count"))
    return g.selectExpr(*SNAP, "level_of_service AS los", "station_count",
                        f"{rnd('1e2 * station_count / sum(station_count) OVER (PARTITION BY reading_date, scope, bucket_idx)', 1)}"
                        " AS pct")


@plan
def snapshot_incidents(spark: SparkSession, sf_dir: str, limit: int = K.INCIDENT_LIMIT, day: str | None = None) -> DataFrame:
    """S3: the ``limit`` worst incident stations of each snapshot (severity, lanes blocked,
    v/c, all descending) with the true total beside the truncated list."""
    f = _frames(spark, sf_dir, day).filter("incident_active").selectExpr(
        *SNAP, "station_id", "freeway", "direction", f"{rnd('postmile', 1)} AS postmile",
        "CAST(COALESCE(max_incident_severity, 0) AS INT) AS severity",
        "CAST(COALESCE(lanes_blocked, 0) AS INT) AS lanes_blocked", "CAST(num_lanes AS INT) AS num_lanes",
        f"{rnd('avg_speed_mph', 1)} AS speed_mph", f"{rnd('vc_ratio', 2)} AS vc_ratio")
    w = "PARTITION BY reading_date, scope, bucket_idx"
    r = f.selectExpr("*", f"CAST(row_number() OVER ({w} ORDER BY severity DESC, lanes_blocked DESC, vc_ratio DESC,"
                          f" station_id) AS INT) AS rank", f"CAST(count(1) OVER ({w}) AS INT) AS incident_total")
    return r.filter(f"rank <= {limit}")


@plan
def frame_kpis(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """E16 + B8: live KPIs of each displayed frame: mean speed over observed stations,
    total flow, percent LOS E/F by the speed-and-v/c grade, over-capacity count,
    incidents, observed stations."""
    los = M.los_from_speed_vc("avg_speed_mph", "vc_ratio")
    g = _frames(spark, sf_dir, day).groupBy(*SNAP).agg(
        E("avg(avg_speed_mph)").alias("_ms"),
        E("CAST(sum(avg_flow_vph) AS BIGINT)").alias("total_flow"),
        E(f"count_if(avg_speed_mph IS NOT NULL AND {los} IN ('E', 'F'))").alias("_cong"),
        E("CAST(count_if(vc_ratio > 1) AS INT)").alias("over_capacity"),
        E("CAST(count_if(incident_active) AS INT)").alias("incidents"),
        E("CAST(count(avg_speed_mph) AS INT)").alias("observed"))
    return g.selectExpr(*SNAP, f"{rnd('COALESCE(_ms, 0e0)', 6)} AS mean_speed", "total_flow",
                        f"{rnd('CASE WHEN observed > 0 THEN 1e2 * _cong / observed ELSE 0e0 END', 6)} AS pct_congested",
                        "over_capacity", "incidents", "observed")


@plan
def frame_worst_corridors(spark: SparkSession, sf_dir: str, limit: int = K.FRAME_WORST_CORRIDORS, day: str | None = None) -> DataFrame:
    """E18 + F4: per frame and freeway: mean speed, total flow, percent LOS E/F; the
    ``limit`` slowest freeways of each frame."""
    los = M.los_from_speed_vc("avg_speed_mph", "vc_ratio")
    f = MD.frames_table(spark, sf_dir, day)
    g = f.groupBy("reading_date", "bucket_idx", "freeway").agg(
        E("avg(avg_speed_mph)").alias("_ms"), E("CAST(sum(avg_flow_vph) AS BIGINT)").alias("total_flow"),
        E(f"count_if(avg_speed_mph IS NOT NULL AND {los} IN ('E', 'F'))").alias("_c"),
        E("count(avg_speed_mph)").alias("_n"))
    r = g.selectExpr("reading_date", "bucket_idx", "freeway", f"{rnd('COALESCE(_ms, 0e0)', 6)} AS mean_speed",
                     "total_flow", f"{rnd('CASE WHEN _n > 0 THEN 1e2 * _c / _n ELSE 0e0 END', 6)} AS congested_pct")
    r = r.withColumn("rank", E("CAST(row_number() OVER (PARTITION BY reading_date, bucket_idx ORDER BY mean_speed,"
                               " freeway) AS INT)"))
    return r.filter(f"rank <= {limit}")


@plan
def frame_interpolation_day(spark: SparkSession, sf_dir: str, steps: int = 3, day: str | None = None) -> DataFrame:
    """B24 over every bucket: ``steps`` sub-frames for each of the 96 buckets of a station's
    day, with or without a frame. Speed, flow and v/c are linear towards the next bucket
    (which wraps within the day); where one side is missing the other one's value holds.
    Incident from the nearer bucket, 0 without a frame."""
    f = MD.frames_table(spark, sf_dir, day).selectExpr(
        "station_id", "reading_date", "bucket_idx", "struct(avg_speed_mph AS s, CAST(avg_flow_vph AS DOUBLE) AS q, vc_ratio AS v,"
        " CAST(CASE WHEN incident_active THEN COALESCE(max_incident_severity, 1) ELSE 0 END AS INT) AS inc) AS c")
    last = K.BUCKETS_PER_DAY - 1
    grid = f.select("station_id", "reading_date").distinct().withColumn("bucket_idx", E(f"explode(sequence(0, {last}))"))
    w = "OVER (PARTITION BY station_id, reading_date ORDER BY bucket_idx)"
    j = grid.join(f, ["station_id", "reading_date", "bucket_idx"], "left").selectExpr(
        "*", f"CASE WHEN bucket_idx = {last} THEN first_value(c) {w} ELSE lead(c) {w} END AS n").selectExpr(
        "*", f"explode(sequence(0, {steps - 1})) AS step")
    t = f"(step / {float(steps)!r}e0)"
    blend = lambda x: rnd_expr(f"COALESCE(c.{x} + (n.{x} - c.{x}) * {t}, c.{x}, n.{x})")
    return j.selectExpr("station_id", "reading_date", "bucket_idx", "step", f"{blend('s')} AS speed_mph",
                        f"{blend('q')} AS flow_vph", f"{blend('v')} AS vc_ratio",
                        f"COALESCE(CASE WHEN {t} >= 5e-1 THEN n.inc ELSE c.inc END, 0) AS incident")


def rnd_expr(x: str) -> str:
    return rnd(x, 6)


@plan
def snapshot_brief(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """A plain-text brief of every quarter of an hour of every date and scope: when and where, the
    sums and means of all stations, grades, slowest roads, incidents. A quarter without any reading
    says only that, so that a reader does not fill the gap."""
    grades = snapshot_los(spark, sf_dir, day=day).groupBy(*SNAP).agg(E(
        "array_join(transform(array_sort(collect_list(struct(los, station_count, pct))),"
        " x -> format_string('%s %d (%.1f %%)', x.los, x.station_count, x.pct)), ', ')").alias("grades"))
    roads = snapshot_corridors(spark, sf_dir, day=day).groupBy(*SNAP).agg(
        E("count(1)").alias("n_roads"),
        E("array_join(transform(array_sort(collect_list(struct(rank, freeway, direction, mean_speed_mph, free_flow_mph,"
          " mean_delay_min_per_mi, mean_vc, stations_over_capacity, station_count, incident_count, demanded_flow_vph,"
          " served_flow_vph))), x -> concat(format_string('%d. %s %s, %.1f of %.1f mph, %.3f min per mile late, load %.2f,"
          " %d of %d stations overfull, %d with an incident', x.rank, x.freeway, x.direction, x.mean_speed_mph, x.free_flow_mph,"
          " x.mean_delay_min_per_mi, x.mean_vc, x.stations_over_capacity, x.station_count, x.incident_count),"
          " CASE WHEN x.demanded_flow_vph > x.served_flow_vph THEN format_string(', %d veh/h turned away',"
          " x.demanded_flow_vph - x.served_flow_vph) ELSE '' END)), '\n')").alias("roads"))
    events = snapshot_incidents(spark, sf_dir, day=day).groupBy(*SNAP).agg(
        E("max(incident_total)").alias("n_events"), E("count(1)").alias("n_listed"),
        E("array_join(transform(array_sort(collect_list(struct(rank, freeway, direction, postmile, severity, lanes_blocked,"
          " num_lanes, speed_mph, station_id))), x -> format_string('%d. %s, %s %s mile %.1f, severity %d, %d/%d lanes shut, %.1f mph',"
          " x.rank, x.station_id, x.freeway, x.direction, x.postmile, x.severity, x.lanes_blocked, x.num_lanes, x.speed_mph)), '\n')").alias("events"))
    net = snapshot_network(spark, sf_dir, day=day)
    every = net.select("reading_date", "scope").distinct().withColumn("bucket_idx", E(f"explode(sequence(0, {K.BUCKETS_PER_DAY - 1}))"))
    j = every.join(net, SNAP, "left").join(grades, SNAP, "left").join(roads, SNAP, "left").join(events, SNAP, "left")
    where = "CASE WHEN scope = 'ALL' THEN 'all freeways' ELSE concat('freeway ', scope) END"
    head = (f"format_string('Traffic of %s at %s (%s), %s', CAST(reading_date AS STRING), {clock.bucket_label('bucket_idx')},"
            f" {clock.period_label(clock.bucket_hour('bucket_idx'))}, {where}), 'One quarter of an hour, not a trend.'")
    away = ("CASE WHEN total_demanded_flow_vph > total_served_flow_vph THEN format_string('turned away: %d veh/h (%.1f %% of demand)',"
            " total_demanded_flow_vph - total_served_flow_vph, 1e2 * (total_demanded_flow_vph - total_served_flow_vph) / total_demanded_flow_vph) END")
    seen = ("format_string('stations: %d, overfull %d, congested %d, with an incident %d', station_count, stations_over_capacity,"
            " stations_congested, stations_with_incident),"
            " format_string('speed: %.1f mph where %.1f is free, slowest station %.1f', mean_speed_mph, mean_free_flow_mph, min_speed_mph),"
            " format_string('lateness: %.3f min per mile; load: %.3f, at most %.2f', mean_delay_min_per_mi, mean_vc, max_vc),"
            f" format_string('flow: %d veh/h wanted, %d carried', total_demanded_flow_vph, total_served_flow_vph), {away},"
            " concat('grades from A (free) to F (breakdown): ', grades), format_string('slowest roads (%d):', n_roads), roads,"
            " CASE WHEN n_events IS NULL THEN 'incidents: none' WHEN n_listed < n_events THEN"
            " format_string('incidents: %d, here the worst %d', n_events, n_listed) ELSE format_string('incidents: all %d', n_events) END, events")
    return j.selectExpr(*SNAP, f"concat_ws('\n', {head}, CASE WHEN station_count IS NULL THEN 'No readings: nothing is known of it.'"
                               f" ELSE concat_ws('\n', {seen}) END) AS brief")


@plan
def snapshot_json(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """The snapshot as JSON: network measures, grade shares, worst corridors."""
    net = snapshot_network(spark, sf_dir, day=day)
    los = snapshot_los(spark, sf_dir, day=day).groupBy(*SNAP).agg(
        E("array_sort(collect_list(struct(los, station_count, pct)))").alias("los"))
    cor = snapshot_corridors(spark, sf_dir, day=day).groupBy(*SNAP).agg(
        E("transform(array_sort(collect_list(struct(rank, freeway, direction, mean_speed_mph, mean_delay_min_per_mi))),"
          " x -> struct(x.freeway AS freeway, x.direction AS direction, x.mean_speed_mph AS mean_speed_mph,"
          " x.mean_delay_min_per_mi AS mean_delay_min_per_mi))").alias("worst_corridors"))
    j = net.join(los, SNAP, "left").join(cor, SNAP, "left")
    return j.selectExpr(*SNAP, "to_json(struct(station_count, mean_speed_mph, min_speed_mph, mean_free_flow_mph,"
                               " mean_vc, max_vc, stations_over_capacity, stations_congested, stations_with_incident,"
                               " total_served_flow_vph, total_demanded_flow_vph, mean_delay_min_per_mi, los,"
                               " worst_corridors)) AS kpi_json")
