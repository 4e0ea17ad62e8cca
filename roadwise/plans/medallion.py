"""Medallion tables.

    stations -> stations_geo
    readings + incidents -> bronze_readings -> enriched -> frames, corridor_summary

Shuffles: the worst incident per (station, slot) is computed on the incident side (small)
and keyed by (station, 15-minute bucket), so the readings join it without fan-out, and the
frame rollup groups by the same (station_id, abs_bucket) keys: one hash shuffle of the
readings for join and rollup together. Station attributes are a dimension joined without
hints: the planner broadcasts it only while its size estimate is under
``spark.sql.autoBroadcastJoinThreshold``, and AQE re-checks the real size at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K
from ..functions import clock, geo
from ..functions import measures as M
from ..functions.numeric import E, add_cols, agg_exprs, exact_sum, mean_rounded, rnd
from ..operators.intervals import interval_join
from ..operators.quality import Rule, apply_rules
from ..sources import tables as S
from .memo import plan

CELL_RESOLUTIONS = (7, 8, 9)
INCIDENT_KEY_LANES = 100  # worst-incident key = lanes_blocked * 100 + severity

# A station, an incident and a sample must be identified; what cannot be true of one is dropped;
# what is only odd is counted. Bounds are the fixed values of ``constants``.
STATION_RULES = [
    Rule("identified", "station_id IS NOT NULL", "fail"),
    Rule("id_is_short", f"length(station_id) BETWEEN {K.STATION_ID_LENGTH[0]} AND {K.STATION_ID_LENGTH[1]}", "fail"),
    Rule("inside_the_state", f"latitude BETWEEN {K.CA_MIN_LAT} AND {K.CA_MAX_LAT} AND longitude BETWEEN {K.CA_MIN_LON} AND {K.CA_MAX_LON}"),
    Rule("has_a_direction", f"direction IN {K.COMPASS}"),
    Rule("lanes_possible", f"num_lanes BETWEEN 1 AND {K.MAX_LANES}"),
    Rule("lane_capacity_possible", f"lane_capacity_vph BETWEEN {K.LANE_CAPACITY_RANGE[0]} AND {K.LANE_CAPACITY_RANGE[1]}"),
    Rule("has_capacity", "baseline_capacity_vph > 0"),
    Rule("starts_after_mile_zero", "postmile >= 0", "warn"),
]

INCIDENT_RULES = [
    Rule("identified", "incident_id IS NOT NULL", "fail"),
    Rule("at_a_station", "station_id IS NOT NULL"),
    Rule("ends_after_start", "end_slot > start_slot"),
    Rule("severity_known", "severity BETWEEN 1 AND 4"),
    Rule("blocks_own_lanes", "lanes_blocked BETWEEN 0 AND num_lanes"),
    Rule("not_overlong", f"(end_slot - start_slot) * {K.INTERVAL_MINUTES} <= {K.LONG_INCIDENT_MIN}", "warn"),
]

_SPEED_POSSIBLE = f"avg_speed_mph > 0 AND avg_speed_mph <= {K.TOP_SPEED_MPH}"
_GRADED = f"level_of_service IN {K.LOS_GRADES}"

BRONZE_RULES = [
    Rule("placed_and_dated", "station_id IS NOT NULL AND ts IS NOT NULL", "fail"),
    Rule("flows_possible", f"demanded_flow_vph >= 0 AND total_flow_vph BETWEEN 0 AND {K.TOP_FLOW_VPH}"),
    Rule("serves_at_most_demand", "total_flow_vph <= demanded_flow_vph"),
    Rule("speed_possible", _SPEED_POSSIBLE),
    Rule("shares_are_shares", "avg_occupancy BETWEEN 0 AND 1 AND observed_pct BETWEEN 0 AND 100"),
    Rule("reports_own_lanes", "num_lanes_reporting BETWEEN 0 AND num_lanes"),
]

ENRICHED_RULES = [
    Rule("observed_enough", f"observed_pct >= {K.MIN_OBSERVED_PCT}"),
    Rule("load_not_negative", "vc_ratio >= 0"),
    Rule("graded", _GRADED),
    Rule("delay_not_negative", "delay_vs_freeflow_min_per_mi >= 0", "warn"),
    Rule("load_plausible", f"vc_ratio <= {K.HIGH_VC}", "warn"),
]

FRAME_RULES = [
    Rule("placed", "station_id IS NOT NULL", "fail"),
    Rule("speed_possible", _SPEED_POSSIBLE),
    Rule("flow_not_negative", "avg_flow_vph >= 0"),
    Rule("has_capacity", "baseline_capacity_vph > 0"),
]

CORRIDOR_RULES = [
    Rule("placed_and_dated", "freeway IS NOT NULL AND time_bucket IS NOT NULL", "fail"),
    Rule("has_stations", "station_count > 0"),
    Rule("speed_possible", _SPEED_POSSIBLE),
    Rule("has_capacity", "baseline_capacity_vph > 0"),
    Rule("graded", _GRADED),
    Rule("travel_not_negative", "vmt >= 0", "warn"),
]


def _exprs(d: dict[str, str]) -> dict:
    return {k: E(v) for k, v in d.items()}


# --- stations -------------------------------------------------------------------------

@plan
def stations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension with hexagon cells, WKT and the baseline lever columns."""
    out = S.stations(spark, sf_dir)
    for r in CELL_RESOLUTIONS:
        out = geo.with_hex_cell(out, "longitude", "latitude", r, f"cell_r{r}")
    out = geo.with_cell_parent(out, "cell_r7", 7, 5, "cell_r7_p5")
    out = add_cols(out, {"_q8": geo.cell_q("cell_r8"), "_r8": geo.cell_r("cell_r8")})
    cols = {f"cell_r{r}_str": geo.cell_string(f"cell_r{r}") for r in CELL_RESOLUTIONS}
    cols.update({
        "geom_wkt": geo.point_wkt("longitude", "latitude"),
        "cell_r8_boundary_wkt": geo.cell_boundary_wkt("_q8", "_r8", 8),
        "baseline_capacity_vph": M.base_capacity("num_lanes", "lane_capacity_vph"),
        "baseline_lanes": "num_lanes",
        "baseline_lane_capacity_vph": "lane_capacity_vph",
    })
    return add_cols(out, cols).drop("_q8", "_r8")


@plan
def stations_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The station dimension after its expectations."""
    return apply_rules(stations_raw(spark, sf_dir), STATION_RULES)


# --- bronze ---------------------------------------------------------------------------

def worst_incident_by_bucket(inc: DataFrame) -> DataFrame:
    """The worst active incident (most lanes blocked, then severity) of each 5-minute
    slot, as one row per (station_id, abs_bucket) with the bucket's three slots in columns
    k0, k1, k2 (NULL = no incident). Incidents are exploded into the slots they cover
    (bounded by their duration) and reduced here, on the small side, before any join."""
    slots = inc.selectExpr(
        "station_id", f"lanes_blocked * {INCIDENT_KEY_LANES} + severity AS k",
        f"explode(sequence(day_no * {K.SLOTS_PER_DAY} + start_slot,"
        f" day_no * {K.SLOTS_PER_DAY} + end_slot - 1)) AS abs_slot")
    return (slots.selectExpr("*", "CAST(abs_slot DIV 3 AS INT) AS abs_bucket")
                 .groupBy("station_id", "abs_bucket")
                 .agg(*[E(f"max(CASE WHEN abs_slot % 3 = {i} THEN k END)").alias(f"k{i}") for i in range(3)]))


@plan
def bronze_raw(spark: SparkSession, sf_dir: str, incidents: DataFrame | None = None) -> DataFrame:
    """Readings with the incident join, capacity chain, BPR speed, served flow,
    occupancy and detector-health columns (B11-B17, D2, H1, H6).

    The join key (station_id, abs_bucket) is also the key of the 15-minute rollup, so the
    readings are hash-shuffled once for join and rollup together."""
    st = S.stations(spark, sf_dir)
    rd = add_cols(S.readings(spark, sf_dir), {
        "abs_slot": f"day_no * {K.SLOTS_PER_DAY} + slot5",
        "abs_bucket": f"day_no * {K.BUCKETS_PER_DAY} + bucket_idx"})
    inc = apply_rules(S.incidents(spark, sf_dir), INCIDENT_RULES) if incidents is None else incidents
    j = (rd.join(worst_incident_by_bucket(inc), ["station_id", "abs_bucket"], "left")
           .join(st.select("station_id", "num_lanes"), "station_id"))
    j = j.withColumn("_k", E("CASE abs_slot % 3 WHEN 0 THEN k0 WHEN 1 THEN k1 ELSE k2 END"))
    j = add_cols(j, {
        "incident_active": "_k IS NOT NULL",
        "lanes_blocked": f"COALESCE(CAST(_k DIV {INCIDENT_KEY_LANES} AS INT), 0)",
        "incident_severity": f"COALESCE(CAST(_k % {INCIDENT_KEY_LANES} AS INT), 0)",
        "local_ts": S.slot_local_ts("abs_slot")})
    j = add_cols(j, {
        "ts": clock.local_to_utc("local_ts"),
        "effective_capacity_vph": M.effective_capacity("base_capacity_vph", "incident_active", "num_lanes",
                                                       "lanes_blocked")})
    j = add_cols(j, {
        "avg_speed_mph": M.jittered_speed(
            M.bpr_speed("free_flow_speed_mph", "demanded_flow_vph / GREATEST(1e0, effective_capacity_vph)"),
            "speed_jitter"),
        "total_flow_vph": M.served_flow("demanded_flow_vph", "effective_capacity_vph"),
        "num_lanes_reporting": M.lanes_reporting("num_lanes", "observed_pct")})
    j = j.withColumn("avg_occupancy", E(rnd(M.occupancy("total_flow_vph", "avg_speed_mph", "num_lanes"), 4)))
    out = j.select(
        "station_id", "src_order", "src_line", "day_no", "slot5", "abs_slot", "abs_bucket", "bucket_idx",
        "ts", "local_ts", "demanded_flow_vph", "total_flow_vph", "avg_occupancy", "avg_speed_mph",
        "observed_pct", "num_lanes_reporting", "num_lanes", "base_capacity_vph", "effective_capacity_vph",
        "free_flow_speed_mph", "incident_active", "lanes_blocked", "incident_severity")
    return out


@plan
def bronze_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze readings after their expectations."""
    return apply_rules(bronze_raw(spark, sf_dir), BRONZE_RULES)


@plan
def incident_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 literal mode: every (reading, incident) pair whose window covers the reading,
    readings without one kept once (left join; overlapping incidents fan out)."""
    st = S.stations(spark, sf_dir)
    rd = S.readings(spark, sf_dir).selectExpr(
        "station_id", "src_order", "src_line", f"day_no * {K.SLOTS_PER_DAY} + slot5 AS abs_slot")
    inc = S.incidents(spark, sf_dir).selectExpr(
        "station_id", "incident_id", "severity AS incident_severity", "lanes_blocked",
        f"day_no * {K.SLOTS_PER_DAY} + start_slot AS inc_start", f"day_no * {K.SLOTS_PER_DAY} + end_slot AS inc_end")
    j = interval_join(rd, inc, ["station_id"], "abs_slot", "inc_start", "inc_end", width=12)
    return j.select("station_id", "src_order", "src_line", "abs_slot", "incident_id", "incident_severity",
                    "lanes_blocked")


# --- silver ---------------------------------------------------------------------------

def enriched_of(bronze: DataFrame, stations: DataFrame) -> DataFrame:
    """Readings with v/c, grade, delay, congestion flag and local calendar (B7-B10, B15,
    B18, B26, H1-H5)."""
    st = stations.select(
        "station_id", "freeway", "direction", "postmile", "latitude", "longitude", "station_type",
        "urban_intensity", "cell_r7", "cell_r8", "baseline_capacity_vph", "baseline_lanes",
        "baseline_lane_capacity_vph")
    d = add_cols(bronze.join(st, "station_id"), {
        "vc_ratio": M.vc_ratio("demanded_flow_vph", "effective_capacity_vph"),
        "served_vc_ratio": M.vc_ratio("total_flow_vph", "effective_capacity_vph"),
        "delay_vs_freeflow_min_per_mi": rnd(M.delay_min_per_mi("avg_speed_mph", "free_flow_speed_mph"), 4),
        "is_congested": M.is_congested("avg_speed_mph", "free_flow_speed_mph"),
        "speed_ratio": M.speed_ratio("avg_speed_mph", "free_flow_speed_mph"),
        "reading_date": clock.reading_date("local_ts"),
        "hour_of_day": "hour(local_ts)",
        "day_of_week": clock.day_of_week("local_ts"),
        "time_bucket": clock.floor_to_minutes("ts")})
    d = add_cols(d, {
        "level_of_service": M.level_of_service("vc_ratio"),
        "is_weekend": clock.is_weekend("day_of_week"),
        "peak_period": clock.peak_period("day_of_week", "hour_of_day")})
    return d


@plan
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched readings after their expectations."""
    return apply_rules(enriched_of(bronze_readings(spark, sf_dir), stations_geo(spark, sf_dir)), ENRICHED_RULES)


# --- gold -----------------------------------------------------------------------------

FRAME_AGGS = {
    "avg_demanded_flow_vph": f"CAST({mean_rounded('demanded_flow_vph', 0, 0)} AS INT)",
    "peak_demanded_flow_vph": "max(demanded_flow_vph)",
    "avg_flow_vph": f"CAST({mean_rounded('total_flow_vph', 0, 0)} AS INT)",
    "peak_flow_vph": "max(total_flow_vph)",
    "avg_speed_mph": mean_rounded("avg_speed_mph", 1, 1),
    "min_speed_mph": "min(avg_speed_mph)",
    "avg_occupancy": mean_rounded("avg_occupancy", 4, 4),
    "vc_ratio": mean_rounded("vc_ratio", 4, 4),
    "max_vc_ratio": "max(vc_ratio)",
    "served_vc_ratio": mean_rounded("served_vc_ratio", 4, 4),
    "max_served_vc_ratio": "max(served_vc_ratio)",
    "delay_vs_freeflow_min_per_mi": mean_rounded("delay_vs_freeflow_min_per_mi", 4, 4),
    "free_flow_speed_mph": mean_rounded("free_flow_speed_mph", 2, 1),
    "observed_pct": mean_rounded("observed_pct", 1, 1),
    "is_congested": "bool_or(is_congested)",
    "incident_active": "bool_or(incident_active)",
    "max_incident_severity": "max(incident_severity)",
    "lanes_blocked": "max(lanes_blocked)",
    "num_lanes": "max(num_lanes)",
    "sample_count": "count(1)",
}


def _bucket_calendar(prefix_cols: dict | None = None) -> dict[str, str]:
    lb = S.slot_local_ts("abs_bucket * 3")
    cols = {
        "day_no": f"CAST(abs_bucket DIV {K.BUCKETS_PER_DAY} AS INT)",
        "bucket_idx": clock.bucket_idx(lb),
        "time_bucket": clock.local_to_utc(lb),
        "reading_date": clock.reading_date(lb),
        "hour_of_day": f"hour({lb})",
        "day_of_week": clock.day_of_week(lb),
    }
    cols.update(prefix_cols or {})
    return cols


def frames_of(e: DataFrame, stations: DataFrame) -> DataFrame:
    """One row per station and local 15-minute bucket; grade recomputed from the
    bucket-mean v/c (E6); congestion index (B18); calendar from the local bucket (H3, H5)."""
    agg = e.groupBy("station_id", "abs_bucket").agg(*agg_exprs(FRAME_AGGS))
    st = stations.select(
        "station_id", "freeway", "direction", "postmile", "latitude", "longitude", "station_type",
        "cell_r7", "cell_r8", "cell_r8_str", "cell_r9", "baseline_capacity_vph", "baseline_lanes",
        "baseline_lane_capacity_vph", "geom_wkt")
    f = add_cols(agg.join(st, "station_id"), _bucket_calendar({
        "level_of_service": M.level_of_service("vc_ratio"),
        "congestion_index": M.congestion_index("avg_speed_mph", "free_flow_speed_mph")}))
    return f.withColumn("is_weekend", E(clock.is_weekend("day_of_week")))


@plan
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station frames from the raw tables, after their expectations."""
    return apply_rules(frames_of(enriched(spark, sf_dir), stations_geo(spark, sf_dir)), FRAME_RULES)


def corridors_of(e: DataFrame, sample_minutes: int = K.INTERVAL_MINUTES, stored: bool = False) -> DataFrame:
    """(freeway, direction, local 15-minute bucket) rollup with VMT, VHT and delay
    hours (B19, E5, E6, E7). VMT counts each 5-minute sample as ``sample_minutes``/60
    hours of flow (T3: the bucket width would count a full bucket three times);
    ``sample_minutes=15`` gives that literal reading. Distinct stations make the planner shuffle every sum
    by station, too; of a ``stored`` table they are counted by a second, narrow scan."""
    aggs = {
        "station_count": "count(DISTINCT station_id)",
        "avg_demanded_flow_vph": f"CAST({mean_rounded('demanded_flow_vph', 0, 0)} AS INT)",
        "sum_demanded_flow_vph": "sum(demanded_flow_vph)",
        "avg_flow_vph": f"CAST({mean_rounded('total_flow_vph', 0, 0)} AS INT)",
        "sum_flow_vph": "sum(total_flow_vph)",
        "avg_speed_mph": mean_rounded("avg_speed_mph", 1, 1),
        "min_speed_mph": "min(avg_speed_mph)",
        "avg_occupancy": mean_rounded("avg_occupancy", 4, 4),
        "vc_ratio": mean_rounded("vc_ratio", 4, 4),
        "max_vc_ratio": "max(vc_ratio)",
        "served_vc_ratio": mean_rounded("served_vc_ratio", 4, 4),
        "max_served_vc_ratio": "max(served_vc_ratio)",
        "baseline_capacity_vph": "sum(baseline_capacity_vph)",
        "baseline_lane_count": "CAST(sum(baseline_lanes) AS BIGINT)",
        "baseline_lane_capacity_vph": mean_rounded("baseline_lane_capacity_vph", 0, 1),
        "effective_capacity_vph": rnd(exact_sum("effective_capacity_vph", 6), 1),
        "free_flow_speed_mph": mean_rounded("free_flow_speed_mph", 2, 1),
        "avg_delay_min_per_mi": mean_rounded("delay_vs_freeflow_min_per_mi", 4, 4),
        "congested_station_samples": "count_if(is_congested)",
        "sample_count": "count(1)",
        "incident_samples": "count_if(incident_active)",
        "max_incident_severity": "max(incident_severity)",
        "min_postmile": "min(postmile)",
        "max_postmile": "max(postmile)",
    }
    keys = ["freeway", "direction", "abs_bucket"]
    if stored:
        count = e.select(*keys, "station_id").distinct().groupBy(*keys).agg(E(aggs.pop("station_count").replace("DISTINCT ", "") + " AS station_count"))
        count = count.selectExpr(*[f"{k} AS _{k}" for k in keys], "station_count")
        agg = e.groupBy(*keys).agg(*agg_exprs(aggs))
        agg = agg.join(count, E(" AND ".join(f"{k} <=> _{k}" for k in keys))).select(*keys, "station_count", *aggs)
    else:
        agg = e.groupBy(*keys).agg(*agg_exprs(aggs))
    length = rnd("max_postmile - min_postmile", 2)
    out = add_cols(agg, _bucket_calendar({
        "level_of_service": M.level_of_service("vc_ratio"),
        "congested_pct": rnd("1e2 * congested_station_samples / GREATEST(1, sample_count)", 2),
        "corridor_length_mi": length,
        "vmt": rnd(f"sum_flow_vph * {sample_minutes / 60.0!r} * ({length} / GREATEST(1, station_count))", 1)}))
    out = add_cols(out, {
        "vht": rnd("vmt / GREATEST(1e0, avg_speed_mph)", 2),
        "total_delay_veh_hours": rnd("vmt * avg_delay_min_per_mi / 6e1", 2),
        "is_weekend": clock.is_weekend("day_of_week"),
        "peak_period": clock.peak_period("day_of_week", "hour_of_day")})
    return out.drop("abs_bucket")


@plan
def corridor_summary(spark: SparkSession, sf_dir: str, sample_minutes: int = K.INTERVAL_MINUTES) -> DataFrame:
    """Corridor rollups from the raw tables, after their expectations."""
    return apply_rules(corridors_of(enriched(spark, sf_dir), sample_minutes), CORRIDOR_RULES)


def stations_geo_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refreshed station dimension (see ``plans.gold``)."""
    from . import gold
    return gold.table(spark, sf_dir, "stations_geo")


def frames_table(spark: SparkSession, sf_dir: str, day=None) -> DataFrame:
    """The refreshed frame table, or one local date of it (see ``plans.gold``)."""
    from . import gold
    return gold.table(spark, sf_dir, "frames", day)


def days_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored catalogue of local dates (see ``plans.gold``)."""
    from . import gold
    return gold.table(spark, sf_dir, "days")
