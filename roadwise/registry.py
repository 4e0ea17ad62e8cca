"""Registered queries: name -> (Spark plan builder, DuckDB oracle SQL or None).

Every builder takes (spark, sf_dir) and reads the whole base tables under ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import constants as K
from .oracle import duck as D
from .plans import medallion as MD

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, oracle: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        _REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    return {k: v[0] for k, v in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _REGISTRY.items() if v[1] is not None}


# --- medallion ----------------------------------------------------------------------

STATION_GEO_COLS = ("cell_r7_p5, station_num, station_id, freeway, direction, postmile, latitude, longitude, num_lanes, "
                    "lane_capacity_vph, station_type, urban_intensity, detector_health, cell_r7, cell_r8, cell_r9, "
                    "cell_r7_str, cell_r8_str, cell_r9_str, geom_wkt, cell_r8_boundary_wkt, baseline_capacity_vph, "
                    "baseline_lanes, baseline_lane_capacity_vph")

register("stations_geo", D.with_ctes(f"SELECT {STATION_GEO_COLS} FROM stations_geo"))(MD.stations_geo)
register("bronze_readings", D.with_ctes("SELECT * FROM bronze"))(MD.bronze_readings)
register("incident_fanout", D.with_ctes("""
SELECT r.station_id, r.src_order, r.src_line, r.day_no * 288 + r.slot5 AS abs_slot, i.incident_id,
       i.severity AS incident_severity, i.lanes_blocked
FROM readings r LEFT JOIN incidents i ON i.station_id = r.station_id
 AND i.day_no * 288 + i.start_slot <= r.day_no * 288 + r.slot5 AND r.day_no * 288 + r.slot5 < i.day_no * 288 + i.end_slot
"""))(MD.incident_fanout)
register("enriched", D.with_ctes("SELECT * FROM enriched"))(MD.enriched)
register("frames", D.with_ctes("SELECT * FROM frames"))(MD.frames)
register("corridor_summary", D.with_ctes("SELECT * FROM corridor"))(MD.corridor_summary)
register("corridor_summary_15", D.with_ctes("SELECT * FROM corridor").replace("0.08333333333333333", "0.25"))(
    lambda spark, sf_dir: MD.corridor_summary(spark, sf_dir, sample_minutes=K.FRAME_MINUTES))

# --- refreshed tables -----------------------------------------------------------------
from .plans import gold as GO  # noqa: E402

_DAY = "2026-06-07"  # the second local date of the fixture
register("gold_corridors", D.with_ctes("SELECT * FROM corridor"))(lambda spark, sf_dir: GO.table(spark, sf_dir, "corridor_summary"))
register("gold_frames_day", D.with_ctes(f"SELECT * FROM frames WHERE reading_date = DATE '{_DAY}'"))(
    lambda spark, sf_dir: GO.table(spark, sf_dir, "frames", _DAY))
register("quality_report", D.quality_sql())(GO.quality_report)
register("corridor_history", D.with_ctes("""
SELECT strftime(reading_date, '%Y%m%d') AS run_id, freeway, direction, CAST(sum(sample_count) AS BIGINT) AS samples,
       CAST(sum(sum_flow_vph) AS BIGINT) AS sum_flow_vph, max(max_vc_ratio) AS max_vc_ratio,
       CAST(sum(incident_samples) AS BIGINT) AS incident_samples
FROM corridor GROUP BY reading_date, freeway, direction"""))(GO.corridor_history)
register("workday_profile", D.with_ctes("""
SELECT freeway, bucket_idx, count(*) AS station_frames, CAST(sum(avg_flow_vph) AS BIGINT) AS flow_vph
FROM frames WHERE dayofweek(reading_date) BETWEEN 1 AND 5 GROUP BY freeway, bucket_idx"""))(GO.workday_profile)

# --- dashboard ----------------------------------------------------------------------
from .plans import dashboard as DB  # noqa: E402

_DASH = D.dashboard_ctes()


_BODY: dict[str, str] = {}  # bodies that other oracles build on


def _dq(body: str, name: str | None = None) -> str:
    if name:
        _BODY[name] = body
    return D.with_ctes(body, _DASH)


register("day_catalogue", _dq("""
SELECT reading_date AS day, CAST(max(day_of_week) AS INT) AS day_of_week,
       CAST(max(CASE WHEN is_weekend THEN 1 ELSE 0 END) AS INT) AS is_weekend,
       strftime(reading_date, '%a') AS day_name, CAST(count(DISTINCT station_id) AS INT) AS station_count
FROM frames GROUP BY reading_date"""))(DB.day_catalogue)
register("corridor_options", _dq(
    "SELECT freeway, CAST(count(DISTINCT station_id) AS INT) AS station_count FROM frames GROUP BY freeway"
))(DB.corridor_options)
register("station_geometry", _dq("""
SELECT station_id, freeway, direction, postmile, latitude, longitude, num_lanes, station_type,
       cell_r7_str AS cell_r7, cell_r8_str AS cell_r8, baseline_capacity_vph, baseline_lanes,
       CAST(row_number() OVER (ORDER BY station_id) - 1 AS INT) AS station_idx
FROM stations_geo g WHERE EXISTS (SELECT 1 FROM frames f WHERE f.station_id = g.station_id)"""))(DB.station_geometry)
register("station_index", _dq("SELECT * FROM station_index"))(DB.station_index)
register("time_matrix", _dq(D.packed_select("tm_cells", "reading_date, scope, from_bucket",
                                            ["flow", "speed_half", "vc_pct", "incident"], "station_idx")))(DB.time_matrix)
register("time_matrix_decoded", _dq("""
SELECT reading_date, scope, bucket_idx, station_id, NULLIF(flow, -1) AS flow_vph,
       CASE WHEN speed_half = -1 THEN NULL ELSE speed_half / 2e0 END AS speed_mph,
       CASE WHEN vc_pct = -1 THEN NULL ELSE vc_pct / 1e2 END AS vc_ratio, incident
FROM tm_cells"""))(DB.time_matrix_decoded)
register("cell_congestion", _dq("""
SELECT p.*, m.max_congestion_pct, d.hex_count, d.hex_ids FROM (
  SELECT reading_date, scope, from_bucket, CAST(min(bucket_idx) AS INT) AS first_bucket,
         string_agg(CAST(congestion_pct AS VARCHAR), ',' ORDER BY bucket_idx, hex_idx) AS congestion_pct,
         string_agg(CAST(speed_half AS VARCHAR), ',' ORDER BY bucket_idx, hex_idx) AS speed_half
  FROM hex_dense GROUP BY ALL) p
JOIN (SELECT reading_date, scope, from_bucket, CAST(max(congestion_pct) AS INT) AS max_congestion_pct
      FROM hex_dense GROUP BY ALL) m USING (reading_date, scope, from_bucket)
JOIN (SELECT reading_date, scope, CAST(count(*) AS INT) AS hex_count,
             string_agg(hex_id, ',' ORDER BY hex_idx) AS hex_ids FROM hex_dim GROUP BY ALL) d
  USING (reading_date, scope)"""))(DB.cell_congestion)
register("alignment_check", _dq("""
SELECT t.reading_date, t.scope, t.from_bucket, t.stations, i.index_stations, t.n_values, t.n_values = 24 * i.index_stations AS aligned
FROM (SELECT reading_date, scope, from_bucket, CAST(count(DISTINCT station_idx) AS INT) AS stations, CAST(count(*) AS INT) AS n_values
      FROM tm_cells GROUP BY ALL) t
LEFT JOIN (SELECT reading_date, scope, CAST(count(DISTINCT station_id) AS INT) AS index_stations FROM scoped_frames GROUP BY ALL) i
  USING (reading_date, scope)"""))(DB.alignment_check)
register("cell_congestion_decoded", _dq("""
SELECT reading_date, scope, bucket_idx, hex_id, CASE WHEN congestion_pct <> -1 THEN congestion_pct / 1e2 END AS congestion,
  CASE WHEN congestion_pct <> -1 THEN speed_half / 2e0 END AS speed_mph,
  (SELECT max(m.congestion_pct) FROM hex_dense m WHERE m.reading_date = d.reading_date AND m.scope = d.scope AND m.from_bucket <= d.from_bucket) / 1e2
    AS max_so_far
FROM hex_dense d"""))(DB.cell_congestion_decoded)

# one local date of a dashboard: the frame scan reads that date's folder only
for _name, _fn in (("time_matrix", DB.time_matrix), ("cell_congestion", DB.cell_congestion), ("station_index", DB.station_index)):
    register(f"{_name}_day", f"SELECT * FROM ({_REGISTRY[_name][1]}) WHERE reading_date = DATE '{_DAY}'")(
        lambda spark, sf_dir, fn=_fn: fn(spark, sf_dir, day=_DAY))

# --- network geometry ---------------------------------------------------------------
from .plans import network as NW  # noqa: E402
from .plans import scenario as SC  # noqa: E402

from .oracle import scenario_sql as _SQ  # noqa: E402

register("segments", _SQ.network_sql("segments"))(NW.segments)
register("candidates", _SQ.network_sql("candidates"))(NW.candidates)
register("corridor_lengths", None)(NW.corridor_lengths)
register("linear_reference", None)(NW.linear_reference)
register("corridor_paths", None)(NW.corridor_paths)

# --- scenario engine ----------------------------------------------------------------
register("scenario_kpis", _SQ.kpis_sql())(SC.scenario_kpis)
register("scenario_cells", _SQ.cells_sql())(SC.scenario_cells)
register("scenario_buckets", _SQ.buckets_sql())(SC.scenario_buckets)
from .plans import levers as LV  # noqa: E402

register("scenario_levers", _SQ.folded_sql())(LV.folded_levers)
register("lever_warnings", _SQ.warnings_sql())(LV.warnings)


# --- snapshots ----------------------------------------------------------------------
from .functions import measures as _M  # noqa: E402
from .functions.numeric import mean_rounded as _mr, rnd as _rnd  # noqa: E402
from .functions import clock as _C  # noqa: E402
from .plans import snapshot as SN  # noqa: E402

_SNAP = "reading_date, scope, bucket_idx"
register("snapshot_network", _dq(f"""
SELECT {_SNAP}, CAST(count(*) AS INT) AS station_count, {_mr('avg_speed_mph', 1, 1)} AS mean_speed_mph,
  min(min_speed_mph) AS min_speed_mph, {_mr('free_flow_speed_mph', 1, 1)} AS mean_free_flow_mph,
  {_mr('vc_ratio', 4, 3)} AS mean_vc, {_rnd('max(vc_ratio)', 2)} AS max_vc,
  CAST(count_if(vc_ratio > 1) AS INT) AS stations_over_capacity, CAST(count_if(is_congested) AS INT) AS stations_congested,
  CAST(count_if(incident_active) AS INT) AS stations_with_incident,
  CAST(sum(avg_flow_vph) AS BIGINT) AS total_served_flow_vph,
  CAST(sum(avg_demanded_flow_vph) AS BIGINT) AS total_demanded_flow_vph,
  {_mr('delay_vs_freeflow_min_per_mi', 4, 3)} AS mean_delay_min_per_mi
FROM scoped_frames GROUP BY {_SNAP}""", "snapshot_network"))(SN.snapshot_network)
register("snapshot_corridors", _dq(f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {_SNAP} ORDER BY mean_delay_min_per_mi DESC, freeway,
  direction) AS INT) AS rank FROM (
SELECT {_SNAP}, freeway, direction, CAST(count(*) AS INT) AS station_count,
  {_mr('avg_speed_mph', 1, 1)} AS mean_speed_mph, {_mr('free_flow_speed_mph', 1, 1)} AS free_flow_mph,
  {_mr('vc_ratio', 4, 2)} AS mean_vc, {_rnd('max(vc_ratio)', 2)} AS max_vc,
  CAST(count_if(vc_ratio > 1) AS INT) AS stations_over_capacity,
  {_mr('delay_vs_freeflow_min_per_mi', 4, 3)} AS mean_delay_min_per_mi,
  CAST(count_if(incident_active) AS INT) AS incident_count,
  CAST(COALESCE(max(lanes_blocked), 0) AS INT) AS max_lanes_blocked,
  CAST(sum(avg_demanded_flow_vph) AS BIGINT) AS demanded_flow_vph, CAST(sum(avg_flow_vph) AS BIGINT) AS served_flow_vph
FROM scoped_frames GROUP BY {_SNAP}, freeway, direction)) WHERE rank <= 8""", "snapshot_corridors"))(SN.snapshot_corridors)
register("snapshot_los", _dq(f"""
SELECT {_SNAP}, los, station_count,
  {_rnd(f'1e2 * station_count / sum(station_count) OVER (PARTITION BY {_SNAP})', 1)} AS pct
FROM (SELECT {_SNAP}, level_of_service AS los, CAST(count(*) AS INT) AS station_count FROM scoped_frames
      GROUP BY {_SNAP}, level_of_service)""", "snapshot_los"))(SN.snapshot_los)
register("snapshot_incidents", _dq(f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {_SNAP} ORDER BY severity DESC, lanes_blocked DESC,
  vc_ratio DESC, station_id) AS INT) AS rank, CAST(count(*) OVER (PARTITION BY {_SNAP}) AS INT) AS incident_total
FROM (SELECT {_SNAP}, station_id, freeway, direction, {_rnd('postmile', 1)} AS postmile,
  CAST(COALESCE(max_incident_severity, 0) AS INT) AS severity, CAST(COALESCE(lanes_blocked, 0) AS INT) AS lanes_blocked,
  CAST(num_lanes AS INT) AS num_lanes, {_rnd('avg_speed_mph', 1)} AS speed_mph, {_rnd('vc_ratio', 2)} AS vc_ratio
  FROM scoped_frames WHERE incident_active)) WHERE rank <= 12""", "snapshot_incidents"))(SN.snapshot_incidents)
_LOS8 = _M.los_from_speed_vc("avg_speed_mph", "vc_ratio")
register("frame_kpis", _dq(f"""
SELECT {_SNAP}, {_rnd('COALESCE(avg(avg_speed_mph), 0e0)', 6)} AS mean_speed,
  CAST(sum(avg_flow_vph) AS BIGINT) AS total_flow,
  {_rnd(f"CASE WHEN count(avg_speed_mph) > 0 THEN 1e2 * count_if(avg_speed_mph IS NOT NULL AND {_LOS8} IN ('E', 'F')) / count(avg_speed_mph) ELSE 0e0 END", 6)} AS pct_congested,
  CAST(count_if(vc_ratio > 1) AS INT) AS over_capacity, CAST(count_if(incident_active) AS INT) AS incidents,
  CAST(count(avg_speed_mph) AS INT) AS observed
FROM scoped_frames GROUP BY {_SNAP}"""))(SN.frame_kpis)
register("frame_worst_corridors", _dq(f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY reading_date, bucket_idx ORDER BY mean_speed, freeway)
  AS INT) AS rank FROM (
SELECT reading_date, bucket_idx, freeway, {_rnd('COALESCE(avg(avg_speed_mph), 0e0)', 6)} AS mean_speed,
  CAST(sum(avg_flow_vph) AS BIGINT) AS total_flow,
  {_rnd(f"CASE WHEN count(avg_speed_mph) > 0 THEN 1e2 * count_if(avg_speed_mph IS NOT NULL AND {_LOS8} IN ('E', 'F')) / count(avg_speed_mph) ELSE 0e0 END", 6)} AS congested_pct
FROM frames GROUP BY reading_date, bucket_idx, freeway)) WHERE rank <= 5"""))(SN.frame_worst_corridors)
register("frame_interpolation_day", _dq("""
SELECT d.station_id, d.reading_date, CAST(b.bucket_idx AS INT) AS bucket_idx, s.step,
  """ + _rnd("CASE WHEN f.avg_speed_mph IS NULL THEN n.avg_speed_mph WHEN n.avg_speed_mph IS NULL THEN f.avg_speed_mph ELSE f.avg_speed_mph + (n.avg_speed_mph - f.avg_speed_mph) * (s.step / 3.0e0) END", 6) + """ AS speed_mph,
  """ + _rnd("CASE WHEN f.avg_flow_vph IS NULL THEN CAST(n.avg_flow_vph AS DOUBLE) WHEN n.avg_flow_vph IS NULL THEN CAST(f.avg_flow_vph AS DOUBLE) ELSE CAST(f.avg_flow_vph AS DOUBLE) + (CAST(n.avg_flow_vph AS DOUBLE) - CAST(f.avg_flow_vph AS DOUBLE)) * (s.step / 3.0e0) END", 6) + """ AS flow_vph,
  """ + _rnd("CASE WHEN f.vc_ratio IS NULL THEN n.vc_ratio WHEN n.vc_ratio IS NULL THEN f.vc_ratio ELSE f.vc_ratio + (n.vc_ratio - f.vc_ratio) * (s.step / 3.0e0) END", 6) + """ AS vc_ratio,
  CAST(CASE WHEN s.step / 3.0e0 >= 5e-1 THEN CASE WHEN n.incident_active THEN COALESCE(n.max_incident_severity, 1) ELSE 0 END
       ELSE CASE WHEN f.incident_active THEN COALESCE(f.max_incident_severity, 1) ELSE 0 END END AS INT) AS incident
FROM (SELECT DISTINCT station_id, reading_date FROM frames) d CROSS JOIN (SELECT unnest(range(96)) AS bucket_idx) b
CROSS JOIN (SELECT unnest([0, 1, 2]) AS step) s
LEFT JOIN frames f ON f.station_id = d.station_id AND f.reading_date = d.reading_date AND f.bucket_idx = b.bucket_idx
LEFT JOIN frames n ON n.station_id = d.station_id AND n.reading_date = d.reading_date
  AND n.bucket_idx = (b.bucket_idx + 1) % 96"""))(SN.frame_interpolation_day)

register("snapshot_brief", _dq(f"""
SELECT e.reading_date, e.scope, CAST(e.bucket_idx AS INT) AS bucket_idx, concat_ws(chr(10),
  printf('Traffic of %s at %02d:%02d (%s), %s', CAST(e.reading_date AS VARCHAR), e.bucket_idx // 4, e.bucket_idx % 4 * 15,
    {_C.period_label('(e.bucket_idx // 4)')}, CASE WHEN e.scope = 'ALL' THEN 'all freeways' ELSE 'freeway ' || e.scope END),
  'One quarter of an hour, not a trend.',
  CASE WHEN n.station_count IS NULL THEN 'No readings: nothing is known of it.' ELSE concat_ws(chr(10),
    printf('stations: %d, overfull %d, congested %d, with an incident %d', n.station_count, stations_over_capacity, stations_congested, stations_with_incident),
    printf('speed: %.1f mph where %.1f is free, slowest station %.1f', mean_speed_mph, mean_free_flow_mph, min_speed_mph),
    printf('lateness: %.3f min per mile; load: %.3f, at most %.2f', mean_delay_min_per_mi, mean_vc, max_vc),
    printf('flow: %d veh/h wanted, %d carried', total_demanded_flow_vph, total_served_flow_vph),
    CASE WHEN total_demanded_flow_vph > total_served_flow_vph THEN printf('turned away: %d veh/h (%.1f %% of demand)',
      total_demanded_flow_vph - total_served_flow_vph, 1e2 * (total_demanded_flow_vph - total_served_flow_vph) / total_demanded_flow_vph) END,
    'grades from A (free) to F (breakdown): ' || l.grades, printf('slowest roads (%d):', c.n_roads), c.roads,
    CASE WHEN i.n_events IS NULL THEN 'incidents: none' WHEN i.n_listed < i.n_events THEN printf('incidents: %d, here the worst %d', i.n_events, i.n_listed)
      ELSE printf('incidents: all %d', i.n_events) END, i.events) END) AS brief
FROM (SELECT reading_date, scope, unnest(range(96)) AS bucket_idx FROM (SELECT DISTINCT reading_date, scope FROM scoped_frames)) e
LEFT JOIN ({_BODY['snapshot_network']}) n USING ({_SNAP})
LEFT JOIN (SELECT {_SNAP}, string_agg(printf('%s %d (%.1f %%)', los, station_count, pct), ', ' ORDER BY los) AS grades
  FROM ({_BODY['snapshot_los']}) GROUP BY {_SNAP}) l USING ({_SNAP})
LEFT JOIN (SELECT {_SNAP}, count(*) AS n_roads, string_agg(printf('%d. %s %s, %.1f of %.1f mph, %.3f min per mile late, load %.2f, %d of %d stations overfull,'
    || ' %d with an incident', rank, freeway, direction, mean_speed_mph, free_flow_mph, mean_delay_min_per_mi, mean_vc, stations_over_capacity,
    station_count, incident_count) || CASE WHEN demanded_flow_vph > served_flow_vph THEN printf(', %d veh/h turned away', demanded_flow_vph - served_flow_vph)
    ELSE '' END, chr(10) ORDER BY rank) AS roads FROM ({_BODY['snapshot_corridors']}) GROUP BY {_SNAP}) c USING ({_SNAP})
LEFT JOIN (SELECT {_SNAP}, max(incident_total) AS n_events, count(*) AS n_listed, string_agg(printf('%d. %s, %s %s mile %.1f, severity %d, %d/%d lanes shut, %.1f mph',
    rank, station_id, freeway, direction, postmile, severity, lanes_blocked, num_lanes, speed_mph), chr(10) ORDER BY rank) AS events
  FROM ({_BODY['snapshot_incidents']}) GROUP BY {_SNAP}) i USING ({_SNAP})"""))(SN.snapshot_brief)
_NET = ["station_count", "mean_speed_mph", "min_speed_mph", "mean_free_flow_mph", "mean_vc", "max_vc", "stations_over_capacity", "stations_congested",
        "stations_with_incident", "total_served_flow_vph", "total_demanded_flow_vph", "mean_delay_min_per_mi"]
register("snapshot_json", _dq(f"""
SELECT {_SNAP}, CAST(to_json({{{', '.join(f"'{c}': n.{c}" for c in _NET)}, 'los': l.los, 'worst_corridors': c.roads}}) AS VARCHAR) AS kpi_json
FROM ({_BODY['snapshot_network']}) n
LEFT JOIN (SELECT {_SNAP}, list({{'los': los, 'station_count': station_count, 'pct': pct}} ORDER BY los) AS los
  FROM ({_BODY['snapshot_los']}) GROUP BY {_SNAP}) l USING ({_SNAP})
LEFT JOIN (SELECT {_SNAP}, list({{'freeway': freeway, 'direction': direction, 'mean_speed_mph': mean_speed_mph, 'mean_delay_min_per_mi': mean_delay_min_per_mi}}
  ORDER BY rank) AS roads FROM ({_BODY['snapshot_corridors']}) GROUP BY {_SNAP}) c USING ({_SNAP})"""))(SN.snapshot_json)

# --- advice -------------------------------------------------------------------------
from .plans import advice as AD  # noqa: E402

register("advice_blocks", None)(AD.advice_blocks)
from .oracle import advice_sql as _AQ  # noqa: E402

register("advice_items", _AQ.items_sql())(AD.advice_items)
register("advice_summary", _AQ.summary_sql())(AD.advice_summary)
register("session_messages", """
SELECT s.conv_id, COALESCE(c.message_count, 0) AS message_count
FROM (SELECT DISTINCT conv_id FROM conversations) s
LEFT JOIN (SELECT conv_id, count(*) AS message_count FROM conversations WHERE role <> 'system' GROUP BY conv_id) c
  ON c.conv_id = s.conv_id""")(AD.session_messages)

for _name, _fn in (("snapshot_network", SN.snapshot_network), ("snapshot_corridors", SN.snapshot_corridors)):
    register(f"{_name}_day", f"SELECT * FROM ({_REGISTRY[_name][1]}) WHERE reading_date = DATE '{_DAY}'")(
        lambda spark, sf_dir, fn=_fn: fn(spark, sf_dir, day=_DAY))

register("calendar", _dq("""
SELECT CAST(day AS DATE) AS day, CAST(dayofweek(day) + 1 AS INT) AS day_of_week, dayofweek(day) IN (0, 6) AS is_weekend,
  CAST(day AS DATE) IN (SELECT reading_date FROM frames) AS has_frames
FROM (SELECT unnest(generate_series(date_trunc('week', min(reading_date)), date_trunc('week', max(reading_date)) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS day FROM frames)"""
))(DB.calendar)

# --- remaining operators --------------------------------------------------------------
from .functions import clock as _C  # noqa: E402
from .functions.numeric import rnd_signed as _rs  # noqa: E402
from .plans import extras as EX  # noqa: E402

_LOC = "timezone('America/Los_Angeles', timezone('UTC', ts))"
_B = D.pmod("CAST(bucket_idx AS INT)", "96")
register("event_clock", D.with_ctes(f"""
SELECT event_id, local_ts, {D.to_utc('local_ts')} AS ts_roundtrip,
  date_trunc('minute', ts) - to_minutes(CAST(minute(ts) % 15 AS BIGINT)) AS time_bucket, bucket_idx,
  printf('%02d:%02d', {_B} // 4, ({_B} % 4) * 15) AS bucket_label, local_date, hour_of_day, day_of_week,
  day_of_week IN (1, 7) AS is_weekend, strftime(local_date, '%a') AS day_name,
  {_rnd('hour(local_ts) + minute(local_ts) / 6e1', 6)} AS hour_frac,
  CAST(local_date AS TIMESTAMP) + to_minutes(CAST(CAST(FLOOR(hour(local_ts) + minute(local_ts) / 6e1) AS INT) * 60
    + CAST(FLOOR(((hour(local_ts) + minute(local_ts) / 6e1) - FLOOR(hour(local_ts) + minute(local_ts) / 6e1)) * 12)
    AS INT) * 5 AS BIGINT)) AS slot_start,
  {_C.peak_period('day_of_week', 'hour_of_day')} AS peak_period, {_C.period_label('hour_of_day')} AS period_label
FROM (SELECT *, CAST(hour(local_ts) * 4 + minute(local_ts) // 15 AS INT) AS bucket_idx,
        CAST(hour(local_ts) AS INT) AS hour_of_day, CAST(dayofweek(local_ts) + 1 AS INT) AS day_of_week,
        CAST(local_ts AS DATE) AS local_date
      FROM (SELECT event_id, ts, {_LOC} AS local_ts FROM events))"""))(EX.event_clock)

_HOUR = "(bucket_idx / 4e0)"
_CAP = _M.base_capacity("num_lanes", _M.lane_capacity_vph("urban_intensity"), _M.station_type_scale("station_type"))
register("demand_profile", D.with_ctes(f"""
SELECT *, {_rnd('demand_factor * dow_scale * demand_scale * model_capacity_vph', 3)} AS expected_demand_vph FROM (
SELECT f.station_id, f.reading_date, f.bucket_idx,
  {_rnd(_M.demand_factor(_HOUR, 'is_weekend', 'f.direction'), 6)} AS demand_factor,
  {_M.dow_scale('day_of_week')} AS dow_scale, {_rnd(_M.demand_scale('urban_intensity'), 6)} AS demand_scale,
  {_rnd(_M.free_flow_speed('urban_intensity'), 6)} AS free_flow_speed_mph,
  {_M.lane_capacity_vph('urban_intensity')} AS lane_capacity_vph, {_M.station_type_scale('s.station_type')} AS type_scale,
  {_rnd(_CAP.replace('num_lanes', 'f.num_lanes').replace('station_type', 's.station_type'), 6)} AS model_capacity_vph,
  f.avg_demanded_flow_vph
FROM frames f JOIN stations s ON s.station_id = f.station_id)"""))(EX.demand_profile)
register("frame_unserved", D.with_ctes(f"""
SELECT station_id, reading_date, bucket_idx,
  {_M.unserved_demand('avg_demanded_flow_vph', 'avg_flow_vph')} AS unserved_vph,
  {_rs(_M.unserved_pct('avg_demanded_flow_vph', 'avg_flow_vph'), 4)} AS unserved_pct FROM frames"""))(EX.frame_unserved)


_D = "(speed_after - speed_before)"
register("scenario_speed_changes", _SQ.with_cells(f"""
SELECT scenario_id, reading_date, bucket_idx, station_id, {_rs(_D, 6)} AS speed_delta,
  {_M.speed_change_class(_D)} AS change_class, {_rnd(_M.speed_change_magnitude(_D), 6)} AS magnitude,
  {_D} < -8e0 AS severe_drop FROM cells"""))(EX.scenario_speed_changes)
register("scenario_corridor_compare", _SQ.with_cells(f"""
SELECT scenario_id, reading_date, bucket_idx, freeway, b AS baseline_speed,
  COALESCE(a, b) AS scenario_speed, {_rs('COALESCE(a, b) - b', 4)} AS speed_delta
FROM (SELECT c.scenario_id, c.reading_date, c.bucket_idx, s.freeway, {_mr('c.speed_before', 6, 4)} AS b,
        {_mr('c.speed_after', 6, 4)} AS a
      FROM cells c JOIN stations s ON s.station_id = c.station_id GROUP BY ALL)"""))(EX.scenario_corridor_compare)
register("scenario_time_matrix", _SQ.with_cells(D.packed_select("stm_cells", "scenario_id, reading_date, scope, from_bucket",
                                                                ["flow", "speed_half", "vc_pct", "incident", "delay_c"],
                                                                "station_idx"), {"stm_grid": """
SELECT s.scenario_id, i.reading_date, i.scope, i.station_id, i.station_idx, b.bucket_idx
FROM (SELECT DISTINCT scenario_id, reading_date FROM cells) s
JOIN station_index i ON i.reading_date = s.reading_date
CROSS JOIN (SELECT CAST(unnest(generate_series(0, 95)) AS INT) AS bucket_idx) b""", "stm_cells": f"""
SELECT g.scenario_id, g.reading_date, g.scope, g.bucket_idx, g.station_idx, CAST(g.bucket_idx // 24 * 24 AS INT) AS from_bucket,
  COALESCE({_M.scaled_int('served_after', 1.0)}, -1) AS flow, COALESCE({_M.scaled_int('speed_after', 2.0)}, -1) AS speed_half,
  COALESCE({_M.scaled_int('vc_after', 100.0)}, -1) AS vc_pct,
  CASE WHEN c.station_id IS NULL THEN 0 ELSE {_M.capacity_loss_severity('cap_scen', 'cap_obs')} END AS incident,
  COALESCE({_M.scaled_int('delay_after', 100.0)}, -1) AS delay_c
FROM stm_grid g LEFT JOIN cells c ON c.scenario_id = g.scenario_id AND c.reading_date = g.reading_date
  AND c.bucket_idx = g.bucket_idx AND c.station_id = g.station_id"""}))(EX.scenario_time_matrix)
_PAIRS = [("demand", "d_lever", "demand_after"), ("vc", "vc_before", "vc_after"), ("speed", "speed_before", "speed_after"),
          ("served", "served_before", "served_after"), ("delay", "delay_before", "delay_after"),
          ("vmt", "vmt_before", "vmt_after"), ("vht", "vht_before", "vht_after")]
register("noop_proof", _SQ.with_cells("SELECT scenario_id, " + ", ".join(
    f"max(ABS({a} - {b})) AS max_abs_diff_{n}" for n, b, a in _PAIRS)
    + ", count_if(los_before <> los_after) AS grade_changes FROM cells WHERE scenario_id = 'noop' GROUP BY scenario_id"
))(EX.noop_proof)


@register("scenario_kpis_no_reassignment", _SQ.kpis_sql(0))
def _kpis_k0(spark, sf_dir):
    """S7 / K7 with k = 0: levers applied, no demand reassignment."""
    return SC.scenario_kpis(spark, sf_dir, iterations=0)


# --- polyline oracles ---------------------------------------------------------------
from .functions import geo as _G  # noqa: E402

_HAV = _G.haversine_mi("lat", "lon", "lat2", "lon2")
_VERT = f"""WITH vertices AS (SELECT concat('F', CAST(n_nationkey % 5 AS VARCHAR)) AS freeway,
  CAST(n_nationkey // 5 AS INT) AS seq, 34e0 + CAST(n_nationkey // 5 AS DOUBLE) * 2e-1 AS lat,
  -118e0 + CAST(n_nationkey % 5 AS DOUBLE) * 3e-2 AS lon, CAST((n_nationkey * 17) % 101 AS DOUBLE) / 1e2 AS urban,
  n_name AS city, CAST(n_regionkey + 1 AS INT) AS district, (SELECT r_name FROM region r WHERE r.r_regionkey = n.n_regionkey) AS county FROM nation n),
vseg0 AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(urban) OVER w AS urban2,
  lead(city) OVER w AS city2, lead(district) OVER w AS district2, lead(county) OVER w AS county2 FROM vertices WINDOW w AS (PARTITION BY freeway ORDER BY seq)),
vseg1 AS (SELECT *, CASE WHEN lat2 IS NULL THEN 0e0 ELSE {_HAV} END AS len FROM vseg0),
vseg AS (SELECT *, sum(len) OVER (PARTITION BY freeway ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  - len AS d0, sum(len) OVER (PARTITION BY freeway) AS total FROM vseg1),
st AS (SELECT concat('ST', CAST(s_suppkey AS VARCHAR)) AS station_id, concat('F', CAST(s_suppkey % 5 + 5 * (s_suppkey // 10000) AS VARCHAR))
  AS freeway, GREATEST(0e0, CAST(s_suppkey // 10 % 1000 AS DOUBLE) * 6e-1 + CAST(s_suppkey % 7 AS DOUBLE) * 1e-2) AS d,
  CASE WHEN s_suppkey // 5 % 2 = 0 THEN 1 ELSE -1 END AS side FROM supplier)
"""
NW_ORACLE_LENGTHS = _VERT + f"""SELECT freeway, {_rnd('sum(len)', 6)} AS length_mi, CAST(count(*) AS INT) AS vertices
FROM vseg1 GROUP BY freeway"""
NW_ORACLE_LINREF = _VERT + """SELECT station_id, freeway, distance_mi, lat, lon, urban, city, district, county,
  CASE WHEN lat + side * 35e-5 < 0 THEN -floor(-(lat + side * 35e-5) * 1e6 + 5e-1) / 1e6 ELSE floor((lat + side * 35e-5) * 1e6 + 5e-1) / 1e6 END AS side_lat,
  CASE WHEN lon + side * 35e-5 < 0 THEN -floor(-(lon + side * 35e-5) * 1e6 + 5e-1) / 1e6 ELSE floor((lon + side * 35e-5) * 1e6 + 5e-1) / 1e6 END AS side_lon
FROM (SELECT station_id, freeway, side, d AS distance_mi,
  CASE WHEN past_end THEN lat ELSE lat + (lat2 - lat) * t END AS lat,
  CASE WHEN past_end THEN lon ELSE lon + (lon2 - lon) * t END AS lon,
  CASE WHEN past_end THEN urban ELSE urban + (urban2 - urban) * t END AS urban,
  CASE WHEN NOT past_end AND t >= 5e-1 THEN city2 ELSE city END AS city,
  CASE WHEN NOT past_end AND t >= 5e-1 THEN district2 ELSE district END AS district,
  CASE WHEN NOT past_end AND t >= 5e-1 THEN county2 ELSE county END AS county
FROM (
  SELECT s.station_id, s.freeway, s.side, s.d, false AS past_end, LEAST(1e0, (s.d - v.d0) / v.len) AS t, v.*
  FROM st s JOIN vseg v ON v.freeway = concat('F', CAST(CAST(s.freeway[2:] AS BIGINT) % 5 AS VARCHAR))
  WHERE v.lat2 IS NOT NULL AND v.len > 0 AND s.d >= v.d0 AND s.d < v.d0 + v.len AND s.d < v.total
  UNION ALL
  SELECT s.station_id, s.freeway, s.side, s.d, true, 1e0, v.*
  FROM st s JOIN vseg v ON v.freeway = concat('F', CAST(CAST(s.freeway[2:] AS BIGINT) % 5 AS VARCHAR)) WHERE v.lat2 IS NULL AND s.d >= v.total))"""
_REGISTRY["corridor_lengths"] = (NW.corridor_lengths, NW_ORACLE_LENGTHS)
_REGISTRY["linear_reference"] = (NW.linear_reference, NW_ORACLE_LINREF)
