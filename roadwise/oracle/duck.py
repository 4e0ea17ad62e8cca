"""DuckDB CTE chain mirroring the library's derived tables."""

from __future__ import annotations

from .. import constants as K
from ..functions import geo as G
from ..functions import measures as M
from ..functions.numeric import lit, mean_rounded, rnd

LOCAL0 = "TIMESTAMP '2026-06-06 00:00:00'"


def local_ts(abs_slot: str) -> str:
    return f"({LOCAL0} + to_minutes(CAST(({abs_slot}) * 5 AS BIGINT)))"


def to_utc(x: str) -> str:
    return f"timezone('UTC', timezone('{K.LOCAL_TZ}', {x}))"


def dow(x: str) -> str:
    return f"CAST(dayofweek({x}) + 1 AS INT)"


def pmod(a: str, b: str) -> str:
    return f"((({a}) % ({b}) + ({b})) % ({b}))"


def hex_cell(lon: str, lat: str, res: int) -> str:
    s = G.edge_km(res)
    ox, oy = G.origin_km(res)
    x = f"(({lon}) * {lit(G.KM_PER_DEG_LON)} + {lit(ox)})"
    y = f"(({lat}) * {lit(G.KM_PER_DEG_LAT)} + {lit(oy)})"
    q = f"(({lit(G.SQRT3 / 3.0)} * {x} - {y} / 3e0) / {lit(s)})"
    r = f"((2e0 / 3e0 * {y}) / {lit(s)})"
    rx, rz, ry = f"FLOOR({q} + 5e-1)", f"FLOOR({r} + 5e-1)", f"FLOOR(-{q} - {r} + 5e-1)"
    dx, dz, dy = f"ABS({rx} - {q})", f"ABS({rz} - {r})", f"ABS({ry} + {q} + {r})"
    fix_x = f"({dx} > {dy} AND {dx} > {dz})"
    fix_y = f"(NOT {fix_x} AND {dy} > {dz})"
    qx = f"CAST(CASE WHEN {fix_x} THEN -{ry} - {rz} ELSE {rx} END AS BIGINT)"
    qz = f"CAST(CASE WHEN NOT {fix_x} AND NOT {fix_y} THEN -{rx} - {ry} ELSE {rz} END AS BIGINT)"
    return f"CAST({res} * {G.RES_MUL} + ({qx} + {G.OFF}) * {G.Q_MUL} + ({qz} + {G.OFF}) AS BIGINT)"


def cell_parent(cell: str, res: int, parent_res: int) -> str:
    lon, lat = G.cell_centre(cell, res)
    return hex_cell(lon, lat, parent_res)


def boundary_wkt(cell: str, res: int) -> str:
    return G.cell_boundary_wkt(G.cell_q(cell), G.cell_r(cell), res).replace("format_string(", "printf(")


FRAME_AGGS_SQL = {
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
    "sample_count": "count(*)",
}


def _bucket_calendar(prefix: str = "") -> str:
    lb = local_ts(f"{prefix}abs_bucket * 3")
    return (f"CAST({prefix}abs_bucket // {K.BUCKETS_PER_DAY} AS INT) AS day_no,"
            f" CAST(hour({lb}) * 4 + minute({lb}) // 15 AS INT) AS bucket_idx,"
            f" {to_utc(lb)} AS time_bucket, CAST({lb} AS DATE) AS reading_date,"
            f" CAST(hour({lb}) AS INT) AS hour_of_day, {dow(lb)} AS day_of_week")


def ctes() -> dict[str, str]:
    c: dict[str, str] = {}
    c["stations"] = """
SELECT s_suppkey AS station_num,
       concat('ST', CAST(s_suppkey AS VARCHAR)) AS station_id,
       concat('F', CAST(s_suppkey % 5 + 5 * (s_suppkey // 10000) AS VARCHAR)) AS freeway,
       CASE WHEN CAST(floor(s_suppkey / 5) AS BIGINT) % 2 = 0 THEN 'N' ELSE 'S' END AS direction,
       CAST(s_suppkey // 10 % 1000 AS DOUBLE) * 6e-1 + CAST(s_suppkey % 7 AS DOUBLE) * 1e-2 AS postmile,
       34e0 + CAST(s_suppkey // 10 % 1000 AS DOUBLE) * 8e-3 AS latitude,
       -118e0 + CAST(s_suppkey % 5 AS DOUBLE) * 3e-2 + CAST(s_suppkey // 10 % 1000 AS DOUBLE) * 2e-3
         - CAST(s_suppkey // 10000 % 300 AS DOUBLE) * 2e-2 AS longitude,
       CAST(2 + s_suppkey % 4 AS INT) AS num_lanes,
       CAST(1950 + (s_suppkey * 37) % 151 AS INT) AS lane_capacity_vph,
       CASE s_suppkey % 9 WHEN 0 THEN 'HV' WHEN 1 THEN 'OR' WHEN 2 THEN 'FR' ELSE 'ML' END AS station_type,
       CAST((s_suppkey * 13) % 101 AS DOUBLE) / 1e2 AS urban_intensity,
       CASE WHEN s_suppkey % 31 = 7 THEN 'dark' WHEN s_suppkey % 11 = 3 THEN 'degraded' ELSE 'healthy' END
         AS detector_health
FROM supplier"""
    c["incidents"] = """
SELECT 'INC-' || s.station_id || '-' || CAST(o.o_custkey % 3 AS VARCHAR) || '-' || CAST(o.o_orderkey AS VARCHAR) AS incident_id,
       s.station_id, s.freeway, s.direction, s.num_lanes,
       CAST(o.o_custkey % 3 AS INT) AS day_no,
       CAST(o.o_orderkey % 288 AS INT) AS start_slot,
       CAST(o.o_orderkey % 288 + 2 + o.o_custkey % 12 AS INT) AS end_slot,
       CAST(greatest(1, 5 - CAST(o.o_orderpriority[1:1] AS INT)) AS INT) AS severity,
       CAST(least(s.num_lanes - 1, 1 + o.o_orderkey % 2) AS INT) AS lanes_blocked
FROM orders o JOIN stations s ON s.station_num = o.o_custkey % (SELECT count(*) FROM supplier)"""
    c["readings"] = """
SELECT s.station_id, l.l_orderkey AS src_order, l.l_linenumber AS src_line,
       CAST(l.l_partkey % 3 AS INT) AS day_no,
       CAST((l.l_orderkey * 7 + l.l_linenumber) % 288 AS INT) AS slot5,
       CAST(((l.l_orderkey * 7 + l.l_linenumber) % 288) // 3 AS INT) AS bucket_idx,
       CAST(s.num_lanes * s.lane_capacity_vph AS DOUBLE) * CASE s.station_type WHEN 'ML' THEN 1e0 WHEN 'HV' THEN 55e-2 WHEN 'OR' THEN 22e-2 ELSE 20e-2 END AS base_capacity_vph,
       CAST(floor(CAST(s.num_lanes * s.lane_capacity_vph AS DOUBLE) * CASE s.station_type WHEN 'ML' THEN 1e0 WHEN 'HV' THEN 55e-2 WHEN 'OR' THEN 22e-2 ELSE 20e-2 END * (2e-1 + l.l_quantity / 45e0) + 5e-1) AS INT)
         AS demanded_flow_vph,
       7e1 - 5e0 * s.urban_intensity AS free_flow_speed_mph,
       1e0 + 5e-1 * (l.l_discount - 5e-2) AS speed_jitter,
       CASE s.detector_health WHEN 'dark' THEN 0e0
            WHEN 'degraded' THEN 35e0 + 4e0 * CAST(l.l_linenumber AS DOUBLE) ELSE 96e0 + 4e1 * l.l_discount END
         AS observed_pct
FROM lineitem l JOIN stations s ON s.station_num = l.l_suppkey"""
    geo_cols = ", ".join(f"{hex_cell('longitude', 'latitude', r)} AS cell_r{r}" for r in (7, 8, 9))
    c["stations_geo00"] = f"SELECT *, {geo_cols} FROM stations"
    c["stations_geo0"] = f"SELECT *, {cell_parent('cell_r7', 7, 5)} AS cell_r7_p5 FROM stations_geo00"
    c["stations_geo"] = f"""
SELECT *, lower(hex(cell_r7)) AS cell_r7_str, lower(hex(cell_r8)) AS cell_r8_str, lower(hex(cell_r9)) AS cell_r9_str,
       printf('POINT(%.6f %.6f)', longitude, latitude) AS geom_wkt,
       {boundary_wkt('cell_r8', 8)} AS cell_r8_boundary_wkt,
       CAST(num_lanes AS DOUBLE) * CAST(lane_capacity_vph AS DOUBLE) AS baseline_capacity_vph,
       num_lanes AS baseline_lanes, lane_capacity_vph AS baseline_lane_capacity_vph
FROM stations_geo0
WHERE latitude BETWEEN 32.50 AND 42.05 AND longitude BETWEEN -124.50 AND -114.10 AND direction IN ('N', 'S', 'E', 'W')
  AND num_lanes BETWEEN 1 AND 8 AND lane_capacity_vph BETWEEN 1000 AND 2400 AND num_lanes * lane_capacity_vph > 0"""
    c["good_incidents"] = """
SELECT * FROM incidents
WHERE station_id IS NOT NULL AND end_slot > start_slot AND severity BETWEEN 1 AND 4 AND lanes_blocked BETWEEN 0 AND num_lanes"""
    c["worst_incident"] = """
SELECT station_id, abs_slot, max(k) AS k FROM (
  SELECT station_id, lanes_blocked * 100 + severity AS k,
         unnest(generate_series(day_no * 288 + start_slot, day_no * 288 + end_slot - 1)) AS abs_slot
  FROM good_incidents) GROUP BY station_id, abs_slot"""
    c["bronze1"] = f"""
SELECT r.*, r.day_no * 288 + r.slot5 AS abs_slot, r.day_no * 96 + r.bucket_idx AS abs_bucket, s.num_lanes,
       w.k IS NOT NULL AS incident_active,
       COALESCE(CAST(w.k // 100 AS INT), 0) AS lanes_blocked,
       COALESCE(CAST(w.k % 100 AS INT), 0) AS incident_severity,
       {local_ts('r.day_no * 288 + r.slot5')} AS local_ts
FROM readings r JOIN stations s ON s.station_id = r.station_id
LEFT JOIN worst_incident w ON w.station_id = r.station_id AND w.abs_slot = r.day_no * 288 + r.slot5"""
    c["bronze2"] = f"""
SELECT *, {to_utc('local_ts')} AS ts,
       {M.effective_capacity('base_capacity_vph', 'incident_active', 'num_lanes', 'lanes_blocked')}
         AS effective_capacity_vph
FROM bronze1"""
    speed = M.jittered_speed(M.bpr_speed("free_flow_speed_mph",
                                         "demanded_flow_vph / GREATEST(1e0, effective_capacity_vph)"), "speed_jitter")
    c["bronze3"] = f"""
SELECT *, {speed} AS avg_speed_mph, {M.served_flow('demanded_flow_vph', 'effective_capacity_vph')} AS total_flow_vph,
       {M.lanes_reporting('num_lanes', 'observed_pct')} AS num_lanes_reporting
FROM bronze2"""
    c["bronze_raw"] = f"""
SELECT station_id, src_order, src_line, day_no, slot5, abs_slot, abs_bucket, bucket_idx, ts, local_ts,
       demanded_flow_vph, total_flow_vph, avg_occupancy, avg_speed_mph, observed_pct, num_lanes_reporting,
       num_lanes, base_capacity_vph, effective_capacity_vph, free_flow_speed_mph, incident_active,
       lanes_blocked, incident_severity
FROM (SELECT *, {rnd(M.occupancy('total_flow_vph', 'avg_speed_mph', 'num_lanes'), 4)} AS avg_occupancy FROM bronze3)"""
    c["bronze"] = f"""SELECT * FROM bronze_raw
WHERE demanded_flow_vph >= 0 AND total_flow_vph >= 0 AND total_flow_vph <= demanded_flow_vph AND total_flow_vph <= 20000
  AND avg_speed_mph > 0 AND avg_speed_mph <= 100 AND avg_occupancy BETWEEN 0 AND 1 AND observed_pct BETWEEN 0 AND 100
  AND num_lanes_reporting BETWEEN 0 AND num_lanes"""
    c["enriched0"] = f"""
SELECT b.*, g.freeway, g.direction, g.postmile, g.latitude, g.longitude, g.station_type, g.urban_intensity,
       g.cell_r7, g.cell_r8, g.baseline_capacity_vph, g.baseline_lanes, g.baseline_lane_capacity_vph,
       {M.vc_ratio('demanded_flow_vph', 'effective_capacity_vph')} AS vc_ratio,
       {M.vc_ratio('total_flow_vph', 'effective_capacity_vph')} AS served_vc_ratio,
       {rnd(M.delay_min_per_mi('avg_speed_mph', 'b.free_flow_speed_mph'), 4)} AS delay_vs_freeflow_min_per_mi,
       {M.is_congested('avg_speed_mph', 'b.free_flow_speed_mph')} AS is_congested,
       {M.speed_ratio('avg_speed_mph', 'b.free_flow_speed_mph')} AS speed_ratio,
       CAST(local_ts AS DATE) AS reading_date, CAST(hour(local_ts) AS INT) AS hour_of_day,
       {dow('local_ts')} AS day_of_week,
       date_trunc('minute', ts) - to_minutes(CAST(minute(ts) % 15 AS BIGINT)) AS time_bucket
FROM bronze b JOIN stations_geo g ON g.station_id = b.station_id"""
    c["enriched_raw"] = f"""
SELECT *, {M.level_of_service('vc_ratio')} AS level_of_service, day_of_week IN (1, 7) AS is_weekend,
       CASE WHEN day_of_week IN (1, 7) THEN 'WEEKEND' WHEN hour_of_day BETWEEN 6 AND 9 THEN 'AM_PEAK'
            WHEN hour_of_day BETWEEN 15 AND 18 THEN 'PM_PEAK' ELSE 'OFF_PEAK' END AS peak_period
FROM enriched0"""
    c["enriched"] = f"""SELECT * FROM enriched_raw
WHERE observed_pct >= 20 AND vc_ratio >= 0"""
    aggs = ", ".join(f"{v} AS {k}" for k, v in FRAME_AGGS_SQL.items())
    c["frames_agg"] = f"SELECT station_id, abs_bucket, {aggs} FROM enriched GROUP BY station_id, abs_bucket"
    c["frames_raw"] = f"""
SELECT a.*, g.freeway, g.direction, g.postmile, g.latitude, g.longitude, g.station_type, g.cell_r7, g.cell_r8,
       g.cell_r8_str, g.cell_r9, g.baseline_capacity_vph, g.baseline_lanes, g.baseline_lane_capacity_vph,
       g.geom_wkt, {_bucket_calendar('a.')},
       {M.level_of_service('a.vc_ratio')} AS level_of_service,
       {M.congestion_index('a.avg_speed_mph', 'a.free_flow_speed_mph')} AS congestion_index,
       {dow(local_ts('a.abs_bucket * 3'))} IN (1, 7) AS is_weekend
FROM frames_agg a JOIN stations_geo g ON g.station_id = a.station_id"""
    c["frames"] = """SELECT * FROM frames_raw
WHERE avg_speed_mph > 0 AND avg_speed_mph <= 100 AND avg_flow_vph >= 0 AND baseline_capacity_vph > 0"""
    corr_aggs = {
        "station_count": "count(DISTINCT station_id)",
        "avg_demanded_flow_vph": f"CAST({mean_rounded('demanded_flow_vph', 0, 0)} AS INT)",
        "sum_demanded_flow_vph": "CAST(sum(demanded_flow_vph) AS BIGINT)",
        "avg_flow_vph": f"CAST({mean_rounded('total_flow_vph', 0, 0)} AS INT)",
        "sum_flow_vph": "CAST(sum(total_flow_vph) AS BIGINT)",
        "avg_speed_mph": mean_rounded("avg_speed_mph", 1, 1),
        "min_speed_mph": "min(avg_speed_mph)",
        "avg_occupancy": "floor(sum(round(avg_occupancy * 1e4)) / count(avg_occupancy) + 5e-1) / 1e4",
        "vc_ratio": mean_rounded("vc_ratio", 4, 4),
        "max_vc_ratio": "max(vc_ratio)",
        "served_vc_ratio": "floor(sum(round(served_vc_ratio * 1e4)) / count(served_vc_ratio) + 5e-1) / 1e4",
        "max_served_vc_ratio": "max(served_vc_ratio)",
        "baseline_capacity_vph": "sum(baseline_capacity_vph)",
        "baseline_lane_count": "CAST(sum(baseline_lanes) AS BIGINT)",
        "baseline_lane_capacity_vph": "floor(sum(baseline_lane_capacity_vph) / (count(*) * 1e-1) + 5e-1) / 1e1",
        "effective_capacity_vph": "floor(CAST(sum(CAST(floor(effective_capacity_vph * 1e6 + 5e-1) AS BIGINT)) AS DOUBLE) / 1e6 * 1e1 + 5e-1) / 1e1",
        "free_flow_speed_mph": mean_rounded("free_flow_speed_mph", 2, 1),
        "avg_delay_min_per_mi": mean_rounded("delay_vs_freeflow_min_per_mi", 4, 4),
        "congested_station_samples": "count_if(is_congested)",
        "sample_count": "count(*)",
        "incident_samples": "count_if(incident_active)",
        "max_incident_severity": "max(incident_severity)",
        "min_postmile": "min(postmile)",
        "max_postmile": "max(postmile)",
    }
    c["corridor_agg"] = (f"SELECT freeway, direction, abs_bucket, {', '.join(f'{v} AS {k}' for k, v in corr_aggs.items())}"
                         f" FROM enriched GROUP BY freeway, direction, abs_bucket")
    length = rnd("max_postmile - min_postmile", 2)
    c["corridor0"] = f"""
SELECT *, {_bucket_calendar()}, {M.level_of_service('vc_ratio')} AS level_of_service,
       {rnd('1e2 * congested_station_samples / GREATEST(1, sample_count)', 2)} AS congested_pct,
       {length} AS corridor_length_mi,
       {rnd(f'sum_flow_vph * {K.INTERVAL_MINUTES / 60.0!r} * ({length} / GREATEST(1, station_count))', 1)} AS vmt
FROM corridor_agg"""
    c["corridor_raw"] = f"""
SELECT * EXCLUDE (abs_bucket), {rnd('vmt / GREATEST(1e0, avg_speed_mph)', 2)} AS vht,
       {rnd('vmt * avg_delay_min_per_mi / 6e1', 2)} AS total_delay_veh_hours,
       day_of_week IN (1, 7) AS is_weekend,
       CASE WHEN day_of_week IN (1, 7) THEN 'WEEKEND' WHEN hour_of_day BETWEEN 6 AND 9 THEN 'AM_PEAK'
            WHEN hour_of_day BETWEEN 15 AND 18 THEN 'PM_PEAK' ELSE 'OFF_PEAK' END AS peak_period
FROM corridor0"""
    c["corridor"] = """SELECT * FROM corridor_raw WHERE station_count > 0 AND avg_speed_mph > 0 AND avg_speed_mph <= 100
  AND baseline_capacity_vph > 0 AND level_of_service IN ('A', 'B', 'C', 'D', 'E', 'F')"""
    return c


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    c = ctes()
    if extra:
        c.update(extra)
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in c.items()) + "\n" + body


def dashboard_ctes() -> dict[str, str]:
    c: dict[str, str] = {}
    c["scoped_frames"] = ("SELECT f.*, s.scope FROM frames f, "
                          "(SELECT unnest(['ALL', f2.freeway]) AS scope, f2.station_id AS sid, f2.abs_bucket AS ab "
                          " FROM frames f2) s WHERE s.sid = f.station_id AND s.ab = f.abs_bucket")
    c["station_index"] = """
SELECT reading_date, scope, station_id,
       CAST(row_number() OVER (PARTITION BY reading_date, scope ORDER BY station_id) - 1 AS INT) AS station_idx
FROM (SELECT DISTINCT reading_date, scope, station_id FROM scoped_frames)"""
    c["tm_cells"] = """
SELECT i.reading_date, i.scope, b.bucket_idx, i.station_id, i.station_idx,
       CAST(b.bucket_idx // 24 * 24 AS INT) AS from_bucket,
       COALESCE(CAST(f.avg_flow_vph AS INT), -1) AS flow,
       COALESCE(CAST(floor(f.avg_speed_mph * 2e0 + 5e-1) AS INT), -1) AS speed_half,
       COALESCE(CAST(floor(f.vc_ratio * 1e2 + 5e-1) AS INT), -1) AS vc_pct,
       COALESCE(CAST(CASE WHEN f.incident_active THEN COALESCE(f.max_incident_severity, 1) ELSE 0 END AS INT), 0)
         AS incident
FROM station_index i
JOIN (SELECT reading_date, scope, unnest(generate_series(0, 95)) AS bucket_idx
      FROM (SELECT DISTINCT reading_date, scope FROM scoped_frames)) b
  ON b.reading_date = i.reading_date AND b.scope = i.scope
LEFT JOIN scoped_frames f ON f.reading_date = i.reading_date AND f.scope = i.scope
  AND f.bucket_idx = b.bucket_idx AND f.station_id = i.station_id"""
    c["hex_agg"] = f"""
SELECT reading_date, scope, bucket_idx, lower(hex(cell_r7_p5)) AS hex_id,
       CAST(floor(SUM(CAST(floor(congestion_index * 1e4 + 5e-1) AS BIGINT)) / (COUNT(congestion_index) * 1e2)
            + 5e-1) AS INT) AS congestion_pct,
       CAST(floor(SUM(CAST(floor(avg_speed_mph * 1e1 + 5e-1) AS BIGINT)) / (COUNT(avg_speed_mph) * 5e0)
            + 5e-1) AS INT) AS speed_half
FROM (SELECT f.*, g.cell_r7_p5 FROM scoped_frames f JOIN stations_geo g ON g.station_id = f.station_id)
GROUP BY ALL"""
    c["hex_dim"] = """
SELECT reading_date, scope, hex_id,
       CAST(row_number() OVER (PARTITION BY reading_date, scope ORDER BY hex_id) - 1 AS INT) AS hex_idx
FROM (SELECT DISTINCT reading_date, scope, hex_id FROM hex_agg)"""
    c["hex_dense"] = """
SELECT b.reading_date, b.scope, b.bucket_idx, h.hex_idx, h.hex_id, CAST(b.bucket_idx // 24 * 24 AS INT) AS from_bucket,
       COALESCE(a.congestion_pct, -1) AS congestion_pct, COALESCE(a.speed_half, 0) AS speed_half
FROM (SELECT reading_date, scope, unnest(generate_series(0, 95)) AS bucket_idx
      FROM (SELECT DISTINCT reading_date, scope FROM hex_agg)) b
JOIN hex_dim h ON h.reading_date = b.reading_date AND h.scope = b.scope
LEFT JOIN hex_agg a ON a.reading_date = b.reading_date AND a.scope = b.scope AND a.bucket_idx = b.bucket_idx
  AND a.hex_id = h.hex_id"""
    return c


def packed_select(src: str, keys: str, values: list[str], index: str) -> str:
    strs = ", ".join(f"string_agg(CAST({v} AS VARCHAR), ',' ORDER BY bucket_idx, {index}) AS {v}" for v in values)
    return (f"SELECT {keys}, CAST(count(*) AS INT) AS n, CAST(min(bucket_idx) AS INT) AS first_bucket,"
            f" CAST(max(bucket_idx) AS INT) AS last_bucket, CAST(count(DISTINCT {index}) AS INT) AS stations, {strs}"
            f" FROM {src} GROUP BY {keys}")


def quality_sql() -> str:
    """Violations of every expectation, written out from its definition and counted stage by stage."""
    speed, graded = "avg_speed_mph > 0 AND avg_speed_mph <= 100", "level_of_service IN ('A', 'B', 'C', 'D', 'E', 'F')"
    stages = {
        "stations": ("stations", [
            ("identified", "fail", "station_id IS NOT NULL"), ("id_is_short", "fail", "length(station_id) BETWEEN 3 AND 16"),
            ("inside_the_state", "drop", "latitude BETWEEN 32.50 AND 42.05 AND longitude BETWEEN -124.50 AND -114.10"),
            ("has_a_direction", "drop", "direction IN ('N', 'S', 'E', 'W')"), ("lanes_possible", "drop", "num_lanes BETWEEN 1 AND 8"),
            ("lane_capacity_possible", "drop", "lane_capacity_vph BETWEEN 1000 AND 2400"),
            ("has_capacity", "drop", "num_lanes * lane_capacity_vph > 0"), ("starts_after_mile_zero", "warn", "postmile >= 0")]),
        "incidents": ("incidents", [
            ("identified", "fail", "incident_id IS NOT NULL"), ("at_a_station", "drop", "station_id IS NOT NULL"),
            ("ends_after_start", "drop", "end_slot > start_slot"), ("severity_known", "drop", "severity BETWEEN 1 AND 4"),
            ("blocks_own_lanes", "drop", "lanes_blocked BETWEEN 0 AND num_lanes"), ("not_overlong", "warn", "5 * (end_slot - start_slot) <= 360")]),
        "readings": ("bronze_raw", [
            ("placed_and_dated", "fail", "station_id IS NOT NULL AND ts IS NOT NULL"),
            ("flows_possible", "drop", "demanded_flow_vph >= 0 AND total_flow_vph >= 0 AND total_flow_vph <= 20000"),
            ("serves_at_most_demand", "drop", "total_flow_vph <= demanded_flow_vph"), ("speed_possible", "drop", speed),
            ("shares_are_shares", "drop", "avg_occupancy BETWEEN 0 AND 1 AND observed_pct BETWEEN 0 AND 100"),
            ("reports_own_lanes", "drop", "num_lanes_reporting BETWEEN 0 AND num_lanes")]),
        "enriched": ("enriched_raw", [
            ("observed_enough", "drop", "observed_pct >= 20"), ("load_not_negative", "drop", "vc_ratio >= 0"), ("graded", "drop", graded),
            ("delay_not_negative", "warn", "delay_vs_freeflow_min_per_mi >= 0"), ("load_plausible", "warn", "vc_ratio <= 3")]),
        "frames": ("frames_raw", [
            ("placed", "fail", "station_id IS NOT NULL"), ("speed_possible", "drop", speed), ("flow_not_negative", "drop", "avg_flow_vph >= 0"),
            ("has_capacity", "drop", "baseline_capacity_vph > 0")]),
        "corridors": ("corridor_raw", [
            ("placed_and_dated", "fail", "freeway IS NOT NULL AND time_bucket IS NOT NULL"), ("has_stations", "drop", "station_count > 0"),
            ("speed_possible", "drop", speed), ("has_capacity", "drop", "baseline_capacity_vph > 0"), ("graded", "drop", graded),
            ("travel_not_negative", "warn", "vmt >= 0")]),
    }
    return with_ctes(" UNION ALL ".join(
        f"SELECT '{stage}' AS stage, '{rule}' AS rule, '{action}' AS action, count(*) FILTER (WHERE ({good}) IS NOT TRUE) AS violations,"
        f" count(*) AS rows FROM {src}" for stage, (src, rules) in stages.items() for rule, action, good in rules))
