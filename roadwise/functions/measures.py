"""Traffic measures as Spark SQL expression builders.

Arguments are SQL expressions (usually column names); results are SQL text, used through
``numeric.E`` / ``selectExpr``. No UDFs: everything fuses into whole-stage codegen.
"""

from __future__ import annotations

from .. import constants as K
from .numeric import clamp, lit, rnd, rnd_int


def _case(subject: str, mapping: dict, default: str) -> str:
    arms = " ".join(f"WHEN {subject} = {k!r} THEN {v}" for k, v in mapping.items())
    return f"(CASE {arms} ELSE {default} END)"


# --- B1-B4: demand profile and urbanisation -----------------------------------------

def _gauss(x: str, mu: float, sigma: float) -> str:
    return f"EXP(-POW((({x}) - {lit(mu)}) / {lit(sigma)}, 2) / 2e0)"


def demand_factor(hour_frac: str, is_weekend: str, direction: str) -> str:
    """B1: expected diurnal demand share for a local fractional hour."""
    inbound = f"{direction} IN ({', '.join(repr(d) for d in K.INBOUND_DIRECTIONS)})"
    w_am = f"(CASE WHEN {inbound} THEN {lit(K.AM_WEIGHT_INBOUND)} ELSE {lit(K.AM_WEIGHT_OUTBOUND)} END)"
    w_pm = f"(CASE WHEN {inbound} THEN {lit(K.PM_WEIGHT_INBOUND)} ELSE {lit(K.PM_WEIGHT_OUTBOUND)} END)"
    weekday = (f"({lit(K.WD_BASE)} + {lit(K.AM_AMP)} * {w_am} * {_gauss(hour_frac, K.AM_MU, K.AM_SIGMA)}"
               f" + {lit(K.PM_AMP)} * {w_pm} * {_gauss(hour_frac, K.PM_MU, K.PM_SIGMA)})")
    weekend = f"({lit(K.WE_BASE)} + {lit(K.WE_AMP)} * {_gauss(hour_frac, K.WE_MU, K.WE_SIGMA)})"
    return f"(CASE WHEN {is_weekend} THEN {weekend} ELSE {weekday} END)"


def dow_scale(dow: str) -> str:
    """B2: day-of-week multiplier (dayofweek, 1 = Sunday); 1.0 otherwise."""
    arms = " ".join(f"WHEN {dow} = {k} THEN {lit(v)}" for k, v in sorted(K.DOW_SCALE.items()))
    return f"(CASE {arms} ELSE 1e0 END)"


def lerp_urban(rural: float, urban: float, u: str) -> str:
    """Clamped linear interpolation between a rural and an urban value."""
    return f"({lit(rural)} + {lit(urban - rural)} * {clamp(u, 0.0, 1.0)})"


def free_flow_speed(u: str) -> str:
    return lerp_urban(K.FREE_FLOW_RURAL, K.FREE_FLOW_URBAN, u)


def lane_capacity_vph(u: str) -> str:
    return rnd_int(lerp_urban(float(K.CAPACITY_RURAL_VPL), float(K.CAPACITY_URBAN_VPL), u))


def demand_scale(u: str) -> str:
    return f"({lit(K.DEMAND_SCALE_INTERCEPT)} + {lit(K.DEMAND_SCALE_SLOPE)} * {clamp(u, 0.0, 1.0)})"


def station_type_scale(t: str) -> str:
    """Facility multiplier; an unknown type scales like an off-ramp."""
    return _case(t, {k: lit(v) for k, v in K.STATION_TYPE_SCALE.items()},
                 lit(K.STATION_TYPE_SCALE[K.DEFAULT_STATION_TYPE]))


# --- B5-B10: speed, occupancy, grades, delay ---------------------------------------

def bpr_factor(vc: str, alpha: float = K.BPR_ALPHA, beta: float = K.BPR_BETA) -> str:
    """1 + alpha * max(0, vc)^beta."""
    return f"(1e0 + {lit(alpha)} * POW(GREATEST(0e0, {vc}), {lit(beta)}))"


def bpr_speed(ff: str, vc: str, alpha: float = K.BPR_ALPHA, beta: float = K.BPR_BETA) -> str:
    """Ff / (1 + alpha vc^beta), floored at 8 mph; negative v/c counts as 0."""
    return f"GREATEST({lit(K.MIN_SPEED_MPH)}, ({ff}) / {bpr_factor(vc, alpha, beta)})"


def occupancy(flow: str, speed: str, lanes: str) -> str:
    """Per-lane density * 20 ft / 5280 ft, clamped to [0.002, 0.60]."""
    density = f"((({flow}) / GREATEST(1, {lanes})) / GREATEST(1e0, {speed}))"
    return clamp(f"{density} * {lit(K.EFFECTIVE_VEHICLE_LENGTH_FT)} / {lit(K.FEET_PER_MILE)}",
                 K.MIN_OCCUPANCY, K.MAX_OCCUPANCY)


def level_of_service(vc: str) -> str:
    """HCM grade A..F from demand-based v/c."""
    arms = " ".join(f"WHEN {vc} < {lit(u)} THEN '{g}'" for g, u in K.LOS_THRESHOLDS)
    return f"(CASE {arms} ELSE 'F' END)"


def los_from_speed_vc(speed: str, vc: str) -> str:
    """Live-map grade from speed and v/c; a missing speed grades F."""
    arms = " ".join(f"WHEN {speed} < {lit(u)} THEN '{g}'" for g, u in K.LOS_SPEED_BANDS)
    return (f"(CASE WHEN {speed} IS NULL OR isnan({speed}) THEN 'F'"
            f" WHEN {vc} >= 1e0 OR {speed} < {lit(K.LOS_SPEED_BREAKDOWN_MPH)} THEN 'F' {arms} ELSE 'A' END)")


def delay_min_per_mi(speed: str, ff: str) -> str:
    """max(0, 60/speed - 60/ff), both speeds floored at 1 mph."""
    return f"GREATEST(0e0, 6e1 / GREATEST(1e0, {speed}) - 6e1 / GREATEST(1e0, {ff}))"


def is_congested(speed: str, ff: str) -> str:
    """Speed below 75 % of the station's own free-flow speed."""
    return f"(({speed}) < {lit(K.CONGESTION_SPEED_RATIO)} * ({ff}))"


# --- B11-B17: capacity and flow chain ------------------------------------------------

def incident_capacity_factor(lanes: str, blocked: str) -> str:
    """Open-lane share * (1 - 12 % rubbernecking), floor 0.05."""
    ln = f"CAST({lanes} AS DOUBLE)"
    open_lanes = f"GREATEST(0e0, {ln} - CAST(COALESCE({blocked}, 0) AS DOUBLE))"
    return (f"GREATEST({lit(K.MIN_CAPACITY_FACTOR)}, ({open_lanes} / GREATEST(1e0, {ln}))"
            f" * {lit(1.0 - K.RUBBERNECK_CAPACITY_LOSS)})")


def closure_capacity_factor(lanes: str, closed: str) -> str:
    """Open-lane share for a planned closure (no rubbernecking term), floor 0.05."""
    ln = f"CAST({lanes} AS DOUBLE)"
    open_lanes = f"GREATEST(0e0, {ln} - CAST({closed} AS DOUBLE))"
    return f"GREATEST({lit(K.MIN_CAPACITY_FACTOR)}, {open_lanes} / GREATEST(1e0, {ln}))"


def base_capacity(lanes: str, lane_capacity: str, type_scale: str | None = None) -> str:
    """Lanes * per-lane capacity (* facility scale)."""
    c = f"(CAST({lanes} AS DOUBLE) * CAST({lane_capacity} AS DOUBLE))"
    return c if type_scale is None else f"({c} * {type_scale})"


def effective_capacity(base: str, incident_active: str, lanes: str, blocked: str) -> str:
    """Base capacity reduced by the incident factor while an incident is active."""
    return f"(({base}) * CASE WHEN {incident_active} THEN {incident_capacity_factor(lanes, blocked)} ELSE 1e0 END)"


def demanded_flow(factor: str, base: str) -> str:
    """int(round(factor * base))."""
    return rnd_int(f"({factor}) * ({base})")


def served_flow(demand: str, effective: str) -> str:
    """least(demand, floor(effective capacity))."""
    return f"LEAST({demand}, CAST(FLOOR({effective}) AS INT))"


def vc_ratio(flow: str, effective: str) -> str:
    """round(flow / greatest(1, capacity), 4)."""
    return rnd(f"({flow}) / GREATEST(1e0, {effective})", 4)


def jittered_speed(raw_speed: str, jitter: str) -> str:
    """round(least(95, greatest(8, raw * jitter)), 1)."""
    return rnd(clamp(f"({raw_speed}) * ({jitter})", K.MIN_SPEED_MPH, K.MAX_SPEED_MPH), 1)


def lanes_reporting(lanes: str, observed_pct: str) -> str:
    """round(lanes * observed% / 100)."""
    return rnd_int(f"({lanes}) * ({observed_pct}) / 1e2")


def observed_pct_for_health(health: str, draw: str) -> str:
    """Dark 0, degraded 35..80, otherwise 96..100, from a uniform draw."""
    return (f"(CASE {health} WHEN 'dark' THEN 0e0 WHEN 'degraded' THEN {rnd(f'35e0 + 45e0 * ({draw})', 1)}"
            f" ELSE {rnd(f'96e0 + 4e0 * ({draw})', 1)} END)")


# --- B18-B21: ratios and extensive measures ----------------------------------------

def speed_ratio(speed: str, ff: str) -> str:
    return rnd(f"({speed}) / ({ff})", 4)


def congestion_index(speed: str, ff: str) -> str:
    """clamp(1 - speed/ff, 0, 1), 4 decimals."""
    return rnd(clamp(f"1e0 - ({speed}) / ({ff})", 0.0, 1.0), 4)


def station_vmt(served: str, seg_len_mi: str, bucket_hours: float = K.BUCKET_HOURS) -> str:
    """Served vph * bucket hours * segment miles."""
    return f"(({served}) * {lit(bucket_hours)} * ({seg_len_mi}))"


def station_vht(vmt: str, speed: str) -> str:
    return f"(({vmt}) / GREATEST(1e-9, {speed}))"


def delay_vht(vmt: str, speed: str, ff: str) -> str:
    """VMT * (1/speed - 1/ff)."""
    return f"(({vmt}) * (1e0 / GREATEST(1e-9, {speed}) - 1e0 / GREATEST(1e-9, {ff})))"


# --- B22-B27: payload scaling, scenario classes, labels ------------------------------

def scaled_int(x: str, factor: float) -> str:
    """round(value * factor) as INT (speed*2, v/c*100, delay*100)."""
    return rnd_int(f"({x}) * {lit(factor)}")


def capacity_loss_severity(cap_scen: str, cap_obs: str) -> str:
    """0 unless capacity fell below 99.9 % of observed, else ceil(loss*4) in 1..4."""
    loss = f"(1e0 - ({cap_scen}) / GREATEST(1e-9, {cap_obs}))"
    return (f"CAST(CASE WHEN ({cap_scen}) < ({cap_obs}) * {lit(K.CAP_LOSS_SEVERITY_TOLERANCE)}"
            f" THEN LEAST(4, GREATEST(1, CAST(CEIL({loss} * 4e0) AS INT))) ELSE 0 END AS INT)")


def speed_change_class(delta: str) -> str:
    """Worse below -0.25 mph, better above +0.25 mph, else same."""
    return f"(CASE WHEN ({delta}) < -25e-2 THEN 'worse' WHEN ({delta}) > 25e-2 THEN 'better' ELSE 'same' END)"


def speed_change_magnitude(delta: str) -> str:
    """min(1, |delta| / 18)."""
    return f"LEAST(1e0, ABS({delta}) / 18e0)"


def unserved_demand(demand: str, served: str) -> str:
    """Demanded - served (vph)."""
    return f"(({demand}) - ({served}))"


def unserved_pct(demand: str, served: str) -> str:
    """Percent of demand unserved; NULL unless demand is positive."""
    return f"(CASE WHEN ({demand}) > 0 THEN 1e2 * (({demand}) - ({served})) / ({demand}) END)"
