"""Model constants.

FIXED VALUES -- these must equal the values the traffic model was defined with, or the
results (grades, speeds, capacity factors) will not match. They are listed plainly here,
in one place, in the order the model uses them.
"""

# --- fixed values: BPR volume-delay curve ------------------------------------------
BPR_ALPHA = 0.55
BPR_BETA = 4.5
MIN_SPEED_MPH = 8.0
MAX_SPEED_MPH = 95.0

# --- fixed values: level of service by v/c (upper bounds, exclusive); above -> F ----
LOS_THRESHOLDS = (("A", 0.35), ("B", 0.55), ("C", 0.77), ("D", 0.92), ("E", 1.00))
LOS_GRADES = ("A", "B", "C", "D", "E", "F")

# --- fixed values: level of service from speed and v/c (live frame KPIs) -------------
# F when v/c >= 1 or speed < 30; then E < 40, D < 50, C < 57, B < 62, else A.
LOS_SPEED_BREAKDOWN_MPH = 30.0
LOS_SPEED_BANDS = (("E", 40.0), ("D", 50.0), ("C", 57.0), ("B", 62.0))

# --- fixed values: congestion, delay, occupancy -------------------------------------
CONGESTION_SPEED_RATIO = 0.75
EFFECTIVE_VEHICLE_LENGTH_FT = 20.0
FEET_PER_MILE = 5280.0
MIN_OCCUPANCY = 0.002
MAX_OCCUPANCY = 0.60

# --- fixed values: capacity factors -------------------------------------------------
RUBBERNECK_CAPACITY_LOSS = 0.12
MIN_CAPACITY_FACTOR = 0.05

# --- fixed values: diurnal demand profile -------------------------------------------
WD_BASE, AM_AMP, AM_MU, AM_SIGMA = 0.16, 0.62, 7.75, 1.15
PM_AMP, PM_MU, PM_SIGMA = 0.72, 17.25, 1.45
WE_BASE, WE_AMP, WE_MU, WE_SIGMA = 0.14, 0.46, 13.5, 3.40
INBOUND_DIRECTIONS = ("N", "E")
AM_WEIGHT_INBOUND, PM_WEIGHT_INBOUND = 1.25, 0.85
AM_WEIGHT_OUTBOUND, PM_WEIGHT_OUTBOUND = 0.85, 1.25
# day-of-week multipliers keyed by Spark dayofweek (1 = Sunday .. 7 = Saturday)
DOW_SCALE = {1: 0.62, 2: 0.98, 3: 1.00, 4: 1.01, 5: 1.02, 6: 1.05, 7: 0.72}

# --- fixed values: urbanisation interpolation ----------------------------------------
FREE_FLOW_RURAL, FREE_FLOW_URBAN = 70.0, 65.0
CAPACITY_RURAL_VPL, CAPACITY_URBAN_VPL = 1950, 2100
DEMAND_SCALE_INTERCEPT, DEMAND_SCALE_SLOPE = 0.45, 0.75
STATION_TYPE_SCALE = {"ML": 1.00, "HV": 0.55, "OR": 0.22, "FR": 0.20}
DEFAULT_STATION_TYPE = "FR"

# --- fixed values: detector health -------------------------------------------------
MIN_OBSERVED_PCT = 20.0

# --- fixed values: bounding box used by the data-quality rules ----------------------
CA_MIN_LAT, CA_MAX_LAT = 32.50, 42.05
CA_MIN_LON, CA_MAX_LON = -124.50, -114.10

# --- fixed values: bounds of the data-quality rules ----------------------------------
STATION_ID_LENGTH = (3, 16)
MAX_LANES = 8
LANE_CAPACITY_RANGE = (1000, 2400)
TOP_SPEED_MPH = 100
TOP_FLOW_VPH = 20000
HIGH_VC = 3.0
LONG_INCIDENT_MIN = 360

# --- fixed values: clock -----------------------------------------------------------
LOCAL_TZ = "America/Los_Angeles"
INTERVAL_MINUTES = 5
FRAME_MINUTES = 15
BUCKETS_PER_DAY = 96
SLOTS_PER_DAY = 288
WINDOW_BUCKETS = 24
BUCKET_HOURS = 0.25
# Peak labels: AM 6..9, PM 15..18 (inclusive hours)
AM_PEAK_HOURS, PM_PEAK_HOURS = (6, 9), (15, 18)

# --- fixed values: scenario engine defaults ------------------------------------------
REASSIGN_SHARE = 0.35
OFFNETWORK_SHARE = 0.3
PARALLEL_MAX_DIST_M = 8000.0
PARALLEL_MAX_BEARING_DEG = 45.0
SAME_CORRIDOR_MAX_PM = 2.0
MSA_ITERATIONS = 4
WORST_N = 10
SNAP_EPS = 1e-6
CAP_LOSS_SEVERITY_TOLERANCE = 0.999
SEGMENT_LEN_MIN_MI, SEGMENT_LEN_MAX_MI, SEGMENT_LEN_DEFAULT_MI = 0.05, 12.0, 0.5
LEVER_PM_PAD_MI = 0.25

# --- fixed values: snapshots --------------------------------------------------------
WORST_CORRIDOR_LIMIT = 8
INCIDENT_LIMIT = 12
FRAME_WORST_CORRIDORS = 5

# --- fixed values: advice vocabulary -------------------------------------------------
ACTION_TYPES = (
    "ramp_metering",
    "lane_reversal",
    "incident_clearance_priority",
    "signal_retiming",
    "demand_shift_messaging",
    "speed_harmonization",
    "shoulder_running",
    "transit_diversion",
    "other",
)
ADVICE_TAGS = ("[advice]", "[/advice]")
ADVICE_FIELDS = (
    "action", "action_type", "target", "target_label", "corridor", "direction", "expected_effect", "effect", "expected",
    "effect_direction", "magnitude", "magnitude_unit", "confidence", "rationale",
)
# how a target names its direction and its route
COMPASS_PATTERN = r"\b([NSEW])B?\b"
BOUND_PATTERN = r"\b(north|south|east|west)bound\b"
ROUTE_PATTERN = r"(?i)\b((?:I|US|SR|CA)-\d+)\b"
EFFECT_DIRECTIONS = ("decrease", "increase", "unclear")
CONFIDENCES = ("low", "medium", "high")
COMPASS = ("N", "S", "E", "W")
MAX_RECOMMENDATIONS = 5

# --- fixed values: earth ------------------------------------------------------------
EARTH_RADIUS_MI = 3958.7613
EARTH_RADIUS_M = EARTH_RADIUS_MI * 1609.344
METRES_PER_MILE = 1609.344

# --- fixed values: incident generation ------------------------------------------------
INCIDENT_RATE_PER_STATION_DAY = 0.28
INCIDENT_TYPE_WEIGHTS = (("collision", 0.34), ("breakdown", 0.38), ("debris", 0.18), ("construction", 0.10))
SEVERITY_WEIGHTS = (("1", 0.52), ("2", 0.30), ("3", 0.14), ("4", 0.04))
INCIDENT_DURATION_MIN = {1: 10, 2: 25, 3: 55, 4: 110}
INCIDENT_DURATION_MAX = {1: 25, 2: 60, 3: 120, 4: 260}
DEMAND_NOISE_SIGMA = 0.08
