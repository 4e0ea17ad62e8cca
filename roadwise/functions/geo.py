"""Geometry as SQL expressions (SURVEY 2I: J1-J4, J12; F3's bearing formula).

Open-source Spark has no H3 or ST_* functions, so hexagon cells come from a projected
axial hexagon grid. It is *not* H3: ids differ, and a parent cell does not exactly contain
its children (the parent is the coarse cell holding the fine cell's centre).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .numeric import lit

# Equirectangular projection to kilometres around a fixed reference latitude.
REF_LAT_DEG = 37.0
KM_PER_DEG_LAT = math.pi / 180.0 * K.EARTH_RADIUS_MI * 1.609344
KM_PER_DEG_LON = KM_PER_DEG_LAT * math.cos(math.radians(REF_LAT_DEG))
# Hexagon edge length per resolution: an aperture-7 ladder from a 1107.71 km base edge.
BASE_EDGE_KM = 1107.71
SQRT3 = math.sqrt(3.0)
# id packing: res * 2^56 + (q + 2^27) * 2^28 + (r + 2^27)
RES_MUL, Q_MUL, OFF = 2 ** 56, 2 ** 28, 2 ** 27


def edge_km(res: int) -> float:
    return BASE_EDGE_KM / (math.sqrt(7.0) ** res)


def origin_km(res: int) -> tuple[float, float]:
    """Per-resolution grid origin shift (fractions of an edge), so the centre of a fine
    cell never lies exactly on a coarse cell's border and the parent is well defined."""
    s = edge_km(res)
    return 0.3141592653589793 * s, 0.2718281828459045 * s


def haversine_m(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance in metres on a sphere."""
    a = (f"POW(SIN((RADIANS({lat2}) - RADIANS({lat1})) / 2e0), 2) + COS(RADIANS({lat1})) * COS(RADIANS({lat2}))"
         f" * POW(SIN(RADIANS(({lon2}) - ({lon1})) / 2e0), 2)")
    return f"(2e0 * {lit(K.EARTH_RADIUS_M)} * ASIN(SQRT({a})))"


def haversine_mi(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"({haversine_m(lat1, lon1, lat2, lon2)} / {lit(K.METRES_PER_MILE)})"


def bearing_deg(lat: str, dlat: str, dlon: str) -> str:
    """local heading, pmod(degrees(atan2(dlon * cos(lat), dlat)), 360)."""
    return f"pmod(DEGREES(ATAN2(RADIANS({dlon}) * COS(RADIANS({lat})), RADIANS({dlat}))), 36e1)"


def bearing_diff(b1: str, b2: str) -> str:
    """Smallest absolute difference of two headings, 0..180."""
    return f"ABS(pmod(({b1}) - ({b2}) + 18e1, 36e1) - 18e1)"


def with_hex_cell(df: DataFrame, lon: str, lat: str, res: int, name: str) -> DataFrame:
    """Add ``name`` = BIGINT id of the hexagon holding (lon, lat) at ``res``.

    Cube rounding runs in staged columns, each intermediate computed once."""
    s = edge_km(res)
    ox, oy = origin_km(res)
    t = f"_{name}_"
    x = f"(({lon}) * {lit(KM_PER_DEG_LON)} + {lit(ox)})"
    y = f"(({lat}) * {lit(KM_PER_DEG_LAT)} + {lit(oy)})"
    df = df.selectExpr("*", f"({lit(SQRT3 / 3.0)} * {x} - {y} / 3e0) / {lit(s)} AS {t}q",
                       f"(2e0 / 3e0 * {y}) / {lit(s)} AS {t}r")
    q, r = t + "q", t + "r"
    df = df.selectExpr("*", f"FLOOR({q} + 5e-1) AS {t}rx", f"FLOOR({r} + 5e-1) AS {t}rz",
                       f"FLOOR(-{q} - {r} + 5e-1) AS {t}ry")
    df = df.selectExpr("*", f"ABS({t}rx - {q}) AS {t}dx", f"ABS({t}rz - {r}) AS {t}dz",
                       f"ABS({t}ry + {q} + {r}) AS {t}dy")
    fix_x = f"({t}dx > {t}dy AND {t}dx > {t}dz)"
    fix_y = f"(NOT {fix_x} AND {t}dy > {t}dz)"
    qx = f"CAST(CASE WHEN {fix_x} THEN -{t}ry - {t}rz ELSE {t}rx END AS BIGINT)"
    qz = f"CAST(CASE WHEN NOT {fix_x} AND NOT {fix_y} THEN -{t}rx - {t}ry ELSE {t}rz END AS BIGINT)"
    # Non-nullable (-1 when a coordinate is missing): no null-check predicate is inferred on
    # the id and pushed back through the staged columns above.
    tmp = {t + c for c in ("q", "r", "rx", "ry", "rz", "dx", "dy", "dz")}
    keep = [f"`{c}`" for c in df.columns if c not in tmp]
    return df.selectExpr(*keep, f"COALESCE(CAST({res} * {RES_MUL} + ({qx} + {OFF}) * {Q_MUL} + ({qz} + {OFF})"
                                f" AS BIGINT), CAST(-1 AS BIGINT)) AS {name}")


def _cell_rest(cell: str) -> str:
    return f"({cell} - CAST(FLOOR({cell} / {RES_MUL}) AS BIGINT) * {RES_MUL})"


def cell_q(cell: str) -> str:
    return f"(CAST(FLOOR({_cell_rest(cell)} / {Q_MUL}) AS BIGINT) - {OFF})"


def cell_r(cell: str) -> str:
    return f"({_cell_rest(cell)} - ({cell_q(cell)} + {OFF}) * {Q_MUL} - {OFF})"


def cell_centre(cell: str, res: int) -> tuple[str, str]:
    """(lon, lat) of a cell centre; ``res`` must be the cell's resolution."""
    s = edge_km(res)
    ox, oy = origin_km(res)
    q, r = cell_q(cell), cell_r(cell)
    x = f"{lit(s)} * ({lit(SQRT3)} * {q} + {lit(SQRT3 / 2.0)} * {r}) - {lit(ox)}"
    y = f"{lit(s)} * (15e-1 * {r}) - {lit(oy)}"
    return f"({x}) / {lit(KM_PER_DEG_LON)}", f"({y}) / {lit(KM_PER_DEG_LAT)}"


def with_cell_parent(df: DataFrame, cell: str, res: int, parent_res: int, name: str) -> DataFrame:
    """The coarse cell that contains the fine cell's centre (staged columns)."""
    t = f"_{name}_p"
    s = edge_km(res)
    ox, oy = origin_km(res)
    df = df.withColumn(t + "rest", F.expr(f"{cell} - CAST(FLOOR({cell} / {RES_MUL}) AS BIGINT) * {RES_MUL}"))
    df = df.withColumn(t + "q", F.expr(f"CAST(FLOOR({t}rest / {Q_MUL}) AS BIGINT) - {OFF}"))
    df = df.withColumn(t + "r", F.expr(f"{t}rest - ({t}q + {OFF}) * {Q_MUL} - {OFF}"))
    df = df.withColumns({
        t + "lon": F.expr(f"({lit(s)} * ({lit(SQRT3)} * {t}q + {lit(SQRT3 / 2.0)} * {t}r) - {lit(ox)})"
                          f" / {lit(KM_PER_DEG_LON)}"),
        t + "lat": F.expr(f"({lit(s)} * (15e-1 * {t}r) - {lit(oy)}) / {lit(KM_PER_DEG_LAT)}")})
    out = with_hex_cell(df, t + "lon", t + "lat", parent_res, name)
    return out.drop(t + "rest", t + "q", t + "r", t + "lon", t + "lat")


def cell_string(cell: str) -> str:
    """Hex string form of a cell id."""
    return f"lower(hex({cell}))"


def cell_boundary_wkt(q: str, r: str, res: int) -> str:
    """POLYGON WKT (closed ring of six corners, lon/lat with 6 decimals) of the cell
    with axial coordinates (q, r); pass decoded columns (see ``cell_q``/``cell_r``)."""
    s = edge_km(res)
    ox, oy = origin_km(res)
    cx = f"({lit(s)} * ({lit(SQRT3)} * {q} + {lit(SQRT3 / 2.0)} * {r}) - {lit(ox)})"
    cy = f"({lit(s)} * (15e-1 * {r}) - {lit(oy)})"
    pts = []
    for i in list(range(6)) + [0]:
        ang = math.radians(60 * i + 30)
        px = f"({cx} + {lit(s * math.cos(ang))}) / {lit(KM_PER_DEG_LON)}"
        py = f"({cy} + {lit(s * math.sin(ang))}) / {lit(KM_PER_DEG_LAT)}"
        pts.append(f"format_string('%.6f %.6f', {px}, {py})")
    return f"concat('POLYGON((', concat_ws(', ', {', '.join(pts)}), '))')"


def point_wkt(lon: str, lat: str) -> str:
    """POINT(lon lat) with 6 decimals."""
    return f"format_string('POINT(%.6f %.6f)', {lon}, {lat})"


def carriageway_offset(value: str, direction: str, step: float = 0.00035) -> str:
    """Shift a coordinate +step for N/E carriageways and -step otherwise."""
    inbound = ", ".join(repr(d) for d in K.INBOUND_DIRECTIONS)
    return f"(({value}) + CASE WHEN {direction} IN ({inbound}) THEN {lit(step)} ELSE {lit(-step)} END)"
