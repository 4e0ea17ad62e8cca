"""Steps of demand reassignment over patches of the network (SURVEY: K6, F5, F6).

A sum over neighbours needs only the stations around a cell, never its pairs as rows: with some
hundred neighbours a station, the product of cells and pairs is what fills disks. So the cells of a
station and day are one row (a sheet: an array over the buckets of the day), and a step deals the sheets
to patches of ``PATCH`` degrees, each also to the patches within two hops. A task then holds a patch, a day
and the stations around it, finds the weights from their positions (those of ``network.candidates``) in
blocks of ``ROWS`` stations, and returns its own stations' sheets. What is shuffled a step is the
sheets, about twice; a patch holds a bounded stretch of land whatever the size of the network.

State holds only cells that a lever or a neighbour reached; all others are NaN in a sheet, and
stand as observed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import lit
from ..operators.spatial import range_band_join

PATCH = 0.25
ROWS = 512
DAY = K.BUCKETS_PER_DAY
ARRAYS = ("x", "leak", "cap", "d_lever")
SHEET = "run int, day int, station_num long, latitude double, longitude double, " + ", ".join(f"{a} array<double>" for a in ARRAYS)


def sheets(cells: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """One row per ``keys`` and day, with every value as an array over the buckets of the day (null: no cell)."""
    entry = ", ".join(f"'{n}', CAST({v} AS DOUBLE)" for n, v in values.items())
    by = cells.selectExpr(*keys, f"CAST(slot DIV {DAY} AS INT) AS day", f"struct(CAST(slot % {DAY} AS INT) AS b, named_struct({entry}) AS v) AS e")
    by = by.groupBy(*keys, "day").agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    return by.selectExpr(*keys, "day", *[f"transform(sequence(0, {DAY - 1}), b -> m[b].{n}) AS {n}" for n in values])


def cells_of(state: DataFrame) -> DataFrame:
    """The cells of sheets: (run, slot, station_num, and the arrays' values)."""
    rows = state.selectExpr("run", "day", "station_num", f"posexplode(arrays_zip({', '.join(ARRAYS)})) AS (b, v)").where("NOT isnan(v.x)")
    return rows.selectExpr("run", f"CAST(day * {DAY} + b AS INT) AS slot", "station_num", *[f"v.{a} AS {a}" for a in ARRAYS])


def reach(segments: DataFrame) -> tuple[float, float]:
    """Degrees of latitude and longitude within which all neighbours of a station lie."""
    lat = K.PARALLEL_MAX_DIST_M / (math.pi / 180.0 * K.EARTH_RADIUS_M)
    lon = lat / math.cos(math.radians(K.CA_MAX_LAT))
    own = segments.select("station_id", "freeway", "direction", "postmile", "latitude", "longitude")
    far = range_band_join(own, own, ["freeway", "direction"], "postmile", K.SAME_CORRIDOR_MAX_PM).selectExpr(
        "max(ABS(l_latitude - r_latitude)) AS lat", "max(ABS(l_longitude - r_longitude)) AS lon").first()
    return 1.001 * max(lat, far["lat"] or 0.0), 1.001 * max(lon, far["lon"] or 0.0)


def patch(near: float) -> float:
    """Degrees of a patch: two hops at least, as ``PATCH`` doubled so many times, so that rows of patches are whole tiles."""
    return PATCH * 2 ** max(0, math.ceil(math.log2(2 * near / PATCH))) if near > 0 else PATCH


def dealt(df: DataFrame, near: tuple[float, float]) -> DataFrame:
    """Every sheet once for each patch within two hops, ``own`` in its own."""
    size = [patch(r) for r in near]
    for name, c, s, r in (("py", "latitude", size[0], near[0]), ("px", "longitude", size[1], near[1])):
        cell = f"CAST(FLOOR(({c} {{}}) / {lit(s)}) AS INT)"
        df = df.selectExpr("*", f"{cell.format('')} AS own_{name}", f"explode(sequence({cell.format(f'- {lit(2 * r)}')}, {cell.format(f'+ {lit(2 * r)}')})) AS {name}")
    return df.withColumn("own", F.expr("py = own_py AND px = own_px")).drop("own_py", "own_px")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DAY)


class Land:
    """The stations of a patch and around it, in order of latitude, and their weights."""

    def __init__(self, t: pa.Table):
        order = np.argsort(t["latitude"].to_numpy(), kind="stable")
        take = lambda c: t[c].to_numpy()[order]
        self.num, self.own = take("station_num"), t["own"].to_numpy(zero_copy_only=False)[order]
        self.lat, self.lon, self.pm, self.heading = take("latitude"), take("longitude"), take("postmile"), take("bearing_deg")
        self.freeway = np.unique(take("freeway").astype(str), return_inverse=True)[1]
        self.way = np.unique(np.char.add(np.char.add(take("freeway").astype(str), "|"), take("direction").astype(str)), return_inverse=True)[1]
        self.demand, self.cap = _matrix(t["x"])[order], _matrix(t["cap"])[order]
        self.by_num = np.argsort(self.num)

    def place(self, num: np.ndarray) -> np.ndarray:
        return self.by_num[np.searchsorted(self.num, num, sorter=self.by_num)]

    def weights(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, columns, weights between them) of blocks of ``rows``: every pair of ``network.candidates``."""
        dlat = 1.001 * K.PARALLEL_MAX_DIST_M / (math.pi / 180.0 * K.EARTH_RADIUS_M)
        lat, lon = np.radians(self.lat), self.lon
        for a in range(0, len(rows), ROWS):
            i = rows[a:a + ROWS]
            near = (self.lat >= self.lat[i].min() - dlat) & (self.lat <= self.lat[i].max() + dlat)
            near |= (np.isin(self.way, self.way[i]) & (self.pm >= self.pm[i].min() - K.SAME_CORRIDOR_MAX_PM)
                     & (self.pm <= self.pm[i].max() + K.SAME_CORRIDOR_MAX_PM))
            j = np.flatnonzero(near)
            h = (np.sin((lat[j][None] - lat[i][:, None]) / 2) ** 2
                 + np.cos(lat[i])[:, None] * np.cos(lat[j])[None] * np.sin(np.radians(lon[j][None] - lon[i][:, None]) / 2) ** 2)
            dist = 2 * K.EARTH_RADIUS_M * np.arcsin(np.sqrt(h))
            turn = np.abs(np.mod(self.heading[i][:, None] - self.heading[j][None] + 180.0, 360.0) - 180.0)
            parallel = (self.freeway[i][:, None] != self.freeway[j][None]) & (dist <= K.PARALLEL_MAX_DIST_M) & (turn <= K.PARALLEL_MAX_BEARING_DEG)
            along = np.abs(self.pm[i][:, None] - self.pm[j][None])
            same = (self.way[i][:, None] == self.way[j][None]) & (along <= K.SAME_CORRIDOR_MAX_PM) & (i[:, None] != j[None])
            yield i, j, np.where(parallel, 1.0 / (1.0 + dist / 1e3), 0.0) + np.where(same, 0.5 / (1.0 + along), 0.0)


def step_of(k: int, share: float, off: float):
    """The function of a patch and a day: K6's step ``k`` (see ``scenario.step`` for the formulas)."""
    fields = [("run", pa.int32()), ("day", pa.int32()), ("station_num", pa.int64()), ("latitude", pa.float64()), ("longitude", pa.float64()),
              *[(a, pa.list_(pa.float64())) for a in ARRAYS]]
    schema = pa.schema(fields)

    def run(t: pa.Table) -> pa.Table:
        is_state = t["run"].to_numpy() >= 0
        state = t.filter(pa.array(is_state))
        if not state.num_rows:
            return schema.empty_table()
        land = Land(t.filter(pa.array(~is_state)))
        runs, r = np.unique(state["run"].to_numpy(), return_inverse=True)
        n, at = len(land.num), land.place(state["station_num"].to_numpy())
        own_state = state["own"].to_numpy(zero_copy_only=False)
        wide = lambda m: np.repeat(m[:, None, :], len(runs), axis=1)
        x, cap, given = wide(land.demand), wide(land.cap), _matrix(state["x"])
        reached, seen = np.zeros(x.shape, dtype=bool), ~np.isnan(given)
        reached[at, r] = seen
        x[at, r] = np.where(seen, given, x[at, r])
        cap[at, r] = np.where(seen, _matrix(state["cap"]), cap[at, r])
        base = np.maximum(0.0, land.demand - land.cap)[:, None, :]
        excess = np.where(reached, np.maximum(0.0, x - cap - base), 0.0)
        room = np.nan_to_num(np.maximum(0.0, cap - x))
        flat = lambda m: m.reshape(n, -1)
        rate, sent = np.zeros_like(x), np.zeros_like(x)
        for i, j, w in land.weights(np.flatnonzero(flat(excess).any(axis=1))):
            attraction = (w @ flat(room)[j]).reshape(len(i), len(runs), DAY)
            goes = attraction > 0
            sent[i] = np.where(goes, excess[i] * (share * (1 - off)), 0.0)
            rate[i] = np.divide(sent[i], attraction, out=np.zeros_like(attraction), where=goes)
        received = np.zeros_like(x)
        own = np.flatnonzero(land.own)
        for i, j, w in land.weights(own):
            received[i] = room[i] * (w @ flat(rate)[j]).reshape(len(i), len(runs), DAY)
        leak, d_lever = np.zeros_like(x), wide(land.demand)
        mine = state.filter(pa.array(own_state))
        if mine.num_rows:
            a, b, s = at[own_state], r[own_state], seen[own_state]
            leak[a, b] = np.where(s, _matrix(mine["leak"]), 0.0)
            d_lever[a, b] = np.where(s, _matrix(mine["d_lever"]), d_lever[a, b])
        lost = excess * (share * off)
        x = np.maximum(0.0, x + (received - sent - lost) / (k + 1))
        leak += lost / (k + 1)
        reached |= received > 0
        keep = reached & land.own[:, None, None]
        i, q = np.nonzero(keep.any(axis=2))
        offsets = pa.array(np.arange(len(i) + 1, dtype=np.int32) * DAY)
        out = [pa.ListArray.from_arrays(offsets, pa.array(np.where(keep[i, q], m[i, q], np.nan).ravel())) for m in (x, leak, cap, d_lever)]
        day = np.full(len(i), t["day"][0].as_py(), dtype=np.int32)
        return pa.Table.from_arrays([pa.array(runs[q].astype(np.int32)), pa.array(day), pa.array(land.num[i]), pa.array(land.lat[i]), pa.array(land.lon[i]), *out],
                                    schema=schema)

    return run


def advance(state: DataFrame, observed: DataFrame, near: tuple[float, float], k: int, share: float, off: float, rows: str = "true", tasks: int | None = None) -> DataFrame:
    """One step: ``state`` and ``observed`` are sheets, the latter with each station's attributes. ``rows`` are
    the rows of patches (``py``) to compute; both hold these and one row around."""
    n = tasks or int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = dealt(state, near).where(rows).withColumns({a: F.when(F.col("own"), F.col(a)) for a in ("leak", "d_lever")})  # of no use around
    both = own.unionByName(dealt(observed, near).where(rows), allowMissingColumns=True)
    # as many tasks as asked for: much work on few bytes, which the adaptive planner would gather
    return both.repartition(n, "py", "px", "day").groupBy("py", "px", "day").applyInArrow(step_of(k, share, off), SHEET)
