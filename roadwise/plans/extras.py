"""Remaining operators as jobs over the given tables (SURVEY: B1-B4, B25, B27,
D12, H1-H8, K14, K18, K20)."""

from __future__ import annotations

import datetime
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K
from ..functions import clock
from ..functions import measures as M
from ..functions.numeric import E, mean_rounded, rnd, rnd_signed
from ..operators.packing import pack_dense
from ..session import release
from ..sources import sinks
from ..sources import tables as S
from . import medallion as MD
from . import scenario as SC
from .memo import plan


@plan
def event_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1-H8 + B26 on the event stream: UTC -> Pacific, 15-minute floor, bucket index and
    label, calendar parts, fractional hour, 5-minute snap, both peak labels."""
    e = S.events(spark, sf_dir, ["event_id", "ts"]).withColumn("local_ts", E(clock.utc_to_local("ts")))
    e = e.withColumns({
        "bucket_idx": E(clock.bucket_idx("local_ts")), "hour_of_day": E("hour(local_ts)"),
        "day_of_week": E(clock.day_of_week("local_ts")), "local_date": E(clock.reading_date("local_ts"))})
    return e.selectExpr(
        "event_id", "local_ts", f"{clock.local_to_utc('local_ts')} AS ts_roundtrip",
        f"{clock.floor_to_minutes('ts')} AS time_bucket", "bucket_idx", f"{clock.bucket_label('bucket_idx')} AS bucket_label",
        "local_date", "hour_of_day", "day_of_week", f"{clock.is_weekend('day_of_week')} AS is_weekend",
        f"{clock.day_name('local_date')} AS day_name", f"{rnd(clock.hour_frac('local_ts'), 6)} AS hour_frac",
        f"{clock.snap_to_slot('CAST(local_date AS TIMESTAMP_NTZ)', clock.hour_frac('local_ts'))} AS slot_start",
        f"{clock.peak_period('day_of_week', 'hour_of_day')} AS peak_period",
        f"{clock.period_label('hour_of_day')} AS period_label")


@plan
def demand_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's expected demand for each frame (diurnal profile at the local hour,
    day-of-week and urban scale, facility-scaled capacity) beside the observed demand."""
    f = MD.frames_table(spark, sf_dir).select("station_id", "reading_date", "bucket_idx", "direction", "day_of_week",
                                        "is_weekend", "avg_demanded_flow_vph", "num_lanes")
    st = S.stations(spark, sf_dir).select("station_id", "urban_intensity", "station_type")
    hour = f"(bucket_idx / 4e0)"
    cap = M.base_capacity("num_lanes", M.lane_capacity_vph("urban_intensity"), M.station_type_scale("station_type"))
    x = f.join(st, "station_id").selectExpr(
        "station_id", "reading_date", "bucket_idx",
        f"{rnd(M.demand_factor(hour, 'is_weekend', 'direction'), 6)} AS demand_factor",
        f"{M.dow_scale('day_of_week')} AS dow_scale",
        f"{rnd(M.demand_scale('urban_intensity'), 6)} AS demand_scale",
        f"{rnd(M.free_flow_speed('urban_intensity'), 6)} AS free_flow_speed_mph",
        f"{M.lane_capacity_vph('urban_intensity')} AS lane_capacity_vph",
        f"{M.station_type_scale('station_type')} AS type_scale",
        f"{rnd(cap, 6)} AS model_capacity_vph", "avg_demanded_flow_vph")
    return x.selectExpr("*", f"{rnd('demand_factor * dow_scale * demand_scale * model_capacity_vph', 3)}"
                             " AS expected_demand_vph")


@plan
def frame_unserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unserved demand (vph and percent of demand) of every frame."""
    return MD.frames_table(spark, sf_dir).selectExpr(
        "station_id", "reading_date", "bucket_idx",
        f"{M.unserved_demand('avg_demanded_flow_vph', 'avg_flow_vph')} AS unserved_vph",
        f"{rnd_signed(M.unserved_pct('avg_demanded_flow_vph', 'avg_flow_vph'), 4)} AS unserved_pct")


@plan
def scenario_speed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scenario cell the speed change, its class and magnitude, and the severe-drop
    flag (more than 8 mph slower)."""
    c = SC.scenario_cells(spark, sf_dir)
    d = "(speed_after - speed_before)"
    return c.selectExpr("scenario_id", "reading_date", "bucket_idx", "station_id",
                        f"{rnd_signed(d, 6)} AS speed_delta", f"{M.speed_change_class(d)} AS change_class",
                        f"{rnd(M.speed_change_magnitude(d), 6)} AS magnitude", f"{d} < -8e0 AS severe_drop")


@plan
def scenario_corridor_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scenario, day, bucket and freeway the baseline mean speed beside the
    scenario mean speed and their difference."""
    c = SC.scenario_cells(spark, sf_dir)
    st = S.stations(spark, sf_dir).select("station_id", "freeway")
    g = c.join(st, "station_id").groupBy("scenario_id", "reading_date", "bucket_idx", "freeway").agg(
        E(mean_rounded("speed_before", 6, 4)).alias("baseline_speed"),
        E(mean_rounded("speed_after", 6, 4)).alias("a"))
    return g.selectExpr("scenario_id", "reading_date", "bucket_idx", "freeway", "baseline_speed",
                        "COALESCE(a, baseline_speed) AS scenario_speed",
                        f"{rnd_signed('COALESCE(a, baseline_speed) - baseline_speed', 4)} AS speed_delta")


#: Station-days of a part of the matrix at least, parts at most while a part holds more than a window of a day for a run.
PART_SHEETS, PARTS = 2_000, 48


@dataclass(frozen=True)
class Part:
    """Rows of the matrix that are packed together: days, windows (the buckets from ``first`` to before ``last``) and every ``of``-th run."""

    days: tuple[datetime.date, ...]
    first: int = 0
    last: int = K.BUCKETS_PER_DAY
    run: int = 0
    of: int = 1

    @property
    def dates(self) -> str:
        return f"reading_date IN ({', '.join(f"DATE '{d}'" for d in self.days)})"

    @property
    def cells(self) -> str:
        return f"{self.dates} AND bucket_idx >= {self.first} AND bucket_idx < {self.last}"


def matrix_parts(sizes: list[tuple[datetime.date, int]], runs: int) -> list[Part]:
    """Days with their number of cells, dealt to parts of about equal size; a row of the matrix is in one part. More
    than one window of a day are dealt by run."""
    w, out, room = K.WINDOW_BUCKETS, [], 0
    size = max(PART_SHEETS * K.BUCKETS_PER_DAY, sum(n for _, n in sizes) // PARTS)
    for day, n in sizes:
        if room and n <= room:
            out[-1] = Part((*out[-1].days, day))
            room -= n
        elif n <= size:
            out.append(Part((day,)))
            room = size - n
        else:
            room = 0
            windows = K.BUCKETS_PER_DAY // w
            together = max(1, size * windows // n)
            of = min(max(1, runs), math.ceil(n / windows / size))
            out += [Part((day,), a * w, min(windows, a + together) * w, r, of) for a in range(0, windows, together) for r in range(of)]
    return out


@plan
def scenario_time_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenario payload per (scenario, day, scope, 24-bucket window), over all stations and
    over each freeway's:
    served flow, speed x2, v/c x100, capacity-loss severity proxy and delay x100; a station
    without a frame in a bucket carries -1 (incident 0). Cells by run are many times the tables, so they are shuffled
    and packed part by part, and the rows of each part stored."""
    from .dashboard import scope_widths, station_index
    index, names = station_index(spark, sf_dir), SC.runs(spark, sf_dir)
    beside, path = SC.beside(spark, sf_dir, K.MSA_ITERATIONS), SC.new_folder(spark, "scenario-matrix")
    seen = {r["reading_date"]: r["count"] for r in beside.groupBy("reading_date").count().collect()}
    days = sorted(r["reading_date"] for r in MD.days_table(spark, sf_dir).select("reading_date").collect() if r["reading_date"] is not None)
    parts = matrix_parts([(d, seen.get(d, 0)) for d in days], names.count())
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(parts)))
    for part in parts or [Part((datetime.date.min,))]:
        idx, own = index.where(part.dates), names.where(f"run % {part.of} = {part.run}")
        places = idx.groupBy("reading_date", "station_id").agg(E("collect_list(struct(scope, station_idx)) AS places"))  # two a station
        # a window of a day lies in few files, and its cells become many: dealt to all tasks while they are few
        obs = beside.where(part.cells).withColumn("own", E(f"filter(own, o -> o.run % {part.of} = {part.run})")).repartition(tasks, "station_id", "bucket_idx")
        obs = obs.join(places, ["reading_date", "station_id"])
        m = SC.rounded(SC.cells_under(obs, own, [*SC.CELL[1:], "places", "los_before", "los_after", *SC.ROUNDED]), [*SC.CELL, "places"])
        cells = m.selectExpr(
            "scenario_id", "reading_date", "bucket_idx", "inline(places)",
            f"COALESCE({M.scaled_int('served_after', 1.0)}, -1) AS flow", f"COALESCE({M.scaled_int('speed_after', 2.0)}, -1) AS speed_half",
            f"COALESCE({M.scaled_int('vc_after', 100.0)}, -1) AS vc_pct",
            f"CAST({M.capacity_loss_severity('cap_scen', 'cap_obs')} AS INT) AS incident", f"COALESCE({M.scaled_int('delay_after', 100.0)}, -1) AS delay_c")
        # dense, so that a reader finds bucket and station from the position alone
        widths = SC.run_days(spark, sf_dir).where(part.dates).join(own, "run").drop("run").join(scope_widths(idx), "reading_date")
        packed = pack_dense(cells, widths, ["scenario_id", "reading_date", "scope"], "bucket_idx", "station_idx",
                            {"flow": -1, "speed_half": -1, "vc_pct": -1, "incident": 0, "delay_c": -1}, part.last, K.WINDOW_BUCKETS, part.first)
        # a row may be hundreds of MB of digits: row groups of few rows, so that a reader holds few
        packed.write.mode("append").options(**{"compression": "zstd", "parquet.block.size": sinks.ROW_GROUP, "parquet.page.size.row.check.min": 1}).parquet(path)
        if len(parts) > 1:
            release(spark)
    return sinks.open_table(spark, path, packed)


@plan
def noop_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the all-levers-off scenario, the largest absolute after - before difference
    of every measure (all zero for an exact no-op)."""
    c = SC.scenario_cells(spark, sf_dir, only="noop")
    pairs = [("demand", "d_lever", "demand_after"), ("vc", "vc_before", "vc_after"),
             ("speed", "speed_before", "speed_after"), ("served", "served_before", "served_after"),
             ("delay", "delay_before", "delay_after"), ("vmt", "vmt_before", "vmt_after"),
             ("vht", "vht_before", "vht_after")]
    aggs = [E(f"max(ABS({a} - {b}))").alias(f"max_abs_diff_{n}") for n, b, a in pairs]
    aggs.append(E("count_if(los_before <> los_after)").alias("grade_changes"))
    return c.groupBy("scenario_id").agg(*aggs)
