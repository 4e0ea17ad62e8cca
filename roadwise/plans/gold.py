"""The refreshed tables: stations, enriched readings, frames and
corridor rollups, each written once and read back by the next, with the violations of every
expectation counted in the pass that writes.

``refresh`` writes them under a folder; ``table`` gives one of a session's own refresh (in
``spark.checkpoint.dir``), optionally for one local date, which prunes the date's folders.
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number
from ..operators.quality import Rule, apply_rules, counts_of
from ..session import ensure_checkpoint_dir, release
from ..sources import sinks
from ..sources import tables as S
from . import medallion as MD
from .memo import plan


@dataclass
class Refresh:
    """The tables of one refresh, and what the expectations saw."""

    tables: dict[str, DataFrame]
    quality: list[tuple[str, str, str, int, int]]


def refresh(spark: SparkSession, sf_dir: str, path: str) -> Refresh:
    """Write every table in dependency order. The readings chain runs once: frames and corridor
    rollups start from the stored enriched readings. A ``fail`` rule stops the job before the
    table it guards is committed."""
    watched: list[tuple[str, list[Rule], Observation]] = []

    def guard(stage: str, df: DataFrame, rules: list[Rule]) -> DataFrame:
        watched.append((stage, rules, Observation(f"{stage}-{uuid.uuid4().hex}")))
        return apply_rules(df, rules, watched[-1][2])

    t: dict[str, DataFrame] = {}
    t["stations_geo"] = sinks.write_table(guard("stations", MD.stations_raw(spark, sf_dir), MD.STATION_RULES), f"{path}/stations_geo", sinks.DIMENSION)
    t["incidents"] = sinks.write_table(guard("incidents", S.incidents(spark, sf_dir), MD.INCIDENT_RULES), f"{path}/incidents",
                                       sinks.Layout(None, None, ("freeway", "day_no", "start_slot")))
    bronze = guard("readings", MD.bronze_raw(spark, sf_dir, t["incidents"]), MD.BRONZE_RULES)
    t["enriched"] = sinks.write_table(guard("enriched", MD.enriched_of(bronze, t["stations_geo"]), MD.ENRICHED_RULES), f"{path}/enriched")
    release(spark)  # the readings' shuffles are as large as the table
    t["frames"] = sinks.write_table(guard("frames", MD.frames_of(t["enriched"], t["stations_geo"]), MD.FRAME_RULES), f"{path}/frames")
    release(spark)
    t["days"] = sinks.write_table(t["frames"].groupBy("reading_date").agg(F.expr("CAST(max(day_of_week) AS INT) AS day_of_week")), f"{path}/days",
                                  sinks.Layout(None, None, ("reading_date",)))
    # the dense station numbers that payloads are laid out by: per date and scope, and over all
    scratch = lambda name: lambda df: sinks.write_table(df, f"{path}/{name}-ranges", sinks.Layout(None, None, ()))
    present = t["frames"].select("reading_date", "freeway", "station_id").distinct()
    scopes = present.withColumn("scope", F.explode(F.array(F.lit("ALL"), "freeway"))).select("reading_date", "scope", "station_id")
    t["station_index"] = sinks.write_table(number(scopes, ["reading_date", "scope"], "station_id", "station_idx", scratch("index")), f"{path}/station_index",
                                           sinks.Layout("reading_date", None, ("scope", "station_idx")))
    t["station_order"] = sinks.write_table(number(present.select("station_id").distinct(), [], "station_id", "station_idx", scratch("order")), f"{path}/station_order",
                                           sinks.Layout(None, None, ("station_id",)))
    t["corridor_summary"] = sinks.write_table(guard("corridors", MD.corridors_of(t["enriched"], stored=True), MD.CORRIDOR_RULES), f"{path}/corridor_summary")
    quality = []
    for stage, rules, seen in watched:
        counts = counts_of(seen, rules)
        quality += [(stage, r.name, r.action, counts[r.name], counts["rows"]) for r in rules]
    return Refresh(t, quality)


@plan
def session_refresh(spark: SparkSession, sf_dir: str) -> Refresh:
    """One refresh per session and input folder, in the shared checkpoint folder."""
    return refresh(spark, sf_dir, f"{ensure_checkpoint_dir(spark).rstrip('/')}/roadwise-gold-{uuid.uuid4().hex}")


def table(spark: SparkSession, sf_dir: str, name: str, day: datetime.date | str | None = None) -> DataFrame:
    """A refreshed table, whole or of one local date."""
    t = session_refresh(spark, sf_dir).tables[name]
    return t if day is None else t.where(F.col("reading_date") == F.lit(str(day)).cast("date"))


@plan
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, rule, action, violations, rows) of every expectation, as counted while
    the tables were written."""
    return spark.createDataFrame(session_refresh(spark, sf_dir).quality, "stage string, rule string, action string, violations long, rows long")


@plan
def corridor_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily corridor totals kept per run. Each local date is a run; the last one writes
    twice, as a retried job does."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/roadwise-history-{uuid.uuid4().hex}"
    days = [r["reading_date"] for r in table(spark, sf_dir, "corridor_summary").select("reading_date").distinct().orderBy("reading_date").collect()]
    out = None
    for day in [*days, *days[-1:]]:
        out = daily_totals(spark, sf_dir, day)
        sinks.append_history(out, path, f"{day:%Y%m%d}")
    return sinks.read_history(spark, path, out or daily_totals(spark, sf_dir, None))


@plan
def daily_totals(spark: SparkSession, sf_dir: str, day: datetime.date | None) -> DataFrame:
    return table(spark, sf_dir, "corridor_summary", day).groupBy("freeway", "direction").agg(
        F.expr("CAST(sum(sample_count) AS BIGINT) AS samples"), F.expr("CAST(sum(sum_flow_vph) AS BIGINT) AS sum_flow_vph"),
        F.expr("max(max_vc_ratio) AS max_vc_ratio"), F.expr("CAST(sum(incident_samples) AS BIGINT) AS incident_samples"))


@plan
def workday_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per freeway and bucket over workdays only. The dates come from the stored day catalogue, so
    the frames are pruned at run time to the folders that its filter leaves."""
    f = table(spark, sf_dir, "frames")
    days = table(spark, sf_dir, "days").where("day_of_week BETWEEN 2 AND 6").select("reading_date")
    return f.select("reading_date", "freeway", "bucket_idx", "avg_flow_vph").join(days, "reading_date").groupBy("freeway", "bucket_idx").agg(
        F.expr("CAST(count(1) AS BIGINT) AS station_frames"), F.expr("CAST(sum(avg_flow_vph) AS BIGINT) AS flow_vph"))
