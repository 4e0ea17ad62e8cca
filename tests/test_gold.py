"""Refreshed tables: pruned reads, retried history, counted and failing expectations."""

import pytest
from pyspark.sql import Observation

from helpers import SMALL
from roadwise.operators.quality import Rule, apply_rules
from roadwise.plans import dashboard as DB, gold as GO, medallion as MD, snapshot as SN
from roadwise.sources import sinks

DAY = "2026-06-07"


@pytest.fixture(autouse=True)
def long_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [DB.time_matrix, DB.cell_congestion, DB.day_catalogue, SN.snapshot_network, SN.snapshot_corridors, SN.frame_kpis])
def test_one_day_reads_one_folder(spark, query):
    scans = [x for x in plan_of(query(spark, SMALL, day=DAY)).split("FileScan parquet")[1:] if "/frames" in x]
    assert scans
    for s in scans:
        assert "PartitionFilters: [isnotnull(reading_date" in s and DAY in s
        assert s.split("ReadSchema: struct<")[1].split("\n")[0].count(":") <= 14  # of 37 columns


def test_days_of_a_dimension_prune_at_run_time(spark):
    assert "dynamicpruning" in plan_of(GO.workday_profile(spark, SMALL))


def test_day_is_a_slice_of_the_whole(spark):
    whole, day = DB.time_matrix(spark, SMALL), DB.time_matrix(spark, SMALL, day=DAY)
    assert day.count() == 24 and not day.exceptAll(whole.where(f"reading_date = DATE '{DAY}'").select(day.columns)).count()


def test_files_are_clustered_by_window(spark):
    f = GO.table(spark, SMALL, "frames")
    files = f.selectExpr("input_file_name() AS f", "reading_date", "bucket_idx DIV 24 AS w").groupBy("f").agg({"w": "max", "reading_date": "max"})
    assert f.count() == MD.frames(spark, SMALL).count() and files.count() >= 3


def test_refresh_of_a_day_leaves_the_others(spark, tmp_path):
    f = MD.frames_table(spark, SMALL)
    stored = sinks.write_table(f, str(tmp_path / "t"))
    n = stored.count()
    for _ in range(2):  # the second time is a retry
        stored = sinks.write_table(MD.frames_table(spark, SMALL, DAY).limit(5), str(tmp_path / "t"), only_dates_present=True)
    assert stored.where(f"reading_date = DATE '{DAY}'").count() == 5
    assert stored.count() == n - MD.frames_table(spark, SMALL, DAY).count() + 5


def test_retried_run_keeps_one_history(spark, tmp_path):
    path, row = str(tmp_path / "h"), lambda x: spark.createDataFrame([(x,)], "kpi long")
    for run, value in (("a", 1), ("b", 2), ("b", 3)):
        sinks.append_history(row(value), path, run)
    got = {(r["run_id"], r["kpi"]) for r in sinks.read_history(spark, path, row(0)).collect()}
    assert got == {("a", 1), ("b", 3)}
    assert [r["kpi"] for r in sinks.read_history(spark, path, row(0), latest=True).collect()] == [3]


def test_counts_are_those_of_a_separate_pass(spark):
    seen = {(r["stage"], r["rule"]): (r["violations"], r["rows"]) for r in GO.quality_report(spark, SMALL).collect()}
    raw = MD.enriched_of(MD.bronze_readings(spark, SMALL), MD.stations_geo(spark, SMALL))
    assert {s for s, _ in seen} == {"stations", "incidents", "readings", "enriched", "frames", "corridors"}
    for rule in MD.ENRICHED_RULES:
        assert seen["enriched", rule.name] == (raw.where(f"NOT {rule.sql()}").count(), raw.count())


def test_rules_drop_keep_and_stop(spark, tmp_path):
    df = spark.createDataFrame([(1,), (None,), (-3,)], "x int")
    seen = Observation("rules")
    kept = apply_rules(df, [Rule("positive", "x > 0"), Rule("small", "x < 1", "warn")], seen)
    assert sinks.write_table(kept, str(tmp_path / "ok"), sinks.Layout(None, None, ("x",))).collect() == [(1,)]
    assert seen.get == {"rows": 3, "positive": 2, "small": 2}
    with pytest.raises(Exception, match="expectation failed: known"):
        sinks.write_table(apply_rules(df, [Rule("known", "x IS NOT NULL", "fail")]), str(tmp_path / "bad"), sinks.Layout(None, None, ("x",)))
    assert not list((tmp_path / "bad").glob("*.parquet"))


def test_numbers_are_dense_and_sorted_across_ranges(spark, tmp_path):
    from roadwise.operators.numbering import number
    rows = [(k, f"s{i:03d}") for k, n in (("a", 300), ("b", 7), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, s string").repartition(5)
    seen = []

    def store(x):
        x.write.parquet(str(tmp_path / "r"))
        seen.append(spark.read.parquet(str(tmp_path / "r")))
        return seen[0]

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges of so few rows
    got = {(r["k"], r["s"]): r["i"] for r in number(df, ["k"], "s", "i", store).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert seen[0].select("_range").distinct().count() > 1
    assert got == {(k, s): int(s[1:]) for k, s in rows}


def test_tables_without_readings(spark, tmp_path):
    """No line items and no orders: every table is there and empty, and every count is 0."""
    from roadwise.plans import scenario as SC
    for t in ("region", "nation", "supplier", "orders", "lineitem", "events", "conversations"):
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        (df.limit(0) if t in ("orders", "lineitem") else df).write.parquet(str(tmp_path / f"{t}.parquet"))
    sf = str(tmp_path)
    seen = {(r["stage"], r["rule"]): (r["violations"], r["rows"]) for r in GO.quality_report(spark, sf).collect()}
    assert seen["stations", "identified"][1] > 0 and {v for (s, _), v in seen.items() if s != "stations"} == {(0, 0)}
    assert not DB.time_matrix(spark, sf).count() and not DB.calendar(spark, sf).count() and not SC.scenario_kpis(spark, sf).count()
