"""What the plans move: no filter computes the chain again, no product of cells and runs or pairs is shuffled."""

import pytest
from pyspark.sql import functions as F

from helpers import SMALL
from roadwise import constants as K
from roadwise.operators.packing import pack_dense, pack_ordered
from roadwise.operators.quality import Rule, apply_rules
from roadwise.operators.spatial import grid_band_join, range_band_join
from roadwise.plans import dashboard as DB, extras as EX, gold as GO, medallion as MD, network as NW, scenario as SC
from roadwise.sources import sinks


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_read_columns_and_do_not_compute_them_again(spark):
    """The power of the volume-delay curve stood in the filter once for every rule that names a speed."""
    df = spark.range(5).selectExpr("id", "POWER(id, 2.5e0) AS p")
    kept = apply_rules(df, [Rule("some", "p > 3"), Rule("few", "p < 20")])
    filters = [x for x in plan_of(kept).split("\n") if "Filter" in x]
    assert filters and not any("POWER" in x for x in filters)
    assert kept.count() == 2
    for query in (MD.bronze_readings, MD.enriched):
        assert not any("POWER" in x for x in plan_of(query(spark, SMALL)).split("\n") if "Filter" in x)


def test_a_table_is_written_without_a_shuffle_of_its_rows(spark):
    df = spark.range(10).selectExpr("id", "DATE '2026-06-06' AS reading_date", "id AS bucket_idx", "id AS time_bucket", "'F1' AS freeway")
    assert "Exchange" not in plan_of(sinks._arranged(df, sinks.FACTS))


def test_stored_corridors_count_the_same_stations(spark):
    e = GO.table(spark, SMALL, "enriched")
    a, b = MD.corridors_of(e, stored=True), MD.corridors_of(e)
    assert a.columns == b.columns and a.count() == b.count() and not a.exceptAll(b).count()
    assert "count(station_id" in plan_of(a) and "distinct" not in plan_of(a).lower()


@pytest.mark.parametrize("seen", [[(0, 0, 5), (0, 2, 6), (1, 1500, 7)], [(1, 3, 4), (1, 3, 2)], []])
def test_dense_packing_equals_the_packed_grid(spark, seen):
    cells = spark.createDataFrame([("k", *x) for x in seen], "k string, b int, i int, v int")
    widths = spark.createDataFrame([("k", 2000), ("none", 3)], "k string, width int")
    grid = widths.selectExpr("k", "explode(sequence(0, width - 1)) AS i").crossJoin(spark.range(2).selectExpr("CAST(id AS INT) AS b"))
    dense = grid.join(cells, ["k", "b", "i"], "left").selectExpr("k", "b", "i", "0 AS from_bucket", "COALESCE(v, -1) AS v")
    want = pack_ordered(dense, ["k", "from_bucket"], "b", "i", ["v"])
    got = pack_dense(cells, widths, ["k"], "b", "i", {"v": -1}, 2, 2).select(want.columns)
    assert got.count() == 2 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_time_matrix_joins_no_grid(spark):
    want = pack_ordered(DB.time_matrix_cells(spark, SMALL), ["reading_date", "scope", "from_bucket"], "bucket_idx", "station_idx", ["flow", "speed_half", "vc_pct", "incident"])
    got = DB.time_matrix(spark, SMALL)
    assert got.columns == want.columns and got.count() == want.count() and not got.exceptAll(want).count()
    assert plan_of(got).count("Join") == 1  # the frames and their stations' numbers
    assert plan_of(EX.scenario_time_matrix(spark, SMALL)).count("Join") <= 5


@pytest.mark.parametrize("query", [SC.scenario_cells, EX.noop_proof, EX.scenario_speed_changes])
def test_cells_of_all_runs_are_told_apart_after_the_last_shuffle(spark, query):
    plan = plan_of(query(spark, SMALL))
    above = plan.split("Generate inline")[0]  # operators that work on rows by cell and run
    assert "Generate inline" in plan and "hashpartitioning(station_id" not in above and "SortMergeJoin" not in above


def test_pairs_are_made_by_as_many_tasks_as_asked_for(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = spark.range(300).selectExpr("concat('S', id) AS station_id", "34 + id % 100 * 1e-2 AS latitude", "-118 + id % 3 * 1e-2 AS longitude", "id * 1e-1 AS postmile", "concat('F', id % 2) AS freeway")
        for j in (grid_band_join(p, p, 8000.0), range_band_join(p, p, ["freeway"], "postmile", 2.0)):
            assert len({r["t"] for r in j.select(F.spark_partition_id().alias("t")).collect()}) > 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_patches_equal_the_join_of_pairs(spark, monkeypatch):
    """Small patches, so that most neighbours lie in another one; and the join when numbers repeat."""
    from roadwise.plans import reassign as RE
    monkeypatch.setattr(RE, "ROWS", 3)
    solve = SC.solve.__wrapped__
    got = {(r["instant"], r["station_num"]): r for r in solve(spark, SMALL, 2).collect()}
    monkeypatch.setattr(SC, "repeated_stations", lambda spark, sf_dir: True)
    want = {(r["instant"], r["station_num"]): r for r in solve(spark, SMALL, 2).collect()}
    assert want and got.keys() == want.keys()
    for k, r in want.items():
        for c in ("dx", "leak", "cap_scen", "d_lever"):
            assert got[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-6)
    assert "Join" not in plan_of(RE.advance(spark.createDataFrame([], RE.SHEET), SC.observed_sheets(spark, SMALL), SC.reach(spark, SMALL), 1, 0.3, 0.3))


def test_a_patch_sees_every_neighbour(spark):
    """Stations of 60,000 suppliers' density around one patch: the weights are those of ``candidates``."""
    import numpy as np
    import pyarrow as pa
    from roadwise.plans import reassign as RE
    seg = NW.segments(spark, SMALL).select("station_num", "station_id", "freeway", "direction", "postmile", "latitude", "longitude", "bearing_deg").toArrow()
    n = seg.num_rows
    zero = pa.array([[0.0] * RE.DAY] * n)
    land = RE.Land(seg.append_column("own", pa.array([True] * n)).append_column("x", zero).append_column("cap", zero))
    got = {(int(land.num[a]), int(land.num[b])): w[x, y] for i, j, w in land.weights(np.arange(n)) for x, a in enumerate(i) for y, b in enumerate(j) if w[x, y] > 0}
    want = {(r["src"], r["dst"]): r["w"] for r in SC.neighbours(spark, SMALL).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.fixture(scope="module")
def road(spark, tmp_path_factory):
    """Tables of 120 stations on four rows of patches, three days."""
    d = str(tmp_path_factory.mktemp("road"))
    for t in ("nation", "region"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    spark.range(120).selectExpr("id * 8 AS s_suppkey").write.parquet(f"{d}/supplier.parquet")
    line = spark.range(120 * 40).selectExpr("id", "id DIV 40 * 8 AS l_suppkey", "id % 40 AS n")
    line.selectExpr("id AS l_orderkey", "id % 7 AS l_partkey", "l_suppkey", "CAST(1 + n % 4 AS INT) AS l_linenumber", "CAST(20 + id % 31 AS DOUBLE) AS l_quantity",
                    "CAST(id % 11 AS DOUBLE) / 1e2 AS l_discount").write.parquet(f"{d}/lineitem.parquet")
    spark.range(300).selectExpr("id AS o_orderkey", "id * 13 AS o_custkey", "concat(1 + id % 5, '-X') AS o_orderpriority").write.parquet(f"{d}/orders.parquet")
    return d


def folders(spark, name: str) -> list[str]:
    import glob
    return glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/roadwise-{name}-*")


def test_slices_equal_one_and_leave_nothing(spark, road, monkeypatch):
    """Rows of patches solved apart, several a day, with the state of those beside them; no state but the last stays."""
    solve = lambda: {(r["instant"], r["station_num"]): r for r in SC.solve.__wrapped__(spark, road, 2).collect()}
    monkeypatch.setattr(SC, "SHEETS", 10 ** 9)
    want = solve()
    assert [len(g) for g in SC.slices(SC.observed(spark, road))] == [1]
    monkeypatch.setattr(SC, "SHEETS", 1)
    sizes = [len(g) for g in SC.slices(SC.observed(spark, road))]
    assert len(sizes) == 3 and min(sizes) >= 3
    got = solve()
    assert len(want) > 1000 and got.keys() == want.keys()
    for k, r in want.items():
        for c in ("dx", "leak", "cap_scen", "d_lever"):
            assert got[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-6)
    assert not folders(spark, "sheets")


@pytest.mark.parametrize("height", [1, 2])
@pytest.mark.parametrize("sheets", [1, 30, 100, 10 ** 9])
def test_slices_hold_every_cell_once(spark, road, monkeypatch, sheets, height):
    monkeypatch.setattr(SC, "SHEETS", sheets)
    obs = SC.observed(spark, road)
    parts = [p for g in SC.slices(obs, height) for p in g]
    assert sum(obs.where(p.cells).count() for p in parts) == obs.count()
    lost = obs.limit(5).withColumn("tile", F.lit(None).cast("int"))
    assert sum(lost.where(p.cells).count() for p in parts) == lost.count()
    for g in SC.slices(obs, height):  # rows of patches in order, so that those around a slice are in the ones beside it
        assert all(a.rows[1] < b.rows[0] and a.days == b.days for a, b in zip(g, g[1:]))


def test_cells_of_scenarios_are_stored_beside_the_observed(spark, road):
    """Cells were joined, and shuffled, again for every query that reads them."""
    b = SC.beside(spark, road)
    own = b.selectExpr("slot", "station_num", "inline(own)").collect()
    want = SC.solve(spark, road).select("slot", "station_num", "run", "d_lever", "dx", "leak", "cap_scen").collect()
    assert b.count() == SC.observed(spark, road).count() and want
    key = lambda r: (r["run"], r["slot"], r["station_num"])
    assert [tuple(x[c] for c in ("run", "slot", "station_num", "d_lever", "dx", "leak", "cap_scen")) for x in sorted(own, key=key)] == [
        pytest.approx(tuple(x[c] for c in ("run", "slot", "station_num", "d_lever", "dx", "leak", "cap_scen")), rel=1e-9, abs=1e-6) for x in sorted(want, key=key)]
    for query in (SC.scenario_cells, EX.scenario_speed_changes):
        assert "hashpartitioning(slot" not in plan_of(query(spark, road))


def test_buckets_store_no_cells_of_their_own(spark, road):
    """The differences of all touched cells, thirty columns, were stored to be summed once."""
    before = set(folders(spark, "changes"))
    got = SC.scenario_buckets(spark, road)
    assert "hashpartitioning(slot" not in plan_of(got) and "SortMergeJoin" not in plan_of(got) and got.count()
    assert set(folders(spark, "changes")) == before
    want = SC.totals(SC.observed(spark, road), SC.stored_changes(spark, road, K.MSA_ITERATIONS), SC.run_days(spark, road), ["reading_date", "bucket_idx"])
    parts = SC.totals(SC.observed(spark, road), SC.changes(spark, road, K.MSA_ITERATIONS), SC.run_days(spark, road), ["reading_date", "bucket_idx"])
    assert not want.drop("p_residual").exceptAll(parts.drop("p_residual")).count()


def test_parts_of_the_matrix_hold_every_row_once(spark, road, monkeypatch):
    """All cells by run, some dozen times the observed ones, were shuffled at once, twice. Parts of some windows and runs give the same rows as all
    together, and what is handed out shuffles nothing."""
    build = EX.scenario_time_matrix.__wrapped__
    want = build(spark, road).collect()
    days = [r["reading_date"] for r in MD.days_table(spark, road).orderBy("reading_date").collect()]
    monkeypatch.setattr(EX, "matrix_parts", lambda sizes, runs: [EX.Part((days[0],), a, b, r, 2) for a, b in ((0, 24), (24, 96)) for r in (0, 1)] + [EX.Part(tuple(days[1:]))])
    got = build(spark, road)
    assert len(want) == SC.run_days(spark, road).count() * 4 * 6  # four windows, five freeways and all
    assert sorted(map(str, want)) == sorted(map(str, got.collect()))
    assert "Exchange" not in plan_of(got)


@pytest.mark.parametrize("size", [1, 20, 60, 100, 1000, 10 ** 6])
def test_parts_cover_days_windows_and_runs(monkeypatch, size):
    import datetime
    monkeypatch.setattr(EX, "PART_SHEETS", size)
    monkeypatch.setattr(EX, "PARTS", 10 ** 9)
    sizes = [(datetime.date(2026, 6, 6 + i), 96 * n) for i, n in enumerate((100, 0, 30, 30, 500))]
    parts = EX.matrix_parts(sizes, 9)
    found = sorted((d, b, r) for p in parts for d in p.days for b in range(p.first, p.last, 24) for r in range(9) if r % p.of == p.run)
    assert found == [(d, b, r) for d, _ in sizes for b in range(0, 96, 24) for r in range(9)]
    cells = dict(sizes)
    assert all(sum(cells[d] for d in p.days) * (p.last - p.first) / 96 / p.of <= 96 * size or (p.last - p.first, p.of) == (24, 9) for p in parts)
