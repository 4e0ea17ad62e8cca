"""Job-level invariants on the smallest fixture."""

import pytest

from helpers import SMALL


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"freeway", "direction", "vmt", "vht"} <= set(df.columns)


def test_every_query_has_unique_name_and_oracle_subset():
    import __spark_entry__ as entry
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


def test_frames_one_row_per_station_bucket(spark):
    from roadwise.plans import medallion as MD
    f = MD.frames(spark, SMALL)
    assert f.count() == f.select("station_id", "reading_date", "bucket_idx").distinct().count()


def test_pack_unpack_round_trip(spark):
    from roadwise.plans import dashboard as DB
    dec = DB.time_matrix_decoded(spark, SMALL)
    cells = DB.time_matrix_cells(spark, SMALL).selectExpr(
        "reading_date", "scope", "bucket_idx", "station_id", "NULLIF(flow, -1) AS flow_vph")
    a = sorted(map(tuple, dec.select("reading_date", "scope", "bucket_idx", "station_id", "flow_vph").collect()),
               key=str)
    b = sorted(map(tuple, cells.collect()), key=str)
    assert a == b


@pytest.fixture(scope="module")
def kpis(spark):
    from roadwise.plans import scenario as SC
    return SC.scenario_kpis(spark, SMALL).collect()


def test_noop_is_exact(kpis):
    noop = [r for r in kpis if r.scenario_id == "noop"]
    assert noop
    for r in noop:
        assert r.vht_delta == 0 and r.vmt_delta == 0 and r.vc_after == r.vc_before
        assert r.los_ef_after == r.los_ef_before and r.demand_offnetwork_veh == 0


def test_conservation(kpis):
    for r in kpis:
        if r.scope == "NETWORK":
            assert abs(r.conservation_error_veh) < 1e-6


def test_closure_hurts_and_capacity_helps(kpis):
    net = {(r.scenario_id, r.reading_date): r for r in kpis if r.scope == "NETWORK"}
    assert all(r.vht_delta >= 0 for (s, _), r in net.items() if s in ("closure", "incident", "demand"))
    assert all(r.capacity_after_vph > r.capacity_before_vph for (s, _), r in net.items() if s == "capacity")


def test_advice_cap_and_vocabulary(spark):
    from roadwise import constants as K
    from roadwise.plans import advice as AD
    items = AD.advice_items(spark, SMALL).collect()
    assert items and all(r.action_type in K.ACTION_TYPES for r in items)
    assert all(r.seq < K.MAX_RECOMMENDATIONS for r in items)
    assert all(r.action_type_raw is not None for r in items if r.action_type == "other")


def test_every_station_survives_at_100_000_suppliers(spark, tmp_path):
    from roadwise.plans import medallion
    from roadwise import constants as K
    spark.range(100_000).selectExpr("id AS s_suppkey", "CAST(id AS STRING) AS s_name", "id % 25 AS s_nationkey", "0e0 AS s_acctbal").write.parquet(
        str(tmp_path / "supplier.parquet"))
    st = medallion.stations_geo(spark, str(tmp_path))
    assert st.count() == 100_000
    assert st.select("freeway").distinct().count() == 50
    assert not st.where(f"latitude NOT BETWEEN {K.CA_MIN_LAT} AND {K.CA_MAX_LAT} OR longitude NOT BETWEEN {K.CA_MIN_LON} AND {K.CA_MAX_LON}").count()


def test_scenario_payload_decodes_to_cells(spark):
    from roadwise.operators.packing import unpack_all
    from roadwise.plans import dashboard, extras, scenario
    payload = extras.scenario_time_matrix(spark, SMALL)
    assert not payload.where("n <> stations * 24").count()
    got = unpack_all(payload, ["scenario_id", "reading_date", "scope"], ["speed_half"], "stations", "station_idx")
    got = got.join(dashboard.station_index(spark, SMALL), ["reading_date", "scope", "station_idx"]).where("speed_half >= 0")
    cells = scenario.scenario_cells(spark, SMALL).join(dashboard.station_index(spark, SMALL), ["reading_date", "station_id"]).selectExpr(
        "scenario_id", "reading_date", "scope", "bucket_idx", "station_id", "CAST(floor(speed_after * 2 + 0.5) AS INT) AS speed_half")
    assert got.count() == cells.count() and not got.select(cells.columns).exceptAll(cells).count()


def test_damaged_payload_is_not_aligned(spark):
    from roadwise.plans import dashboard, medallion
    frames = medallion.frames_table(spark, SMALL)
    whole = dashboard.time_matrix(spark, SMALL)
    assert not dashboard.check_alignment(whole, frames).where("NOT aligned").count()
    short = whole.selectExpr("* EXCEPT (vc_pct)", "substring(vc_pct, 1, length(vc_pct) - instr(reverse(vc_pct), ',')) AS vc_pct")
    assert not dashboard.check_alignment(short, frames).where("aligned").count()
    other = frames.where(f"station_id <> '{frames.agg({'station_id': 'min'}).first()[0]}'")
    assert dashboard.check_alignment(whole, other).where("scope = 'ALL' AND aligned").count() == 0


def test_interpolation_fills_every_bucket(spark, monkeypatch):
    """A gap, a null speed and the wrap: each side stands in for a missing one."""
    from roadwise.plans import medallion as MD, snapshot as SN
    rows = [("a", "d", 0, 60.0, 100, 0.5, False, None), ("a", "d", 1, None, 200, 0.6, True, None),
            ("a", "d", 2, 30.0, 300, 0.7, True, 3)]
    frames = spark.createDataFrame(rows, "station_id string, reading_date string, bucket_idx int, avg_speed_mph double,"
                                         " avg_flow_vph int, vc_ratio double, incident_active boolean, max_incident_severity int")
    monkeypatch.setattr(MD, "frames_table", lambda spark, sf_dir, day=None: frames)
    got = {(r["bucket_idx"], r["step"]): r for r in SN.frame_interpolation_day(spark, "made-up").collect()}
    assert len(got) == 96 * 3
    assert got[0, 1]["speed_mph"] == 60 and got[0, 0]["flow_vph"] == 100 and got[0, 2]["incident"] == 1
    assert got[1, 0]["speed_mph"] == 30  # the current one is null: the next one's
    assert got[2, 2]["speed_mph"] == 30 and got[2, 1]["incident"] == 3 and got[2, 2]["incident"] == 0
    assert got[95, 1]["speed_mph"] == 60 and got[50, 0]["speed_mph"] is None and got[50, 0]["incident"] == 0
