"""Folded levers and the affected-cells engine against plain Python."""

from collections import defaultdict

import pytest

from helpers import SMALL
from roadwise import constants as K
from roadwise.plans import levers as LV, medallion as MD, network as NW, scenario as SC
from roadwise.sources import tables as S


def lever(scenario, no, kind, freeway="F1", direction="N", pm=1.0, b=(0, 95), amount=1.0, vph=-1.0, severity=1):
    return scenario, no, kind, freeway, direction, pm, pm, *b, amount, 1.0, vph, severity


def test_fold_takes_levers_in_order(spark):
    rows = [lever("s", 2, "closure", pm=3.0, amount=1.0), lever("s", 1, "closure", pm=1.0, amount=2.0),
            lever("s", 3, "demand", amount=10.0), lever("s", 4, "demand", amount=10.0),
            lever("s", 5, "incident", b=(-3, 40), amount=1.0), lever("s", 6, "incident", b=(90, 101), amount=3.0, severity=4),
            lever("s", 8, "capacity", vph=4000.0), lever("s", 7, "capacity", vph=9000.0),
            lever("one", 1, "demand", amount=20.0), lever("wide", 1, "demand", "F1", amount=25.0), lever("wide", 2, "demand", "F2", amount=-20.0),
            lever("split", 1, "closure", "F1"), lever("split", 2, "closure", "F2")]
    f = LV.fold(spark.createDataFrame(rows, S.LEVER_SCHEMA))
    got = {(r["scenario_id"], r["kind"]): r for r in f.collect()}
    c, d, i, k = (got["s", x] for x in ("closure", "demand", "incident", "capacity"))
    assert (c["pm_from"], c["pm_to"], c["amount"]) == (0.75, 3.25, 2.0)
    assert d["amount"] == pytest.approx(21.0) and d["freeway"] == "F1"
    assert (i["bucket_from"], i["bucket_to"], i["amount"], i["severity"]) == (0, 95, 3.0, 4)
    assert k["absolute_vph"] == 4000.0  # lever 8 comes last
    assert got["one", "demand"]["amount"] == 20.0  # untouched, not through the product
    assert got["wide", "demand"]["freeway"] == "ALL" and got["wide", "demand"]["cancelled"]
    rules = defaultdict(set)
    for r in LV.explain(f).collect():
        rules[r["scenario_id"]].add(r["rule"])
    assert rules == {"s": {"hull", "product", "cut_at_midnight", "severity_unused", "last_wins"}, "wide": {"product", "widened", "cancelled"}, "split": {"refused"}}
    assert {r["scenario_id"] for r in LV.running(f).collect()} == {"s", "one", "wide"}


def test_only_reached_cells_are_state(spark):
    """The closure's state is its stretch of road and what lies within one hop a step."""
    runs = {r["run"]: r["scenario_id"] for r in SC.runs(spark, SMALL).collect()}
    pairs = defaultdict(set)
    for r in SC.neighbours(spark, SMALL).collect():
        pairs[r["src"]].add(r["dst"])
    st = [r for r in SC.runs(spark, SMALL).collect()]
    assert st and "region-4" not in runs.values()  # refused
    size = {}
    for k in (0, 1, 4):
        cells = defaultdict(set)
        for r in SC.solve(spark, SMALL, k).select("run", "slot", "station_num").collect():
            cells[runs[r["run"]]].add((r["slot"], r["station_num"]))
        size[k] = cells
    assert "noop" not in size[4] and size[0]["closure"] <= size[1]["closure"] <= size[4]["closure"]
    reach = set(size[0]["closure"])
    for _ in range(4):
        reach |= {(s, d) for s, n in reach for d in pairs[n]}
    assert size[4]["closure"] <= reach


def test_steps_equal_a_plain_loop(spark):
    obs = {(r["slot"], r["station_num"]): r for r in SC.observed(spark, SMALL).select("slot", "station_num", "demand_obs", "cap_obs").collect()}
    pairs = [(r["src"], r["dst"], r["w"]) for r in SC.neighbours(spark, SMALL).collect()]
    start = {(r["run"], r["slot"], r["station_num"]): r for r in SC.solve(spark, SMALL, 0).collect()}
    got = {(r["run"], r["slot"], r["station_num"]): r for r in SC.solve(spark, SMALL, 3).collect()}
    share, off = K.REASSIGN_SHARE, K.OFFNETWORK_SHARE
    for run in {k[0] for k in got}:
        x, cap, base, leak = {}, {}, {}, {}
        for (slot, n), o in obs.items():
            s = start.get((run, slot, n))
            x[slot, n], cap[slot, n] = (s["dx"], s["cap_scen"]) if s else (o["demand_obs"], o["cap_obs"])
            base[slot, n], leak[slot, n] = max(0.0, o["demand_obs"] - o["cap_obs"]), 0.0
        for k in range(1, 4):
            over = {c: max(0.0, x[c] - cap[c] - base[c]) for c in x}
            pull, gain = defaultdict(float), defaultdict(float)
            links = [(c, (c[0], d), w * (cap[c[0], d] - x[c[0], d])) for c, e in over.items() if e > 0 for s, d, w in pairs
                     if s == c[1] and (c[0], d) in x and cap[c[0], d] > x[c[0], d]]
            for c, _, p in links:
                pull[c] += p
            for c, d, p in links:
                gain[d] += over[c] * share * (1 - off) * p / pull[c]
            x = {c: max(0.0, x[c] + (gain[c] - (over[c] * share * (1 - off) if pull[c] else 0.0) - over[c] * share * off) / (k + 1)) for c in x}
            leak = {c: leak[c] + over[c] * share * off / (k + 1) for c in x}
        for c in x:
            r = got.get((run, *c))
            if r:
                assert r["dx"] == pytest.approx(x[c], rel=1e-9, abs=1e-5) and r["leak"] == pytest.approx(leak[c], rel=1e-9, abs=1e-9)
            else:
                assert x[c] == obs[c]["demand_obs"] and not leak[c]


def test_kpi_plan_has_no_product_of_cells_and_scenarios(spark):
    plan = SC.scenario_kpis(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "ExistingRDD" not in plan


def test_segments_and_places(spark):
    rows = SC.scenario_kpis(spark, SMALL).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["scenario_id"], r["reading_date"]].append(r)
    for g in by.values():
        g.sort(key=lambda r: r["place"])
        assert [r["place"] for r in g] == list(range(1, len(g) + 1)) and g[0]["scope"] == "NETWORK"
        seg = [r for r in g if r["scope"] == "SEGMENT"]
        assert len(seg) == min(K.WORST_N, g[0]["cells"]) and all(a["vht_delta"] >= b["vht_delta"] for a, b in zip(seg, seg[1:]))
        assert sum(r["cells"] for r in g if r["scope"] == "CORRIDOR") == g[0]["cells"]
    assert NW.candidates(spark, SMALL).count() and MD.days_table(spark, SMALL).count() == 3
