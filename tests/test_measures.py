"""Formula checks: each Column expression against the plain arithmetic it encodes."""

import math

import pytest

from helpers import scalar
from roadwise import constants as K
from roadwise.functions import clock, measures as M
from roadwise.functions.numeric import mean_rounded, rnd, rnd_signed


def bpr(ff, vc):
    return max(K.MIN_SPEED_MPH, ff / (1 + K.BPR_ALPHA * max(0.0, vc) ** K.BPR_BETA))


@pytest.mark.parametrize("vc", [0.0, 0.4, 0.9, 1.0, 1.3, 2.0, -0.5])
def test_bpr_speed(spark, vc):
    assert scalar(spark, M.bpr_speed("65e0", repr(float(vc)) + "e0")) == pytest.approx(bpr(65.0, vc), rel=1e-12)


def test_bpr_monotone_and_floor(spark):
    speeds = [scalar(spark, M.bpr_speed("7e1", f"{v}e-1")) for v in range(0, 40, 2)]
    assert all(a >= b for a, b in zip(speeds, speeds[1:]))
    assert speeds[-1] >= K.MIN_SPEED_MPH


@pytest.mark.parametrize("vc,grade", [(0.0, "A"), (0.3499, "A"), (0.35, "B"), (0.549, "B"), (0.55, "C"),
                                      (0.77, "D"), (0.9199, "D"), (0.92, "E"), (0.9999, "E"), (1.0, "F"), (3.0, "F")])
def test_level_of_service(spark, vc, grade):
    assert scalar(spark, M.level_of_service(f"CAST({vc} AS DOUBLE)")) == grade


@pytest.mark.parametrize("speed,vc,grade", [(65, 0.5, "A"), (60, 0.5, "B"), (55, 0.5, "C"), (45, 0.5, "D"),
                                            (35, 0.5, "E"), (25, 0.5, "F"), (65, 1.0, "F")])
def test_los_from_speed_vc(spark, speed, vc, grade):
    assert scalar(spark, M.los_from_speed_vc(f"CAST({speed} AS DOUBLE)", f"CAST({vc} AS DOUBLE)")) == grade


@pytest.mark.parametrize("lanes,blocked", [(4, 0), (4, 1), (5, 3), (2, 2)])
def test_incident_worse_than_closure(spark, lanes, blocked):
    inc = scalar(spark, M.incident_capacity_factor(str(lanes), str(blocked)))
    clo = scalar(spark, M.closure_capacity_factor(str(lanes), str(blocked)))
    expect_inc = max(0.05, (max(0, lanes - blocked) / lanes) * 0.88)
    assert inc == pytest.approx(expect_inc)
    assert inc <= clo


def test_occupancy_clamps(spark):
    assert scalar(spark, M.occupancy("0", "6e1", "4")) == pytest.approx(K.MIN_OCCUPANCY)
    assert scalar(spark, M.occupancy("1e6", "1e0", "1")) == pytest.approx(K.MAX_OCCUPANCY)
    assert scalar(spark, M.occupancy("2e3", "5e1", "2")) == pytest.approx(2000 / 2 / 50 * 20 / 5280)


def test_delay_and_congestion(spark):
    assert scalar(spark, M.delay_min_per_mi("3e1", "6e1")) == pytest.approx(1.0)
    assert scalar(spark, M.delay_min_per_mi("7e1", "6e1")) == 0.0
    assert scalar(spark, M.is_congested("44e0", "6e1")) is True
    assert scalar(spark, M.is_congested("45e0", "6e1")) is False


def test_demand_profile_peaks(spark):
    am = scalar(spark, M.demand_factor("7.75e0", "false", "'N'"))
    pm = scalar(spark, M.demand_factor("17.25e0", "false", "'N'"))
    night = scalar(spark, M.demand_factor("3e0", "false", "'N'"))
    weekend = scalar(spark, M.demand_factor("13.5e0", "true", "'N'"))
    assert am > pm > night and weekend == pytest.approx(K.WE_BASE + K.WE_AMP)
    assert am == pytest.approx(K.WD_BASE + K.AM_AMP * 1.25 + K.PM_AMP * 0.85 * math.exp(-((7.75 - 17.25) / 1.45) ** 2 / 2))


def test_rounding_helpers(spark):
    assert scalar(spark, rnd("2.25e0", 1)) == 2.3
    assert scalar(spark, rnd_signed("-2.25e0", 1)) == -2.3
    assert str(scalar(spark, rnd_signed("-1e-5", 2))) == "0.0"
    v = spark.sql(f"SELECT {mean_rounded('x', 1, 1)} AS m FROM VALUES (48.3), (48.4) AS t(x)").collect()[0][0]
    assert v == 48.4


def test_capacity_loss_severity(spark):
    assert scalar(spark, M.capacity_loss_severity("1e3", "1e3")) == 0
    assert scalar(spark, M.capacity_loss_severity("7.5e2", "1e3")) == 1
    assert scalar(spark, M.capacity_loss_severity("1e0", "1e3")) == 4


def test_clock_alignment(spark):
    # Pacific wall clock -> UTC and back, bucket index and label at six local hours
    for h in (0, 6, 7, 12, 17, 23):
        local = f"TIMESTAMP_NTZ '2026-06-10 {h:02d}:45:00'"
        utc = scalar(spark, clock.local_to_utc(local))
        assert utc.hour == (h + 7) % 24
        assert scalar(spark, clock.utc_to_local(f"TIMESTAMP_NTZ '{utc:%Y-%m-%d %H:%M:%S}'")).hour == h
        assert scalar(spark, clock.bucket_idx(local)) == h * 4 + 3
        assert scalar(spark, clock.bucket_label(str(h * 4 + 3))) == f"{h:02d}:45"
    assert scalar(spark, clock.bucket_label("-1")) == "23:45"
    assert scalar(spark, clock.floor_to_minutes("TIMESTAMP_NTZ '2026-06-10 07:44:59'")).minute == 30
