import pytest

from gaugeflow.operators import regrid

from .helpers import BRONZE, at, micros, reading, rows


def grid_of(spark, data, **kw):
    return regrid.regrid(spark.createDataFrame(data, BRONZE), **kw)


def test_slots_between_first_and_last_row(spark):
    data = [reading(1, minute=1, temp=10.0), reading(2, minute=50, temp=20.0), reading(3, minute=63, temp=None)]
    g = grid_of(spark, data)
    assert [r[0] for r in rows(g, "slot_start_us")] == [micros(at(m)) for m in (0, 15, 30, 45, 60)]
    assert rows(regrid.empty_slots(g)) == [("M-000001", micros(at(m))) for m in (15, 30, 60)]


def test_time_weighted_between_neighbours(spark):
    g = grid_of(spark, [reading(1, minute=2.5, temp=10.0), reading(2, minute=42.5, temp=50.0)])
    value = {r["slot_start_us"]: (r["grid_value"], r["fill"]) for r in g.collect()}
    assert value[micros(at(15))] == (pytest.approx(10 + 20.0), "interpolated")
    assert value[micros(at(0))][1] == "observed"


def test_gap_limit(spark):
    g = grid_of(spark, [reading(1, minute=0, temp=10.0), reading(2, minute=300, temp=50.0)], max_gap_us=60 * 60_000_000)
    assert {r["fill"] for r in g.collect() if r["n_readings"] == 0} == {"gap"}


def test_nulls_nan_and_empty(spark):
    data = [reading(1, minute=0, temp=float("nan")), reading(2, machine=None), reading(3, ts=None), reading(4, minute=20, temp=None)]
    g = grid_of(spark, data)
    assert [(r["n_readings"], r["fill"], r["grid_value"]) for r in g.orderBy("slot_start_us").collect()] == [(0, "gap", None)] * 2
    assert grid_of(spark, []).count() == 0


def test_extra_columns_and_ties(spark):
    df = spark.createDataFrame([reading(1, minute=1, temp=10.0), reading(2, minute=1, temp=30.0)], BRONZE).selectExpr("*", "1 AS slot", "2 AS n", "3 AS k")
    (r,) = regrid.regrid(df).collect()
    assert (r["n_readings"], r["slot_mean"]) == (2, 20.0)
