"""The rows of pN_found come through the operator: its plan keeps the method's steps."""

from gaugeflow.operators import late, regrid, rolling

from .helpers import BRONZE, reading


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_empty_slots_keep_the_merge(spark):
    df = spark.createDataFrame([reading(1), reading(2, minute=50)], BRONZE)
    text = plan(regrid.empty_slots(regrid.regrid(df)))
    assert "Window" in text and "last(" in text and "first(" in text


def test_idle_days_keep_the_running_sum(spark):
    gold = spark.createDataFrame([], "machine_id string, window_end timestamp, window_duration string, record_count long, error_count long, vibration_mean double, motor_temp_mean double")
    text = plan(rolling.idle_days(rolling.rolling_totals(gold)))
    assert "Window" in text and "active_1" in text


def test_outcomes_come_from_the_buffer(spark):
    df = spark.createDataFrame([reading(1), reading(2, minute=50)], BRONZE)
    assert "MapInPandas" in plan(late.late_outcomes(late.kslack_stages(late.message_readings(df))))


def test_buffers_with_nulls_copies_and_clashing_columns(spark):
    data = [reading(1, minute=5), reading(1, minute=5), reading(2, machine=None), reading(3, ts=None), reading(4, minute=6, temp=float("nan"), kafka=None, ingest=None), reading(5, minute=7, temp=None, err=None)]
    df = spark.createDataFrame(data, BRONZE).selectExpr("*", "1 AS us", "2 AS arrival", "3 AS slice", "4 AS stage", "5 AS value")
    got = late.kslack_stages(late.message_readings(df)).collect()
    assert [(r["stage"], r["n_messages"], r["n_values"]) for r in got if r["stage"] == "final"] == [("final", 3, 1)]
    assert {r["stage"] for r in got} == {"provisional", "final"}
    assert late.late_outcomes(late.kslack_stages(late.message_readings(df.limit(0)))).count() == 0
