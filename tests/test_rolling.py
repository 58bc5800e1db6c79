from datetime import UTC, datetime, timedelta

import pytest

from gaugeflow.operators import rolling

GOLD = "machine_id string, window_start timestamp, window_end timestamp, window_duration string, vibration_mean double, motor_temp_mean double, error_count long, record_count long"
DAY0 = datetime(2026, 1, 1, tzinfo=UTC)


def window(day, machine="m", vib=1.0, temp=50.0, errors=1, records=10, duration="24h"):
    start = DAY0 + timedelta(days=day)
    return (machine, start, start + timedelta(days=1), duration, vib, temp, errors, records)


def result(spark, data):
    df = spark.createDataFrame(data, GOLD)
    return {(r["machine_id"], r["activity_day"]): r for r in rolling.rolling_totals(df).collect()}


def test_brute_force(spark):
    days = {0: (1.0, 2), 1: (2.5, 0), 4: (3.0, 5), 9: (0.25, 1), 10: (4.0, 7), 40: (1.0, 1)}
    got = result(spark, [window(d, vib=v, errors=e) for d, (v, e) in days.items()])
    assert len(got) == 41
    for k in range(41):
        r = got["m", f"{DAY0 + timedelta(days=k):%Y-%m-%d}"]
        assert r["is_idle"] == (k not in days)
        for p in (7, 30):
            live = [days[d] for d in days if k - p < d <= k]
            assert r[f"error_count_{p}d"] == sum(e for _, e in live)
            want = sum(v for v, _ in live) / len(live) if live else None
            assert r[f"vibration_mean_{p}d"] == (pytest.approx(want) if live else None)


def test_idle_days_between_active_ones_only(spark):
    data = [window(0), window(1, records=0), window(3), window(5, records=None), window(2, duration="1h")]
    df = spark.createDataFrame(data, GOLD)
    assert sorted(r["activity_day"] for r in rolling.idle_days(rolling.rolling_totals(df)).collect()) == ["2026-01-02", "2026-01-03"]


def test_repeats_nulls_and_empty(spark):
    data = [window(0), window(0), window(0, machine=None), window(1, vib=None, temp=float("nan"), errors=None)]
    got = result(spark, data)
    assert got["m", "2026-01-02"]["error_count_7d"] == 1
    assert got["m", "2026-01-02"]["vibration_mean_7d"] == 1.0
    assert got["m", "2026-01-02"]["active_days_7d"] == 2
    assert result(spark, []) == {}
