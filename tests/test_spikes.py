import numpy as np
import pytest

from gaugeflow.functions import kalman
from gaugeflow.operators import spikes

from .helpers import BRONZE, at, micros, reading, rows


def series(n=200, seed=1):
    r = np.random.default_rng(seed)
    return 50 + 5 * np.sin(np.arange(n) / 30) + r.normal(0, 0.4, n)


def flags(spark, temps, **kw):
    data = [reading(i, minute=i * 2.0, temp=None if t is None else float(t), vib=None, soh=None, cpu=None) for i, t in enumerate(temps)]
    out = spikes.implausible(spark.createDataFrame(data, BRONZE), **kw)
    return {(int((r["ts_us"] - micros(at(0))) // 120_000_000), r["kind"]) for r in out.collect()}


def test_spike_of_one_and_two_readings(spark):
    t = series()
    t[60] += 12
    t[120:122] -= 15
    assert flags(spark, t) == {(60, "spike"), (120, "spike"), (121, "spike")}


def test_lasting_change_and_rise_are_no_cases(spark):
    t = series()
    t[100:] += 20
    t += np.linspace(0, 30, len(t))
    assert flags(spark, t) == set()


def test_stuck_with_nulls_and_first_reading(spark):
    t = list(series())
    for i in range(80, 100):
        t[i] = None if i == 90 else t[80]
    assert flags(spark, t) == {(i, "stuck") for i in range(80, 100) if i != 90}


def test_coarse_sensor_repeats_by_chance(spark):
    t = np.round(series(400) * 2) / 2
    assert {k for _, k in flags(spark, t)} <= {"spike"} and not flags(spark, t)


def test_impossible_values_and_nan(spark):
    t = series()
    t[5], t[6], t[50] = 900.0, float("nan"), -91.0
    assert flags(spark, t) == {(5, "impossible"), (50, "impossible")}


def test_slices_find_the_same(spark):
    t = series(1500, 3)
    t[[200, 701, 1250]] += 14
    t[900:930] = t[900]
    want = {(200, "spike"), (701, "spike"), (1250, "spike")} | {(i, "stuck") for i in range(900, 930)}
    assert flags(spark, t) == want
    assert flags(spark, t, slice_rows=300, halo_rows=60) == want


def test_copies_nulls_short_and_empty(spark):
    data = [reading(1, minute=1, temp=400.0), reading(2, minute=1, temp=400.0, ingest=at(9)), reading(3, machine=None, temp=900.0), reading(4, ts=None, temp=900.0), reading(5, machine="x", minute=2, soh=float("inf"))]
    df = spark.createDataFrame(data, BRONZE)
    assert rows(spikes.flagged(spikes.implausible(df))) == [("M-000001", micros(at(1)), "motor_temp"), ("x", micros(at(2)), "battery_soh")]
    assert spikes.implausible(spark.createDataFrame([], BRONZE)).count() == 0


def test_filters_run_alike_alone_and_together():
    y = np.column_stack([series(80, s) for s in range(5)])
    y[10:20, 2] = np.nan
    t = np.repeat(np.arange(80.0)[:, None] * 60, 5, axis=1)
    p, w, _ = kalman.pack(y, t)
    r, q = kalman.noise(p, w, np.full(5, 0.01))
    together = kalman.spikes(p, w, r, q, 5.0, 6)
    for i in range(5):
        alone = kalman.spikes(p[:, i : i + 1], w[:, i : i + 1], r[i : i + 1], q[i : i + 1], 5.0, 6)
        assert np.allclose(alone[0][:, 0], together[0][:, i]) and np.allclose(alone[1][:, 0], together[1][:, i])


@pytest.mark.parametrize("repeat", [0.0, 0.3, 0.6, 0.8, 0.85, 0.9, 0.95])
def test_coarse_walks_are_never_stuck_whatever_their_chance_of_repeats(repeat):
    r = np.random.default_rng(int(repeat * 100))
    n, width = 2_200, 24
    steps = np.where(r.random((n, width)) < repeat, 0.0, r.choice([-0.5, 0.5], (n, width)))
    y = 60 + np.cumsum(steps, axis=0)
    t = np.repeat(np.arange(float(n))[:, None] * 60, width, axis=1)
    inf = np.full(width, np.inf)
    _, stuck, _, _ = spikes.score_series(y, t, -inf, inf)
    assert stuck.sum() == 0


@pytest.mark.parametrize("repeat", [0.0, 0.5, 0.8])
def test_stuck_stretch_in_a_coarse_walk_is_found_whole(repeat):
    r = np.random.default_rng(5)
    y = 60 + np.cumsum(np.where(r.random((900, 6)) < repeat, 0.0, r.choice([-0.5, 0.5], (900, 6))), axis=0)
    y[400:560] = y[400]
    t = np.repeat(np.arange(900.0)[:, None] * 60, 6, axis=1)
    inf = np.full(6, np.inf)
    _, stuck, _, _ = spikes.score_series(y, t, -inf, inf)
    for j in range(6):
        first = 400 - int(np.argmax(y[400::-1, j] != y[400, j])) + 1
        last = 560 + int(np.argmax(y[560:, j] != y[400, j])) if y[560, j] == y[400, j] else 560
        assert np.flatnonzero(stuck[:, j]).tolist() == list(range(first, last))
