"""Synthetic telemetry and feature frames, generated on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gaugeflow.schema import DURATIONS, METRICS, wire_schema

#: Fixed values of the failure model: thresholds of wear, label lead in ticks, fault codes, wear per tick and its jitter.
WARN_AT, FAULT_AT, LEAD_STEPS = 0.60, 0.85, 60
FAULT_CODES = (101, 102, 103)
FAST, SLOW, JITTER = (2.5e-4, 6e-4), (1e-6, 1e-5), 0.2
#: Fixed values of the machines' surroundings: latitudes, longitudes, degrees Celsius, phase of the load per tick.
LATITUDES, LONGITUDES, AMBIENT, PHASE = (47.0, 55.0), (5.0, 15.0), 20.0, 0.02
#: Machines that tick together in one task.
TOGETHER = 64
_DIGITS = {"lat": 6, "lon": 6, "speed": 3, "accel_x": 4, "accel_y": 4, "accel_z": 4, "vibration": 4, "battery_soh": 6, "motor_temp": 3, "cpu_usage": 2}


def _fleet(ids: np.ndarray, degrading: np.ndarray, ticks: int, rate: float, start_us: int, seed: int) -> pd.DataFrame:
    """The readings of machines that tick together: what a machine draws comes from its own stream, whoever is beside it.

    Hidden state per machine: wear, heading, speed, heat, battery. Speed and heat follow a load that swings with the
    phase; wear raises heat, vibration and CPU usage and drains the battery.
    """
    n = len(ids)
    start, noise, jitter, fault = np.empty((n, 8)), np.empty((n, ticks, 12)), np.empty((n, ticks)), np.empty((n, ticks), dtype=int)
    for k, i in enumerate(ids):
        rng = np.random.default_rng(seed * 1_000_003 + int(i))
        start[k], noise[k], jitter[k], fault[k] = rng.random(8), rng.normal(size=(ticks, 12)), rng.uniform(1 - JITTER, 1 + JITTER, ticks), rng.choice(FAULT_CODES, ticks)
    between = lambda j, lo, hi: lo + (hi - lo) * start[:, j]
    growth = np.where(degrading, between(0, *FAST), between(0, *SLOW))
    wear = np.minimum(1.0, np.cumsum(growth[:, None] * jitter, axis=1))
    load = np.sin(between(1, 0, 2 * np.pi)[:, None] + PHASE * np.arange(1, ticks + 1))
    heading = between(2, 0, 2 * np.pi)[:, None] + np.cumsum(0.05 * noise[:, :, 0], axis=1)
    heat_to = AMBIENT + 40 * (0.5 + 0.5 * load) + 50 * wear
    speeds, heats = np.empty((n, ticks)), np.empty((n, ticks))
    speed, heat = between(3, 0, 40), AMBIENT + between(4, 5, 15)
    for k in range(ticks):
        speed = np.maximum(0.0, 0.9 * speed + 0.1 * (20 + 15 * load[:, k]) + noise[:, k, 1])
        heat = 0.8 * heat + 0.2 * heat_to[:, k] + 0.5 * noise[:, k, 2]
        speeds[:, k], heats[:, k] = speed, heat
    moved = speeds / 3600 / rate * 0.01
    vibration = np.maximum(0.0, 0.2 + 3 * wear + 0.05 * np.abs(noise[:, :, 3]))
    shake = lambda j: 0.3 * noise[:, :, j] + vibration * noise[:, :, j + 1]
    values = {
        "lat": np.clip(between(5, *LATITUDES)[:, None] + np.cumsum(moved * np.cos(heading), axis=1), *LATITUDES),
        "lon": np.clip(between(6, *LONGITUDES)[:, None] + np.cumsum(moved * np.sin(heading), axis=1), *LONGITUDES),
        "speed": speeds,
        "accel_x": shake(4),
        "accel_y": shake(6),
        "accel_z": 9.81 + shake(8),
        "vibration": vibration,
        "battery_soh": np.maximum(0.0, between(7, 0.85, 1.0)[:, None] - np.cumsum(1e-6 + 5e-5 * wear + 1e-6 * np.abs(noise[:, :, 10]), axis=1)),
        "motor_temp": heats,
        "cpu_usage": np.clip(30 + 40 * (0.5 + 0.5 * load) + 20 * wear + 3 * noise[:, :, 11], 0, 100),
    }
    failing = wear >= FAULT_AT
    near = degrading[:, None] & ((FAULT_AT - wear) / growth[:, None] <= LEAD_STEPS)
    tick_us = start_us + (np.arange(1, ticks + 1) * 1e6 / rate).astype("int64")
    # A tick of the whole fleet after the other.
    flat = lambda x: x.T.reshape(-1)
    return pd.DataFrame(
        {
            "machine_id": np.tile(np.array([f"M-{int(i):06d}" for i in ids], dtype=object), ticks),
            "ts": pd.to_datetime(np.repeat(tick_us, n), unit="us", utc=True),
            **{c: np.round(flat(x), _DIGITS[c]) for c, x in values.items()},
            "error_code": flat(np.where(failing, fault, 0)).astype("int32"),
            "event": flat(np.where(failing, "fault", np.where(wear >= WARN_AT, "warning", "ok"))),
            "failure_within_horizon": flat(failing | near),
        }
    )


def synthetic_telemetry(spark: SparkSession, machines: int = 20, ticks: int = 600, rate: float = 5.0, failure_rate: float = 0.2, seed: int = 7, start_us: int = 1_767_225_600_000_000) -> DataFrame:
    """Readings of a fleet, the same for the same seed; round(machines * failure_rate) of the machines degrade.

    Machines tick in lockstep within blocks of TOGETHER, a task each, so the fleet spreads over the executors.
    """
    bad = np.sort(np.random.default_rng(seed).permutation(machines)[: round(machines * failure_rate)])

    def make(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            together = max(1, min(TOGETHER, 2_000_000 // max(1, ticks)))
            for k in range(0, len(pdf), together):
                ids = pdf["id"].to_numpy()[k : k + together]
                yield _fleet(ids, np.isin(ids, bad), ticks, rate, start_us, seed)

    return spark.range(0, machines, 1, max(1, -(-machines // TOGETHER))).mapInPandas(make, wire_schema())


def synthetic_features(spark: SparkSession, machines: int = 40, steps: int = 60, seed: int = 11, start_us: int = 1_767_225_600_000_000) -> DataFrame:
    """Wide feature rows with a hidden autoregressive stress; the label's probability is 0.04 + 0.7 * stress."""
    wide = [f"{m}_{d}" for d in DURATIONS for m in METRICS]
    schema = T.StructType(
        [T.StructField("machine_id", T.StringType()), T.StructField("event_timestamp", T.TimestampType()), T.StructField("created_timestamp", T.TimestampType()), T.StructField("window_duration_anchor", T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in wide]
        + [T.StructField("uptime_ratio_5m", T.DoubleType()), T.StructField("label_failure_within_horizon", T.BooleanType())]
    )

    def make(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for i in pdf["id"]:
                rng = np.random.default_rng(seed * 1_000_003 + int(i))
                # Stress returns to the machine's own level; the constants are fixed values.
                level = x = rng.uniform(0.1, 0.7)
                stress = np.empty(steps)
                for k, push in enumerate(rng.normal(0, 0.08, steps)):
                    stress[k] = x = min(1.2, max(0.0, 0.7 * x + 0.3 * level + push))
                at = pd.to_datetime(start_us + np.arange(steps) * 300_000_000, unit="us", utc=True)
                out = {"machine_id": f"M-{int(i):06d}", "event_timestamp": at, "created_timestamp": at + pd.Timedelta(minutes=1), "window_duration_anchor": "5m"}
                for c in wide:
                    sign = -1 if c.startswith("battery") else 1
                    out[c] = sign * stress + rng.normal(0, 0.2, steps)
                out["uptime_ratio_5m"] = np.clip(1 - stress * 0.2, 0, 1)
                out["label_failure_within_horizon"] = rng.random(steps) < 0.04 + 0.7 * stress
                yield pd.DataFrame(out)

    return spark.range(0, machines, 1, max(1, min(machines, 200))).mapInPandas(make, schema)
