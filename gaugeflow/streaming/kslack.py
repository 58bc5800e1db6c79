"""K-slack reordering on a stream: buffer, provisional value, sorted release, refusal."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeflow.functions.columns import us

MINUTE_US, HOUR_US = 60_000_000, 3_600_000_000
OUTPUT = (
    "machine_id string, window_start_us long, slice long, stage string, n_messages long, n_late long, n_refused long, weighted_mean double, "
    "first_us long, first_value double, last_us long, last_value double, area double"
)
STATE = T.StructType([T.StructField("stage", T.StringType()), T.StructField("n_late", T.LongType()), T.StructField("n_refused", T.LongType()), T.StructField("buffer", T.BinaryType())])


def release(buffer: np.ndarray) -> dict[str, Any]:
    """n_messages, weighted_mean, first and last value and the area between, of (us, value) pairs in the order of event time."""
    ranked = buffer[np.argsort(buffer[:, 0], kind="stable")]
    kept = ranked[~np.isnan(ranked[:, 1])]
    out: dict[str, Any] = {"n_messages": len(ranked), "weighted_mean": None, "first_us": None, "first_value": None, "last_us": None, "last_value": None, "area": None}
    if len(kept):
        t, v = kept[:, 0], kept[:, 1]
        span = t[-1] - t[0]
        area = float(np.sum((t[1:] - t[:-1]) * (v[1:] + v[:-1]) / 2))
        out |= {"weighted_mean": area / span if span > 0 else float(v[0]), "first_us": int(t[0]), "first_value": float(v[0]), "last_us": int(t[-1]), "last_value": float(v[-1]), "area": area}
    return out


def _step(key: tuple[Any, ...], pdfs: Iterator[pd.DataFrame], state: GroupState, window_us: int, provisional_us: int, cutoff_us: int, timer_ms: int) -> Iterator[pd.DataFrame]:
    machine, start, part = key
    end = start + window_us
    stage, late, refused, blob = state.get if state.exists else ("open", 0, 0, b"")
    buffer = np.frombuffer(blob, dtype="float64").reshape(-1, 2)
    changed = False
    before = refused
    if not state.hasTimedOut:
        parts = [buffer]
        for pdf in pdfs:
            arrival = pdf["arrival"].to_numpy(dtype="int64")
            over = (arrival >= end + cutoff_us) | (stage == "final")
            behind = (arrival >= end + provisional_us) & ~over
            refused += int(over.sum())
            late += int(behind.sum())
            parts.append(pdf.loc[~over, ["us", "value"]].to_numpy(dtype="float64"))
            changed = changed or bool(behind.any())
        buffer = np.concatenate(parts)
    clock = state.getCurrentWatermarkMs() * 1000
    now = "final" if stage == "final" or clock >= end + cutoff_us else "provisional" if stage == "provisional" or clock >= end + provisional_us else "open"
    rows = []
    if (now != stage and now != "open") or (changed and now == "provisional"):
        rows.append({"stage": "corrected" if changed and now == stage else now, **release(buffer)})
    if refused > before:
        rows.append({"stage": "refused", "n_messages": refused - before})
    if rows:
        yield pd.DataFrame([{"machine_id": machine, "window_start_us": start, "slice": part, "n_late": late, "n_refused": refused, **r} for r in rows]).reindex(columns=[c.split()[0] for c in OUTPUT.split(", ")])
    state.update((now, late, refused, b"" if now == "final" else np.ascontiguousarray(buffer).tobytes()))
    if now != "final":
        state.setTimeoutDuration(timer_ms)


def kslack_stream(
    messages: DataFrame,
    value: str = "motor_temp",
    window_us: int = HOUR_US,
    provisional_us: int = 2 * MINUTE_US,
    cutoff_us: int = 6 * HOUR_US,
    slack: str = "0 seconds",
    slice_us: int | None = None,
    timer_ms: int = 1,
) -> DataFrame:
    """Window values of a stream of messages (machine_id, ts, _kafka_ts, _ingest_ts and the value).

    The clock is the watermark of the arrival times. A window's messages wait in its state; when the clock passes its end
    plus ``provisional_us`` the value of the buffer is published, each later batch of late messages publishes a corrected
    one, and at its end plus ``cutoff_us`` the buffer is released in event time order for the last time and emptied. What
    comes after is published as 'refused', with the number of messages refused in the batch. Copies should be removed before; a NULL machine or ts takes no part.

    Timers need batches: the job should run on an interval, or, where it takes what there is and ends, with
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off, as batches without data would follow each other for ever.

    A buffer holds one window of one machine, or ``slice_us`` of it: with slices a hot machine's window is spread over many
    keys with the window's deadlines, and merge_slices() joins what they publish.
    """
    arrival = F.coalesce(F.col("_kafka_ts"), F.col("_ingest_ts")).cast("timestamp")
    rows = messages.where(F.col("machine_id").isNotNull() & F.col("ts").isNotNull()).select("machine_id", (F.floor(us("ts") / window_us).cast("long") * window_us).alias("window_start_us"), (F.floor(us("ts") / (slice_us or window_us))).cast("long").alias("slice"), us("ts").alias("us"), F.col(value).cast("double").alias("value"), arrival.alias("clock"), us(arrival).alias("arrival"))

    def step(key, pdfs, state):  # noqa: ANN001, ANN202
        return _step(key, pdfs, state, window_us, provisional_us, cutoff_us, timer_ms)

    return rows.withWatermark("clock", slack).groupBy("machine_id", "window_start_us", "slice").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def merge_slices(published: DataFrame) -> DataFrame:
    """(machine_id, window_start_us, stage, n_messages, weighted_mean, first_value, last_value) of whole windows.

    Takes the stored output of the stream; of several corrections of a slice the one with the most messages counts, and
    refusals add up.
    """
    key = ["machine_id", "window_start_us", "stage"]
    best = published.groupBy(*key, "slice").agg(F.max(F.struct("n_messages", "area", "first_us", "first_value", "last_us", "last_value")).alias("b"), F.sum("n_messages").alias("all"))
    rows = best.select(*key, "slice", F.when(F.col("stage") == "refused", F.col("all")).otherwise(F.col("b.n_messages")).alias("n"), "b.area", F.when(F.col("b.first_us").isNotNull(), F.struct(F.col("b.first_us").alias("us"), F.col("b.first_value").alias("v"))).alias("p0"), F.when(F.col("b.last_us").isNotNull(), F.struct(F.col("b.last_us").alias("us"), F.col("b.last_value").alias("v"))).alias("p1"))
    seam = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("pb", F.last("p1", ignorenulls=True).over(seam))
    bridge = (F.col("p0.us") - F.col("pb.us")) * (F.col("p0.v") + F.col("pb.v")) / 2
    whole = rows.groupBy(*key).agg(F.sum("n").alias("n_messages"), F.sum(F.coalesce("area", F.lit(0.0)) + F.coalesce(bridge, F.lit(0.0))).alias("area"), F.min("p0").alias("p0"), F.max("p1").alias("p1"))
    span = F.col("p1.us") - F.col("p0.us")
    return whole.select(*key, "n_messages", F.when(span > 0, F.col("area") / span).otherwise(F.col("p0.v")).alias("weighted_mean"), F.col("p0.v").alias("first_value"), F.col("p1.v").alias("last_value"))
