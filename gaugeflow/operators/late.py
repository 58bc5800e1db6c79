"""Late and out-of-order events: provisional, corrected and final aggregates by event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.copies import components
from gaugeflow.operators.hotkeys import TARGET_ROWS, hot_keys
from gaugeflow.session import spill

MINUTE_US = 60_000_000
HOUR_US = 3_600_000_000
#: Rows of whole buffers that are worked on at once.
BLOCK_ROWS = 200_000

STAGES = (
    "machine_id string, window_start_us long, slice long, stage string, n_messages long, n_content long, n_errors long, n_values long, value_sum double, area double, "
    "first_us long, last_us long, longest_gap_us long, first_value_us long, first_value double, last_value_us long, last_value double"
)


def _us(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def message_readings(bronze: DataFrame, values: tuple[str, ...] = ("motor_temp", "error_code")) -> DataFrame:
    """(machine_id, us, arrival, values): one row per machine and ts, with the earliest arrival of any copy.

    Copies share their place in the log, or machine and ts, also by way of a third row. A copy without machine or ts
    passes its arrival on through its place. One aggregation by place (rows without one go by machine and ts) is written
    to the shared folder. As a rule a place belongs to one (machine, ts), and then a second aggregation settles
    everything; only the messages of places with several are resolved as connected components. The values are those of
    the copy ingested last.
    """
    place = ["_topic", "_partition", "_offset"]
    has_moment = F.col("machine_id").isNotNull() & F.col("ts").isNotNull()
    has_place = F.col("_topic").isNotNull() & F.col("_partition").isNotNull() & F.col("_offset").isNotNull()
    moment = F.when(has_moment, F.struct(F.col("machine_id").alias("m"), _us("ts").alias("us")))
    tag = F.when(has_moment, F.xxhash64("machine_id", _us("ts")))
    row = F.when(has_moment, F.struct(_us("_ingest_ts").alias("i"), F.col("_offset").alias("o"), F.col("row_id").alias("r"), *[F.col(v) for v in values]))
    rows = (
        bronze.select(*place, has_place.alias("placed"), moment.alias("moment"), tag.alias("tag"), F.coalesce(_us("_kafka_ts"), _us("_ingest_ts")).alias("arrival"), row.alias("row"))
        .where(F.col("placed") | F.col("moment").isNotNull())
        .withColumn("loose", F.when(~F.col("placed"), F.col("tag")))
    )
    best = [F.min("arrival").alias("arrival"), F.max("row").alias("row")]
    cells = spill(rows.groupBy(*place, "loose").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi"), F.max("moment").alias("moment"), *best), "cells")
    # Rows without a place are keyed by their own moment, so they are never mixed.
    mixed = cells.where((F.col("lo") != F.col("hi")) & F.col("loose").isNull()).select(*place, "lo", F.col("arrival").alias("first"))
    single = cells.where((F.col("lo") == F.col("hi")) | F.col("loose").isNotNull()).select("moment", F.col("hi").alias("tag"), "arrival", "row")
    if mixed.isEmpty():
        merged = single.groupBy("moment", "tag").agg(*best)
    else:
        # Every moment of a mixed place keeps its own row, with the arrival of the whole place.
        there = rows.where(F.col("placed") & F.col("tag").isNotNull()).join(mixed, place)
        merged = single.unionByName(there.select("moment", "tag", F.col("first").alias("arrival"), "row")).groupBy("moment", "tag").agg(*best)
        comp = components(there.select(F.col("lo").alias("r1"), F.col("tag").alias("r2")).distinct())
        joined = merged.join(comp, merged["tag"] == comp["node"], "left")
        together = joined.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("arrival").alias("whole"))
        merged = joined.join(together, "comp", "left").select("moment", "tag", F.coalesce("whole", "arrival").alias("arrival"), "row")
    return merged.select(F.col("moment.m").alias("machine_id"), F.col("moment.us").alias("us"), "arrival", *[F.col(f"row.{v}").alias(v) for v in values])


def release(buffer: np.ndarray, n: int, us: np.ndarray, value: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
    """The order-sensitive aggregate of each of ``n`` buffers, whose messages are given buffer by buffer in event time.

    Besides counts and sums: the area under the value (trapezoids between neighbours), the longest silence, and the first
    and last message and value, by which slices of a window are joined. -1 stands for no time.
    """
    def ends(b: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        lo[b[::-1]], hi[b] = np.arange(len(b))[::-1], np.arange(len(b))
        return lo, hi

    at = lambda i, x, blank: np.where(i >= 0, x[np.maximum(i, 0)] if len(x) else blank, blank)
    gap = np.full(n, -1, dtype=np.int64)
    if len(us) > 1:
        beside = np.flatnonzero(buffer[1:] == buffer[:-1])
        np.maximum.at(gap, buffer[beside + 1], us[beside + 1] - us[beside])
    lo, hi = ends(buffer, us)
    there = ~np.isnan(value)
    b, t, v = buffer[there], us[there], value[there]
    vlo, vhi = ends(b, t)
    area = np.zeros(n)
    if len(t) > 1:
        same = np.flatnonzero(b[1:] == b[:-1])
        area = np.bincount(b[same + 1], (t[same + 1] - t[same]) * (v[same + 1] + v[same]) / 2, n)
    return {
        "n_content": np.bincount(buffer, minlength=n),
        "n_errors": np.bincount(buffer, error, n).astype(np.int64),
        "n_values": np.bincount(b, minlength=n),
        "value_sum": np.bincount(b, v, n),
        "area": area,
        "first_us": at(lo, us, -1),
        "last_us": at(hi, us, -1),
        "longest_gap_us": gap,
        "first_value_us": at(vlo, t, -1),
        "first_value": at(vlo, v, np.nan),
        "last_value_us": at(vhi, t, -1),
        "last_value": at(vhi, v, np.nan),
    }


def _stages(block: pd.DataFrame, new: np.ndarray, window_us: int, provisional_us: int, cutoff_us: int) -> pd.DataFrame:
    """What the buffers of a block publish: provisional content, corrections, the final release, and refusals."""
    buffer = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    n = len(head)
    us, value = block["us"].to_numpy(dtype=np.int64), block["value"].to_numpy(dtype=np.float64)
    error = block["error"].to_numpy(dtype=np.int64)
    start = block["window_start_us"].to_numpy(dtype=np.int64)
    # A message without arrival is on time.
    arrival = block["arrival"].fillna(-(2**62)).to_numpy(dtype=np.int64)
    refused = arrival >= start + window_us + cutoff_us
    late = ~refused & (arrival >= start + window_us + provisional_us)
    count = lambda mask: np.bincount(buffer[mask], minlength=n)
    content = lambda mask: release(buffer[mask], n, us[mask], value[mask], error[mask])
    at_first, at_last = content(~refused & ~late), content(~refused)
    names = {c: block[c].to_numpy()[head] for c in ("machine_id", "window_start_us", "slice")}
    out = []
    for stage, messages, data in (
        ("provisional", count(~refused & ~late), at_first),
        ("corrected", count(late), at_last),
        ("final", count(~refused), at_last),
        ("cut_off", count(refused), None),
    ):
        some = messages > 0
        if not some.any():
            continue
        data = data or release(np.zeros(0, dtype=np.int64), n, *[np.zeros(0, dtype=k) for k in (np.int64, float, np.int64)])
        out.append(pd.DataFrame({**{c: x[some] for c, x in names.items()}, "stage": stage, "n_messages": messages[some], **{c: x[some] for c, x in data.items()}}))
    return pd.concat(out, ignore_index=True)


def _drain(pdfs: Iterator[pd.DataFrame], window_us: int, provisional_us: int, cutoff_us: int) -> Iterator[pd.DataFrame]:
    """Gather whole buffers from a partition that is sorted by buffer and event time, and release them."""
    kept: list[pd.DataFrame] = []
    rows = 0

    def starts(pdf: pd.DataFrame) -> np.ndarray:
        new = np.ones(len(pdf), dtype=bool)
        for c in ("window_start_us", "slice", "machine_id"):
            x = pdf[c].to_numpy()
            new[1:] = (x[1:] != x[:-1]) if c == "window_start_us" else new[1:] | (x[1:] != x[:-1])
        return new

    for pdf in pdfs:
        if not len(pdf):
            continue
        kept.append(pdf)
        rows += len(pdf)
        if rows < BLOCK_ROWS:
            continue
        whole = pd.concat(kept, ignore_index=True)
        new = starts(whole)
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield _stages(whole[:cut], new[:cut], window_us, provisional_us, cutoff_us)
        kept, rows = [whole[cut:]], len(whole) - cut
    if rows:
        whole = pd.concat(kept, ignore_index=True)
        yield _stages(whole, starts(whole), window_us, provisional_us, cutoff_us)


def kslack_stages(
    messages: DataFrame,
    value: str = "motor_temp",
    window_us: int = HOUR_US,
    provisional_us: int = 2 * MINUTE_US,
    cutoff_us: int = 6 * HOUR_US,
    target_rows: int = TARGET_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """What K-slack buffers publish, from messages (machine_id, us, arrival, ``value``, error_code) in any order.

    A message waits in the buffer of its window. At window end plus ``provisional_us`` the buffer's content is published
    ('provisional'); until window end plus ``cutoff_us`` late messages correct it ('corrected', with the content after the
    last correction); then the buffer is released in the order of event time ('final'), and what comes after is refused
    ('cut_off'). Each record has n_messages (those that caused it) and the order-sensitive aggregate of its content.

    Machines above ``target_rows`` rows have a buffer for each minute of a window, with the deadlines of the window, so
    no task sees a whole hour of a hot machine; ``sizes`` is where rows per machine are counted (machine_id, us), where
    that is cheaper than counting messages. A task holds a bounded block of whole buffers.

    Defined cases: a message without arrival time is on time; NULL and NaN values take no part in the value's aggregate;
    a stage without messages gives no record; rows with NULL machine or time are left out; an empty table gives nothing.
    """
    counted = messages.select("machine_id", "us") if sizes is None else sizes
    hot = hot_keys(counted, "machine_id", F.col("us"), target_rows).select(F.col("_hot_key").alias("machine_id"), F.lit(True).alias("hot"))
    buffers = (
        messages.where(F.col("machine_id").isNotNull() & F.col("us").isNotNull())
        .withColumn("window_start_us", F.floor(F.col("us") / window_us).cast("long") * window_us)
        .join(hot, "machine_id", "left")
        .select(
            "machine_id",
            "window_start_us",
            F.when(F.col("hot"), F.floor(F.col("us") / MINUTE_US)).otherwise(F.lit(0)).cast("long").alias("slice"),
            "us",
            "arrival",
            F.col(value).cast("double").alias("value"),
            (F.coalesce("error_code", F.lit(0)) != 0).cast("int").alias("error"),
        )
    )
    key = ["window_start_us", "slice", "machine_id"]
    ready = buffers.repartition(*key).sortWithinPartitions(*key, "us")
    return ready.mapInPandas(lambda pdfs: _drain(pdfs, window_us, provisional_us, cutoff_us), STAGES)


def sew(stages: DataFrame) -> DataFrame:
    """One row per machine, window and stage: the records of slices joined at their seams.

    Adds weighted_mean, the mean of the value over time. A window has as many slices as minutes, so the seams are
    sewn by a window of bounded size.
    """
    time = lambda c: F.when(F.col(c) >= 0, F.col(c))
    point = lambda t, v: F.when(F.col(t) >= 0, F.struct(F.col(t).alias("us"), F.col(v).alias("v")))
    rows = stages.select(
        "machine_id", "window_start_us", "stage", "slice", "n_messages", "n_content", "n_errors", "n_values", "value_sum", "area", time("longest_gap_us").alias("gap"),
        time("first_us").alias("u0"), time("last_us").alias("u1"), point("first_value_us", "first_value").alias("p0"), point("last_value_us", "last_value").alias("p1"),
    )
    seam = Window.partitionBy("machine_id", "window_start_us", "stage").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("p_before", F.last("p1", ignorenulls=True).over(seam)).withColumn("u_before", F.max("u1").over(seam))
    bridge = (F.col("p0.us") - F.col("p_before.us")) * (F.col("p0.v") + F.col("p_before.v")) / 2
    whole = rows.groupBy("machine_id", "window_start_us", "stage").agg(
        F.sum("n_messages").alias("n_messages"),
        F.sum("n_content").alias("n_content"),
        F.sum("n_errors").alias("n_errors"),
        F.sum("n_values").alias("n_values"),
        F.sum("value_sum").alias("value_sum"),
        F.sum(F.col("area") + F.coalesce(bridge, F.lit(0.0))).alias("area"),
        F.min("p0").alias("p0"),
        F.max("p1").alias("p1"),
        F.max(F.greatest("gap", F.col("u0") - F.col("u_before"))).alias("longest_gap_us"),
    )
    span = F.col("p1.us") - F.col("p0.us")
    return whole.withColumn("weighted_mean", F.when(span > 0, F.col("area") / span).otherwise(F.col("p0.v")))


def kslack_windows(messages: DataFrame, target_rows: int = TARGET_ROWS, sizes: DataFrame | None = None, **bounds: int) -> DataFrame:
    """One row per machine and hour from the records of kslack_stages.

    Result: machine_id, window_start_us, n_provisional, provisional_mean (motor_temp), n_final, n_late, n_refused,
    error_count, final_mean, weighted_mean, first_temp, last_temp, longest_gap_us. A window whose messages were all
    refused keeps a row with n_final 0.
    """
    rows = sew(kslack_stages(messages, target_rows=target_rows, sizes=sizes, **bounds))
    pick = lambda stage, c: F.max(F.when(F.col("stage") == stage, c))
    mean = F.col("value_sum") / F.nullif(F.col("n_values"), F.lit(0))
    zero = F.lit(0).cast("long")
    return rows.groupBy("machine_id", "window_start_us").agg(
        F.coalesce(pick("provisional", F.col("n_content")), zero).alias("n_provisional"),
        pick("provisional", mean).alias("provisional_mean"),
        F.coalesce(pick("final", F.col("n_content")), zero).alias("n_final"),
        F.coalesce(pick("corrected", F.col("n_messages")), zero).alias("n_late"),
        F.coalesce(pick("cut_off", F.col("n_messages")), zero).alias("n_refused"),
        F.coalesce(pick("final", F.col("n_errors")), zero).alias("error_count"),
        pick("final", mean).alias("final_mean"),
        pick("final", F.col("weighted_mean")).alias("weighted_mean"),
        pick("final", F.col("p0.v")).alias("first_temp"),
        pick("final", F.col("p1.v")).alias("last_temp"),
        pick("final", F.col("longest_gap_us")).alias("longest_gap_us"),
    )


def late_outcomes(stages: DataFrame) -> DataFrame:
    """(machine_id, window_start_us, outcome) of the windows for which a correction or a refusal was published."""
    return stages.where(F.col("stage").isin("corrected", "cut_off")).select("machine_id", "window_start_us", F.col("stage").alias("outcome")).distinct()
