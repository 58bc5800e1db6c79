"""Attributes as known at event time (bitemporal point-in-time join)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.hotkeys import TARGET_ROWS, slice_of, slice_table, with_slices

DAY_US = 86_400_000_000


def known_versions(
    events: DataFrame,
    versions: DataFrame,
    key: str = "machine_id",
    event_time: str = "event_timestamp",
    version_time: str = "event_timestamp",
    known_time: str | None = "created_timestamp",
    version_id: str = "feature_id",
    event_cols: tuple[str, ...] = ("prediction_id",),
    payload: tuple[str, ...] = (),
    ttl_us: int | None = DAY_US,
    target_rows: int = TARGET_ROWS,
    only_known: bool = True,
) -> DataFrame:
    """For each event the version of its entity that was valid and already known at its time.

    A version becomes usable at the later of its own time and the time it became known. Ordered by that instant, the
    best version usable at an event is the running maximum of (time, known time, id): the largest time wins, and if that
    one is older than ``ttl_us`` no other can be younger. Entities above ``target_rows`` rows are cut into slices of time;
    each slice gets the maximum over all earlier slices as carry-in, so the slices merge independently and the result
    doesn't depend on where they are cut.

    With ``only_known`` false the time at which a version became known doesn't matter and only settles ties.

    Result: key, event_cols, ``asof_time`` (the event's), version_id and payload (prefixed ``v_``); events without a usable
    version keep NULLs there.

    Defined cases: events with NULL key or time come out with NULLs; versions with NULL key, time or known time are never
    used; equal instants count as known; repeated events stay repeated; columns of the same name on both sides don't
    clash, as only the named ones are read and the payload is prefixed; empty tables give NULLs or no rows.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rank = [us(version_time).alias("t"), (us(known_time) if known_time else F.lit(0).cast("long")).alias("c"), F.col(version_id).alias("id"), *[F.col(p).alias(f"v_{p}") for p in payload]]
    there = F.col(key).isNotNull() & F.col(version_time).isNotNull()
    if only_known:
        there = there & F.col(known_time).isNotNull()
    usable = versions.where(there).select(F.col(key).alias("k"), (F.greatest(us(version_time), us(known_time)) if only_known else us(version_time)).alias("at"), F.struct(*rank).alias("ver"))
    asked = events.select(F.col(key).alias("k"), us(event_time).alias("at"), F.struct(*[F.col(c) for c in event_cols], F.col(event_time).alias("asof_time")).alias("ev"))
    nobody = asked.where(F.col("k").isNull() | F.col("at").isNull())
    both = usable.select("k", "at", F.lit(0).alias("side"), "ver", F.lit(None).cast(asked.schema["ev"].dataType).alias("ev")).unionByName(
        asked.where(F.col("k").isNotNull() & F.col("at").isNotNull()).select("k", "at", F.lit(1).alias("side"), F.lit(None).cast(usable.schema["ver"].dataType).alias("ver"), "ev")
    )
    slices = slice_table(both.select("k", "at"), "k", F.col("at"), target_rows)
    cut = with_slices(both, "k", slices).withColumn("slice", slice_of(F.col("at"))).drop("_hot_lo", "_hot_len", "_hot_n")
    hot = slices.select(F.col("_hot_key").alias("k"))
    # The last version before each slice: one row per hot entity and slice, none for the others.
    heads = with_slices(usable.join(hot, "k", "left_semi"), "k", slices).withColumn("slice", slice_of(F.col("at"))).groupBy("k", "slice").agg(F.max("ver").alias("ver"), F.first("_hot_n").alias("n"))
    grid = slices.select(F.col("_hot_key").alias("k"), F.explode(F.sequence(F.lit(0), (F.col("_hot_n") - 1).cast("int"))).alias("slice"))
    before = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        grid.join(heads.drop("n"), ["k", "slice"], "left")
        .select("k", F.lit(None).cast("long").alias("at"), F.lit(-1).alias("side"), F.max("ver").over(before).alias("ver"), F.lit(None).cast(asked.schema["ev"].dataType).alias("ev"), "slice")
        .where(F.col("ver").isNotNull())
    )
    run = Window.partitionBy("k", "slice").orderBy(F.col("side") >= 0, "at", "side").rowsBetween(Window.unboundedPreceding, 0)
    merged = cut.unionByName(carry).withColumn("best", F.max("ver").over(run)).where(F.col("side") == 1).select("k", "at", "ev", "best")
    if ttl_us is not None:
        merged = merged.withColumn("best", F.when(F.col("best.t") >= F.col("at") - ttl_us, F.col("best")))
    matched = merged.unionByName(nobody.select("k", "at", "ev", F.lit(None).cast(usable.schema["ver"].dataType).alias("best")))
    return matched.select(F.col("k").alias(key), *[F.col(f"ev.{c}") for c in event_cols], "ev.asof_time", F.col("best.id").alias(version_id), *[F.col(f"best.v_{p}") for p in payload])


def found_versions(joined: DataFrame, event_id: str = "prediction_id", version_id: str = "feature_id") -> DataFrame:
    """The pairs of the join that have a version."""
    return joined.where(F.col(version_id).isNotNull()).select(event_id, version_id)
