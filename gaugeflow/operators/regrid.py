"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_US = 60_000_000


def usable(value: str) -> Column:
    """The value where it is neither NULL nor NaN."""
    return F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))


def regrid(df: DataFrame, key: str = "machine_id", ts: str = "ts", value: str = "motor_temp", step_us: int = 15 * MINUTE_US, max_gap_us: int = 120 * MINUTE_US) -> DataFrame:
    """One row per source and slot, from the slot of its first row to the slot of its last.

    The sorted grid and the readings of a source are merged as of each slot's middle: the nearest usable reading on
    either side gives the time-weighted linear value, unless they are further apart than ``max_gap_us``. The merge runs
    on one summary row per source and slot (first, last and the neighbours of the middle), built with map-side combine,
    so a source of any number of rows costs at most its number of slots.

    Result: key, slot_start_us, n_readings, slot_mean (NULL if the slot has no usable reading), left_us, right_us,
    grid_value, fill ('observed', 'interpolated', 'gap').

    Defined cases: rows with NULL key or time are left out; a NULL or NaN value counts for the source's span but not as
    a reading; readings of the same time are averaged; a source without any usable reading gets only 'gap' rows; an
    empty table gives an empty result; other columns are ignored. A slot before the first or after the last usable
    reading is a 'gap' unless it has readings itself.
    """
    half = step_us // 2
    rows = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), usable(value).cast("double").alias("v"))
    slot = F.floor(F.col("us") / step_us).cast("long") * step_us
    reading = F.when(F.col("v").isNotNull(), F.struct("us", "v"))
    at_or_before = F.when(F.col("us") <= F.col("slot") + half, reading)
    after = F.when(F.col("us") > F.col("slot") + half, reading)
    slots = (
        rows.withColumn("slot", slot)
        .groupBy("k", "slot")
        .agg(
            F.count("v").alias("n"),
            F.avg("v").alias("mean"),
            F.min(reading).alias("first"),
            F.max(reading).alias("last"),
            F.max(at_or_before).alias("before"),
            F.min(after).alias("after"),
        )
    )
    span = slots.groupBy("k").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    grid = span.select("k", F.explode(F.sequence("lo", "hi", F.lit(step_us))).alias("slot"))
    merged = grid.join(slots, ["k", "slot"], "left")
    order = Window.partitionBy("k").orderBy("slot")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    future = order.rowsBetween(1, Window.unboundedFollowing)
    sides = merged.select(
        "k",
        "slot",
        F.coalesce("n", F.lit(0)).alias("n"),
        "mean",
        F.coalesce(F.col("before"), F.last("last", ignorenulls=True).over(past)).alias("lft"),
        F.coalesce(F.col("after"), F.first("first", ignorenulls=True).over(future)).alias("rgt"),
    )
    mid = F.col("slot") + half
    gap = F.col("rgt.us") - F.col("lft.us")
    weight = (mid - F.col("lft.us")) / F.greatest(gap, F.lit(1))
    # Both neighbours are the nearest ones: a slot has a reading of its own if and only if one of them lies within it.
    own = F.coalesce(F.col("lft.us") >= F.col("slot"), F.lit(False)) | F.coalesce(F.col("rgt.us") < F.col("slot") + step_us, F.lit(False))
    between = F.when(gap <= max_gap_us, F.col("lft.v") + (F.col("rgt.v") - F.col("lft.v")) * weight)
    value_at = F.coalesce(between, F.col("mean"))
    return sides.select(
        F.col("k").alias(key),
        F.col("slot").alias("slot_start_us"),
        F.col("n").alias("n_readings"),
        F.col("mean").alias("slot_mean"),
        F.col("lft.us").alias("left_us"),
        F.col("rgt.us").alias("right_us"),
        value_at.alias("grid_value"),
        F.when(own, F.lit("observed")).when(between.isNotNull(), F.lit("interpolated")).otherwise(F.lit("gap")).alias("fill"),
    )


def empty_slots(grid: DataFrame, key: str = "machine_id") -> DataFrame:
    """Slots of the grid whose neighbours as of the merge both lie outside of them."""
    return grid.where(F.col("fill") != "observed").select(key, "slot_start_us")
