"""Tumbling-window aggregates at several granularities from one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.columns import from_us, us
from gaugeflow.schema import DURATIONS


def build_windows(df: DataFrame, durations: dict[str, int] = DURATIONS, key: str = "machine_id", ts: str = "ts") -> DataFrame:
    """One row per key, window and duration with the long window schema.

    Each row is spread to its window of every duration before a single grouped aggregation, so the table is read and
    shuffled once however many granularities there are; partial aggregation on the map side keeps hot keys small.
    Windows are aligned to the epoch. Rows without ts belong to no window; a NULL error_code counts as no error; the
    label is NULL where all labels are; the deviation of a single reading is NULL.
    """
    slots = [F.struct(F.lit(name).alias("window_duration"), (F.floor(us(ts) / (sec * 1_000_000)) * sec * 1_000_000).cast("long").alias("s"), F.lit(sec * 1_000_000).cast("long").alias("len")) for name, sec in durations.items()]
    values = ("vibration", "motor_temp", "cpu_usage", "battery_soh", "error_code", "failure_within_horizon")
    rows = df.where(F.col(ts).isNotNull()).select(F.col(key).alias("machine_id"), *values, F.explode(F.array(*slots)).alias("w")).select("machine_id", *values, "w.*")
    return (
        rows.groupBy("machine_id", "window_duration", "s", "len")
        .agg(
            F.avg("vibration").alias("vibration_mean"),
            F.stddev_samp("vibration").alias("vibration_std"),
            F.max("vibration").alias("vibration_max"),
            F.avg("motor_temp").alias("motor_temp_mean"),
            F.stddev_samp("motor_temp").alias("motor_temp_std"),
            F.max("motor_temp").alias("motor_temp_max"),
            F.avg("cpu_usage").alias("cpu_usage_mean"),
            F.stddev_samp("cpu_usage").alias("cpu_usage_std"),
            F.avg("battery_soh").alias("battery_soh_mean"),
            F.min("battery_soh").alias("battery_soh_min"),
            F.count_if(F.coalesce(F.col("error_code") != 0, F.lit(False))).alias("error_count"),
            F.bool_or("failure_within_horizon").alias("failure_label"),
            F.count("*").alias("record_count"),
        )
        .select(
            "machine_id",
            from_us(F.col("s")).alias("window_start"),
            from_us(F.col("s") + F.col("len")).alias("window_end"),
            "window_duration",
            F.to_date(from_us(F.col("s"))).alias("event_date"),
            "vibration_mean",
            "vibration_std",
            "vibration_max",
            "motor_temp_mean",
            "motor_temp_std",
            "motor_temp_max",
            "cpu_usage_mean",
            "cpu_usage_std",
            "battery_soh_mean",
            "battery_soh_min",
            "error_count",
            "record_count",
            "failure_label",
        )
    )
