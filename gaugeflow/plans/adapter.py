"""The event table in the columns of the telemetry records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def telemetry_of(events: DataFrame) -> DataFrame:
    """A deterministic stand-in: user as machine, value as the sensors, the JSON's k as battery and error code."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").cast("string").alias("machine_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit(50.0).alias("lat"),
        F.lit(10.0).alias("lon"),
        (F.col("value") / 10).alias("speed"),
        F.lit(0.0).alias("accel_x"),
        F.lit(0.0).alias("accel_y"),
        F.lit(0.0).alias("accel_z"),
        (F.col("value") / 100).alias("vibration"),
        ((102 - k).cast("double") / 100).alias("battery_soh"),
        (20 + F.col("value") / 4).alias("motor_temp"),
        F.col("value").alias("cpu_usage"),
        F.when(F.col("event_type") == "error", k).otherwise(F.lit(0)).cast("int").alias("error_code"),
        F.col("event_type").alias("event"),
        ((F.col("event_type") == "error") & (F.col("value") > 60)).alias("failure_within_horizon"),
        F.col("ts").cast("timestamp").alias("_ingest_ts"),
        F.lit("events").alias("_topic"),
        F.lit(0).alias("_partition"),
        F.col("event_id").alias("_offset"),
        F.to_date("ts").alias("event_date"),
    )


#: The same columns in SQL.
TELEMETRY_SQL = """(
    SELECT CAST(user_id AS VARCHAR) AS machine_id, ts, 50.0::DOUBLE AS lat, 10.0::DOUBLE AS lon, value / 10 AS speed, value / 100 AS vibration,
           CAST(102 - CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) / 100 AS battery_soh, 20 + value / 4 AS motor_temp, value AS cpu_usage,
           CASE WHEN event_type = 'error' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) ELSE 0 END AS error_code, event_type AS event,
           (event_type = 'error' AND value > 60) AS failure_within_horizon, event_id
    FROM events)"""
