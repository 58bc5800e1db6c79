"""Queries of the data-preparation problems 1 to 7, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeflow.functions.columns import flat, us
from gaugeflow.operators import copies, late, pit, profile, regrid, rolling, spikes
from gaugeflow.sources.tables import table, table_path
from gaugeflow.streaming import seen

Query = Callable[[SparkSession, str], DataFrame]


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(table(spark, d, "bronze"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flagged(p1_flags(spark, d))


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    return flat(regrid.regrid(table(spark, d, "bronze")), nudge=1e-7)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return regrid.empty_slots(regrid.regrid(table(spark, d, "bronze")))


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    return flat(rolling.rolling_totals(table(spark, d, "gold")), nudge=1e-7)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.idle_days(rolling.rolling_totals(table(spark, d, "gold")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    output = seen.run_seen_links(spark, table_path(d, "bronze"))
    return copies.copies(output).where("not stays").select("row_id")


def _raw_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bronze").select("machine_id", us("ts").alias("us"))


def p5_windows(spark: SparkSession, d: str) -> DataFrame:
    return late.kslack_windows(late.message_readings(table(spark, d, "bronze")), sizes=_raw_sizes(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return late.late_outcomes(late.kslack_stages(late.message_readings(table(spark, d, "bronze")), sizes=_raw_sizes(spark, d)))


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile_report(table(spark, d, "silver"), table(spark, d, "dq_rules"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.findings(p6_profile(spark, d))


FEATURES = (
    "label_failure_within_horizon",
    "vibration_mean_5m",
    "motor_temp_mean_5m",
    "cpu_usage_mean_5m",
    "battery_soh_mean_5m",
    "error_count_5m",
    "record_count_5m",
    "uptime_ratio_5m",
)


def p7_joined(spark: SparkSession, d: str) -> DataFrame:
    return flat(pit.known_versions(table(spark, d, "predictions"), table(spark, d, "telemetry_features"), event_cols=("prediction_id", "failure_probability"), payload=FEATURES), nudge=1e-7)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pit.found_versions(pit.known_versions(table(spark, d, "predictions"), table(spark, d, "telemetry_features")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_flags, p1_found, p2_grid, p2_found, p3_rolling, p3_found, p4_found, p5_windows, p5_found, p6_profile, p6_found, p7_joined, p7_found)}

_PAYLOAD = ", ".join(f"round(f.{c}::DOUBLE + 1e-7, 4) AS v_{c}" if c not in ("label_failure_within_horizon", "error_count_5m", "record_count_5m") else f"f.{c} AS v_{c}" for c in FEATURES)
_TRAILING = ", ".join(
    f"""CAST(coalesce(sum(d.e) FILTER (d.day > g.day - {p}), 0) AS BIGINT) AS error_count_{p}d, count(d.day) FILTER (d.day > g.day - {p}) AS active_days_{p}d,
    round(sum(d.v) FILTER (d.day > g.day - {p}) / nullif(sum(d.vn) FILTER (d.day > g.day - {p}), 0) + 1e-7, 4) AS vibration_mean_{p}d,
    round(sum(d.t) FILTER (d.day > g.day - {p}) / nullif(sum(d.tn) FILTER (d.day > g.day - {p}), 0) + 1e-7, 4) AS motor_temp_mean_{p}d"""
    for p in (7, 30)
)

ORACLE: dict[str, str] = {
    "p2_grid": """
        WITH r AS (SELECT machine_id, epoch_us(ts) AS us, CASE WHEN isnan(motor_temp) THEN NULL ELSE motor_temp END AS v FROM bronze WHERE machine_id IS NOT NULL AND ts IS NOT NULL),
        s AS (SELECT machine_id, us // 900000000 * 900000000 AS slot, count(v) AS n, avg(v) AS m FROM r GROUP BY ALL),
        g AS (SELECT machine_id, unnest(range(min(slot), max(slot) + 1, 900000000)) AS slot FROM s GROUP BY 1),
        u AS (SELECT machine_id, us, max(v) AS hi, min(v) AS lo FROM r WHERE v IS NOT NULL GROUP BY ALL),
        j AS (SELECT g.machine_id, g.slot, coalesce(s.n, 0) AS n, s.m, a.us AS au, a.hi AS av, b.us AS bu, b.lo AS bv
          FROM g LEFT JOIN s USING (machine_id, slot)
          ASOF LEFT JOIN u a ON g.machine_id = a.machine_id AND g.slot + 450000000 >= a.us
          ASOF LEFT JOIN u b ON g.machine_id = b.machine_id AND g.slot + 450000000 < b.us),
        x AS (SELECT *, CASE WHEN bu - au <= 7200000000 THEN av + (bv - av) * ((slot + 450000000 - au) / (bu - au)) END AS mid FROM j)
        SELECT machine_id, slot AS slot_start_us, n AS n_readings, round(m + 1e-7, 4) AS slot_mean, au AS left_us, bu AS right_us, round(coalesce(mid, m) + 1e-7, 4) AS grid_value,
               CASE WHEN n > 0 THEN 'observed' WHEN mid IS NOT NULL THEN 'interpolated' ELSE 'gap' END AS fill FROM x""",
    "p3_rolling": f"""
        WITH r AS (SELECT DISTINCT machine_id, window_start, window_end, record_count, error_count, vibration_mean, motor_temp_mean, vibration_std, vibration_max, motor_temp_std, cpu_usage_mean, battery_soh_mean, failure_label
          FROM gold WHERE window_duration = '24h' AND machine_id IS NOT NULL AND window_end IS NOT NULL AND record_count > 0),
        d AS (SELECT machine_id, CAST(window_end AS date) - 1 AS day, coalesce(sum(error_count), 0) AS e, sum(vibration_mean) AS v, count(vibration_mean) AS vn, sum(motor_temp_mean) AS t, count(motor_temp_mean) AS tn FROM r GROUP BY ALL),
        g AS (SELECT machine_id, CAST(unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS date) AS day FROM d GROUP BY 1)
        SELECT g.machine_id, strftime(g.day, '%Y-%m-%d') AS activity_day, count(*) FILTER (d.day = g.day) = 0 AS is_idle, {_TRAILING}
        FROM g LEFT JOIN d ON d.machine_id = g.machine_id AND d.day <= g.day AND d.day > g.day - 30 GROUP BY g.machine_id, g.day""",
    "p7_joined": f"""
        WITH b AS (SELECT prediction_id, feature_id FROM (
          SELECT p.prediction_id, f.feature_id, row_number() OVER (PARTITION BY p.prediction_id ORDER BY f.event_timestamp DESC, f.created_timestamp DESC, f.feature_id DESC) AS rn
          FROM predictions p JOIN telemetry_features f ON p.machine_id = f.machine_id AND f.event_timestamp <= p.event_timestamp
           AND f.event_timestamp >= p.event_timestamp - INTERVAL 1 DAY AND f.created_timestamp <= p.event_timestamp) WHERE rn = 1)
        SELECT p.machine_id, p.prediction_id, round(p.failure_probability + 1e-7, 4) AS failure_probability, epoch_us(p.event_timestamp) AS asof_time_us, b.feature_id, {_PAYLOAD}
        FROM predictions p LEFT JOIN b USING (prediction_id) LEFT JOIN telemetry_features f ON f.feature_id = b.feature_id""",
    "p2_found": """
        WITH r AS (SELECT machine_id, epoch_us(ts) AS us, motor_temp AS v FROM bronze WHERE machine_id IS NOT NULL AND ts IS NOT NULL),
        s AS (SELECT machine_id, us // 900000000 * 900000000 AS slot, count(*) FILTER (v IS NOT NULL AND NOT isnan(v)) AS n FROM r GROUP BY ALL),
        g AS (SELECT machine_id, unnest(range(min(slot), max(slot) + 1, 900000000)) AS slot FROM s GROUP BY 1)
        SELECT g.machine_id, g.slot AS slot_start_us FROM g LEFT JOIN s USING (machine_id, slot) WHERE coalesce(n, 0) = 0""",
    "p3_found": """
        WITH a AS (SELECT DISTINCT machine_id, CAST(window_end AS date) - 1 AS d FROM gold WHERE window_duration = '24h' AND record_count > 0 AND machine_id IS NOT NULL),
        g AS (SELECT machine_id, CAST(unnest(range(min(d), max(d) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS date) AS d FROM a GROUP BY 1)
        SELECT machine_id, strftime(d, '%Y-%m-%d') AS activity_day FROM g ANTI JOIN a USING (machine_id, d)""",
    "p7_found": """
        SELECT prediction_id, feature_id FROM (
          SELECT p.prediction_id, f.feature_id,
                 row_number() OVER (PARTITION BY p.prediction_id ORDER BY f.event_timestamp DESC, f.created_timestamp DESC, f.feature_id DESC) AS rn
          FROM predictions p JOIN telemetry_features f
            ON p.machine_id = f.machine_id AND f.event_timestamp <= p.event_timestamp
           AND f.event_timestamp >= p.event_timestamp - INTERVAL 1 DAY AND f.created_timestamp <= p.event_timestamp)
        WHERE rn = 1""",
}
