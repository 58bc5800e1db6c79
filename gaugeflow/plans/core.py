"""Queries of the telemetry operators, each with its oracle SQL where SQL can express it.

Times come out as microseconds and floating-point values are rounded, so that both engines give the same values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.functions.columns import flat, us
from gaugeflow.operators import alerts, asof, bi, dedup, drift, evalmetrics, features, joins, models, quality, verify, windows
from gaugeflow.plans.adapter import TELEMETRY_SQL, telemetry_of
from gaugeflow.schema import DURATIONS, METRICS, TASKS
from gaugeflow.session import scratch_path
from gaugeflow.sources import files, generator
from gaugeflow.sources.tables import table
from gaugeflow.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# Windows

_AGG = """round(avg(vibration) + 1e-7, 4) AS vibration_mean, round(stddev_samp(vibration) + 1e-7, 4) AS vibration_std, round(max(vibration) + 1e-7, 4) AS vibration_max,
  round(avg(motor_temp) + 1e-7, 4) AS motor_temp_mean, round(stddev_samp(motor_temp) + 1e-7, 4) AS motor_temp_std, round(max(motor_temp) + 1e-7, 4) AS motor_temp_max,
  round(avg(cpu_usage) + 1e-7, 4) AS cpu_usage_mean, round(stddev_samp(cpu_usage) + 1e-7, 4) AS cpu_usage_std, round(avg(battery_soh) + 1e-7, 4) AS battery_soh_mean,
  round(min(battery_soh) + 1e-7, 4) AS battery_soh_min, count(*) FILTER (error_code <> 0) AS error_count, count(*) AS record_count, bool_or(failure_within_horizon) AS failure_label"""


def _gold_sql(source: str, durations: dict[str, int]) -> str:
    return " UNION ALL ".join(
        f"""SELECT machine_id, s AS window_start_us, s + {sec}000000 AS window_end_us, '{name}' AS window_duration, strftime(make_timestamp(s), '%Y-%m-%d') AS event_date, {_AGG}
        FROM (SELECT *, epoch_us(ts) // {sec}000000 * {sec}000000 AS s FROM {source}) GROUP BY machine_id, s"""
        for name, sec in durations.items()
    )


def _events(spark: SparkSession, d: str) -> DataFrame:
    return telemetry_of(table(spark, d, "events"))


@query(_gold_sql(TELEMETRY_SQL, {"5m": 300}))
def gold_5m(spark: SparkSession, d: str) -> DataFrame:
    return flat(windows.build_windows(_events(spark, d), {"5m": 300}), nudge=1e-7)


@query(_gold_sql(TELEMETRY_SQL, {"1h": 3_600}))
def gold_1h(spark: SparkSession, d: str) -> DataFrame:
    return flat(windows.build_windows(_events(spark, d), {"1h": 3_600}), nudge=1e-7)


@query(_gold_sql(TELEMETRY_SQL, {"24h": 86_400}))
def gold_24h(spark: SparkSession, d: str) -> DataFrame:
    return flat(windows.build_windows(_events(spark, d), {"24h": 86_400}), nudge=1e-7)


@query(_gold_sql(TELEMETRY_SQL, DURATIONS))
def gold_all(spark: SparkSession, d: str) -> DataFrame:
    return flat(windows.build_windows(_events(spark, d)), nudge=1e-7)


_SENSED = ("vibration", "motor_temp", "cpu_usage", "battery_soh")


def _no_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in _SENSED})


# Parsing, rules, deduplication

_RULE_SQL = """(machine_id IS NULL OR ts IS NULL OR lat IS NULL OR lon IS NULL OR coalesce(lat < -90 OR lat > 90, false) OR coalesce(lon < -180 OR lon > 180, false)
  OR coalesce(speed < 0, false) OR coalesce(vibration < 0, false) OR coalesce(battery_soh < 0 OR battery_soh > 1, false) OR coalesce(cpu_usage < 0 OR cpu_usage > 100, false))"""


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")


@query("SELECT row_id, machine_id, epoch_us(ts) AS ts_us, error_code, event, failure_within_horizon FROM bronze WHERE machine_id IS NOT NULL")
def wire_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Records to wire text, parsed again, malformed ones split off."""
    b = table(spark, d, "bronze")
    wire = ingest.to_wire(b).select("value")
    text = b.select("row_id", F.to_json(F.struct(*[c for c in wire_columns()])).alias("value"), F.col("_topic").alias("topic"), F.col("_partition").alias("partition"), F.col("row_id").alias("offset"), F.col("_kafka_ts").alias("timestamp"))
    good, _ = ingest.split_parsed(ingest.parse(text))
    assert wire.columns == ["value"]
    return flat(good.select(F.col("_offset").alias("row_id"), "machine_id", "ts", "error_code", "event", "failure_within_horizon"))


def wire_columns() -> list[str]:
    return [f.name for f in ingest.wire_schema()]


@query(f"SELECT row_id FROM bronze WHERE NOT {_RULE_SQL}")
def dq_valid(spark: SparkSession, d: str) -> DataFrame:
    return quality.split(table(spark, d, "bronze"), quality.rules_of(table(spark, d, "dq_rules")))[0].select("row_id")


@query(f"SELECT row_id FROM bronze WHERE {_RULE_SQL}")
def dq_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return quality.quarantine(table(spark, d, "bronze")).select("row_id")


_BOUNDS = {"lat": (-90, 90), "lon": (-180, 180), "speed": (0, None), "vibration": (0, None), "battery_soh": (0, 1), "cpu_usage": (0, 100)}


def _profile_sql() -> str:
    cells = [f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in ("machine_id", "ts", "lat", "lon")]
    cells += [f"count(*) FILTER ({c} < {lo}) AS below_{c}" for c, (lo, _) in _BOUNDS.items()]
    cells += [f"count(*) FILTER ({c} > {hi}) AS above_{c}" for c, (_, hi) in _BOUNDS.items() if hi is not None]
    return f"SELECT count(*) AS total, count(*) FILTER (NOT {_RULE_SQL}) AS valid, {', '.join(cells)} FROM bronze"


@query(_profile_sql())
def dq_profile(spark: SparkSession, d: str) -> DataFrame:
    return quality.profile(table(spark, d, "bronze"))


@query(
    f"""SELECT total, valid, total - valid AS quarantined, round((total - valid) / greatest(total, 1), 6) AS quarantine_rate,
    round(greatest(null_machine_id, null_ts, null_lat, null_lon) / greatest(total, 1), 6) AS max_null_rate,
    round(greatest(below_lat + above_lat, below_lon + above_lon, below_speed, below_vibration, below_battery_soh + above_battery_soh, below_cpu_usage + above_cpu_usage) / greatest(total, 1), 6) AS max_range_rate,
    greatest(null_machine_id, null_ts, null_lat, null_lon) <= 0.05 * total AND greatest(below_lat + above_lat, below_lon + above_lon, below_speed, below_vibration, below_battery_soh + above_battery_soh, below_cpu_usage + above_cpu_usage) <= 0.01 * total AS passed
    FROM ({_profile_sql()})"""
)
def dq_gate(spark: SparkSession, d: str) -> DataFrame:
    return flat(quality.gate(table(spark, d, "bronze")), 6)


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY machine_id, ts ORDER BY _ingest_ts DESC NULLS LAST, _offset DESC NULLS LAST, row_id DESC) AS rn FROM bronze) WHERE rn = 1)"


@query(f"SELECT machine_id, epoch_us(ts) AS ts_us, row_id, _offset, error_code FROM {_LATEST}")
def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    return flat(dedup.keep_latest(table(spark, d, "bronze")).select("machine_id", "ts", "row_id", "_offset", "error_code"))


_VALID = f"(SELECT * FROM (SELECT * REPLACE ({', '.join(f'CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}' for c in _SENSED)}) FROM {_LATEST}) WHERE NOT {_RULE_SQL})"


@query(_gold_sql(_VALID, DURATIONS))
def silver_to_gold(spark: SparkSession, d: str) -> DataFrame:
    """The raw table deduplicated, without what the rules forbid, aggregated; NaN is no reading here."""
    return flat(windows.build_windows(quality.split(_no_nan(dedup.keep_latest(table(spark, d, "bronze"))))[0]), nudge=1e-7)


@query("SELECT l_orderkey, l_linenumber, max(struct_pack(a := epoch_us(l_shipdate), b := l_partkey, c := l_suppkey)).b AS l_partkey FROM lineitem GROUP BY ALL")
def dedup_lineitem(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", us("l_shipdate").alias("shipped"), "l_partkey", "l_suppkey")
    return dedup.keep_latest(rows, ("l_orderkey", "l_linenumber"), ("shipped", "l_partkey", "l_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT row_id FROM bronze b WHERE event_date >= DATE '2026-02-03' AND NOT EXISTS (SELECT 1 FROM bronze t WHERE t.event_date < DATE '2026-02-03' AND t.machine_id = b.machine_id AND t.ts = b.ts)")
def merge_insert_only(spark: SparkSession, d: str) -> DataFrame:
    """What a merge of the second day into the first inserts."""
    b = table(spark, d, "bronze")
    first = F.col("event_date") < F.lit("2026-02-03").cast("date")
    return dedup.insert_absent(b.where(first), b.where(~first)).select("row_id")


@query("SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT machine_id, ts FROM bronze)) AS n_keys, count(*) - (SELECT count(*) FROM (SELECT DISTINCT machine_id, ts FROM bronze)) AS n_duplicates FROM bronze")
def duplicate_count(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_count(table(spark, d, "bronze"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (_topic IS NOT NULL AND _offset IS NOT NULL AND _ingest_ts IS NOT NULL) AS n_complete, count(*) = count(*) FILTER (_topic IS NOT NULL AND _offset IS NOT NULL AND _ingest_ts IS NOT NULL) AS complete FROM bronze")
def metadata_complete(spark: SparkSession, d: str) -> DataFrame:
    return dedup.metadata_complete(table(spark, d, "bronze"))


# Features

_PIVOT = "(SELECT machine_id, window_end AS event_timestamp, " + ", ".join(f"max({m}) FILTER (window_duration = '{w}') AS {m}_{w}" for w in DURATIONS for m in METRICS) + ", bool_or(failure_label) FILTER (window_duration = '5m') AS label_failure_within_horizon, '5m' AS window_duration_anchor FROM gold GROUP BY 1, 2)"
_WIDE = ", ".join(f"round({m}_{w}, 4) AS {m}_{w}" if m not in ("error_count", "record_count") else f"{m}_{w}" for w in DURATIONS for m in METRICS)
_ID = "machine_id, epoch_us(event_timestamp) AS event_timestamp_us"
_OVER = "OVER (PARTITION BY machine_id ORDER BY event_timestamp)"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold")


@query(f"SELECT {_ID}, {_WIDE}, label_failure_within_horizon, window_duration_anchor FROM {_PIVOT}")
def feature_pivot(spark: SparkSession, d: str) -> DataFrame:
    return flat(features.pivot(_gold(spark, d)))


def _lag_sql(names: list[str]) -> str:
    return ", ".join(f"round(lag({s}, {n}) {_OVER}, 4) AS {s}_lag_{n}" for s in names for n in features.LAGS)


def _roc_sql(names: list[str]) -> str:
    return ", ".join(f"round({s} - lag({s}, 1) {_OVER}, 4) AS {s}_roc_1" for s in names)


_UPTIME = "round(CASE WHEN error_count_5m IS NULL OR record_count_5m IS NULL OR record_count_5m = 0 THEN NULL ELSE greatest(0.0, least(1.0, 1 - error_count_5m / record_count_5m)) END, 4) AS uptime_ratio_5m"


@query(f"SELECT {_ID}, {_lag_sql(list(features.LAG_SOURCES))} FROM {_PIVOT}")
def feature_lag(spark: SparkSession, d: str) -> DataFrame:
    wide = features.add_lags(features.pivot(_gold(spark, d)))
    return flat(wide.select("machine_id", "event_timestamp", *[c for c in wide.columns if "_lag_" in c]))


@query(f"SELECT {_ID}, {_roc_sql(list(features.LAG_SOURCES))} FROM {_PIVOT}")
def feature_roc(spark: SparkSession, d: str) -> DataFrame:
    wide = features.add_rates(features.add_lags(features.pivot(_gold(spark, d))))
    return flat(wide.select("machine_id", "event_timestamp", *[c for c in wide.columns if c.endswith("_roc_1")]))


@query(f"SELECT {_ID}, {_UPTIME} FROM {_PIVOT}")
def feature_uptime(spark: SparkSession, d: str) -> DataFrame:
    return flat(features.add_uptime(features.pivot(_gold(spark, d))).select("machine_id", "event_timestamp", "uptime_ratio_5m"))


@query(f"SELECT {_ID}, {_WIDE}, label_failure_within_horizon, window_duration_anchor, {_lag_sql(list(features.LAG_SOURCES))}, {_roc_sql(list(features.LAG_SOURCES))}, {_UPTIME} FROM {_PIVOT}")
def feature_dataset(spark: SparkSession, d: str) -> DataFrame:
    return flat(features.feature_dataset(_gold(spark, d)))


# As-of joins and the online table

_FEATURE_ONE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY machine_id, event_timestamp ORDER BY created_timestamp DESC NULLS LAST, feature_id DESC) AS rn FROM telemetry_features WHERE machine_id IS NOT NULL AND event_timestamp IS NOT NULL) WHERE rn = 1)"


def _asof_sql(ttl: str | None) -> str:
    hit = "f.feature_id" if ttl is None else f"CASE WHEN f.event_timestamp >= p.event_timestamp - {ttl} THEN f.feature_id END"
    return f"""SELECT p.prediction_id, {hit} AS feature_id FROM (SELECT * FROM predictions WHERE machine_id IS NOT NULL AND event_timestamp IS NOT NULL) p
        ASOF LEFT JOIN {_FEATURE_ONE} f ON p.machine_id = f.machine_id AND p.event_timestamp >= f.event_timestamp
        UNION ALL SELECT prediction_id, NULL FROM predictions WHERE machine_id IS NULL OR event_timestamp IS NULL"""


@query(_asof_sql(None))
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    return asof.asof_join(table(spark, d, "predictions"), table(spark, d, "telemetry_features"), left_cols=("prediction_id",), tie="created_timestamp").select("prediction_id", "feature_id")


@query(_asof_sql("INTERVAL 30 MINUTE"))
def asof_join_ttl(spark: SparkSession, d: str) -> DataFrame:
    return asof.asof_join(table(spark, d, "predictions"), table(spark, d, "telemetry_features"), left_cols=("prediction_id",), tie="created_timestamp", ttl_us=30 * 60_000_000).select("prediction_id", "feature_id")


_ONLINE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY event_timestamp DESC, created_timestamp DESC NULLS LAST, feature_id DESC) AS rk FROM telemetry_features WHERE machine_id IS NOT NULL AND event_timestamp >= (SELECT max(event_timestamp) FROM telemetry_features) - INTERVAL 30 DAY) WHERE rk = 1)"
_ONLINE_COLS = ("vibration_mean_5m", "motor_temp_mean_5m", "battery_soh_mean_5m", "cpu_usage_mean_5m", "vibration_mean_1h", "uptime_ratio_5m")


@query(f"SELECT machine_id, epoch_us(event_timestamp) AS event_timestamp_us, feature_id FROM {_ONLINE}")
def online_latest(spark: SparkSession, d: str) -> DataFrame:
    return flat(asof.online_latest(table(spark, d, "telemetry_features")).select("machine_id", "event_timestamp", "feature_id"))


@query(f"SELECT m.machine_id, o.feature_id, round(o.vibration_mean_5m, 4) AS vibration_mean_5m FROM (SELECT DISTINCT machine_id FROM predictions WHERE machine_id IS NOT NULL) m LEFT JOIN {_ONLINE} o USING (machine_id)")
def online_lookup(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "predictions").where("machine_id IS NOT NULL").select("machine_id").distinct()
    return flat(asof.online_lookup(entities, asof.online_latest(table(spark, d, "telemetry_features")), ("feature_id", "vibration_mean_5m")))


_ASKED = "(SELECT machine_id, max(event_timestamp) AS t FROM predictions WHERE machine_id IS NOT NULL GROUP BY 1)"
_HISTORY = f"(SELECT a.machine_id, {', '.join(f'CASE WHEN f.event_timestamp >= a.t - INTERVAL 1 DAY THEN f.{c} END AS {c}' for c in _ONLINE_COLS)} FROM {_ASKED} a ASOF LEFT JOIN {_FEATURE_ONE} f ON a.machine_id = f.machine_id AND a.t >= f.event_timestamp)"


@query(
    " UNION ALL ".join(
        f"SELECT machine_id, '{c}' AS feature, round(h.{c}::DOUBLE, 4) AS historical, round(o.{c}::DOUBLE, 4) AS online, h.{c} IS NOT DISTINCT FROM o.{c} AS equal FROM {_HISTORY} h FULL JOIN {_ONLINE} o USING (machine_id)"
        for c in _ONLINE_COLS
    )
)
def online_offline_parity(spark: SparkSession, d: str) -> DataFrame:
    """Features as of each machine's last prediction, at most a day old, against what the online table holds."""
    t = table(spark, d, "telemetry_features")
    asked = table(spark, d, "predictions").where("machine_id IS NOT NULL").groupBy("machine_id").agg(F.max("event_timestamp").alias("event_timestamp"))
    then = asof.asof_join(asked, t, left_cols=(), right_cols=_ONLINE_COLS, tie="created_timestamp", ttl_us=asof.DAY_US)
    historical = then.select("machine_id", *[F.col(f"v_{c}").alias(c) for c in _ONLINE_COLS])
    return flat(asof.parity(historical, asof.online_latest(t), _ONLINE_COLS))


# Dashboard tables


def _kpi_sql(where: str = "") -> str:
    return f"""SELECT count(DISTINCT machine_id) AS n_machines, count(*) AS n_windows, count(*) FILTER (coalesce(failure_label, false)) AS n_failures, round(avg(coalesce(failure_label, false)::INT), 4) AS failure_rate,
    round(avg(battery_soh_mean), 4) AS avg_battery_soh, round(avg(vibration_mean), 4) AS avg_vibration, CAST(sum(error_count) AS BIGINT) AS total_errors FROM gold {where}"""


@query(_kpi_sql())
def fleet_kpis(spark: SparkSession, d: str) -> DataFrame:
    return flat(bi.fleet_kpis(_gold(spark, d)))


@query(_kpi_sql("WHERE window_duration = '1h'"))
def fleet_kpis_1h(spark: SparkSession, d: str) -> DataFrame:
    return flat(bi.fleet_kpis(_gold(spark, d), "1h"))


_HEALTH = """SELECT machine_id, epoch_us(window_end) AS last_window_end_us, round(battery_soh_mean, 4) AS battery_soh_mean, round(vibration_mean, 4) AS vibration_mean, round(vibration_max, 4) AS vibration_max, round(motor_temp_mean, 4) AS motor_temp_mean,
    error_count, failure_label FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY window_end DESC, battery_soh_mean DESC NULLS LAST, vibration_mean DESC NULLS LAST, vibration_max DESC NULLS LAST, motor_temp_mean DESC NULLS LAST,
    error_count DESC NULLS LAST, failure_label DESC NULLS LAST) AS rn FROM gold WHERE window_duration = '5m' AND window_end IS NOT NULL) WHERE rn = 1"""


@query(_HEALTH)
def machine_health(spark: SparkSession, d: str) -> DataFrame:
    return flat(bi.machine_health(_gold(spark, d)))


@query("SELECT machine_id, epoch_us(window_end) AS window_end_us, window_duration, count(*) AS n FROM gold WHERE window_end >= (SELECT max(window_end) FROM gold) - INTERVAL 7 DAY GROUP BY ALL")
def recent_filter(spark: SparkSession, d: str) -> DataFrame:
    return flat(bi.recent(_gold(spark, d), 7).groupBy("machine_id", "window_end", "window_duration").agg(F.count("*").alias("n")))


@query("SELECT machine_id, epoch_us(window_start) AS window_start_us, epoch_us(window_end) AS window_end_us, window_duration, round(vibration_mean, 4) AS vibration_mean, error_count, record_count FROM gold")
def gold_export(spark: SparkSession, d: str) -> DataFrame:
    return flat(bi.gold_export(_gold(spark, d)).select("machine_id", "window_start", "window_end", "window_duration", "vibration_mean", "error_count", "record_count"))


#: The three tasks stand for the aliases of the prediction table.
_ALIASES = {"predictive_maintenance": "champion", "anomaly_detection": "challenger", "battery_health": "shadow"}


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predictions")
    return bi.predictions_long({t: p.where(F.col("alias") == a).withColumnRenamed("failure_probability", TASKS[t].output) for t, a in _ALIASES.items()})


_LONG = "(SELECT machine_id, event_timestamp, CASE alias WHEN 'champion' THEN 'predictive_maintenance' WHEN 'challenger' THEN 'anomaly_detection' ELSE 'battery_health' END AS task, failure_probability AS score, model, alias FROM predictions WHERE alias IS NOT NULL)"
_LATEST_TASK = f"(SELECT machine_id, task, max(struct_pack(t := event_timestamp, s := coalesce(score, -1))) AS b FROM {_LONG} WHERE machine_id IS NOT NULL AND event_timestamp IS NOT NULL GROUP BY ALL)"
_LATEST_SQL = f"""(SELECT * FROM (SELECT machine_id, max(nullif(b.s, -1)) FILTER (task = 'predictive_maintenance') AS failure_probability, max(nullif(b.s, -1)) FILTER (task = 'anomaly_detection') AS anomaly_score,
    max(nullif(b.s, -1)) FILTER (task = 'battery_health') AS battery_soh_prediction, max(b.t) AS last_scored_at FROM {_LATEST_TASK} GROUP BY 1) WHERE coalesce(failure_probability, anomaly_score, battery_soh_prediction) IS NOT NULL)"""


@query(f"SELECT machine_id, epoch_us(event_timestamp) AS event_timestamp_us, task, round(score, 4) AS score, model, alias FROM {_LONG}")
def predictions_long(spark: SparkSession, d: str) -> DataFrame:
    return flat(_predictions(spark, d))


@query(f"SELECT machine_id, round(failure_probability, 4) AS failure_probability, round(anomaly_score, 4) AS anomaly_score, round(battery_soh_prediction, 4) AS battery_soh_prediction, epoch_us(last_scored_at) AS last_scored_at_us FROM {_LATEST_SQL}")
def predictions_latest(spark: SparkSession, d: str) -> DataFrame:
    return flat(bi.predictions_latest(_predictions(spark, d)))


def _dashboard(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        gold, long = _gold(spark, d), _predictions(spark, d)
        views = {"gold_windows": gold, "predictions_long": long, "predictions_latest": bi.predictions_latest(long), "fleet_kpis": bi.fleet_kpis(gold), "machine_health": bi.machine_health(gold)}
        bi.register(views)
        return flat(bi.dashboard(spark, name))

    run.__name__ = f"dash_{name}"
    return run


_DASH_SQL = {
    "window_count": "SELECT count(*) AS n FROM gold",
    "kpi_machines": f"SELECT n_machines FROM ({_kpi_sql()})",
    "kpi_failure_rate": f"SELECT failure_rate FROM ({_kpi_sql()})",
    "kpi_battery": f"SELECT avg_battery_soh FROM ({_kpi_sql()})",
    "kpi_errors": f"SELECT total_errors FROM ({_kpi_sql()})",
    "series_vibration": "SELECT epoch_us(window_end) AS window_end_us, round(avg(vibration_mean), 4) AS avg_vibration, round(max(vibration_max), 4) AS max_vibration FROM gold WHERE window_duration = '1h' GROUP BY 1",
    "series_battery": "SELECT epoch_us(window_end) AS window_end_us, round(avg(battery_soh_mean), 4) AS avg_soh, round(min(battery_soh_min), 4) AS min_soh FROM gold WHERE window_duration = '1h' GROUP BY 1",
    "health_table": _HEALTH,
    "at_risk": f"SELECT count(*) AS n FROM {_LATEST_SQL} WHERE failure_probability > 0.5",
    "max_risk": f"SELECT round(max(failure_probability), 4) AS max_probability FROM {_LATEST_SQL}",
    "scored_machines": f"SELECT count(*) AS n FROM {_LATEST_SQL}",
    "min_battery_prediction": f"SELECT round(min(battery_soh_prediction), 4) AS min_soh FROM {_LATEST_SQL}",
    "leaderboard": f"SELECT machine_id, round(failure_probability, 4) AS failure_probability, round(anomaly_score, 4) AS anomaly_score, round(battery_soh_prediction, 4) AS battery_soh_prediction, epoch_us(last_scored_at) AS last_scored_at_us FROM {_LATEST_SQL}",
    "series_risk": f"SELECT epoch_us(event_timestamp) AS event_timestamp_us, round(avg(score), 4) AS avg_score FROM {_LONG} WHERE task = 'predictive_maintenance' GROUP BY 1",
    "series_anomaly": f"SELECT epoch_us(event_timestamp) AS event_timestamp_us, round(avg(score), 4) AS avg_score FROM {_LONG} WHERE task = 'anomaly_detection' GROUP BY 1",
    "duration_summary": "SELECT window_duration, count(*) AS n, round(avg(vibration_mean), 4) AS avg_vibration, round(avg(battery_soh_mean), 4) AS avg_soh, CAST(sum(error_count) AS BIGINT) AS errors, CAST(count(*) FILTER (failure_label) AS BIGINT) AS failures FROM gold GROUP BY 1",
    "window_sample": "SELECT machine_id, epoch_us(window_end) AS window_end_us, window_duration, round(vibration_mean, 4) AS vibration_mean, record_count FROM gold ORDER BY machine_id NULLS FIRST, window_end NULLS FIRST, window_duration NULLS FIRST, gold.vibration_mean NULLS FIRST, record_count NULLS FIRST LIMIT 20",
}
for _name, _sql in _DASH_SQL.items():
    query(_sql)(_dashboard(_name))


# Drift

#: All numeric columns of the feature table.
_DRIFT = (
    *[f"{m}_{w}" for m in ("vibration_mean", "motor_temp_mean", "cpu_usage_mean", "battery_soh_mean") for w in ("5m", "1h", "24h")],
    *("vibration_mean_5m_lag_1", "vibration_mean_5m_lag_3", "motor_temp_mean_5m_lag_1", "battery_soh_mean_5m_lag_1", "cpu_usage_mean_5m_lag_1"),
    *[f"{m}_5m_roc_1" for m in ("vibration_mean", "motor_temp_mean", "cpu_usage_mean", "battery_soh_mean")],
    *("error_count_5m", "record_count_5m", "uptime_ratio_5m"),
)


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The older half of the feature rows as reference, the newer as current."""
    return evalmetrics.time_split(table(spark, d, "telemetry_features"), 0.5)


_MIDDLE = "(SELECT quantile_cont(epoch_us(event_timestamp)::DOUBLE, 0.5) FROM telemetry_features)"


def _drift_values(side: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, epoch_us(event_timestamp) <= {_MIDDLE} AS ref FROM telemetry_features WHERE event_timestamp IS NOT NULL AND {c} IS NOT NULL AND isfinite(CAST({c} AS DOUBLE))" for c in _DRIFT)


_V = f"v AS ({_drift_values('')})"
_KS = f"""WITH {_V}, c AS (SELECT feature, v, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS n FROM v GROUP BY ALL),
    s AS (SELECT feature, sum(r) OVER w / sum(r) OVER (PARTITION BY feature) AS fr, sum(n) OVER w / sum(n) OVER (PARTITION BY feature) AS fn FROM c WINDOW w AS (PARTITION BY feature ORDER BY v))
    SELECT feature, round(max(abs(fr - fn)), 6) AS ks FROM s GROUP BY 1"""
_PSI = f"""WITH {_V}, q AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FILTER (ref))) AS e FROM v GROUP BY 1),
    b AS (SELECT v.feature, v.ref, len(q.e) AS ne, len(list_filter(q.e[2:len(q.e) - 1], lambda x: x <= v.v)) AS bin FROM v JOIN q USING (feature)),
    c AS (SELECT feature, bin, max(ne) AS ne, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS n FROM b GROUP BY ALL),
    p AS (SELECT feature, ne, greatest(r / sum(r) OVER (PARTITION BY feature), 1e-6) AS pr, greatest(n / sum(n) OVER (PARTITION BY feature), 1e-6) AS pn FROM c)
    SELECT feature, round(CASE WHEN max(ne) < 2 THEN 0 ELSE sum((pn - pr) * ln(pn / pr)) END + 1e-7, 4) AS psi FROM p GROUP BY 1"""


@query(_PSI)
def psi(spark: SparkSession, d: str) -> DataFrame:
    ref, cur = _sides(spark, d)
    return flat(drift.drift_report(ref, cur).select("feature", "psi"), nudge=1e-7)


@query(_KS)
def ks(spark: SparkSession, d: str) -> DataFrame:
    ref, cur = _sides(spark, d)
    return flat(drift.drift_report(ref, cur).select("feature", "ks"), 6)


@query(f"SELECT a.feature, psi, round(ks + 1e-7, 4) AS ks, psi > 0.2 AS drifted FROM ({_PSI}) a JOIN ({_KS.replace(', 6) AS ks', ', 12) AS ks')}) b USING (feature)")
def drift_report(spark: SparkSession, d: str) -> DataFrame:
    ref, cur = _sides(spark, d)
    return flat(drift.drift_report(ref, cur), nudge=1e-7)


@query(f"SELECT count(*) AS n_features, count(*) FILTER (psi > 0.2) AS n_drifted, round(count(*) FILTER (psi > 0.2) / count(*), 4) AS drift_share, count(*) FILTER (psi > 0.2) / count(*) > 0.5 AS dataset_drift FROM ({_PSI})")
def drift_summary(spark: SparkSession, d: str) -> DataFrame:
    ref, cur = _sides(spark, d)
    return flat(drift.drift_summary(drift.drift_report(ref, cur)))


# Splits and metrics


def _split_sql(test: float, validation: float | None = None) -> str:
    one = f"(SELECT quantile_cont(epoch_us(event_timestamp)::DOUBLE, {1 - test!r}) FROM telemetry_features)"
    part = f"CASE WHEN epoch_us(event_timestamp) <= {one} THEN 'train' ELSE 'test' END"
    if validation:
        two = f"(SELECT quantile_cont(epoch_us(event_timestamp)::DOUBLE, {1 - validation / (1 - test)!r}) FROM telemetry_features WHERE epoch_us(event_timestamp) <= {one})"
        part = f"CASE WHEN epoch_us(event_timestamp) <= {two} THEN 'train' WHEN epoch_us(event_timestamp) <= {one} THEN 'validation' ELSE 'test' END"
    return f"SELECT feature_id, {part} AS part FROM telemetry_features WHERE event_timestamp IS NOT NULL"


def _parts(**parts: DataFrame) -> DataFrame:
    out = [df.select("feature_id", F.lit(name).alias("part")) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, out)


@query(_split_sql(0.2))
def time_split(spark: SparkSession, d: str) -> DataFrame:
    train, test = evalmetrics.time_split(table(spark, d, "telemetry_features"), 0.2)
    return _parts(train=train, test=test)


@query(_split_sql(0.2, 0.1))
def time_split3(spark: SparkSession, d: str) -> DataFrame:
    train, validation, test = evalmetrics.time_split3(table(spark, d, "telemetry_features"), 0.2, 0.1)
    return _parts(train=train, validation=validation, test=test)


#: Scored rows: the uptime and vibration of the feature rows stand for a score of their label.
_SCORED = "(SELECT feature_id, label_failure_within_horizon AS y, round(vibration_mean_5m + 1e-7, 2) AS s FROM telemetry_features WHERE label_failure_within_horizon IS NOT NULL AND vibration_mean_5m IS NOT NULL AND NOT isnan(vibration_mean_5m))"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "telemetry_features").where("label_failure_within_horizon IS NOT NULL AND vibration_mean_5m IS NOT NULL AND NOT isnan(vibration_mean_5m)")
    return rows.select("feature_id", F.col("label_failure_within_horizon").alias("y"), F.round(F.col("vibration_mean_5m") + 1e-7, 2).alias("s"))


@query(
    f"""WITH c AS (SELECT s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM {_SCORED} GROUP BY 1),
    r AS (SELECT p, n, sum(n) OVER (ORDER BY s) - n AS nb, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM c)
    SELECT round(sum(p * (nb + n / 2)) / (max(pp) * max(nn)), 6) AS roc_auc, round(sum(p / pp * tp / (tp + fp)), 6) AS average_precision FROM r"""
)
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return flat(evalmetrics.ranking_metrics(_scored(spark, d), "y", "s"), 6)


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY s DESC, feature_id) AS rk, count(*) OVER () AS n, count(*) FILTER (y) OVER () AS p FROM {_SCORED}), k AS (SELECT *, greatest(1, CAST(round_even(0.2 * n, 0) AS BIGINT)) AS k FROM r)
    SELECT max(k) AS n_flagged, round(count(*) FILTER (y AND rk <= k) / max(k), 6) AS precision, round(count(*) FILTER (y AND rk <= k) / max(p), 6) AS recall FROM k"""
)
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return flat(evalmetrics.precision_at_fraction(_scored(spark, d), "y", "s", 0.2, "feature_id"), 6)


@query(
    f"""SELECT count(*) AS n, round(count(*) FILTER (y) / count(*), 6) AS positive_rate, round(count(*) FILTER (y AND s >= 0.8) / count(*) FILTER (s >= 0.8), 6) AS precision, round(count(*) FILTER (y AND s >= 0.8) / count(*) FILTER (y), 6) AS recall,
    round(2 * count(*) FILTER (y AND s >= 0.8) / (count(*) FILTER (s >= 0.8) + count(*) FILTER (y)), 6) AS f1 FROM {_SCORED}"""
)
def threshold_metrics(spark: SparkSession, d: str) -> DataFrame:
    return flat(evalmetrics.threshold_metrics(_scored(spark, d), "y", "s", 0.8), 6)


@query("SELECT count(*) AS n, round(sqrt(avg(e * e)), 2) AS rmse, round(avg(abs(e)), 2) AS mae, round(1 - avg(e * e) / var_pop(y), 2) AS r2 FROM (SELECT l_extendedprice::DOUBLE AS y, l_extendedprice::DOUBLE - 1500 * l_quantity::DOUBLE AS e FROM lineitem)")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A price guessed from the quantity."""
    guessed = table(spark, d, "lineitem").withColumn("guess", F.col("l_quantity").cast("double") * 1500)
    return flat(evalmetrics.regression_metrics(guessed, "l_extendedprice", "guess"), 2)


@query("SELECT round(greatest(1, count(*) FILTER (NOT label_failure_within_horizon) / count(*) FILTER (label_failure_within_horizon)), 4) AS weight FROM telemetry_features")
def class_weight(spark: SparkSession, d: str) -> DataFrame:
    return flat(evalmetrics.class_weight(table(spark, d, "telemetry_features"), "label_failure_within_horizon"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(median({c}), 4) AS median, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM telemetry_features WHERE {c} IS NOT NULL AND NOT isnan({c})" for c in _DRIFT))
def fit_statistics(spark: SparkSession, d: str) -> DataFrame:
    return flat(evalmetrics.fit_statistics(table(spark, d, "telemetry_features"), list(_DRIFT)))


_BUCKETS = (10.0, 50.0, 100.0, 250.0, 500.0)
_HIST = "SELECT event_type, count(*) AS requests, round(sum(value), 2) AS latency_sum, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{str(b).replace('.', '_')}" for b in _BUCKETS) + " FROM events GROUP BY 1"


@query(_HIST)
def request_histogram(spark: SparkSession, d: str) -> DataFrame:
    return flat(evalmetrics.request_metrics(table(spark, d, "events"), ("event_type",), "value", _BUCKETS), 2)


@query(
    f"""SELECT event_type, round(CASE WHEN le_10_0 >= r THEN 10 * r / le_10_0 WHEN le_50_0 >= r THEN 10 + 40 * (r - le_10_0) / (le_50_0 - le_10_0) WHEN le_100_0 >= r THEN 50 + 50 * (r - le_50_0) / (le_100_0 - le_50_0)
    WHEN le_250_0 >= r THEN 100 + 150 * (r - le_100_0) / (le_250_0 - le_100_0) WHEN le_500_0 >= r THEN 250 + 250 * (r - le_250_0) / (le_500_0 - le_250_0) ELSE 500 END, 4) AS quantile FROM (SELECT *, 0.95 * requests AS r FROM ({_HIST}))"""
)
def request_quantile(spark: SparkSession, d: str) -> DataFrame:
    hist = evalmetrics.request_metrics(table(spark, d, "events"), ("event_type",), "value", _BUCKETS)
    return flat(evalmetrics.histogram_quantile(hist, 0.95, _BUCKETS).select("event_type", "quantile"))


@query("SELECT event_type, epoch_us(ts) // 3600000000 * 3600000000 AS window_start_us, count(*) AS requests, round(count(*) / 3600, 6) AS rate, count(*) FILTER (value > 100) AS errors, round(count(*) FILTER (value > 100) / 3600, 6) AS error_rate FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def request_rates(spark: SparkSession, d: str) -> DataFrame:
    return flat(evalmetrics.request_rates(table(spark, d, "events"), "ts", ("event_type",), F.col("value") > 100, 3_600_000_000), 6)


# Alerts

_CAND = "(SELECT machine_id, ts, vibration AS anomaly_score, row_id FROM bronze WHERE machine_id IS NOT NULL AND ts IS NOT NULL AND vibration >= 1.0 AND NOT isnan(vibration))"
_TOP = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY anomaly_score DESC, ts, row_id DESC) AS rn FROM {_CAND}) WHERE rn = 1)"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bronze").where("ts IS NOT NULL AND NOT isnan(vibration)")
    return alerts.above_threshold(b.select("machine_id", F.col("ts").alias("event_timestamp"), F.col("vibration").alias("anomaly_score"), "row_id"), 1.0)


@query(f"SELECT row_id, round(anomaly_score, 4) AS anomaly_score FROM {_CAND}")
def alert_threshold(spark: SparkSession, d: str) -> DataFrame:
    return flat(_candidates(spark, d).select("row_id", "anomaly_score"))


@query(f"SELECT machine_id, epoch_us(ts) AS event_timestamp_us, round(anomaly_score, 4) AS anomaly_score FROM {_TOP}")
def alert_top1(spark: SparkSession, d: str) -> DataFrame:
    return flat(alerts.best_per_machine(_candidates(spark, d)).select("machine_id", "event_timestamp", "anomaly_score"))


@query(f"SELECT t.machine_id, epoch_us(t.ts) AS event_timestamp_us FROM {_TOP} t LEFT JOIN (SELECT machine_id, max(event_timestamp) AS last FROM predictions GROUP BY 1) p USING (machine_id) WHERE p.last IS NULL OR epoch_us(t.ts) - epoch_us(p.last) >= 7200000000")
def alert_throttle(spark: SparkSession, d: str) -> DataFrame:
    """The prediction times stand for earlier alerts, with a cooldown of two hours."""
    return flat(alerts.throttle(_candidates(spark, d), table(spark, d, "predictions"), "120 minutes").select("machine_id", "event_timestamp"))


# Checks

@query("SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT machine_id, ts FROM bronze)) AS n_duplicates, count(*) FILTER (_topic IS NOT NULL AND _offset IS NOT NULL AND _ingest_ts IS NOT NULL) AS n_complete, count(*) = (SELECT count(*) FROM (SELECT DISTINCT machine_id, ts FROM bronze)) AND count(*) = count(*) FILTER (_topic IS NOT NULL AND _offset IS NOT NULL AND _ingest_ts IS NOT NULL) AS passed FROM bronze")
def verify_bronze(spark: SparkSession, d: str) -> DataFrame:
    return verify.verify_bronze(table(spark, d, "bronze"))


@query(f"SELECT count(*) AS n_rows, count(*) FILTER ({_RULE_SQL}) AS n_violations, count(*) - (SELECT count(*) FROM (SELECT DISTINCT machine_id, ts FROM silver)) AS n_duplicates FROM silver")
def verify_silver(spark: SparkSession, d: str) -> DataFrame:
    return verify.verify_silver(table(spark, d, "silver"))


@query("SELECT count(*) AS n_rows, round(min(vibration_mean), 4) AS low_vibration, round(min(battery_soh_mean), 4) AS low_battery, round(min(cpu_usage_mean), 4) AS low_cpu, round(min(motor_temp_mean), 4) AS low_temp, (SELECT count(*) FROM (SELECT DISTINCT event_date, window_duration FROM gold WHERE event_date IS NOT NULL AND window_duration IS NOT NULL)) AS n_partitions, max(epoch_us(window_end)) AS newest_us, min(vibration_mean) >= 0 AND min(battery_soh_mean) >= 0 AND min(cpu_usage_mean) >= 0 AS sane FROM gold")
def verify_gold(spark: SparkSession, d: str) -> DataFrame:
    return flat(verify.verify_gold(_gold(spark, d)))


@query("SELECT DISTINCT strftime(event_date, '%Y-%m-%d') AS event_date, window_duration FROM gold")
def gold_partitions(spark: SparkSession, d: str) -> DataFrame:
    return flat(verify.partitions(_gold(spark, d)))


_TWO = {k: v for k, v in DURATIONS.items() if k != "24h"}


@query(f"SELECT d AS window_duration FROM (VALUES ('5m'), ('1h'), ('24h')) t(d) WHERE d NOT IN (SELECT window_duration FROM ({_gold_sql(TELEMETRY_SQL, _TWO)}))")
def missing_durations(spark: SparkSession, d: str) -> DataFrame:
    """What a table of two of the three durations lacks."""
    return verify.missing_durations(windows.build_windows(_events(spark, d), _TWO))


@query(
    f"""WITH s AS (SELECT count(*) AS n_silver, count(*) FILTER (coalesce(lat < -90 OR lat > 90, false) OR coalesce(lon < -180 OR lon > 180, false) OR coalesce(speed < 0, false) OR coalesce(vibration < 0, false) OR coalesce(battery_soh < 0 OR battery_soh > 1, false) OR coalesce(cpu_usage < 0 OR cpu_usage > 100, false)) AS n_out_of_range,
    greatest(count(*) FILTER (machine_id IS NULL), count(*) FILTER (ts IS NULL), count(*) FILTER (lat IS NULL), count(*) FILTER (lon IS NULL)) / greatest(1, count(*)) AS r FROM silver),
    k AS (SELECT count(*) AS k FROM (SELECT DISTINCT machine_id, ts FROM silver)),
    g AS (SELECT count(*) AS n_gold, min(vibration_mean) >= 0 AND min(battery_soh_mean) >= 0 AND min(cpu_usage_mean) >= 0 AS sane, count(DISTINCT window_duration) FILTER (window_duration IN ('5m', '1h', '24h')) AS durations FROM gold),
    q AS (SELECT count(*) AS n_quarantined FROM silver WHERE {_RULE_SQL})
    SELECT n_silver, n_silver - k AS n_duplicates, n_out_of_range, round(r, 6) AS max_null_rate, n_gold, sane, n_quarantined, n_silver = k AND n_out_of_range = 0 AND r <= 0.05 AND durations = 3 AND sane AS passed FROM s, k, g, q"""
)
def verify_layers(spark: SparkSession, d: str) -> DataFrame:
    silver = table(spark, d, "silver")
    row = verify.verify_layers(silver, _gold(spark, d), quality.quarantine(silver))
    return flat(row.select("n_silver", "n_duplicates", "n_out_of_range", "max_null_rate", "n_gold", "sane", "n_quarantined", "passed"), 6)


# Streaming


def _message_files(spark: SparkSession, df: DataFrame, path: str) -> None:
    text = df.select(F.col("machine_id").alias("key"), F.to_json(F.struct(*wire_columns())).alias("value"), F.col("_topic").alias("topic"), F.col("_partition").alias("partition"), F.col("_offset").alias("offset"), F.col("_kafka_ts").alias("timestamp"))
    text.write.json(path)


@query("SELECT machine_id, epoch_us(ts) AS ts_us, _offset, error_code FROM bronze WHERE machine_id IS NOT NULL")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The raw table as messages through the ingest stream, read back from its store."""
    source, bronze, bad, state = (scratch_path(spark, n) for n in ("messages", "bronze", "malformed", "ingest-state"))
    _message_files(spark, table(spark, d, "bronze"), source)
    ingest.start_ingest(ingest.file_source(spark, source, 64), bronze, bad, state, interval=None, name=f"ingest-{state[-8:]}").awaitTermination()
    return flat(spark.read.parquet(bronze).select("machine_id", "ts", "_offset", "error_code"))


_Z = "1 - exp(-greatest(0, coalesce(abs((vibration - 0.7) / 0.3), 0), coalesce(abs((motor_temp - 50) / 12), 0)) / 3)"


@query(f"SELECT machine_id, epoch_us(ts) AS event_timestamp_us, round(s, 4) AS anomaly_score, 0.5::DOUBLE AS alert_threshold, 'plain' AS model_name, 'champion' AS model_alias, '7' AS model_version FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY s DESC, ts NULLS LAST) AS rn FROM (SELECT machine_id, ts, {_Z} AS s FROM bronze WHERE machine_id IS NOT NULL) WHERE s >= 0.5) WHERE rn = 1")
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The raw table as messages through the alert stream with the plain scorer, in one micro-batch."""
    source, out, state = (scratch_path(spark, n) for n in ("messages", "alerts", "alert-state"))
    _message_files(spark, table(spark, d, "bronze"), source)
    scorer = lambda df: models.zscore(df, {"vibration": (0.7, 0.3), "motor_temp": (50.0, 12.0)})
    cache = ingest.ModelCache(lambda: alerts.ModelTag("plain", "champion", "7"), lambda _: scorer)
    ingest.start_alerts(ingest.file_source(spark, source, 1_000_000), cache, out, state, threshold=0.5, interval=None, name=f"alerts-{state[-8:]}").awaitTermination()
    return flat(spark.read.parquet(out).select("machine_id", "event_timestamp", "anomaly_score", "alert_threshold", "model_name", "model_alias", "model_version"))


# Models and generators

@query()
def batch_score(spark: SparkSession, d: str) -> DataFrame:
    """An isolation forest with statistics of all rows and trees from a bounded sample scores every feature row."""
    t = table(spark, d, "telemetry_features")
    model = models.train("anomaly_detection", t)
    return flat(models.batch_score(model.score(t), TASKS["anomaly_detection"], "forest", "champion"))


@query()
def train_maintenance(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees on the older feature rows, stopped on the next ones, their metrics on the newest."""
    return flat(models.evaluate("predictive_maintenance", table(spark, d, "telemetry_features"))[1].select("roc_auc", "average_precision"))


@query()
def train_battery(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees for the battery's health without any of its own columns, their errors on the newest rows."""
    return flat(models.evaluate("battery_health", table(spark, d, "telemetry_features"))[1])


@query()
def score_raw_sensors(spark: SparkSession, d: str) -> DataFrame:
    """The forest of the raw sensors, fitted on synthetic normal operation, scores every raw reading."""
    bronze = table(spark, d, "bronze")
    return flat(models.raw_sensor_forest().score(bronze).select("row_id", "anomaly_score"))


@query("SELECT feature_id, round(coalesce(vibration_mean_5m, 0), 4) AS vibration_mean_5m, 0.0::DOUBLE AS not_there FROM telemetry_features")
def align_features(spark: SparkSession, d: str) -> DataFrame:
    return flat(alerts.align(table(spark, d, "telemetry_features"), ["vibration_mean_5m", "not_there"], 0.0, ("feature_id",)))


@query("SELECT feature_id, round(coalesce(uptime_ratio_5m::DOUBLE, 0), 4) AS uptime_ratio_5m, 0.0::DOUBLE AS not_there FROM telemetry_features")
def align_map(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "telemetry_features").select("feature_id", F.create_map(F.lit("uptime_ratio_5m"), F.col("uptime_ratio_5m").cast("double"), F.lit("more"), F.lit(1.0)).alias("m"))
    return flat(alerts.align_map(t, "m", ["uptime_ratio_5m", "not_there"], 0.0, ("feature_id",)))


@query()
def synthetic_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return flat(generator.synthetic_telemetry(spark))


@query()
def synthetic_features(spark: SparkSession, d: str) -> DataFrame:
    return flat(generator.synthetic_features(spark))


@query("SELECT n_name, r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    """A fact table with its dimensions; Spark broadcasts a dimension only where it is small."""
    t = {n: table(spark, d, n) for n in ("orders", "customer", "nation", "region")}
    joined = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


#: Feature rows as versions of their machine: valid for an hour, or until the next one.
_VERSIONS = "(SELECT machine_id, feature_id, event_timestamp AS f, least(lead(event_timestamp) OVER (PARTITION BY machine_id ORDER BY event_timestamp, feature_id), event_timestamp + INTERVAL 1 HOUR) AS t, vibration_mean_5m FROM telemetry_features WHERE machine_id IS NOT NULL AND event_timestamp IS NOT NULL)"
_LASTING = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY machine_id, f ORDER BY feature_id DESC) AS rn FROM {_VERSIONS}) WHERE rn = 1)"


@query(
    f"""SELECT p.prediction_id, CASE WHEN p.event_timestamp < v.t THEN v.feature_id END AS feature_id, round(CASE WHEN p.event_timestamp < v.t THEN v.vibration_mean_5m END + 1e-7, 4) AS v_vibration_mean_5m
    FROM (SELECT * FROM predictions WHERE machine_id IS NOT NULL AND event_timestamp IS NOT NULL) p ASOF LEFT JOIN {_LASTING} v ON p.machine_id = v.machine_id AND p.event_timestamp >= v.f
    UNION ALL SELECT prediction_id, NULL, NULL FROM predictions WHERE machine_id IS NULL OR event_timestamp IS NULL"""
)
def scd2_join(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with the version of their machine that was valid at their time."""
    order = Window.partitionBy("machine_id").orderBy("event_timestamp", "feature_id")
    hour = F.timestamp_micros(us("event_timestamp") + 3_600_000_000)
    t = table(spark, d, "telemetry_features").where("machine_id IS NOT NULL AND event_timestamp IS NOT NULL")
    versions = t.select("machine_id", "feature_id", "event_timestamp", F.least(F.lead("event_timestamp").over(order).cast("timestamp"), hour).alias("valid_to"), "vibration_mean_5m")
    found = joins.valid_at(table(spark, d, "predictions"), versions, "machine_id", "event_timestamp", "feature_id", ("vibration_mean_5m",), ("prediction_id",), "event_timestamp")
    return flat(found.select("prediction_id", "feature_id", "v_vibration_mean_5m"), nudge=1e-7)


@query(
    """WITH e AS (SELECT DISTINCT machine_id, epoch_us(ts) AS u FROM bronze WHERE error_code <> 0 AND machine_id IS NOT NULL AND ts IS NOT NULL)
    SELECT f.row_id, CASE WHEN f.machine_id IS NOT NULL AND f.ts IS NOT NULL THEN e.u IS NOT NULL AND e.u <= epoch_us(f.ts) + 1800000000 END AS label, CASE WHEN e.u <= epoch_us(f.ts) + 1800000000 THEN e.u END AS label_us
    FROM bronze f ASOF LEFT JOIN e ON f.machine_id = e.machine_id AND epoch_us(f.ts) <= e.u"""
)
def late_labels(spark: SparkSession, d: str) -> DataFrame:
    """Whether an error of the machine follows a reading within half an hour."""
    b = table(spark, d, "bronze")
    return joins.label_within(b, b.where("error_code <> 0"), 1_800_000_000, "row_id", time="ts", label_time="ts")


@query("SELECT machine_id, epoch_us(ts) AS ts_us FROM bronze WHERE ts >= TIMESTAMPTZ '2026-02-03 12:00:00+00'")
def scan_since(spark: SparkSession, d: str) -> DataFrame:
    """A filter and two columns, both pushed to the scan."""
    from datetime import UTC, datetime

    return flat(files.read_since(spark, f"{d}/bronze.parquet", "ts", datetime(2026, 2, 3, 12, tzinfo=UTC), ("machine_id", "ts")))
