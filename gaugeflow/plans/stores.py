"""Queries that write through the sources and sinks and read back, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.columns import flat, us
from gaugeflow.operators import bi, features, models, quality, verify
from gaugeflow.plans import core
from gaugeflow.plans.core import ORACLE, QUERIES, query
from gaugeflow.schema import DURATIONS, NOT_FEATURES, TASKS, numeric_columns, require
from gaugeflow.session import scratch_path
from gaugeflow.sources import files
from gaugeflow.sources.tables import table, table_path
from gaugeflow.streaming import ingest


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold")


@query("SELECT row_id, machine_id, error_code, event, _offset FROM bronze")
def store_lines(spark: SparkSession, d: str) -> DataFrame:
    """The raw table through the JSON-lines sink, in two writes."""
    path = scratch_path(spark, "lines")
    b = table(spark, d, "bronze").select("row_id", "machine_id", "error_code", "event", "_offset")
    with files.sink("file", path=path) as out:
        out.write_many([b.where("row_id % 2 = 0"), b.where("row_id % 2 <> 0")])
    return spark.read.schema(b.schema).json(path)


@query("SELECT row_id, strftime(event_date, '%Y-%m-%d') AS event_date FROM bronze")
def store_append(spark: SparkSession, d: str) -> DataFrame:
    """The raw table appended by date, and each day again as a micro-batch that is repeated."""
    path = scratch_path(spark, "appended")
    b = table(spark, d, "bronze").select("row_id", "event_date")
    files.sink("append", path=path).write(b.where("row_id % 3 = 0"))
    for k in (1, 1, 2):
        files.write_batch(b.where(F.col("row_id") % 3 == k), path, k)
    return flat(spark.read.schema(b.schema).parquet(path))


@query("SELECT machine_id, window_duration, epoch_us(window_end) AS window_end_us, record_count FROM gold WHERE event_date IS NOT NULL AND window_duration IS NOT NULL")
def store_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The window table over a stored one: every partition it has is replaced, for each duration on its own."""
    path = scratch_path(spark, "partitions")
    g = _gold(spark, d).where("event_date IS NOT NULL AND window_duration IS NOT NULL")
    files.overwrite_partitions(g.withColumn("record_count", F.lit(-1).cast("long")), path)
    for name in DURATIONS:
        files.overwrite_partitions(g.where(F.col("window_duration") == name), path)
    return flat(spark.read.schema(g.schema).parquet(path).select("machine_id", "window_duration", "window_end", "record_count"))


@query(f"SELECT row_id FROM bronze WHERE {core._RULE_SQL}")
def store_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """The quarantine of a run in place of that of the run before."""
    path = scratch_path(spark, "quarantine")
    b = table(spark, d, "bronze")
    files.replace_quarantine(b.limit(5), path)
    files.replace_quarantine(quality.quarantine(b), path)
    return spark.read.parquet(path).select("row_id")


@query(
    """SELECT row_id FROM bronze WHERE event_date < DATE '2026-02-03' OR event_date IS NULL UNION ALL
    SELECT row_id FROM bronze b WHERE event_date >= DATE '2026-02-03' AND NOT EXISTS (SELECT 1 FROM bronze t WHERE (t.event_date < DATE '2026-02-03' OR t.event_date IS NULL) AND t.machine_id = b.machine_id AND t.ts = b.ts)"""
)
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The second day merged into the first, twice: the second time inserts only rows without a key."""
    path = scratch_path(spark, "upserted")
    b = table(spark, d, "bronze").select("row_id", "machine_id", "ts", "event_date")
    first = F.coalesce(F.col("event_date") < F.lit("2026-02-03").cast("date"), F.lit(True))
    files.upsert_absent(spark, b.where(first), path)
    files.upsert_absent(spark, b.where(~first), path)
    files.upsert_absent(spark, b.where(~first & F.col("machine_id").isNotNull() & F.col("ts").isNotNull()), path)
    return spark.read.schema(b.schema).parquet(path).select("row_id")


@query(f"SELECT {core._ID}, {core._WIDE}, label_failure_within_horizon, {core._lag_sql(list(features.LAG_SOURCES))}, {core._roc_sql(list(features.LAG_SOURCES))}, {core._UPTIME}, true AS stamped FROM {core._PIVOT}")
def store_offline(spark: SparkSession, d: str) -> DataFrame:
    """The feature table built, stamped with the time it became known, stored and read."""
    stored = features.write_offline(_gold(spark, d), scratch_path(spark, "offline"))
    return flat(stored.withColumn("stamped", F.col("created_timestamp").isNotNull()).drop("created_timestamp", "window_duration_anchor"))


_TABLES = {"fleet_kpis": "SELECT 1", "gold_windows": "SELECT machine_id FROM gold", "machine_health": f"SELECT machine_id FROM ({core._HEALTH})", "predictions_long": f"SELECT machine_id FROM {core._LONG}", "predictions_latest": f"SELECT machine_id FROM {core._LATEST_SQL}"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, (SELECT count(*) FROM ({v})) AS n, (SELECT count(*) FROM ({v})) AS stored FROM (SELECT 1)" for k, v in _TABLES.items()))
def store_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """The five dashboard tables stored; their counts as reported and as read."""
    path = scratch_path(spark, "bi")
    p = table(spark, d, "predictions")
    frames = {t: p.where(F.col("alias") == a).withColumnRenamed("failure_probability", TASKS[t].output) for t, a in core._ALIASES.items()}
    counts = bi.write_tables(bi.bi_tables(_gold(spark, d), frames), folder=path)
    return spark.createDataFrame([(k, n, spark.read.parquet(f"{path}/{k}").count()) for k, n in counts.items()], "name string, n long, stored long")


@query("SELECT feature_id, machine_id FROM telemetry_features")
def store_reference(spark: SparkSession, d: str) -> DataFrame:
    """A reference snapshot, frozen a second time."""
    path = scratch_path(spark, "reference")
    t = table(spark, d, "telemetry_features")
    files.replace_table(t.limit(1), path)
    files.replace_table(t, path)
    return files.read_parquet(spark, path).select("feature_id", "machine_id")


@query("SELECT 'offline_parquet' AS source, (SELECT count(*) FROM gold) AS n UNION ALL SELECT 'synthetic', 7 UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'missing', 0 UNION ALL SELECT 'other kind', 0")
def source_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """A stored source, its fallback, the empty one, and the errors of a missing and of another kind of file."""
    gone = scratch_path(spark, "gone")
    there, tag = files.read_or(spark, table_path(d, "gold"), lambda: spark.range(7))
    made, other = files.read_or(spark, gone, lambda: spark.range(7))
    rows = [(tag, there.count()), (other, made.count()), ("empty", files.read_or_empty(spark, gone, T.StructType([T.StructField("x", T.LongType())])).count())]
    for name, path, error in (("missing", gone, FileNotFoundError), ("other kind", gone + ".csv", ValueError)):
        try:
            files.read_parquet(spark, path)
        except error:
            rows.append((name, 0))
    return spark.createDataFrame(rows, "source string, n long")


@query("SELECT true AS there, false AS not_there")
def path_probe(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(files.path_exists(spark, table_path(d, "gold")), files.path_exists(spark, scratch_path(spark, "gone")))], "there boolean, not_there boolean")


@query(
    """SELECT machine_id, epoch_us(ts) AS ts_us, _topic, _partition, _offset, epoch_us(_kafka_ts) // 1000 AS kafka_ms, strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%d') AS event_date, true AS stamped FROM bronze WHERE machine_id IS NOT NULL"""
)
def ingest_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Lineage, date and stamp of the records that the ingest stream stores."""
    source, bronze, bad, state = (scratch_path(spark, n) for n in ("messages", "bronze", "malformed", "ingest-state"))
    core._message_files(spark, table(spark, d, "bronze"), source)
    ingest.start_ingest(ingest.file_source(spark, source, 64), bronze, bad, state, interval=None, name=f"metadata-{state[-8:]}").awaitTermination()
    rows = spark.read.parquet(bronze)
    return flat(rows.select("machine_id", "ts", "_topic", "_partition", "_offset", F.floor(us("_kafka_ts") / 1000).cast("long").alias("kafka_ms"), F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), F.col("_ingest_ts").isNotNull().alias("stamped")))


@query("SELECT row_id AS offset, 'malformed' AS kind FROM bronze WHERE machine_id IS NULL")
def ingest_malformed(spark: SparkSession, d: str) -> DataFrame:
    """What the ingest stream sets aside."""
    source, bronze, bad, state = (scratch_path(spark, n) for n in ("messages", "bronze", "malformed", "ingest-state"))
    core._message_files(spark, table(spark, d, "bronze").withColumn("_offset", F.col("row_id")), source)
    ingest.start_ingest(ingest.file_source(spark, source, 64), bronze, bad, state, interval=None, name=f"malformed-{state[-8:]}").awaitTermination()
    return spark.read.parquet(bad).where("_raw_value IS NOT NULL").select(F.col("_offset").alias("offset"), F.lit("malformed").alias("kind"))


@query(
    """SELECT machine_id, s AS window_start_us, s + 300000000 AS window_end_us, count(*) AS record_count FROM (SELECT machine_id, epoch_us(ts) // 300000000 * 300000000 AS s FROM bronze WHERE ts IS NOT NULL)
    WHERE s + 300000000 <= (SELECT max(epoch_us(ts)) FROM bronze) // 1000 * 1000 - 120000000 GROUP BY ALL"""
)
def windows_on_a_stream(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of a stream that the watermark has passed."""
    out, state, source = (scratch_path(spark, n) for n in ("windows", "windows-state", "windows-source"))
    b = table(spark, d, "bronze").select("machine_id", "ts", "vibration", "motor_temp")
    b.coalesce(1).write.parquet(source)
    query = ingest.stream_windows(spark.readStream.schema(b.schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("machine_id", "window_start_us", "window_end_us", "record_count")


_NAMES = "SELECT column_name FROM (DESCRIBE SELECT * FROM telemetry_features) WHERE column_type IN ('DOUBLE', 'FLOAT', 'BIGINT', 'INTEGER') AND column_name NOT IN (" + ", ".join(f"'{c}'" for c in NOT_FEATURES) + ")"


@query(" UNION ALL ".join(f"SELECT '{t.name}' AS task, column_name AS feature FROM ({_NAMES})" + (f" WHERE NOT starts_with(column_name, '{t.leak_prefix}')" if t.leak_prefix else "") for t in TASKS.values()))
def feature_columns(spark: SparkSession, d: str) -> DataFrame:
    """The features of each task: numbers that neither identify, label nor leak."""
    t = table(spark, d, "telemetry_features")
    return spark.createDataFrame([(k, c) for k, task in TASKS.items() for c in numeric_columns(require(t, "machine_id", "event_timestamp"), drop_prefix=task.leak_prefix)], "task string, feature string")


@query("SELECT feature_id, label_failure_within_horizon::INT::DOUBLE AS target FROM telemetry_features WHERE label_failure_within_horizon IS NOT NULL")
def labelled_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows that can train the classifier."""
    return models.labelled(table(spark, d, "telemetry_features"), models.TARGETS["probability"], ["feature_id"]).select(F.col("feature_id").cast("long").alias("feature_id"), F.col("_y").alias("target"))


_CASES = ((0.9, None), (0.9, 0.88), (0.9, 0.9), (0.86, 0.9), (0.8, None), (0.85, None), (0.8, 0.1))


@query(
    f"SELECT candidate::DOUBLE AS candidate, incumbent::DOUBLE AS incumbent, candidate >= 0.85 AND (incumbent IS NULL OR candidate > incumbent) AS higher, incumbent IS NULL OR candidate < incumbent AS lower FROM (VALUES {', '.join(f'({a}, {"NULL" if b is None else b})' for a, b in _CASES)}) t(candidate, incumbent)"
)
def promotions(spark: SparkSession, d: str) -> DataFrame:
    """Which candidates replace which champions: where higher is better beyond a gate, and where lower is, without one."""
    up, down = TASKS["predictive_maintenance"], TASKS["battery_health"]
    return spark.createDataFrame([(a, b, models.promotes(up, a, b), models.promotes(down, a, b)) for a, b in _CASES], "candidate double, incumbent double, higher boolean, lower boolean")


@query("SELECT round((1800000000000000 - max(epoch_us(window_end))) / 60e6, 4) AS lag_minutes, (1800000000000000 - max(epoch_us(window_end))) / 60e6 <= 15 AS fresh FROM gold")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return flat(verify.freshness(_gold(spark, d), 1_800_000_000_000_000))


@query(
    f"""SELECT feature_id, round(coalesce(vibration_mean_5m, m, 0), 4) AS imputed FROM telemetry_features, (SELECT median(CASE WHEN isnan(vibration_mean_5m) THEN NULL ELSE vibration_mean_5m END) AS m FROM telemetry_features)"""
)
def median_imputed(spark: SparkSession, d: str) -> DataFrame:
    """Missing values filled with the exact median of all rows."""
    t = table(spark, d, "telemetry_features")
    (m,) = models.medians(t, ["vibration_mean_5m"])
    return flat(t.select("feature_id", F.coalesce("vibration_mean_5m", F.lit(m)).alias("imputed")))


__all__ = ["ORACLE", "QUERIES"]
