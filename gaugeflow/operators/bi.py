"""Tables and queries for dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.columns import us
from gaugeflow.schema import TASKS

DAY_US = 86_400_000_000
#: The columns of the health table after machine_id and last_window_end, in order.
HEALTH = ("battery_soh_mean", "vibration_mean", "vibration_max", "motor_temp_mean", "error_count", "failure_label")


def recent(gold: DataFrame, days: float, time: str = "window_end") -> DataFrame:
    """Rows within ``days`` of the newest, the bound included; days <= 0 or a missing column leave the table as it is."""
    if days <= 0 or time not in gold.columns:
        return gold
    bound = gold.agg((F.max(us(time)) - int(days * DAY_US)).alias("b")).select("b").scalar()
    return gold.where(us(time) >= bound)


def fleet_kpis(gold: DataFrame, duration: str | None = None) -> DataFrame:
    """One row: n_machines, n_windows, n_failures, failure_rate, avg_battery_soh, avg_vibration, total_errors.

    By default over all durations together, so an error counts once per duration; ``duration`` takes one of them. A NULL
    label counts as no failure. An empty table gives zeros with NULL averages.
    """
    rows = gold if duration is None else gold.where(F.col("window_duration") == duration)
    failed = F.coalesce(F.col("failure_label"), F.lit(False))
    return rows.agg(
        F.count_distinct("machine_id").alias("n_machines"),
        F.count("*").alias("n_windows"),
        F.count_if(failed).alias("n_failures"),
        F.coalesce(F.avg(failed.cast("int")), F.lit(0.0)).alias("failure_rate"),
        F.avg("battery_soh_mean").alias("avg_battery_soh"),
        F.avg("vibration_mean").alias("avg_vibration"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("total_errors"),
    )


def machine_health(gold: DataFrame, duration: str = "5m") -> DataFrame:
    """The latest window of each machine; windows of ``duration`` if the table has any, else of all durations.

    A window without end is never the latest. Of windows with the same end the one of the largest values counts.
    """
    has = gold.agg(F.coalesce(F.bool_or(F.col("window_duration") == duration), F.lit(False)).alias("h")).select("h").scalar()
    rows = gold.where(F.col("window_end").isNotNull() & ((F.col("window_duration") == duration) | ~has))
    best = F.max(F.struct("window_end", *HEALTH)).alias("b")
    return rows.groupBy("machine_id").agg(best).select("machine_id", F.col("b.window_end").alias("last_window_end"), *[F.col(f"b.{c}").alias(c) for c in HEALTH])


def gold_export(gold: DataFrame) -> DataFrame:
    """The window table in the order of machine and end."""
    return gold.orderBy("machine_id", "window_end", "window_duration")


def predictions_long(frames: dict[str, DataFrame | None]) -> DataFrame:
    """(machine_id, event_timestamp, task, score, model, alias) of all known tasks; ValueError if no frame is given.

    Unknown tasks and missing frames are skipped; absent columns are NULL.
    """
    parts = []
    for name, df in frames.items():
        if df is None or name not in TASKS or TASKS[name].output not in df.columns:
            continue
        col = lambda c, t, df=df: (F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(c)
        parts.append(df.select("machine_id", "event_timestamp", F.lit(name).alias("task"), F.col(TASKS[name].output).cast("double").alias("score"), col("model", "string"), col("alias", "string")))
    if not parts:
        raise ValueError("no predictions")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def predictions_latest(long: DataFrame) -> DataFrame:
    """The latest score of each machine and task as columns, most at risk first; last_scored_at is the latest of all.

    Rows without time are never the latest; machines without any score are left out.
    """
    rows = long.where(F.col("machine_id").isNotNull() & F.col("event_timestamp").isNotNull())
    latest = rows.groupBy("machine_id", "task").agg(F.max(F.struct("event_timestamp", "score")).alias("b"))
    scores = [F.max(F.when(F.col("task") == t.name, F.col("b.score"))).alias(t.output) for t in TASKS.values()]
    out = latest.groupBy("machine_id").agg(*scores, F.max("b.event_timestamp").alias("last_scored_at"))
    return out.where(F.coalesce(*[F.col(t.output) for t in TASKS.values()]).isNotNull()).orderBy(F.desc_nulls_last("failure_probability"), "machine_id")


def bi_tables(gold: DataFrame, predictions: dict[str, DataFrame | None], days: float = 0) -> dict[str, DataFrame]:
    """The five dashboard tables; ``days`` limits the window table only."""
    kept = recent(gold, days)
    long = predictions_long(predictions)
    return {"fleet_kpis": fleet_kpis(kept), "machine_health": machine_health(kept), "gold_windows": gold_export(kept), "predictions_long": long, "predictions_latest": predictions_latest(long)}


def register(tables: dict[str, DataFrame]) -> None:
    """Make the tables visible to SQL under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


#: Dashboard queries over the tables of bi_tables and the window table.
DASHBOARD: dict[str, str] = {
    "window_count": "SELECT count(*) AS n FROM gold_windows",
    "kpi_machines": "SELECT n_machines FROM fleet_kpis LIMIT 1",
    "kpi_failure_rate": "SELECT failure_rate FROM fleet_kpis LIMIT 1",
    "kpi_battery": "SELECT avg_battery_soh FROM fleet_kpis LIMIT 1",
    "kpi_errors": "SELECT total_errors FROM fleet_kpis LIMIT 1",
    "series_vibration": "SELECT window_end, avg(vibration_mean) AS avg_vibration, max(vibration_max) AS max_vibration FROM gold_windows WHERE window_duration = '1h' GROUP BY window_end ORDER BY window_end",
    "series_battery": "SELECT window_end, avg(battery_soh_mean) AS avg_soh, min(battery_soh_min) AS min_soh FROM gold_windows WHERE window_duration = '1h' GROUP BY window_end ORDER BY window_end",
    "health_table": "SELECT * FROM machine_health ORDER BY battery_soh_mean ASC NULLS FIRST, machine_id",
    "at_risk": "SELECT count(*) AS n FROM predictions_latest WHERE failure_probability > 0.5",
    "max_risk": "SELECT max(failure_probability) AS max_probability FROM predictions_latest",
    "scored_machines": "SELECT count(*) AS n FROM predictions_latest",
    "min_battery_prediction": "SELECT min(battery_soh_prediction) AS min_soh FROM predictions_latest",
    "leaderboard": "SELECT machine_id, failure_probability, anomaly_score, battery_soh_prediction, last_scored_at FROM predictions_latest ORDER BY failure_probability DESC NULLS LAST, machine_id",
    "series_risk": "SELECT event_timestamp, avg(score) AS avg_score FROM predictions_long WHERE task = 'predictive_maintenance' GROUP BY event_timestamp ORDER BY event_timestamp",
    "series_anomaly": "SELECT event_timestamp, avg(score) AS avg_score FROM predictions_long WHERE task = 'anomaly_detection' GROUP BY event_timestamp ORDER BY event_timestamp",
    "duration_summary": "SELECT window_duration, count(*) AS n, round(avg(vibration_mean), 4) AS avg_vibration, round(avg(battery_soh_mean), 4) AS avg_soh, sum(error_count) AS errors, sum(CASE WHEN failure_label THEN 1 ELSE 0 END) AS failures FROM gold_windows GROUP BY window_duration ORDER BY window_duration",
    "window_sample": "SELECT machine_id, window_end, window_duration, vibration_mean, record_count FROM gold_windows ORDER BY machine_id, window_end, window_duration, vibration_mean, record_count LIMIT 20",
}


def dashboard(spark: SparkSession, name: str) -> DataFrame:
    """The result of a dashboard query over the registered tables."""
    return spark.sql(DASHBOARD[name])


def write_tables(tables: dict[str, DataFrame], url: str | None = None, folder: str | None = None, dry_run: bool = False, **options: str) -> dict[str, int]:
    """Replace the tables in a database (``url``) or folder; returns their row counts. A dry run only counts."""
    counts = {}
    for name, df in tables.items():
        if dry_run or not (url or folder):
            counts[name] = df.count()
            continue
        seen = Observation(name)
        watched = df.observe(seen, F.count("*").alias("n"))
        if url:
            watched.write.jdbc(url, name, mode="overwrite", properties=options)
        else:
            watched.write.mode("overwrite").parquet(f"{folder}/{name}")
        counts[name] = int(seen.get["n"])
    return counts
