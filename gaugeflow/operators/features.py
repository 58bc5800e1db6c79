"""Wide feature rows: pivot, lags, rates of change and uptime."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.columns import clip, ratio
from gaugeflow.schema import DURATIONS, METRICS, require
from gaugeflow.sources.files import replace_table

#: Columns that get lags and rates of change.
LAG_SOURCES = ("vibration_mean_5m", "motor_temp_mean_5m", "battery_soh_mean_5m", "cpu_usage_mean_5m")
LAGS = (1, 3)
GOLD_KEYS = ("machine_id", "window_end", "window_duration", "failure_label")


def pivot(gold: DataFrame, anchor: str = "5m") -> DataFrame:
    """One row per machine and window_end with a column <metric>_<duration> for each metric and duration.

    One aggregation with fixed columns: no job to discover the durations, and an absent duration gives NULL columns. The
    label is that of the anchor duration. Windows that repeat their (machine, end, duration) count once, by the larger
    value. A metric of 1h or 24h is only there where such a window ends at the same time.
    """
    cells = [F.max(F.when(F.col("window_duration") == d, F.col(m))).alias(f"{m}_{d}") for d in DURATIONS for m in METRICS]
    label = F.bool_or(F.when(F.col("window_duration") == anchor, F.col("failure_label"))).alias("label_failure_within_horizon")
    return gold.groupBy("machine_id", F.col("window_end").alias("event_timestamp")).agg(*cells, label).withColumn("window_duration_anchor", F.lit(anchor))


def _by_time() -> Window:
    return Window.partitionBy("machine_id").orderBy("event_timestamp")


def add_lags(wide: DataFrame, sources: tuple[str, ...] = LAG_SOURCES, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """Values of earlier rows of the machine: <source>_lag_<n>, counted in rows and not in time."""
    w = _by_time()
    return wide.withColumns({f"{s}_lag_{n}": F.lag(s, n).over(w) for s in sources for n in lags})


def add_rates(lagged: DataFrame, sources: tuple[str, ...] = LAG_SOURCES) -> DataFrame:
    """Change against the row before: <source>_roc_1, not divided by time."""
    return lagged.withColumns({f"{s}_roc_1": F.col(s) - F.col(f"{s}_lag_1") for s in sources})


def add_uptime(wide: DataFrame) -> DataFrame:
    """uptime_ratio_5m: 1 minus the share of records with an error, within [0, 1]; NULL without records."""
    return wide.withColumn("uptime_ratio_5m", clip(1 - ratio(F.col("error_count_5m"), F.col("record_count_5m")), 0.0, 1.0))


def feature_dataset(gold: DataFrame, ordered: bool = False) -> DataFrame:
    """Pivot, lags, rates and uptime; the aggregation and the windows share the machine as partitioning key.

    ``ordered`` sorts the result by machine and time, for an export; a table that is only stored needs no order.
    """
    require(gold, *GOLD_KEYS, *METRICS)
    out = add_uptime(add_rates(add_lags(pivot(gold))))
    return out.orderBy("machine_id", "event_timestamp") if ordered else out


def write_offline(gold: DataFrame, path: str) -> DataFrame:
    """Build the feature table with created_timestamp, the time it became known, and replace the stored one."""
    replace_table(feature_dataset(gold).withColumn("created_timestamp", F.current_timestamp()), path)
    return gold.sparkSession.read.parquet(path)
