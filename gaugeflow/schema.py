"""Field specifications of the telemetry records and tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The wire record, in order.
WIRE: tuple[tuple[str, T.DataType], ...] = (
    ("machine_id", T.StringType()),
    ("ts", T.TimestampType()),
    ("lat", T.DoubleType()),
    ("lon", T.DoubleType()),
    ("speed", T.DoubleType()),
    ("accel_x", T.DoubleType()),
    ("accel_y", T.DoubleType()),
    ("accel_z", T.DoubleType()),
    ("vibration", T.DoubleType()),
    ("battery_soh", T.DoubleType()),
    ("motor_temp", T.DoubleType()),
    ("cpu_usage", T.DoubleType()),
    ("error_code", T.IntegerType()),
    ("event", T.StringType()),
    ("failure_within_horizon", T.BooleanType()),
)
#: Columns a message adds, window lengths, and the metrics of a window, in order.
LINEAGE = ("_topic", "_partition", "_offset", "_kafka_ts")
DURATIONS: dict[str, int] = {"5m": 300, "1h": 3_600, "24h": 86_400}
METRICS = (
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
)
#: Columns that identify or label a feature row and are no features.
NOT_FEATURES = ("feature_id", "machine_id", "event_timestamp", "created_timestamp", "window_duration_anchor", "label_failure_within_horizon")


def wire_schema() -> T.StructType:
    """The record as a struct, every field nullable."""
    return T.StructType([T.StructField(n, t) for n, t in WIRE])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The frame itself; ValueError if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = NOT_FEATURES, drop_prefix: str | None = None) -> list[str]:
    """Numeric, non-boolean columns that are no ids or labels; ValueError if there is none.

    ``drop_prefix`` leaves out columns that would leak a target (every column that starts with it).
    """
    found = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude and not (drop_prefix and f.name.startswith(drop_prefix))]
    if not found:
        raise ValueError("no feature columns")
    return found


@dataclass(frozen=True)
class Task:
    """A prediction task: its score column, metric, direction and promotion gate."""

    name: str
    kind: str
    output: str
    metric: str
    higher_is_better: bool
    gate: float
    leak_prefix: str | None = None


#: The prediction tasks.
TASKS: dict[str, Task] = {
    "predictive_maintenance": Task("predictive_maintenance", "probability", "failure_probability", "roc_auc", True, 0.85),
    "anomaly_detection": Task("anomaly_detection", "anomaly", "anomaly_score", "score_auc", True, 0.60),
    "battery_health": Task("battery_health", "regression", "battery_soh_prediction", "rmse", False, float("inf"), "battery_soh"),
}
