"""Queries over whole tables: no day, column, window or tree is left out."""

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from gaugeflow.operators import models, rolling
from gaugeflow.plans import core

from .helpers import micros, rows

DAYS = datetime(2026, 2, 2, 12, tzinfo=UTC), datetime(2026, 2, 3, 12, tzinfo=UTC)


def test_alerts_read_every_day(spark, tmp_path):
    data = [(1, "a", DAYS[0], 3.0), (2, "a", DAYS[1], 2.0), (3, "b", DAYS[0], 1.0), (4, "c", DAYS[1], 1.5), (5, "c", DAYS[0], 0.9)]
    bronze = spark.createDataFrame(data, "row_id long, machine_id string, ts timestamp, vibration double").withColumn("event_date", F.to_date("ts"))
    bronze.write.parquet(f"{tmp_path}/bronze.parquet")
    spark.createDataFrame([("b", DAYS[0] - timedelta(hours=1))], "machine_id string, event_timestamp timestamp").write.parquet(f"{tmp_path}/predictions.parquet")
    assert rows(core.alert_threshold(spark, str(tmp_path)), "row_id") == [(1,), (2,), (3,), (4,)]
    top = [("a", micros(DAYS[0]), 3.0), ("b", micros(DAYS[0]), 1.0), ("c", micros(DAYS[1]), 1.5)]
    assert rows(core.alert_top1(spark, str(tmp_path))) == top
    assert rows(core.alert_throttle(spark, str(tmp_path)), "machine_id") == [("a",), ("c",)]


MEANS = [f"{m}_mean_{w}" for m in ("vibration", "motor_temp", "cpu_usage", "battery_soh") for w in ("5m", "1h", "24h")]
LAGS = ["vibration_mean_5m_lag_1", "vibration_mean_5m_lag_3", "motor_temp_mean_5m_lag_1", "battery_soh_mean_5m_lag_1", "cpu_usage_mean_5m_lag_1"]
RATES = [f"{m}_mean_5m_roc_1" for m in ("vibration", "motor_temp", "cpu_usage", "battery_soh")]
FEATURES = [*MEANS, *LAGS, *RATES, "error_count_5m", "record_count_5m", "uptime_ratio_5m"]


def feature_rows(spark, n, **columns):
    """n feature rows a minute apart, 1.0 in every feature but those given as expressions of id."""
    ids = spark.range(n).withColumns({"feature_id": F.col("id"), "machine_id": F.lit("m"), "event_timestamp": F.timestamp_seconds(F.col("id") * 60 + 1_770_000_000)})
    return ids.withColumns({c: F.expr(columns.get(c, "1.0")).cast("double") for c in FEATURES}).withColumn("label_failure_within_horizon", F.expr(columns.get("label", "id % 2 = 0"))).drop("id")


def test_training_takes_every_feature_and_round(spark, tmp_path, monkeypatch):
    feature_rows(spark, 200, record_count_5m="id % 2").write.parquet(f"{tmp_path}/telemetry_features.parquet")
    real, seen = models.classifier, {}

    def short(features, label, **more):
        seen.update(features=features, rounds=more["rounds"])
        return real(features, label, **{**more, "rounds": 2})

    monkeypatch.setattr(models, "classifier", short)
    assert rows(core.train_maintenance(spark, str(tmp_path))) == [(1.0, 1.0)]
    assert seen == {"features": FEATURES, "rounds": models.ROUNDS}


def test_forest_takes_every_feature_and_samples_rows(spark, tmp_path, monkeypatch):
    # A third of the rows are equal, all NULL in one feature; the other rows are all different.
    df = feature_rows(spark, 600, vibration_mean_5m="CASE WHEN id % 3 > 0 THEN id END", cpu_usage_mean_5m="CASE WHEN id % 3 > 0 THEN id ELSE 0 END")
    df.write.parquet(f"{tmp_path}/telemetry_features.parquet")
    real_sample, real_score, seen = models.bounded_sample, models.score_forest, {}

    def sample(*args, **more):
        seen["sample"] = real_sample(*args, **{**more, "rows": 200})
        return seen["sample"]

    def score(t, forest):
        seen["forest"] = forest
        return real_score(t, forest)

    monkeypatch.setattr(models, "bounded_sample", sample)
    monkeypatch.setattr(models, "score_forest", score)
    got = rows(core.batch_score(spark, str(tmp_path)), "anomaly_score")
    assert len(got) == 600 and all(0 < s < 1 for (s,) in got)
    forest = seen["forest"]
    assert forest.features == FEATURES and len(forest.trees) == 200
    assert 45 <= seen["sample"]["vibration_mean_5m"].isna().sum() <= 90
    kept = [float(i) for i in range(600) if i % 3]
    assert forest.medians[FEATURES.index("vibration_mean_5m")] == (kept[199] + kept[200]) / 2
    everything = sorted([*kept, *[0.0] * 200])
    assert forest.medians[FEATURES.index("cpu_usage_mean_5m")] == (everything[299] + everything[300]) / 2


def test_windows_that_differ_in_any_column_add_up(spark):
    start = DAYS[0].replace(hour=0)
    window = ("m", start, start + timedelta(days=1), "24h", 1.0, 50.0, 3, 10)
    schema = "machine_id string, window_start timestamp, window_end timestamp, window_duration string, vibration_mean double, motor_temp_mean double, error_count long, record_count long, motor_temp_max double, cpu_usage_std double, battery_soh_min double"
    gold = spark.createDataFrame([(*window, 60.0, 1.0, 0.9), (*window, 61.0, 1.0, 0.9), (*window, 61.0, 2.0, 0.9), (*window, 61.0, 2.0, 0.8), (*window, 61.0, 2.0, 0.8)], schema)
    assert rows(rolling.rolling_totals(gold), "error_count_7d") == [(12,)]
