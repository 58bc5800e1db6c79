import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import columns
from gaugeflow.functions.running import exact_quantiles, running_sums
from gaugeflow.operators import alerts, bi, dedup, drift, evalmetrics, features, models, quality, verify, windows
from gaugeflow.schema import METRICS, TASKS, numeric_columns, require
from gaugeflow.sources import files, generator
from gaugeflow.streaming import ingest, metrics

from .helpers import BRONZE, at, micros, reading, rows


def test_durations_and_clip(spark):
    assert columns.seconds_of("2 Minutes") == 120 and columns.seconds_of("0.5 second") == 0.5
    with pytest.raises(ValueError):
        columns.seconds_of("2 hours")
    df = spark.createDataFrame([(None,), (1.5,), (-1.0,)], "x double")
    assert rows(df.select(columns.clip(F.col("x"), 0.0, 1.0))) == [(0.0,), (1.0,), (None,)]


def test_rules_at_their_bounds(spark):
    base = {"machine_id": "m", "ts": at(0), "lat": 1.0, "lon": 1.0, "speed": 0.0, "vibration": 0.0, "battery_soh": 1.0, "cpu_usage": 100.0, "motor_temp": None, "error_code": None}
    schema = "machine_id string, ts timestamp, lat double, lon double, speed double, vibration double, battery_soh double, cpu_usage double, motor_temp double, error_code int"
    nan = float("nan")
    cases = [({}, False), ({"lat": None}, True), ({"battery_soh": 1.01}, True), ({"cpu_usage": nan}, True), ({"speed": nan}, False), ({"vibration": -0.1}, True), ({"ts": None}, True), ({"speed": None}, False)]
    df = spark.createDataFrame([tuple({**base, **c}.values()) for c, _ in cases], schema)
    good, bad = quality.split(df)
    assert bad.count() == sum(b for _, b in cases) and good.count() + bad.count() == len(cases)
    p = quality.profile(df).first()
    assert (p["total"], p["valid"], p["null_lat"], p["above_cpu_usage"]) == (8, 3, 1, 1)
    assert quality.gate(df.limit(0)).first()["passed"] and not quality.gate(df).first()["passed"]


def test_dedup_and_merge(spark):
    df = spark.createDataFrame([reading(1, minute=0, offset=5), reading(2, minute=0, offset=9), reading(3, minute=0, offset=7), reading(4, ts=None), reading(5, ts=None), reading(6, minute=3)], BRONZE)
    kept = dedup.keep_latest(df)
    assert rows(kept, "row_id") == [(2,), (5,), (6,)] and kept.columns == df.columns
    assert dedup.duplicate_count(df).first()["n_duplicates"] == 3
    once = dedup.merged(df.where("row_id = 1"), kept)
    assert rows(once, "row_id") == [(1,), (5,), (6,)]
    assert dedup.merged(once.where("ts IS NOT NULL"), once.where("ts IS NOT NULL")).count() == 2


def test_windows(spark):
    data = [(*reading(1, minute=0, vib=1.0), True), (*reading(2, minute=4.99, vib=3.0, err=7), None), (*reading(3, minute=5, vib=9.0, err=None), None), (*reading(4, ts=None), True)]
    df = spark.createDataFrame(data, BRONZE + ", failure_within_horizon boolean")
    got = {(r["window_duration"], micros(r["window_start"].replace(tzinfo=at(0).tzinfo))): r for r in windows.build_windows(df).collect()}
    first, second = got["5m", micros(at(0))], got["5m", micros(at(5))]
    assert len(got) == 4 and (first["vibration_mean"], first["error_count"], first["failure_label"], first["record_count"]) == (2.0, 1, True, 2)
    assert second["vibration_std"] is None and second["failure_label"] is None and second["error_count"] == 0
    assert got["24h", micros(at(0))]["record_count"] == 3


GOLD = "machine_id string, window_start timestamp, window_end timestamp, window_duration string, event_date date, " + ", ".join(f"{m} {'long' if m.endswith('count') else 'double'}" for m in METRICS) + ", failure_label boolean"


def gold_row(end, duration="5m", vib=1.0, errors=0, records=5, label=False, machine="m-1", soh=0.9):
    values = {m: 50.0 for m in METRICS} | {"vibration_mean": vib, "error_count": errors, "record_count": records, "battery_soh_mean": soh}
    return (machine, at(end - 5), at(end), duration, at(end - 5).date(), *values.values(), label)


def test_features(spark):
    data = [gold_row(5), gold_row(10, vib=2.0, errors=1, label=True), gold_row(10, "1h", vib=11.0), gold_row(15, "1h"), gold_row(20, vib=7.0, records=0)]
    got = features.feature_dataset(spark.createDataFrame(data, GOLD)).orderBy("event_timestamp").collect()
    assert [r["vibration_mean_5m_lag_1"] for r in got] == [None, 1.0, 2.0, None]
    assert [r["vibration_mean_5m_lag_3"] for r in got] == [None, None, None, 1.0]
    assert [r["vibration_mean_5m_roc_1"] for r in got] == [None, 1.0, None, None]
    assert [r["uptime_ratio_5m"] for r in got] == [1.0, 0.8, None, None]
    assert [r["vibration_mean_1h"] for r in got] == [None, 11.0, 1.0, None] and got[0]["vibration_mean_24h"] is None
    assert [r["label_failure_within_horizon"] for r in got] == [False, True, None, False]
    assert len(got[0]) == 53


def test_running_sums_and_quantiles(spark):
    import numpy as np

    values = np.random.default_rng(3).integers(0, 60, 500).astype(float)
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", None)], "g string, v double")
    counts = df.where("v IS NOT NULL").groupBy("g", "v").agg(F.count("*").alias("n"))
    for r in running_sums(counts, ("g",), "v", ("n",), levels=8).collect():
        assert r["n_before"] == (values < r["v"]).sum()
    (q,) = exact_quantiles(df, ("g",), "v", (0.0, 0.13, 0.5, 1.0)).collect()
    assert q["quantiles"] == pytest.approx(np.quantile(values, [0, 0.13, 0.5, 1]).tolist())


def test_drift(spark):
    same = spark.range(2000).select((F.rand(1) * 10).alias("a"), F.randn(2).alias("b"), F.lit(1.0).alias("c"), F.lit("x").alias("machine_id"))
    other = spark.range(2000).select((F.rand(5) * 10).alias("a"), (F.randn(6) + 3).alias("b"), F.lit(float("nan")).alias("c"))
    got = {r["feature"]: r for r in drift.drift_report(same, other).collect()}
    assert not got["a"]["drifted"] and got["b"]["drifted"] and (got["c"]["psi"], got["c"]["ks"]) == (0.0, 0.0)
    own = {r["feature"]: r for r in drift.drift_report(same, same).collect()}
    assert own["b"]["psi"] == pytest.approx(0) and own["b"]["ks"] == 0 and 0 <= got["b"]["ks"] <= 1
    s = drift.drift_summary(spark.createDataFrame([("a", True), ("b", False)], "feature string, drifted boolean")).first()
    assert (s["drift_share"], s["dataset_drift"]) == (0.5, False)


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0.1, 1), (0, 0.2, 2), (1, 0.8, 3), (1, 0.9, 4)], "y int, s double, id long")
    r = evalmetrics.ranking_metrics(df, "y", "s").first()
    assert (r["roc_auc"], r["average_precision"]) == (1.0, 1.0)
    assert math.isnan(evalmetrics.ranking_metrics(df.where("y = 0"), "y", "s").first()["roc_auc"])
    tied = evalmetrics.ranking_metrics(df.withColumn("s", F.lit(0.5)), "y", "s").first()
    assert (tied["roc_auc"], tied["average_precision"]) == (0.5, 0.5)
    t = evalmetrics.threshold_metrics(df, "y", "s", 0.8).first()
    assert (t["precision"], t["recall"], t["f1"]) == (1.0, 1.0, 1.0)
    ten = spark.range(10).select((F.col("id") >= 8).cast("int").alias("y"), F.when(F.col("id") < 7, 0.0).otherwise(1.0).alias("s"), "id")
    k = evalmetrics.precision_at_fraction(ten, "y", "s", 0.25, "id").first()
    assert (k["n_flagged"], k["precision"], k["recall"]) == (2, 0.5, 0.5)
    assert evalmetrics.class_weight(df.where("y = 0"), "y").first()["weight"] == 1.0
    g = evalmetrics.regression_metrics(df.withColumn("g", F.col("s") + 1), "s", "g").first()
    assert g["rmse"] == pytest.approx(1) and math.isnan(evalmetrics.regression_metrics(df.limit(0), "s", "s").first()["r2"])


def test_time_splits(spark):
    df = spark.createDataFrame([(i, at(i)) for i in range(10)] + [(99, None)], "i int, event_timestamp timestamp")
    train, validation, test = evalmetrics.time_split3(df, 0.2, 0.1)
    assert [x.count() for x in (train, validation, test)] == [7, 1, 2]


def test_dashboard_tables(spark):
    data = [gold_row(60 * h + 5, d, machine=m, label=(m, h) == ("m-2", 4)) for m in ("m-1", "m-2") for d in ("5m", "1h") for h in range(5)]
    gold = spark.createDataFrame(data, GOLD)
    k = bi.fleet_kpis(gold).first()
    assert (k["n_machines"], k["n_windows"], k["n_failures"]) == (2, 20, 2)
    e = bi.fleet_kpis(gold.limit(0)).first()
    assert (e["n_windows"], e["failure_rate"], e["total_errors"], e["avg_vibration"]) == (0, 0.0, 0, None)
    assert bi.machine_health(gold).count() == 2 and bi.machine_health(gold.where("window_duration = '1h'")).count() == 2
    frame = lambda rs, c: spark.createDataFrame(rs, f"machine_id string, event_timestamp timestamp, {c} double")
    frames = {"predictive_maintenance": frame([("m1", at(0), 0.1), ("m2", at(0), 0.4), ("m2", at(120), 0.9), ("m2", None, 1.0)], "failure_probability"), "anomaly_detection": frame([("m1", at(0), 0.2)], "anomaly_score"), "battery_health": None, "other": None}
    latest = bi.predictions_latest(bi.predictions_long(frames)).collect()
    assert [(r["machine_id"], r["failure_probability"], r["anomaly_score"], r["battery_soh_prediction"]) for r in latest] == [("m2", 0.9, None, None), ("m1", 0.1, 0.2, None)]
    tables = bi.bi_tables(gold, frames, 1)
    assert bi.write_tables(tables, dry_run=True)["gold_windows"] == 20
    with pytest.raises(ValueError):
        bi.predictions_long({})


def test_alerts(spark):
    df = spark.createDataFrame([("m-1", at(0), 0.95), ("m-1", at(0.33), 0.7), ("m-2", at(0.17), 0.2), (None, at(0), 1.0)], "machine_id string, event_timestamp timestamp, anomaly_score double")
    assert alerts.above_threshold(df, 0.8).count() == 1
    prior = spark.createDataFrame([("m-1", at(0.5)), ("m-2", at(-0.83))], "machine_id string, event_timestamp timestamp")
    assert rows(alerts.throttle(alerts.above_threshold(df, 0.15), prior, "60 seconds"), "machine_id") == [("m-2",)]
    assert rows(alerts.throttle(alerts.above_threshold(df, 0.15), None), "machine_id", "anomaly_score") == [("m-1", 0.95), ("m-2", 0.2)]
    maps = spark.createDataFrame([(1, {"a": 2.0}), (2, {}), (3, None)], "id int, f map<string,double>")
    assert rows(alerts.align_map(maps, "f", ["a", "b"], keep=("id",))) == [(1, 2.0, 0.0)]


def test_models(spark, tmp_path):
    t = TASKS["predictive_maintenance"]
    nan, inf = float("nan"), float("inf")
    assert models.promotes(t, 0.9, 0.88) and not models.promotes(t, 0.8, 0.1) and not models.promotes(t, 0.9, 0.9) and not models.promotes(t, nan, None)
    assert models.promotes(TASKS["battery_health"], 9.0, None) and not models.promotes(TASKS["battery_health"], inf, None)
    reg = models.Registry(str(tmp_path / "r.json"))
    assert reg.register(t.name, 0.9)[1] and not reg.register(t.name, 0.89)[1]
    assert models.Registry(str(tmp_path / "r.json")).champion(t.name).version == 1
    df = spark.range(400).select(F.randn(1).alias("a"), F.when(F.col("id") == 7, 30.0).otherwise(F.randn(2)).alias("b"), "id")
    forest = models.IsolationForest.fit(models.bounded_sample(df, ["a", "b"]), ["a", "b"], trees=40)
    top = models.score_forest(df, forest).orderBy(F.desc("anomaly_score")).first()
    assert top["id"] == 7 and 0 < top["anomaly_score"] < 1
    with pytest.raises(ValueError):
        numeric_columns(df.select(F.lit("x").alias("s")))
    with pytest.raises(ValueError):
        require(df, "nope")


def test_generator_is_reproducible(spark):
    a = generator.synthetic_telemetry(spark, 5, 100).toPandas()
    b = generator.synthetic_telemetry(spark, 5, 100).toPandas()
    assert a.sort_values(["machine_id", "ts"], ignore_index=True).equals(b.sort_values(["machine_id", "ts"], ignore_index=True)) and len(a) == 500
    assert a.lat.between(-90, 90).all() and a.battery_soh.between(0, 1).all() and (a.vibration >= 0).all()
    assert quality.split(generator.synthetic_telemetry(spark, 2, 50))[1].count() == 0


def test_fleet_ticks_in_lockstep_whatever_machines_are_beside(spark):
    ids = np.arange(6)
    whole = generator._fleet(ids, ids < 2, 4_000, 5.0, 0, 3)
    assert whole.ts.is_monotonic_increasing and (whole.groupby("ts").size() == 6).all()
    alone = generator._fleet(ids[1:2], np.array([True]), 4_000, 5.0, 0, 3)
    assert whole[whole.machine_id == "M-000001"].reset_index(drop=True).equals(alone)
    assert whole.lat.between(47, 55).all() and whole.lon.between(5, 15).all() and whole.cpu_usage.between(0, 100).all()
    bad, good = whole[whole.machine_id < "M-000002"], whole[whole.machine_id >= "M-000002"]
    assert set(bad.event) == {"ok", "warning", "fault"} and set(good.event) == {"ok"} and not good.failure_within_horizon.any()
    faults = bad[bad.event == "fault"]
    assert set(faults.error_code) <= set(generator.FAULT_CODES) and faults.failure_within_horizon.all() and (bad[bad.event != "fault"].error_code == 0).all()
    first = bad[bad.machine_id == "M-000000"].reset_index(drop=True)
    at_fault, labelled = (first.event == "fault").idxmax(), first.failure_within_horizon.idxmax()
    assert 40 <= at_fault - labelled <= 80 and first.vibration[at_fault:].mean() > first.vibration[:100].mean() + 2


def test_verification(spark):
    df = spark.createDataFrame([reading(1), reading(2, minute=3)], BRONZE)
    assert verify.verify_bronze(df).first()["passed"]
    assert not verify.verify_bronze(df.unionByName(df)).first()["passed"]
    gold = spark.createDataFrame([gold_row(5), gold_row(60, "1h")], GOLD)
    assert rows(verify.missing_durations(gold)) == [("24h",)]
    assert verify.freshness(gold, micros(at(70))).first()["fresh"]


def test_files(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([reading(1), reading(2, minute=2)], BRONZE).withColumn("event_date", F.to_date("ts"))
    files.upsert_absent(spark, df.where("row_id = 1"), p)
    files.upsert_absent(spark, df.withColumn("vibration", F.lit(9.0)), p)
    files.upsert_absent(spark, df, p)
    assert rows(spark.read.parquet(p), "row_id", "vibration") == [(1, 0.5), (2, 9.0)]
    files.write_batch(df, p + "b", 3)
    files.write_batch(df, p + "b", 3)
    files.write_batch(df.limit(0), p + "b", 4)
    assert spark.read.parquet(p + "b").count() == 2 and spark.read.parquet(p + "b").where("event_date = '2026-02-02'").count() == 2
    files.write_batch(df.where("row_id = 1"), p + "b", 3)
    assert rows(spark.read.parquet(p + "b"), "row_id") == [(1,)]
    files.write_batch(df.limit(0), p + "b", 3)
    assert not list(tmp_path.glob("tb/event_date=*/*.parquet"))
    with pytest.raises(FileNotFoundError):
        files.read_parquet(spark, p + "none")
    with pytest.raises(ValueError):
        files.read_parquet(spark, p + ".csv")
    with pytest.raises(ValueError):
        files.sink("nope")
    assert files.read_or(spark, p + "none", lambda: df)[1] == "synthetic"
    assert files.read_or_empty(spark, p + "none", df.schema).count() == 0


def test_quarantine_is_always_that_of_the_last_run(spark, tmp_path):
    p = str(tmp_path / "q")
    df = spark.createDataFrame([reading(1), reading(2, minute=1500)], BRONZE).withColumn("event_date", F.to_date("ts"))
    files.replace_quarantine(df, p)
    assert spark.read.parquet(p).count() == 2
    files.replace_quarantine(df.where("row_id = 1"), p)
    assert spark.read.parquet(p).count() == 1
    files.replace_quarantine(df.limit(0), p)
    assert spark.read.parquet(p).count() == 0 and "row_id" in spark.read.parquet(p).columns


def test_sinks(spark, tmp_path, capsys):
    df = spark.range(1_500).withColumn("machine_id", F.lit("m"))
    with files.sink("stdout") as out:
        out.write(df)
    printed = capsys.readouterr().out.splitlines()
    assert len(printed) == 1_500 and printed[0].startswith("{")
    with files.sink("file", path=str(tmp_path / "l")) as out:
        out.write_many([df, df])
    assert spark.read.json(str(tmp_path / "l")).count() == 3_000
    with files.sink("file", path=str(tmp_path / "l")) as out:
        out.write(df)
    assert spark.read.json(str(tmp_path / "l")).count() == 1_500
    dated = df.withColumn("event_date", F.lit("2026-02-02").cast("date"))
    for _ in range(2):
        files.sink("append", path=str(tmp_path / "t")).write(dated)
    files.overwrite_partitions(dated.limit(3).withColumn("window_duration", F.lit("5m")), str(tmp_path / "o"))
    files.overwrite_partitions(dated.limit(2).withColumn("window_duration", F.lit("1h")), str(tmp_path / "o"))
    files.overwrite_partitions(dated.limit(1).withColumn("window_duration", F.lit("5m")), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3_000 and spark.read.parquet(str(tmp_path / "o")).count() == 3
    assert files.json_summary(spark.range(1), str(tmp_path / "s.json")) == '{"id": 0}' == (tmp_path / "s.json").read_text()


def test_upsert_reads_only_the_partitions_of_the_source(spark, tmp_path):
    p = str(tmp_path / "u")
    df = spark.createDataFrame([reading(i, minute=i * 1440) for i in range(4)] + [reading(9, ts=None, minute=None)], BRONZE).withColumn("event_date", F.to_date("ts"))
    files.upsert_absent(spark, df, p)
    files.upsert_absent(spark, df.where("row_id in (1, 9)").withColumn("row_id", F.col("row_id") + 100), p)
    assert rows(spark.read.parquet(p), "row_id") == [(0,), (1,), (109,), (2,), (3,), (9,)]


def test_database_tables_are_counted_as_they_are_written(spark, tmp_path):
    df = spark.range(7)
    assert bi.write_tables({"a": df, "b": df.limit(0)}, folder=str(tmp_path / "bi")) == {"a": 7, "b": 0}
    assert spark.read.parquet(str(tmp_path / "bi" / "a")).count() == 7


def test_cooldown_holds_across_batches_and_models_are_swapped(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "alerts")
    texts = [("m", 0), ("m", 1), ("m", 5), ("n", 1), ("m", 6)]
    versions = iter(["1", "1", "2", "2", "2"])
    loads = []

    def load(tag):
        loads.append(tag.version)
        if tag.version == "2" and len(loads) == 2:
            raise OSError("not there yet")
        return lambda df: df.withColumn("anomaly_score", F.col("vibration"))

    cache = ingest.ModelCache(lambda: alerts.ModelTag("forest", "champion", next(versions)), load)
    for k, (machine, minute) in enumerate(texts):
        text = '{"machine_id":"%s","ts":"2026-02-02T00:%02d:00Z","vibration":0.9,"error_code":3,"event":"x"}' % (machine, minute)
        spark.createDataFrame([("k", text, "t", 0, k, at(0))], ingest.MESSAGE).coalesce(1).write.mode("append").json(src)
        ingest.start_alerts(ingest.file_source(spark, src), cache, out, str(tmp_path / "cp"), interval=None, lines=str(tmp_path / "lines")).awaitTermination()
    got = spark.read.parquet(out)
    assert [(r["machine_id"], r["event_timestamp"].minute, r["model_version"]) for r in got.orderBy("_offset").collect()] == [("m", 0, "1"), ("m", 5, "1"), ("n", 1, "2")]
    assert loads == ["1", "2", "2"]
    r = got.where("machine_id = 'n'").first()
    assert (r["alert_threshold"], r["model_name"], r["model_alias"], r["event"], r["error_code"], r["_topic"], r["_partition"], r["_offset"]) == (0.5, "forest", "champion", "x", 3, "t", 0, 3)
    assert set(alerts.ALERT_COLUMNS) < set(got.columns) and got.where("alert_emitted_ts IS NULL").count() == 0
    lines = spark.read.parquet(str(tmp_path / "lines"))
    assert lines.count() == 3 and '"model_version":"2"' in lines.where("key = 'n'").first()["value"]
    assert rows(ingest.last_before(spark, out + "_last", 99), "machine_id") == [("m",), ("n",)]


def test_progress_of_streams_is_a_table(spark, tmp_path):
    log = metrics.ProgressLog().attach(spark)
    src = str(tmp_path / "src")
    spark.createDataFrame([("k", '{"machine_id":"m"}', "t", 0, i, at(0)) for i in range(3)], ingest.MESSAGE).coalesce(1).write.json(src)
    ingest.start_ingest(ingest.file_source(spark, src), str(tmp_path / "b"), str(tmp_path / "m"), str(tmp_path / "cp"), interval=None, name="watched").awaitTermination()
    for _ in range(100):
        if log.table(spark).where("name = 'watched'").count():
            break
        time.sleep(0.1)
    spark.streams.removeListener(log)
    r = log.table(spark).where("name = 'watched' AND batch_id = 0").first()
    assert (r["input_rows"], r["late_rows"]) == (3, 0) and r["seconds"] > 0 and not log.failures


def test_stop_waits_for_the_running_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("k", '{"machine_id":"m"}', "t", 0, 0, at(0))], ingest.MESSAGE).write.json(src)
    query = ingest.start_ingest(ingest.file_source(spark, src), str(tmp_path / "b"), str(tmp_path / "m"), str(tmp_path / "cp"), interval="1 second", name="stopped")
    query.processAllAvailable()
    assert ingest.stop(query) and not query.isActive
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1


def test_stream_windows(spark, tmp_path):
    src = str(tmp_path / "src")
    for minutes in ((0, 1, 6), (30,), (31,)):
        spark.createDataFrame([reading(int(m), minute=m, temp=10.0 * m) for m in minutes], BRONZE).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(BRONZE).parquet(src)
        ingest.stream_windows(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "window_start_us", "motor_temp_mean", "record_count")
    assert got == [(micros(at(0)), 5.0, 2), (micros(at(5)), 60.0, 1)]


def test_training_pipeline_saves_promotes_and_loads(spark, tmp_path):
    wide = generator.synthetic_features(spark, machines=12, steps=40).withColumn("label_failure_within_horizon", F.col("vibration_mean_5m") > 0.5)
    reg = models.Registry(str(tmp_path / "r.json"))
    folder = str(tmp_path / "models")
    first = models.run_pipeline("predictive_maintenance", wide, reg, folder, rounds=5)
    assert first.version == 1 and 0.5 < first.metrics["roc_auc"] <= 1 and 1 <= first.rounds <= 5
    model = models.Model.load(spark, f"{folder}/predictive_maintenance/1")
    stored = models.score_to_table(model, wide, str(tmp_path / "scored"), "gbt", "champion")
    assert stored.count() == wide.count() and stored.columns == ["machine_id", "event_timestamp", "failure_probability", "model", "alias"]
    assert stored.where("failure_probability BETWEEN 0 AND 1").count() == stored.count()
    battery = models.run_pipeline("battery_health", wide, rounds=5)
    assert battery.metrics["rmse"] > 0 and battery.version is None
    fitted, _ = models.evaluate("battery_health", wide, rounds=2)
    assert fitted.features and not any(c.startswith("battery_soh") for c in fitted.features)
    anomaly = models.run_pipeline("anomaly_detection", wide, reg, folder, promote=False)
    assert not anomaly.promoted and reg.champion("anomaly_detection") is None and "score_auc" in anomaly.metrics
    again = models.Model.load(spark, f"{folder}/anomaly_detection/1")
    a, b = (rows(m.score(wide.drop("created_timestamp")), "machine_id", "event_timestamp", "anomaly_score") for m in (again, models.train("anomaly_detection", wide.limit(400))))
    assert len(a) == len(b) == 480
    with pytest.raises(ValueError):
        models.train("predictive_maintenance", wide.withColumn("label_failure_within_horizon", F.lit(None).cast("boolean")))
    raw = models.raw_sensor_forest(rows=500, trees=20).score(spark.createDataFrame([reading(1), reading(2, vib=900.0, temp=None)], BRONZE)).orderBy("row_id").collect()
    assert raw[0]["anomaly_score"] < raw[1]["anomaly_score"] < 1


def test_offline_store_drift_check_and_layers(spark, tmp_path):
    gold = spark.createDataFrame([gold_row(5 * i) for i in range(1, 40)] + [gold_row(60, "1h"), gold_row(1440, "24h")], GOLD)
    stored = features.write_offline(gold, str(tmp_path / "offline"))
    assert stored.where("created_timestamp IS NULL").count() == 0 and stored.count() == features.feature_dataset(gold).count()
    assert [r["event_timestamp"] for r in features.feature_dataset(gold, ordered=True).collect()] == sorted(r["event_timestamp"] for r in stored.collect())
    with pytest.raises(ValueError):
        features.feature_dataset(gold.drop("error_count"))
    drift.freeze_reference(stored, str(tmp_path / "ref"))
    ref = spark.read.parquet(str(tmp_path / "ref"))
    assert drift.drift_check(ref, stored, str(tmp_path / "d.json"))[1] == 0 and "dataset_drift" in (tmp_path / "d.json").read_text()
    numbers = drift.shared_features(stored, stored)
    moved = stored.withColumns({c: F.col(c) * 3 + F.rand(1) + 100 for c in numbers})
    assert drift.drift_check(spark.range(200).select(F.rand(2).alias("a")), spark.range(200).select((F.rand(3) + 5).alias("a")))[1] == 1 and moved.columns == stored.columns
    silver = spark.createDataFrame([reading(1), reading(2, minute=3)], BRONZE).withColumns({"lat": F.lit(1.0), "lon": F.lit(1.0), "speed": F.lit(1.0)})
    ok = verify.verify_layers(silver, gold, silver.limit(1), micros(at(1445))).first()
    assert (ok["passed"], ok["n_quarantined"], ok["missing"], ok["fresh"]) == (True, 1, "", True)
    bad = verify.verify_layers(silver.unionByName(silver), gold.where("window_duration <> '1h'")).first()
    assert (bad["passed"], bad["n_duplicates"], bad["missing"], bad["fresh"]) == (False, 2, "1h", False)


def test_streaming_ingest_and_alerts(spark, tmp_path):
    lines = ['{"machine_id":"m","ts":"2026-02-02T00:00:00Z","vibration":0.9,"error_code":3}', "garbage", '{"ts":"2026-02-02T00:00:00Z"}', '{"machine_id":"n","ts":"bad","vibration":"x","speed":1.5}']
    src, bronze, bad = (str(tmp_path / x) for x in ("src", "bronze", "bad"))
    for k, text in enumerate(lines):
        spark.createDataFrame([("k", text, "t", 0, k, at(0))], ingest.MESSAGE).coalesce(1).write.mode("append").json(src)
    for _ in range(2):  # the second run finds nothing new
        ingest.start_ingest(ingest.file_source(spark, src), bronze, bad, str(tmp_path / "cp"), interval=None).awaitTermination()
    got = {r["machine_id"]: r for r in spark.read.parquet(bronze).collect()}
    assert set(got) == {"m", "n"} and got["m"]["vibration"] == 0.9 and got["n"]["ts"] is None and got["n"]["vibration"] is None and got["n"]["speed"] == 1.5
    assert spark.read.parquet(bad).count() == 2
    out = str(tmp_path / "alerts")
    for _ in range(2):
        ingest.start_alerts(ingest.file_source(spark, src), lambda df: df.withColumn("anomaly_score", F.col("vibration")), out, str(tmp_path / "cp2"), interval=None).awaitTermination()
    assert rows(spark.read.parquet(out), "machine_id", "anomaly_score") == [("m", 0.9)]
