import numpy as np
import pytest

from gaugeflow.streaming import kslack

from .helpers import BRONZE, at, micros, reading


def test_release_sorts():
    r = kslack.release(np.array([[30.0, 3.0], [0.0, 1.0], [10.0, np.nan]]))
    assert (r["n_messages"], r["weighted_mean"], r["first_value"], r["last_value"]) == (3, 2.0, 1.0, 3.0)
    assert kslack.release(np.zeros((0, 2)))["weighted_mean"] is None


@pytest.mark.parametrize("slice_us", [None, 600_000_000])
def test_stream_publishes_corrects_releases_and_refuses(spark, tmp_path, slice_us):
    tick = lambda i, m: [reading(i, machine="x", minute=m)]
    late = [reading(4, minute=50, temp=50.0, kafka=at(90))]
    batches = [[reading(1, minute=40, temp=30.0), reading(2, minute=10, temp=10.0)], tick(3, 70), tick(8, 80), late, tick(5, 430), tick(9, 440), [reading(6, minute=55, temp=99.0, kafka=at(445))], tick(7, 450)]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    src = str(tmp_path / "src")
    for b in batches:
        spark.createDataFrame(b, BRONZE).coalesce(1).write.mode("append").parquet(src)
        query = kslack.kslack_stream(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), slice_us=slice_us).writeStream.foreachBatch(lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    raw = spark.read.parquet(str(tmp_path / "out")).where("machine_id = 'M-000001'")
    whole = [r for r in kslack.merge_slices(raw).collect() if r["window_start_us"] == micros(at(0))]
    assert {r["stage"]: r["n_messages"] for r in whole}["refused"] == 1
    final = next(r for r in whole if r["stage"] == "final")
    assert (final["n_messages"], final["first_value"], final["last_value"]) == (3, 10.0, 50.0)
    assert final["weighted_mean"] == pytest.approx((30 * 20 + 10 * 40) / 40)
    if slice_us:
        return
    got = [r for r in raw.collect() if r["window_start_us"] == micros(at(0))]
    stages = {r["stage"]: r for r in got}
    assert set(stages) == {"provisional", "corrected", "final", "refused"}
    assert (stages["refused"]["n_messages"], stages["refused"]["n_refused"]) == (1, 1)
    assert stages["provisional"]["weighted_mean"] == pytest.approx(20) and stages["provisional"]["n_messages"] == 2
    assert (stages["corrected"]["n_messages"], stages["corrected"]["n_late"]) == (3, 1)
    assert stages["final"]["n_messages"] == 3 and stages["final"]["last_value"] == 50.0
