import random

import pytest

from gaugeflow.operators import asof, hotkeys, pit
from pyspark.sql import functions as F

from .helpers import at, rows

VERSIONS = "feature_id long, machine_id string, event_timestamp timestamp, created_timestamp timestamp, x double"
EVENTS = "prediction_id long, machine_id string, event_timestamp timestamp, x string"


def tables(seed, n=120):
    r = random.Random(seed)
    moment = lambda: at(r.randint(0, 4000)) if r.random() > 0.04 else None
    machine = lambda: r.choice(["a", "a", "a", "b", "c", None])
    versions = []
    for i in range(n):
        t = moment()
        made = None if r.random() < 0.1 else at((t - at(0)).total_seconds() / 60 + r.choice([0, 0, 3, 500, 1500])) if t else moment()
        versions.append((i, machine(), t, made, float(i)))
    return versions, [(i, machine(), moment(), "e") for i in range(n)]


def brute(versions, events, day=86_400):
    out = []
    for p, m, t, _ in events:
        fits = [v for v in versions if m and t and v[1] == m and v[2] and v[3] and v[2] <= t and v[3] <= t and (t - v[2]).total_seconds() <= day]
        if fits:
            out.append((p, max(fits, key=lambda v: (v[2], v[3], v[0]))[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("target", [20_000, 7])
def test_against_brute_force(spark, seed, target):
    versions, events = tables(seed)
    v, e = spark.createDataFrame(versions, VERSIONS), spark.createDataFrame(events, EVENTS)
    joined = pit.known_versions(e, v, target_rows=target, payload=("x",))
    assert rows(pit.found_versions(joined)) == brute(versions, events)
    assert joined.count() == len(events)
    assert joined.where("v_x <> feature_id").count() == 0


def test_bounds_are_inclusive(spark):
    v = spark.createDataFrame([(1, "m", at(0), at(0), 0.0), (2, "m", at(5), at(9), 0.0)], VERSIONS)
    e = spark.createDataFrame([(1, "m", at(1440), None), (2, "m", at(8.99), None), (3, "m", at(9), None), (4, "m", at(5 + 1440.01), None)], EVENTS)
    assert rows(pit.found_versions(pit.known_versions(e, v))) == [(1, 2), (2, 1), (3, 2)]


def test_empty_tables(spark):
    v, e = spark.createDataFrame([], VERSIONS), spark.createDataFrame([(1, "m", at(0), None)], EVENTS)
    assert rows(pit.known_versions(e, v), "prediction_id", "feature_id") == [(1, None)]
    assert pit.known_versions(e.limit(0), v).count() == 0


def test_asof_many_machines_and_ttl(spark):
    v = spark.createDataFrame([(1, "a", at(5), None, 1.0), (2, "a", at(10), at(0), 2.0), (3, "b", at(10), at(3), 3.0), (4, "b", at(10), at(2), 4.0)], VERSIONS)
    e = spark.createDataFrame([(1, "a", at(7.5), None), (2, "a", at(10), None), (3, "b", at(12), None), (4, "b", at(9), None), (5, "c", at(9), None), (6, "a", at(99), None)], EVENTS)
    hit = lambda **kw: rows(asof.asof_join(e, v, left_cols=("prediction_id",), tie="created_timestamp", **kw), "prediction_id", "feature_id")
    assert hit() == [(1, 1), (2, 2), (3, 3), (4, None), (5, None), (6, 2)]
    assert hit(ttl_us=60 * 60_000_000)[-1] == (6, None)


def test_slices_have_a_proven_bound(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 1_000_000).alias("us"))
    table = hotkeys.slice_table(df, "k", F.col("us"), target_rows=50)
    assert [r["_hot_key"] for r in table.collect()] == ["hot"]
    sizes = hotkeys.with_slices(df, "k", table).groupBy("k", hotkeys.slice_of(F.col("us")).alias("s")).count().where("k = 'hot'")
    assert sizes.agg(F.max("count")).first()[0] <= 75 and sizes.agg(F.sum("count")).first()[0] == 334


def test_online_table_and_parity(spark):
    v = spark.createDataFrame([(1, "a", at(0), at(0), 1.0), (2, "a", at(9), at(1), 2.0), (3, "a", at(9), at(2), 3.0), (4, "b", at(-60 * 24 * 31), at(0), 4.0), (5, None, at(99), at(0), 5.0), (6, "c", None, at(0), 6.0)], VERSIONS)
    online = asof.online_latest(v.where("machine_id IS NOT NULL"))
    assert rows(online, "machine_id", "feature_id") == [("a", 3)]
    look = asof.online_lookup(spark.createDataFrame([("a",), ("z",)], "machine_id string"), online, ("x",))
    assert rows(look) == [("a", 3.0), ("z", None)]
    assert rows(asof.parity(online, online, ("x",)), "equal") == [(True,)]
