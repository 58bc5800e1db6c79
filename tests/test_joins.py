import random

from pyspark.sql import functions as F

from gaugeflow.functions.running import levels_for, running_sums
from gaugeflow.operators import evalmetrics, joins
from gaugeflow.operators.hotkeys import hot_keys, slice_of, slice_table, with_slices

from .helpers import at, micros, rows

DIM = "machine_id string, v int, valid_from timestamp, valid_to timestamp, site string, asof_time int"
FACT = "machine_id string, id int, t timestamp, site string"


def test_versions_valid_at_a_time(spark):
    dim = spark.createDataFrame([("a", 1, at(0), at(10), "x", 0), ("a", 2, at(10), at(20), "y", 0), ("a", 3, at(30), None, "z", 0), ("a", 4, at(30), None, None, 0), (None, 5, at(0), None, "n", 0)], DIM)
    facts = spark.createDataFrame([("a", 1, at(0), "f"), ("a", 2, at(10), "f"), ("a", 3, at(20), "f"), ("a", 4, at(99), "f"), ("b", 5, at(1), "f"), (None, 6, at(1), "f"), ("a", 7, None, "f"), ("a", 1, at(0), "f")], FACT)
    got = rows(joins.valid_at(facts, dim, "machine_id", "t", "v", ("site",), ("id",)), "id", "v", "v_site")
    assert got == [(1, 1, "x"), (1, 1, "x"), (2, 2, "y"), (3, None, None), (4, 4, None), (5, None, None), (6, None, None), (7, None, None)]
    assert joins.valid_at(facts, dim.limit(0), "machine_id", "t", "v", ("site",), ("id",)).where("v IS NOT NULL").count() == 0
    assert joins.valid_at(facts.limit(0), dim, "machine_id", "t", "v").count() == 0


def test_labels_against_brute_force(spark):
    r = random.Random(3)
    history = [(i, r.choice(["a", "b", None]), at(r.randint(0, 60)) if r.random() < 0.9 else None) for i in range(80)]
    events = [(r.choice(["a", "b", "c", None]), at(r.randint(0, 90)) if r.random() < 0.9 else None) for _ in range(15)]
    df = spark.createDataFrame(history, "id int, machine_id string, event_timestamp timestamp")
    ev = spark.createDataFrame(events + events[:3], "machine_id string, event_timestamp timestamp")
    got = {x["id"]: (x["label"], x["label_us"]) for x in joins.label_within(df, ev, 12 * 60_000_000, "id").collect()}
    for i, m, t in history:
        if m is None or t is None:
            assert got[i][0] is None
            continue
        later = sorted(micros(e) for k, e in events if k == m and e is not None and t <= e <= at((t - at(0)).total_seconds() / 60 + 12))
        assert got[i] == ((True, later[0]) if later else (False, None))


def test_hot_entities_in_a_table_are_like_broadcast_ones(spark):
    df = spark.range(500).select(F.when(F.col("id") % 5 == 0, F.concat(F.lit("k"), F.col("id"))).otherwise(F.concat(F.lit("h"), F.col("id") % 2)).alias("k"), (F.col("id") * 1_000).alias("us"))
    assert rows(hot_keys(df, "k", F.col("us"), 50), "_hot_key") == rows(hot_keys(df, "k", F.col("us"), 50, max_hot=0), "_hot_key") == [("h0",), ("h1",)]
    few, many = slice_table(df, "k", F.col("us"), 50), slice_table(df, "k", F.col("us"), 50, max_hot=1)
    cut = lambda s: rows(with_slices(df, "k", s).select("k", "us", slice_of(F.col("us")).alias("s")))
    assert rows(few) == rows(many) and cut(few) == cut(many)
    assert max(x[2] for x in cut(few)) == 3


def test_running_sums_with_any_number_of_ranges(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 300).cast("double").alias("v"), F.lit(1).alias("n"))
    plain = {(r["g"], r["v"]): r["n_before"] for r in running_sums(df, ("g",), "v", ("n",), 2).collect()}
    for levels in (16, 100, 4_096):
        assert {(r["g"], r["v"]): r["n_before"] for r in running_sums(df, ("g",), "v", ("n",), levels).collect()} == plain
    by_group = {}
    for (g, v), before in sorted(plain.items()):
        assert before == by_group.setdefault(g, 0)
        by_group[g] += 1
    assert (levels_for(10), levels_for(10**9), levels_for(10**15)) == (64, 2_000, 65_536)


def test_request_rates(spark):
    df = spark.createDataFrame([("a", at(0), 1), ("a", at(4), 9), ("a", at(5), 1), ("b", None, 1)], "g string, t timestamp, v int")
    got = rows(evalmetrics.request_rates(df, "t", ("g",), F.col("v") > 5))
    assert got == [("a", micros(at(0)), 2, 2 / 300, 1, 1 / 300), ("a", micros(at(5)), 1, 1 / 300, 0, 0.0)]
