import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import profile

SILVER = "load_id int, machine_id string, lat double, speed double, battery_soh double"
RULES = [("machine_id", False, None, None), ("lat", False, -90.0, 90.0), ("speed", True, 0.0, None), ("battery_soh", True, 0.0, 1.0)]


def loads(n=12, rows=300, seed=2):
    r = random.Random(seed)
    return [[k, f"M-{r.randint(1, 90):06d}", round(r.uniform(44, 49), 5), round(r.uniform(1, 38), 2), round(r.uniform(0.6, 0.97), 5)] for k in range(1, n + 1) for _ in range(rows)]


def found(spark, data):
    rules = spark.createDataFrame(RULES, "column_name string, nullable boolean, min_value double, max_value double")
    report = profile.profile_report(spark.createDataFrame(data, SILVER), rules)
    return {tuple(x) for x in profile.findings(report).collect()}


def test_clean_loads(spark):
    assert found(spark, loads()) == set()


@pytest.fixture(scope="module")
def dirty():
    data = loads()
    for i, row in enumerate(data):
        if row[0] == 2 and i % 3 == 0:
            row[3] = None if i % 2 else float("nan")
        if row[0] == 3 and i % 50 == 0:
            row[2] = 999.0
        if row[0] == 4:
            row[4] -= 0.3
        if row[0] == 5 and i % 2:
            row[3] = 12.0
        if row[0] == 6 and i % 100 == 0:
            row[1] = row[1].lower()
        if row[0] == 7:
            row[2] = float(round(row[2]))
        if row[0] == 8 and i % 90 == 0:
            row[1] = ""
        if row[0] == 9 and i % 4:
            row[1] = None
    return data


def test_findings(spark, dirty):
    assert found(spark, dirty) == {
        (2, "speed", "null_rate"),
        (3, "lat", "range"),
        (4, "battery_soh", "distribution"),
        (5, "speed", "distribution"),
        (6, "machine_id", "pattern"),
        (7, "lat", "distribution"),
        (8, "machine_id", "pattern"),
        (9, "machine_id", "null_rate"),
    }


def test_all_missing_and_empty(spark):
    data = loads(6, 100)
    for row in data:
        if row[0] == 1:
            row[2] = None
    assert found(spark, data) == {(1, "lat", "null_rate")}
    assert found(spark, []) == set()


def test_mask(spark):
    (r,) = spark.createDataFrame([("Ab-09 é９",)], "s string").select(profile.mask(F.col("s")).alias("m")).collect()
    assert r["m"] == "Aa-99 é９"


def test_form_collapses_runs(spark):
    rows = spark.createDataFrame([("12.5",), ("1234.567",), ("AB-7cd",)], "s string").select(profile.form(F.col("s")).alias("m")).collect()
    assert [r["m"] for r in rows] == ["9+.9", "9+.9+", "A+-9a+"]


def test_many_forms_are_ranked_by_frequency(spark):
    """A free-text column has as many forms as values; the regular one is still found, and nothing ranks them one by one."""
    data = loads(6, 200)
    for i, row in enumerate(data):
        if row[0] == 3:
            row[1] = "x" * (i % 7 + 1) + "-" * (i % 5) + "é"
    got = found(spark, data)
    assert got == {(3, "machine_id", "pattern")}


def test_heap_of_few_values_and_shift_are_told_by_masks(spark):
    data = loads(8, 400)
    for i, row in enumerate(data):
        if row[0] == 2:
            row[2] = (44.5, 45.5, 46.5, 47.5, 48.5)[i % 5]
        if row[0] == 5:
            row[3] = row[3] / 2
    rules = spark.createDataFrame(RULES, "column_name string, nullable boolean, min_value double, max_value double")
    report = {(r["load_id"], r["column_name"]): r for r in profile.profile_report(spark.createDataFrame(data, SILVER), rules).collect()}
    assert report[2, "lat"]["heap"] > 0.15 and report[5, "speed"]["mask_shift"] > 0.3
    assert found(spark, data) == {(2, "lat", "distribution"), (5, "speed", "distribution")}
