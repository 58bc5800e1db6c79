"""Checks of the stored layers as one-pass aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.columns import us, with_row
from gaugeflow.operators.dedup import duplicate_count, metadata_complete
from gaugeflow.operators.quality import NULL_LIMIT, RULES, QualityRule, violates
from gaugeflow.schema import DURATIONS

FRESH_MINUTES = 15


def verify_bronze(bronze: DataFrame) -> DataFrame:
    """One row (n_rows, n_duplicates, n_complete, passed): no repeated key and whole metadata."""
    d = duplicate_count(bronze)
    m = metadata_complete(bronze).select("n_complete")
    return d.select("n_rows", "n_duplicates", m.scalar().alias("n_complete")).withColumn("passed", (F.col("n_duplicates") == 0) & (F.col("n_rows") == F.col("n_complete")))


def verify_silver(silver: DataFrame, rules: tuple[QualityRule, ...] = RULES) -> DataFrame:
    """One row (n_rows, n_violations, n_duplicates)."""
    bad = silver.agg(F.count_if(violates(rules)).alias("v")).select("v").scalar()
    return duplicate_count(silver).select("n_rows", bad.alias("n_violations"), "n_duplicates")


def verify_gold(gold: DataFrame) -> DataFrame:
    """One row: lows of the metrics that can't be negative, number of partitions, newest window, and whether all is well."""
    a = gold.agg(
        F.count("*").alias("n_rows"),
        F.min("vibration_mean").alias("low_vibration"),
        F.min("battery_soh_mean").alias("low_battery"),
        F.min("cpu_usage_mean").alias("low_cpu"),
        F.min("motor_temp_mean").alias("low_temp"),
        F.count_distinct("event_date", "window_duration").alias("n_partitions"),
        F.max(us("window_end")).alias("newest_us"),
    )
    sane = F.lit(True)
    for c in ("low_vibration", "low_battery", "low_cpu"):
        sane = sane & F.coalesce(F.col(c) >= 0, F.lit(True))
    return a.withColumn("sane", sane)


def missing_durations(gold: DataFrame) -> DataFrame:
    """(window_duration): the expected durations that the table lacks."""
    expected = gold.sparkSession.createDataFrame([(d,) for d in DURATIONS], "window_duration string")
    return expected.join(gold.select("window_duration").distinct(), "window_duration", "left_anti")


def partitions(gold: DataFrame) -> DataFrame:
    """(event_date, window_duration): the partitions there are."""
    return gold.select("event_date", "window_duration").distinct()


def freshness(gold: DataFrame, now_us: int, limit_minutes: float = FRESH_MINUTES) -> DataFrame:
    """One row (lag_minutes, fresh); a stale table is worth a warning, no failure."""
    return gold.agg(((F.lit(now_us) - F.max(us("window_end"))) / 60e6).alias("lag_minutes")).withColumn("fresh", F.col("lag_minutes") <= limit_minutes)


def verify_layers(silver: DataFrame, gold: DataFrame, quarantine: DataFrame | None = None, now_us: int | None = None, rules: tuple[QualityRule, ...] = RULES, null_limit: float = NULL_LIMIT) -> DataFrame:
    """One row on both layers: n_silver, n_duplicates, n_out_of_range, max_null_rate, n_gold, missing, sane, n_quarantined, lag_minutes, fresh, passed.

    Silver passes without repeated keys, without values outside the rules and with null rates within the limit of the
    columns that must not be NULL; Gold with every duration there and no negative lows. A stale Gold is a warning and
    doesn't enter ``passed``. One pass over each layer.
    """
    ranges = tuple(QualityRule(r.column, True, r.low, r.high) for r in rules if r.has_range)
    nulls = [F.count_if(F.col(r.column).isNull()) for r in rules if not r.nullable]
    s = silver.agg(F.count("*").alias("n"), F.count_if(violates(ranges)).alias("bad"), F.greatest(F.lit(0), F.lit(0), *nulls).alias("nulls"))
    keys = duplicate_count(silver).select("n_duplicates")
    there = [F.coalesce(F.bool_or(F.col("window_duration") == d), F.lit(False)) for d in DURATIONS]
    g = gold.agg(*[x.alias(f"has_{d}") for d, x in zip(DURATIONS, there, strict=True)])
    absent = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"has_{d}"), F.lit(d)) for d in DURATIONS])), ",")
    low = verify_gold(gold)
    gone = F.lit(0).cast("long") if quarantine is None else quarantine.agg(F.count("*").alias("q")).scalar()
    now = F.lit(now_us) if now_us is not None else F.unix_micros(F.current_timestamp())
    row = with_row(with_row(with_row(s, keys), g), low.select(F.col("n_rows").alias("n_gold"), "newest_us", "sane"))
    out = row.select(
        F.col("n").alias("n_silver"), "n_duplicates", F.col("bad").alias("n_out_of_range"), (F.col("nulls") / F.greatest("n", F.lit(1))).alias("max_null_rate"),
        "n_gold", absent.alias("missing"), "sane", gone.alias("n_quarantined"), ((now - F.col("newest_us")) / 60e6).alias("lag_minutes"),
    )
    return out.withColumns(
        {
            "fresh": F.coalesce(F.col("lag_minutes") <= FRESH_MINUTES, F.lit(False)),
            "passed": (F.col("n_duplicates") == 0) & (F.col("n_out_of_range") == 0) & (F.col("max_null_rate") <= null_limit) & (F.col("missing") == "") & F.col("sane"),
        }
    )
