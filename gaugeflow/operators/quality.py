"""Declarative data-quality rules: violation predicate, split, one-pass profile and gate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QualityRule:
    """A column with its nullability and inclusive bounds."""

    column: str
    nullable: bool = True
    low: float | None = None
    high: float | None = None

    @property
    def has_range(self) -> bool:
        return self.low is not None or self.high is not None


#: The rules of the telemetry records.
RULES: tuple[QualityRule, ...] = (
    QualityRule("machine_id", nullable=False),
    QualityRule("ts", nullable=False),
    QualityRule("lat", nullable=False, low=-90.0, high=90.0),
    QualityRule("lon", nullable=False, low=-180.0, high=180.0),
    QualityRule("speed", low=0.0),
    QualityRule("vibration", low=0.0),
    QualityRule("battery_soh", low=0.0, high=1.0),
    QualityRule("cpu_usage", low=0.0, high=100.0),
    QualityRule("motor_temp"),
    QualityRule("error_code"),
)
NULL_LIMIT, RANGE_LIMIT = 0.05, 0.01


def rules_of(table: DataFrame, limit: int = 10_000) -> tuple[QualityRule, ...]:
    """Rules from a table (column_name, nullable, min_value, max_value); NaN bounds count as none."""
    rows = table.orderBy("column_name").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rules")
    bound = lambda x: None if x is None or x != x else float(x)
    return tuple(QualityRule(r["column_name"], bool(r["nullable"]), bound(r["min_value"]), bound(r["max_value"])) for r in rows)


def _parts(rule: QualityRule) -> dict[str, Column]:
    c = F.col(rule.column)
    parts = {}
    if not rule.nullable:
        parts["null"] = c.isNull()
    if rule.low is not None:
        parts["min"] = c.isNotNull() & (c < rule.low)
    if rule.high is not None:
        parts["max"] = c.isNotNull() & (c > rule.high)
    return parts


def violates(rules: tuple[QualityRule, ...] = RULES) -> Column:
    """Whether a row breaks any rule; never NULL. NaN is above every bound, so it breaks maxima and passes minima."""
    return reduce(lambda a, b: a | b, (p for r in rules for p in _parts(r).values()), F.lit(False))


def split(df: DataFrame, rules: tuple[QualityRule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine); together every row of the input."""
    bad = violates(rules)
    return df.where(~bad), df.where(bad)


def quarantine(df: DataFrame, rules: tuple[QualityRule, ...] = RULES) -> DataFrame:
    """The rows that break a rule, stamped with _dq_ts."""
    return split(df, rules)[1].withColumn("_dq_ts", F.current_timestamp())


def profile(df: DataFrame, rules: tuple[QualityRule, ...] = RULES) -> DataFrame:
    """One row, one pass: total, valid, and for each rule null_<c>, below_<c>, above_<c>."""
    label = {"null": "null", "min": "below", "max": "above"}
    counts = [F.count_if(p).alias(f"{label[k]}_{r.column}") for r in rules for k, p in _parts(r).items()]
    return df.agg(F.count("*").alias("total"), F.count_if(~violates(rules)).alias("valid"), *counts)


def gate(df: DataFrame, rules: tuple[QualityRule, ...] = RULES, null_limit: float = NULL_LIMIT, range_limit: float = RANGE_LIMIT) -> DataFrame:
    """(total, valid, quarantined, quarantine_rate, max_null_rate, max_range_rate, passed) from one pass.

    A column's null rate and range rate (values below and above together) must not exceed the limits; an empty table
    passes with rates of 0.
    """
    p = profile(df, rules)
    total = F.greatest(F.col("total"), F.lit(1))
    zero = F.lit(0)
    nulls = [F.col(f"null_{r.column}") for r in rules if not r.nullable]
    ranges = [reduce(lambda a, b: a + b, [F.col(f"{k}_{r.column}") for k, v in (("below", r.low), ("above", r.high)) if v is not None]) for r in rules if r.has_range]
    highest = lambda cols: (F.greatest(zero, zero, *cols) / total)
    quarantined = F.col("total") - F.col("valid")
    return p.select("total", "valid", quarantined.alias("quarantined"), (quarantined / total).alias("quarantine_rate"), highest(nulls).alias("max_null_rate"), highest(ranges).alias("max_range_rate")).withColumn(
        "passed", (F.col("max_null_rate") <= null_limit) & (F.col("max_range_rate") <= range_limit)
    )
