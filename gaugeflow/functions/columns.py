"""Column expressions with fixed treatment of NULL and NaN, and duration texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DURATION = re.compile(r"^\s*(\d+(?:\.\d+)?)\s*(second|minute)s?\s*$", re.IGNORECASE)


def seconds_of(text: str) -> float:
    """Seconds of '<n> second(s)' or '<n> minute(s)'; ValueError for anything else."""
    m = _DURATION.match(text)
    if not m:
        raise ValueError(f"no duration: {text!r}")
    return float(m[1]) * (60 if m[2].lower() == "minute" else 1)


def us(column: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (taken as UTC)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp"))


def from_us(column: Column) -> Column:
    """Timestamp of microseconds."""
    return F.timestamp_micros(column)


def finite(column: str | Column) -> Column:
    """Whether a number is neither NULL, NaN nor infinite."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def clip(column: Column, low: float, high: float) -> Column:
    """Clipped to [low, high]; NULL stays NULL (least and greatest would skip it)."""
    return F.when(column.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), column)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; NULL where whole is 0 or either is NULL."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, by a scalar subquery (never a join)."""
    return df.withColumn("_row", row.select(F.struct("*")).scalar()).select("*", "_row.*").drop("_row")


def flat(df: DataFrame, digits: int = 4, nudge: float = 0.0) -> DataFrame:
    """Times as microseconds under <name>_us, dates as text, doubles rounded.

    Means of few short decimals lie exactly between two roundings; ``nudge`` moves them off the half in both engines.
    """
    out = []
    for name, kind in df.dtypes:
        if kind in ("timestamp", "timestamp_ntz"):
            out.append(us(name).alias(f"{name}_us"))
        elif kind == "date":
            out.append(F.date_format(name, "yyyy-MM-dd").alias(name))
        elif kind in ("double", "float"):
            out.append(F.round(F.col(name).cast("double") + nudge, digits).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
