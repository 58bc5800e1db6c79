"""Time slices for entities that hold too many rows for one task.

An entity with more rows than the limit is cut into slices of equal length in time, as many as it has times the limit, so
slices are bounded by rows at any size of the input (as far as the entity's pace is even). As long as at most MAX_HOT
entities exceed the limit their table is small and proven so, and it is broadcast; beyond that it is written to the
shared folder and joined like any table. The length of a slice is chosen from the span between the 0.1 and 99.9 per cent
quantiles of the entity's times, so single stray times don't stretch it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.session import spill

#: Up to so many hot entities (some 5 MB) are broadcast.
MAX_HOT = 100_000
TARGET_ROWS = 20_000

_SLICES = "_hot_key string, _hot_lo bigint, _hot_len bigint, _hot_n bigint"


def _slim(df: DataFrame, key: str, us: Column) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("_hot_key"), us.alias("_us")).where(F.col("_hot_key").isNotNull() & F.col("_us").isNotNull())


def _settle(table: DataFrame, schema: str, max_hot: int) -> DataFrame:
    """A table of hot entities, computed once: with a broadcast hint if it is small, else from the shared folder."""
    rows = table.limit(max_hot + 1).collect()
    if len(rows) <= max_hot:
        return F.broadcast(table.sparkSession.createDataFrame([tuple(r) for r in rows], schema))
    return spill(table, "hot")


def hot_keys(df: DataFrame, key: str, us: Column, target_rows: int = TARGET_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """(_hot_key, _n): the entities above the limit, from one scan with map-side combine."""
    counts = _slim(df, key, us).groupBy("_hot_key").agg(F.count("*").alias("_n")).where(F.col("_n") > target_rows)
    return _settle(counts, "_hot_key string, _n bigint", max_hot)


def slice_table(df: DataFrame, key: str, us: Column, target_rows: int = TARGET_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """(_hot_key, _hot_lo, _hot_len, _hot_n) for each entity above the limit; empty when there is none.

    ``us`` is the time in microseconds. Two scans of two columns with map-side combine; NULL keys and times are left out.
    """
    keys = hot_keys(df, key, us, target_rows, max_hot)
    spans = _slim(df, key, us).join(keys, "_hot_key").groupBy("_hot_key", "_n").agg(F.percentile_approx("_us", [0.001, 0.999], 10_000).alias("q"))
    n = F.ceil(F.col("_n") / F.lit(target_rows)).cast("long")
    length = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("q")[1] - F.col("q")[0] + 1) / n).cast("long"))
    return _settle(spans.select("_hot_key", F.col("q")[0].alias("_hot_lo"), length.alias("_hot_len"), n.alias("_hot_n")), _SLICES, max_hot)


def slice_of(us: Column) -> Column:
    """The slice of a time once the slice table is joined: 0 for entities that need none, else 0 to n - 1."""
    raw = F.floor((us - F.col("_hot_lo")) / F.col("_hot_len"))
    inside = F.least(F.greatest(raw, F.lit(0)), F.col("_hot_n") - 1)
    return F.when(F.col("_hot_n").isNull(), F.lit(0)).otherwise(inside).cast("int")


def with_slices(df: DataFrame, key: str, slices: DataFrame) -> DataFrame:
    """Join the slice table, which carries its own broadcast hint where it is small; adds _hot_lo, _hot_len and _hot_n."""
    renamed = slices.withColumnRenamed("_hot_key", "_hot_key_of")
    return df.join(renamed, F.col(key).cast("string") == F.col("_hot_key_of"), "left").drop("_hot_key_of")
