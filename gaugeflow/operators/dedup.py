"""Keep-latest deduplication, insert-if-absent merge and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: tuple[str, ...] = ("machine_id", "ts"), order: tuple[str, ...] = ("_ingest_ts", "_offset", "row_id")) -> DataFrame:
    """One row per key: the one that is last in ``order``.

    An aggregation with map-side combine instead of a ranking window, so a key that holds a large share of the rows is
    reduced before the shuffle. NULL keys form groups like any value; NULL ranks lowest. The order should end in a unique
    column, else equal rows are told apart by their other columns.
    """
    order = tuple(c for c in order if c in df.columns)
    rest = [c for c in df.columns if c not in order and c not in keys]
    best = F.max(F.struct(*[F.col(c) for c in (*order, *rest)])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def insert_absent(target: DataFrame, source: DataFrame, keys: tuple[str, ...] = ("machine_id", "ts")) -> DataFrame:
    """The rows of ``source`` without a match in ``target``: what an insert-only merge adds.

    A NULL key matches nothing, so such rows are always added.
    """
    return source.join(target.select(*keys), list(keys), "left_anti")


def merged(target: DataFrame, source: DataFrame, keys: tuple[str, ...] = ("machine_id", "ts")) -> DataFrame:
    """Target with the absent rows of source; existing rows stay as they are."""
    return target.unionByName(insert_absent(target, source, keys), allowMissingColumns=True)


def duplicate_count(df: DataFrame, keys: tuple[str, ...] = ("machine_id", "ts")) -> DataFrame:
    """(n_rows, n_keys, n_duplicates); NULL keys count as values."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def metadata_complete(df: DataFrame, columns: tuple[str, ...] = ("_topic", "_offset", "_ingest_ts")) -> DataFrame:
    """(n_rows, n_complete, complete): rows with all of the columns."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.agg(F.count("*").alias("n_rows"), F.count_if(whole).alias("n_complete")).withColumn("complete", F.col("n_rows") == F.col("n_complete"))
