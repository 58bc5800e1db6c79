"""Joins of facts with dimensions that change and with labels that come late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.columns import us
from gaugeflow.operators.asof import asof_join


def valid_at(facts: DataFrame, dimension: DataFrame, key: str, time: str, version_id: str, columns: tuple[str, ...] = (), fact_cols: tuple[str, ...] = (), valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Each fact with the version of its dimension row that was valid at its time (a slowly changing dimension).

    A version is valid from ``valid_from`` on and before ``valid_to`` (NULL: until further notice). As versions of a key
    don't overlap, the last one to begin is the only candidate, so this is an as-of join and no join of ranges. Facts
    without a valid version keep NULLs; NULL keys and times match nothing; of versions that begin together the higher
    ``version_id`` counts.

    Result: key, fact_cols, asof_time, version_id and columns (prefixed ``v_``).
    """
    joined = asof_join(facts, dimension, key, time, valid_from, fact_cols, (*columns, valid_to), version_id)
    over = us("asof_time") >= us(f"v_{valid_to}")
    live = F.coalesce(~over, F.lit(True))
    return joined.select(key, *fact_cols, "asof_time", F.when(live, F.col(version_id)).alias(version_id), *[F.when(live, F.col(f"v_{c}")).alias(f"v_{c}") for c in columns])


def label_within(history: DataFrame, labels: DataFrame, horizon_us: int, row_id: str, key: str = "machine_id", time: str = "event_timestamp", label_time: str = "event_timestamp") -> DataFrame:
    """(row_id, label, label_us): whether an event of the entity follows within the horizon, the event at its end included.

    Labels that arrive long after the rows they concern are attached by the time of the event. Found as the next event
    after the row: an as-of join on reversed time. An event at the very time of the row counts as following. Rows with
    NULL key or time get label NULL; a NULL key or time of an event matches nothing.
    """
    turned = lambda df, c, *more: df.select(key, F.timestamp_micros(-us(c)).alias("_t"), *more)
    events = turned(labels.where(F.col(key).isNotNull() & F.col(label_time).isNotNull()), label_time).distinct().withColumn("_id", -F.unix_micros("_t"))
    rows = asof_join(turned(history, time, row_id), events, key, "_t", "_t", (row_id,), (), "_id", ttl_us=horizon_us)
    return rows.select(row_id, F.when(F.col(key).isNotNull() & F.col("asof_time").isNotNull(), F.col("_id").isNotNull()).alias("label"), F.col("_id").alias("label_us"))
