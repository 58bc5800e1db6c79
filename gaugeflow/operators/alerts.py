"""Anomaly alerts: alignment to a model, threshold, best candidate per machine and cooldown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.columns import seconds_of, us

THRESHOLD, COOLDOWN = 0.5, "2 minutes"


def align(df: DataFrame, features: list[str], fill: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the model's features in its order, after the ``keep`` columns.

    Missing features become NULL, or ``fill``; further columns are dropped. With a fill, NULL values are filled too.
    """
    def one(c: str) -> Column:
        got = F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
        return (got if fill is None else F.coalesce(got, F.lit(float(fill)))).alias(c)

    return df.select(*keep, *[one(c) for c in features])


def align_map(df: DataFrame, column: str, features: list[str], fill: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Features from a map column; missing ones get ``fill``, further ones are dropped. Empty or NULL maps give no row."""
    rows = df.where(F.coalesce(F.size(column), F.lit(0)) > 0)
    return rows.select(*keep, *[F.coalesce(F.try_element_at(column, F.lit(c)).cast("double"), F.lit(float(fill))).alias(c) for c in features])


def above_threshold(scored: DataFrame, threshold: float = THRESHOLD, score: str = "anomaly_score") -> DataFrame:
    """Rows with a machine whose score reaches the threshold (inclusive)."""
    return scored.where(F.col("machine_id").isNotNull() & (F.col(score) >= threshold))


def best_per_machine(alerts: DataFrame, score: str = "anomaly_score", time: str = "event_timestamp") -> DataFrame:
    """One candidate per machine: the highest score, of equal ones the earliest."""
    rest = [c for c in alerts.columns if c != "machine_id"]
    best = F.max(F.struct(F.col(score).alias("_s"), (-us(time)).alias("_t"), F.struct(*rest).alias("_r"))).alias("b")
    return alerts.groupBy("machine_id").agg(best).select("machine_id", *[F.col(f"b._r.{c}").alias(c) for c in rest])


def throttle(alerts: DataFrame, prior: DataFrame | None, cooldown: str = COOLDOWN, score: str = "anomaly_score", time: str = "event_timestamp") -> DataFrame:
    """The best candidate per machine unless its last alert is less than the cooldown before it.

    A machine's own last alert counts, however old others are; one later than the candidate suppresses it too. The prior
    alerts are reduced to one row per machine before the join, which Spark broadcasts only where it is small.
    """
    top = best_per_machine(alerts, score, time)
    if prior is None:
        return top
    last = prior.where(F.col("machine_id").isNotNull()).groupBy("machine_id").agg(F.max(us(time)).alias("_last"))
    waited = us(time) - F.col("_last")
    return top.join(last, "machine_id", "left").where(F.col("_last").isNull() | (waited >= int(seconds_of(cooldown) * 1_000_000))).drop("_last")


@dataclass(frozen=True)
class ModelTag:
    """Which model an alert comes from."""

    name: str = "zscore"
    alias: str = "champion"
    version: str = "1"


#: The columns of a stored alert, in order; alert_emitted_ts follows.
ALERT_COLUMNS = ("machine_id", "event_timestamp", "anomaly_score", "alert_threshold", "model_name", "model_alias", "model_version", "event", "error_code", "_topic", "_partition", "_offset")


def alert_rows(scored: DataFrame, model: ModelTag, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that reach the threshold in the layout of alerts, with the model and the lineage of the message.

    ``scored`` has anomaly_score and the parsed record; what it lacks is NULL, further columns are dropped.
    """
    known = {"event_timestamp": F.col("ts"), "anomaly_score": F.col("anomaly_score").cast("double"), "alert_threshold": F.lit(float(threshold)), "model_name": F.lit(model.name), "model_alias": F.lit(model.alias), "model_version": F.lit(model.version)}
    types = {"event": "string", "error_code": "int", "_topic": "string", "_partition": "int", "_offset": "long"}

    def column(c: str) -> Column:
        if c in known:
            return known[c].alias(c)
        return F.col(c) if c in scored.columns else F.lit(None).cast(types[c]).alias(c)

    return above_threshold(scored, threshold).select(*[column(c) for c in ALERT_COLUMNS])


def last_alerts(alerts: DataFrame, before: DataFrame | None, time: str = "event_timestamp") -> DataFrame:
    """(machine_id, event_timestamp): the latest alert of each machine, from new alerts and the same table before."""
    new = alerts.select("machine_id", time)
    both = new if before is None else new.unionByName(before)
    return both.where(F.col("machine_id").isNotNull()).groupBy("machine_id").agg(F.max(time).alias(time))
