"""As-of joins, the latest-value table and its comparison with history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.columns import us
from gaugeflow.operators.hotkeys import TARGET_ROWS
from gaugeflow.operators.pit import known_versions

DAY_US = 86_400_000_000


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str = "machine_id",
    left_time: str = "event_timestamp",
    right_time: str = "event_timestamp",
    left_cols: tuple[str, ...] = (),
    right_cols: tuple[str, ...] = (),
    right_id: str = "feature_id",
    tie: str | None = None,
    ttl_us: int | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    Unmatched left rows stay with NULLs. Ties in time go to the later ``tie`` value, then to the higher ``right_id``. With
    ``ttl_us`` a match older than that becomes NULL. Entities with very many rows are cut into slices of time with a
    carried-in row, so the result is the same and no task holds a whole hot entity.
    """
    return known_versions(left, right, key, left_time, right_time, tie, right_id, left_cols, right_cols, ttl_us, target_rows, only_known=False)


def online_latest(features: DataFrame, days: int | None = 30, key: str = "machine_id", time: str = "event_timestamp", order: tuple[str, ...] = ("created_timestamp", "feature_id")) -> DataFrame:
    """The latest row per key within the last ``days`` of the table: the online table.

    An aggregation with map-side combine; rows with NULL key or time never enter. Ties go to ``order``.
    """
    rows = features.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    if days is not None:
        newest = rows.agg(F.max(us(time)).alias("newest")).select("newest").scalar()
        rows = rows.where(us(time) >= newest - days * DAY_US)
    rest = [c for c in features.columns if c not in (key, time, *order)]
    best = F.max(F.struct(time, *[F.col(c) for c in (*order, *rest)])).alias("_b")
    return rows.groupBy(key).agg(best).select(*[F.col(key) if c == key else F.col(f"_b.{c}").alias(c) for c in features.columns])


def online_lookup(entities: DataFrame, online: DataFrame, columns: tuple[str, ...], key: str = "machine_id") -> DataFrame:
    """Entity rows with columns of the online table; unknown entities get NULLs."""
    return entities.join(online.select(key, *columns), key, "left")


def parity(historical: DataFrame, online: DataFrame, columns: tuple[str, ...], key: str = "machine_id") -> DataFrame:
    """(key, feature, historical, online, equal) for each entity and column; NULL equals NULL."""
    h, o = historical.select(key, F.struct(*columns).alias("h")), online.select(key, F.struct(*columns).alias("o"))
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"h.{c}").cast("double").alias("historical"), F.col(f"o.{c}").cast("double").alias("online")) for c in columns]
    return h.join(o, key, "full").select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*").withColumn("equal", F.col("historical").eqNullSafe(F.col("online")))
