"""Rolling totals over trailing periods, idle days included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Exact running sums: decimals don't drift as amounts are added and taken away again.
EXACT = "decimal(28,8)"


def daily_activity(gold: DataFrame) -> DataFrame:
    """One row per machine and day of the '24h' windows: active, errors, sums and counts of the two metrics.

    The day is the one before the date of window_end. Exact repetitions of a row count once; windows that differ on the
    same day add up. A day is active if a window of record_count > 0 covers it; only such windows contribute.
    """
    rows = gold.where((F.col("window_duration") == "24h") & F.col("machine_id").isNotNull() & F.col("window_end").isNotNull()).distinct()
    live = F.coalesce(F.col("record_count") > 0, F.lit(False))

    def exact(name: str):
        x = F.col(name)
        return F.when(live & x.isNotNull() & ~F.isnan(x), x.cast(EXACT))

    return (
        rows.withColumn("day", F.date_sub(F.to_date("window_end"), 1))
        .groupBy("machine_id", "day")
        .agg(
            F.max(live.cast("int")).alias("active"),
            F.sum(F.when(live, F.col("error_count"))).alias("errors"),
            F.sum(exact("vibration_mean")).cast(EXACT).alias("vib_sum"),
            F.count(exact("vibration_mean")).alias("vib_n"),
            F.sum(exact("motor_temp_mean")).cast(EXACT).alias("temp_sum"),
            F.count(exact("motor_temp_mean")).alias("temp_n"),
        )
    )


def rolling_totals(gold: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One row per machine and day from its first to its last active day, idle days included.

    Each daily amount is written as two deltas, added on its day and taken away after the length of the period; the
    running sum of the deltas is the total; a day is idle where the total of active days over one day is 0. Amounts are decimals and longs, so nothing drifts. A machine of any number
    of rows is first folded to one row per day with map-side combine.

    Result: machine_id, activity_day (string), is_idle, and for each period p: error_count_<p>d, active_days_<p>d,
    vibration_mean_<p>d, motor_temp_mean_<p>d (averages over the active days with a value; NULL if there is none).

    Defined cases: NULL machine or window_end is left out; NULL or NaN metrics don't enter the averages; NULL
    error_count counts 0; record_count of 0 or NULL makes no active day; a machine without active day has no rows.
    """
    daily = daily_activity(gold)
    amounts = ["active", "errors", "vib_sum", "vib_n", "temp_sum", "temp_n"]
    live = daily.where(F.col("active") == 1).select("machine_id", "day", *[F.coalesce(F.col(a), F.lit(0).cast(dict(daily.dtypes)[a])).alias(a) for a in amounts])
    span = live.groupBy("machine_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select("machine_id", F.explode(F.sequence("lo", "hi")).alias("day"))

    # The total of one day tells idle days; it needs the activity alone.
    sums = [("active", 1), *[(a, p) for p in periods for a in amounts if (a, p) != ("active", 1)]]
    kinds = dict(live.dtypes)

    def deltas(shift: int):
        """What is added on a day, or taken away ``shift`` days after it."""
        signed = [(F.col(a) if not shift else -F.col(a) if p == shift else F.lit(0)).cast(kinds[a]).alias(f"{a}_{p}") for a, p in sums]
        return F.struct(F.date_add("day", shift).alias("day"), *signed)

    events = live.select("machine_id", F.explode(F.array(*[deltas(shift) for shift in (0, *sorted({1, *periods}))])).alias("e")).select("machine_id", "e.*")
    folded = events.groupBy("machine_id", "day").agg(*[F.sum(f"{a}_{p}").alias(f"{a}_{p}") for a, p in sums])
    running = Window.partitionBy("machine_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda a, p: F.sum(F.coalesce(F.col(f"{a}_{p}"), F.lit(0))).over(running)
    summed = days.join(folded, ["machine_id", "day"], "left").select("machine_id", "day", *[total(a, p).alias(f"{a}_{p}") for a, p in sums]).withColumn("is_idle", F.col("active_1") == 0)
    mean = lambda s, n, p: F.when(F.col(f"{n}_{p}") > 0, F.col(f"{s}_{p}").cast("double") / F.col(f"{n}_{p}"))
    out = [F.col("machine_id"), F.date_format("day", "yyyy-MM-dd").alias("activity_day"), F.col("is_idle")]
    for p in periods:
        out += [
            F.col(f"errors_{p}").cast("long").alias(f"error_count_{p}d"),
            F.col(f"active_{p}").cast("long").alias(f"active_days_{p}d"),
            mean("vib_sum", "vib_n", p).alias(f"vibration_mean_{p}d"),
            mean("temp_sum", "temp_n", p).alias(f"motor_temp_mean_{p}d"),
        ]
    return summed.select(*out)


def idle_days(totals: DataFrame) -> DataFrame:
    """The days that had to be added: those with a one-day total of no activity."""
    return totals.where("is_idle").select("machine_id", "activity_day")
