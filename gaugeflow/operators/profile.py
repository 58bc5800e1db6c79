"""Column-level data quality profile of loads and what is wrong with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.session import spill

NUMBERS, TEXTS = ("lat", "speed", "battery_soh"), ("machine_id",)
GRID = 64
#: Limits of the findings; see findings().
NULL_EXTRA, NULL_TIMES = 0.05, 4.0
SHIFT, FORM_SHIFT, HEAP = 0.12, 0.3, 0.1
#: A gap between distributions of n values that chance hardly ever makes is CHANCE / sqrt(n).
CHANCE = 2.2
PLAIN_SHARE = 0.99
#: Heads of numbers: so many to the middle half of a column's usual values, and no more than HEADS to either side.
RESOLUTION, HEADS = 48, 2_000

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def mask(value: Column) -> Column:
    """Character classes of a value: A, a and 9 for ASCII letters and digits, every other character itself."""
    return F.translate(value, _UPPER + _LOWER + _DIGIT, "A" * 26 + "a" * 26 + "9" * 10)


def form(value: Column) -> Column:
    """The mask with runs of a class collapsed, so that values of one form and different length are alike."""
    return F.regexp_replace(mask(value), "([Aa9])\\1+", "$1+")


def _long(silver: DataFrame, rules: DataFrame) -> DataFrame:
    """(load_id, column_name, num, txt, bad): one row per reading and profiled column; bad: outside the rule's range."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.when(~F.isnan(c), F.col(c).cast("double")).alias("num"), F.lit(None).cast("string").alias("txt")) for c in NUMBERS]
    cells += [F.struct(F.lit(c).alias("column_name"), F.lit(None).cast("double").alias("num"), F.col(c).cast("string").alias("txt")) for c in TEXTS]
    return silver.select("load_id", F.explode(F.array(*cells)).alias("x")).select("load_id", "x.*").join(F.broadcast(_ranges(rules)), "column_name", "left").withColumn(
        "bad", F.coalesce((F.col("num") < F.col("min_value")) | (F.col("num") > F.col("max_value")), F.lit(False))
    )


def _ranges(rules: DataFrame) -> DataFrame:
    """The range of each profiled column: at most one row each, as only the profiled names are taken."""
    return rules.where(F.col("column_name").isin(*NUMBERS, *TEXTS)).groupBy("column_name").agg(F.max("min_value").alias("min_value"), F.min("max_value").alias("max_value"))


def mask_counts(silver: DataFrame, rules: DataFrame, places: DataFrame) -> DataFrame:
    """(load_id, column_name, form, head, n): how often each mask occurs among the non-missing values within range.

    A text is generalised to its character classes (mask). A number keeps its leading digits and the rest is
    generalised: head is the number of steps it lies from the column's usual middle, form its collapsed mask. ``places``
    has the middle and the step of each column, one row each. Heads are bounded, so a load has at most some thousand masks
    of numbers however many values it has, and counts are combined on the map side.
    """
    cells = _long(silver, rules).where(~F.col("bad") & (F.col("num").isNotNull() | F.col("txt").isNotNull())).join(F.broadcast(places), "column_name", "left")
    steps = F.greatest(F.least(F.floor((F.col("num") - F.col("middle")) / F.col("step")), F.lit(HEADS)), F.lit(-HEADS))
    shape = F.coalesce(mask(F.col("txt")), form(F.col("num").cast("string")))
    return cells.groupBy("load_id", "column_name", shape.alias("form"), steps.alias("head")).agg(F.count("*").alias("n"))


def profile(silver: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per load and column: rows, missing, null_rate, n_distinct, low, high, out_of_range, quantiles.

    One pass with map-side combine; sketches (HyperLogLog, quantile summaries) have a fixed size, so a load of any number
    of rows is no burden. Missing is NULL or NaN. The quantiles are of the values within range.
    """
    ok = F.when(~F.col("bad"), F.col("num"))
    steps = [i / GRID for i in range(1, GRID)]
    return (
        _long(silver, rules)
        .groupBy("load_id", "column_name")
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if(F.col("num").isNull() & F.col("txt").isNull()).alias("n_missing"),
            F.approx_count_distinct(F.coalesce(F.col("txt"), F.col("num").cast("string")), 0.02).alias("n_distinct"),
            F.min("num").alias("low"),
            F.max("num").alias("high"),
            F.count_if("bad").alias("out_of_range"),
            F.percentile_approx(ok, steps, 2_000).alias("quantiles"),
        )
        .withColumn("null_rate", F.col("n_missing") / F.col("n_rows"))
    )


def head_places(prof: DataFrame) -> DataFrame:
    """(column_name, middle, step): where the heads of a column's numbers are counted from and how wide they are.

    Both from the medians over the loads of the quartiles; a column without spread there takes that of its outer eighths,
    or one step of any size.
    """
    at = lambda k: F.percentile_approx(F.col("quantiles")[GRID * k // 16 - 1], 0.5)
    usual = prof.where(F.size("quantiles") == GRID - 1).groupBy("column_name").agg(*[at(k).alias(f"q{k}") for k in (2, 4, 8, 12, 14)])
    spread = F.coalesce(F.nullif(F.col("q12") - F.col("q4"), F.lit(0.0)), F.nullif(F.col("q14") - F.col("q2"), F.lit(0.0)), F.greatest(F.abs("q8") * 1e-6, F.lit(1e-9)))
    return usual.select("column_name", F.col("q8").alias("middle"), (spread / RESOLUTION).alias("step"))


def plain_forms(masks: DataFrame) -> DataFrame:
    """(column_name, form, all_share, plain): the share of each form over all loads, and whether it is regular.

    Of the forms that together cover PLAIN_SHARE of a column's values, most frequent first, those that occur in more than
    half of the loads are regular. Forms of equal frequency rank together, so the ranking sees one row per frequency and
    column, and there are fewer of those than the root of twice the number of values.
    """
    per_load = masks.groupBy("load_id", "column_name", "form").agg(F.sum("n").alias("n"))
    totals = per_load.groupBy("column_name", "form").agg(F.sum("n").alias("all_n"), F.count("*").alias("in_loads"))
    whole = per_load.groupBy("column_name").agg(F.sum("n").alias("col_n"), F.count_distinct("load_id").alias("loads"))
    ranks = totals.groupBy("column_name", "all_n").agg(F.sum("all_n").alias("mass"))
    rank = Window.partitionBy("column_name").orderBy(F.desc("all_n")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranks.select("column_name", "all_n", F.coalesce(F.sum("mass").over(rank), F.lit(0)).alias("before"))
    placed = totals.join(ranks, ["column_name", "all_n"]).join(whole, "column_name")
    return placed.select("column_name", "form", (F.col("all_n") / F.col("col_n")).alias("all_share"), ((F.col("before") < PLAIN_SHARE * F.col("col_n")) & (2 * F.col("in_loads") > F.col("loads"))).alias("plain"))


def form_divergence(masks: DataFrame) -> DataFrame:
    """(load_id, column_name, rare_masks, form_shift): values of irregular form, and total variation from all loads."""
    per_load = masks.groupBy("load_id", "column_name", "form").agg(F.sum("n").alias("n"))
    load_n = masks.groupBy("load_id", "column_name").agg(F.sum("n").alias("load_n"))
    shares = per_load.join(plain_forms(masks), ["column_name", "form"]).join(load_n, ["load_id", "column_name"])
    return shares.groupBy("load_id", "column_name").agg(
        F.sum(F.when(~F.col("plain"), F.col("n")).otherwise(0)).alias("rare_masks"),
        F.sum(F.greatest(F.col("n") / F.col("load_n") - F.col("all_share"), F.lit(0.0))).alias("form_shift"),
    )


def head_divergence(masks: DataFrame) -> DataFrame:
    """(load_id, column_name, mask_shift, heap): how far the masks of a load's numbers lie from those of most loads.

    The usual distribution over heads is the median over the loads of the share at or below each head (loads that lack a
    head have the share of the next lower one). mask_shift is the largest gap to it; heap the largest share a single head
    has beyond its usual one. Tables here have a row per load, column and head, bounded by HEADS.
    """
    heads = masks.where(F.col("head").isNotNull()).groupBy("load_id", "column_name", "head").agg(F.sum("n").alias("n"))
    size = heads.groupBy("load_id", "column_name").agg(F.sum("n").alias("load_n"))
    every = heads.select("column_name", "head").distinct()
    grid = size.join(every, "column_name").join(heads, ["load_id", "column_name", "head"], "left")
    below = Window.partitionBy("load_id", "column_name").orderBy("head").rowsBetween(Window.unboundedPreceding, 0)
    shares = grid.select("load_id", "column_name", "head", (F.coalesce("n", F.lit(0)) / F.col("load_n")).alias("own"), (F.sum(F.coalesce("n", F.lit(0))).over(below) / F.col("load_n")).alias("upto"))
    usual = shares.groupBy("column_name", "head").agg(F.percentile("upto", 0.5).alias("usual_upto"), F.percentile("own", 0.5).alias("usual_own"))
    gaps = shares.join(usual, ["column_name", "head"])
    return gaps.groupBy("load_id", "column_name").agg(F.max(F.abs(F.col("upto") - F.col("usual_upto"))).alias("mask_shift"), F.max(F.col("own") - F.col("usual_own")).alias("heap"))


def profile_report(silver: DataFrame, rules: DataFrame) -> DataFrame:
    """The profile with its comparison to the other loads.

    Adds usual_null_rate (median over the loads), rare_masks (values of a form that is not regular for the column),
    form_shift, mask_shift and heap (see form_divergence and head_divergence).
    """
    # Both are read several times below and are as small as loads times columns (times masks).
    prof = spill(profile(silver, rules), "profile")
    usual = prof.groupBy("column_name").agg(F.percentile_approx("null_rate", 0.5).alias("usual_null_rate"))
    masks = spill(mask_counts(silver, rules, head_places(prof)), "masks")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return (
        prof.join(F.broadcast(usual), "column_name")
        .join(form_divergence(masks), ["load_id", "column_name"], "left")
        .join(head_divergence(masks), ["load_id", "column_name"], "left")
        .select("load_id", "column_name", "n_rows", "n_missing", "null_rate", "usual_null_rate", "n_distinct", "low", "high", "out_of_range", F.coalesce("rare_masks", F.lit(0)).alias("rare_masks"), zero("form_shift"), zero("mask_shift"), zero("heap"))
    )


def findings(report: DataFrame) -> DataFrame:
    """(load_id, column_name, finding) from the report.

    null_rate: above NULL_TIMES the usual rate plus NULL_EXTRA. range: a value outside the rule. pattern (texts): a value
    of a rare mask. distribution (numbers): the masks of the load lie apart from those of most loads: mask_shift above
    SHIFT, and above what chance makes of a load of its size; heap above HEAP and chance (many values under one head); or
    form_shift above FORM_SHIFT.

    Defined cases: a load without a usable value of a column has no shift; an empty table gives no findings.
    """
    number = F.col("column_name").isin(*NUMBERS)
    chance = F.lit(CHANCE) / F.sqrt(F.greatest(F.col("n_rows") - F.col("n_missing"), F.lit(1)))
    tests = {
        "null_rate": F.col("null_rate") > NULL_TIMES * F.col("usual_null_rate") + NULL_EXTRA,
        "range": number & (F.col("out_of_range") > 0),
        "pattern": F.col("column_name").isin(*TEXTS) & (F.col("rare_masks") > 0),
        "distribution": number & ((F.col("mask_shift") > F.greatest(F.lit(SHIFT), chance)) | (F.col("heap") > F.greatest(F.lit(HEAP), chance)) | (F.col("form_shift") > F.greatest(F.lit(FORM_SHIFT), 2 * chance))),
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))
    return report.where(reduce(lambda a, b: a | b, tests.values())).select("load_id", "column_name", F.explode(found).alias("finding"))
