"""Running sums and exact quantiles over values of any number, without a window over a whole group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges a group is cut into where nothing is known of its size, and values a range should hold where something is.
LEVELS, RANGE_VALUES = 1_024, 500_000


def levels_for(values: int) -> int:
    """How many ranges that number of values should be cut into."""
    return min(65_536, max(64, values // RANGE_VALUES))


def running_sums(df: DataFrame, group: tuple[str, ...], order: str, sums: tuple[str, ...], levels: int = LEVELS) -> DataFrame:
    """Add <s>_before for each of ``sums``: the sum over the rows of the group with a lower ``order``.

    ``df`` has one row per group and value of ``order``. Values are cut into about ``levels`` ranges at approximate
    quantiles, found in two steps of the root of that many comparisons; the totals of the ranges are summed first (a table
    of one row per range and group), then each range on its own, so that a group of any size is spread over many tasks.
    """
    keys = list(group) or ["_all"]
    if not group:
        df = df.withColumn("_all", F.lit(0))
    side = max(2, math.isqrt(levels - 1) + 1)
    steps = [i / side**2 for i in range(1, side**2)]
    edges = df.groupBy(*keys).agg(F.percentile_approx(F.col(order).cast("double"), steps, max(10_000, 4 * side**2)).alias("_edges"))
    edges = edges.withColumn("_coarse", F.filter("_edges", lambda _, i: (i + 1) % side == 0))
    below = lambda e: F.size(F.filter(e, lambda x: x < F.col(order)))
    cut = df.join(F.broadcast(edges), keys).withColumn("_c", below(F.col("_coarse")))
    cut = cut.withColumn("_part", F.col("_c") * side + below(F.slice("_edges", F.col("_c") * side + 1, F.lit(side - 1)))).drop("_edges", "_coarse", "_c")
    totals = cut.groupBy(*keys, "_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_p_{s}") for s in sums])
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(prefix, [*keys, "_part"])
    out = out.withColumns({f"{s}_before": F.col(f"_p_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    return out.drop("_part", "_all", *[f"_p_{s}" for s in sums])


def exact_quantiles(df: DataFrame, group: tuple[str, ...], value: str, probabilities: tuple[float, ...]) -> DataFrame:
    """(group, quantiles): exact, linearly interpolated quantiles of the non-NULL values, one array per group.

    The quantile p of n values lies at the place p * (n - 1) of the sorted values. Values are counted before they are
    ranked, so ties cost nothing.
    """
    keys = list(group) or ["_g"]
    rows = (df if group else df.withColumn("_g", F.lit(0))).where(F.col(value).isNotNull())
    counts = rows.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranked = running_sums(counts, tuple(keys), "v", ("n",))
    size = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    place = lambda p: F.lit(float(p)) * (F.col("total") - 1)
    wanted = size.select(*keys, F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), (F.floor(place(p)) if side == 0 else F.ceil(place(p))).cast("long").alias("r"), (place(p) - F.floor(place(p))).alias("w")) for i, p in enumerate(probabilities) for side in (0, 1)]).alias("ranks"))
    hits = ranked.join(F.broadcast(wanted), keys).select(*keys, "v", F.explode(F.filter("ranks", lambda x: (x["r"] >= F.col("n_before")) & (x["r"] < F.col("n_before") + F.col("n")))).alias("x"))
    ends = hits.groupBy(*keys, F.col("x.i").alias("i")).agg(F.max(F.when(F.col("x.side") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("x.side") == 1, F.col("v"))).alias("b"), F.max("x.w").alias("w"))
    each = ends.select(*keys, "i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("q"))
    out = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("quantiles"))
    return out if group else out.drop("_g")
