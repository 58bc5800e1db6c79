"""Distribution drift between two frames, all features at once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.columns import finite
from gaugeflow.functions.running import LEVELS, levels_for, running_sums
from gaugeflow.schema import NOT_FEATURES
from gaugeflow.session import spill
from gaugeflow.sources.files import json_summary, replace_table

PSI_LIMIT, SHARE_LIMIT, FLOOR, BINS = 0.2, 0.5, 1e-6, 10


def shared_features(reference: DataFrame, current: DataFrame, exclude: tuple[str, ...] = NOT_FEATURES) -> list[str]:
    """Numeric, non-boolean columns of the reference that the current frame has too, in the reference's order."""
    return [f.name for f in reference.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude and f.name in current.columns]


def _values(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, ref, cur): how often each finite value occurs on either side."""
    cells = lambda df, side: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("x"), F.lit(side).alias("cur")).select("x.*", "cur")
    both = cells(reference, 0).unionByName(cells(current, 1)).where(finite("value"))
    return both.groupBy("feature", "value").agg(F.count_if(F.col("cur") == 0).alias("ref"), F.count_if(F.col("cur") == 1).alias("now"))


def psi(values: DataFrame, bins: int = BINS, levels: int = LEVELS) -> DataFrame:
    """(feature, psi) over quantile bins of the reference.

    Edges are the distinct quantiles i / bins; bins hold [a, b) and the outer ones everything beyond. Shares are floored
    at FLOOR. Fewer than two distinct edges, or an empty side, give 0.
    """
    edges = _weighted_quantiles(values.where("ref > 0"), bins, levels)
    totals = values.groupBy("feature").agg(F.sum("ref").alias("n_ref"), F.sum("now").alias("n_now"))
    placed = values.join(F.broadcast(edges), "feature").withColumn("bin", F.size(F.filter("inner", lambda e: e <= F.col("value"))))
    counts = placed.groupBy("feature", "bin").agg(F.sum("ref").alias("r"), F.sum("now").alias("c"), F.max("n_edges").alias("n_edges")).join(F.broadcast(totals), "feature")
    share = lambda part, whole: F.greatest(F.col(part) / F.greatest(F.col(whole), F.lit(1)), F.lit(FLOOR))
    term = (share("c", "n_now") - share("r", "n_ref")) * F.log(share("c", "n_now") / share("r", "n_ref"))
    usable = (F.col("n_edges") >= 2) & (F.col("n_ref") > 0) & (F.col("n_now") > 0)
    scored = counts.groupBy("feature").agg(F.sum(F.when(usable, term).otherwise(0.0)).alias("psi"))
    return totals.select("feature").join(scored, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def _weighted_quantiles(values: DataFrame, bins: int, levels: int) -> DataFrame:
    """(feature, inner, n_edges): the inner distinct quantile edges of counted values."""
    ranked = running_sums(values.select("feature", "value", F.col("ref").alias("n")), ("feature",), "value", ("n",), levels)
    size = values.groupBy("feature").agg(F.sum("ref").alias("total"))
    place = lambda i: F.lit(i / bins) * (F.col("total") - 1)
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"), (F.floor(place(i)) if s == 0 else F.ceil(place(i))).cast("long").alias("r"), (place(i) - F.floor(place(i))).alias("w")) for i in range(bins + 1) for s in (0, 1)])
    hits = ranked.join(F.broadcast(size.select("feature", ranks.alias("ranks"))), "feature").select("feature", "value", F.explode(F.filter("ranks", lambda x: (x["r"] >= F.col("n_before")) & (x["r"] < F.col("n_before") + F.col("n")))).alias("x"))
    ends = hits.groupBy("feature", F.col("x.i").alias("i")).agg(F.max(F.when(F.col("x.s") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("x.s") == 1, F.col("value"))).alias("b"), F.max("x.w").alias("w"))
    edges = ends.groupBy("feature").agg(F.array_sort(F.collect_set(F.col("a") + (F.col("b") - F.col("a")) * F.col("w"))).alias("edges"))
    n = F.size("edges")
    return edges.select("feature", F.when(n > 2, F.slice("edges", F.lit(2), n - 2)).otherwise(F.expr("array()").cast("array<double>")).alias("inner"), n.alias("n_edges"))


def ks(values: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(feature, ks): the largest gap between the empirical distribution functions; 0 if a side is empty.

    Values are counted first, so ties fall on one step; the running sums are cut into ranges and no task sees a whole
    feature.
    """
    totals = values.groupBy("feature").agg(F.sum("ref").alias("n_ref"), F.sum("now").alias("n_now"))
    steps = running_sums(values, ("feature",), "value", ("ref", "now"), levels).join(F.broadcast(totals), "feature")
    gap = F.abs((F.col("ref_before") + F.col("ref")) / F.greatest("n_ref", F.lit(1)) - (F.col("now_before") + F.col("now")) / F.greatest("n_now", F.lit(1)))
    usable = (F.col("n_ref") > 0) & (F.col("n_now") > 0)
    return steps.groupBy("feature").agg(F.max(F.when(usable, gap).otherwise(0.0)).alias("ks"))


def drift_report(reference: DataFrame, current: DataFrame, features: list[str] | None = None, limit: float = PSI_LIMIT) -> DataFrame:
    """(feature, psi, ks, drifted) for each shared feature; drifted: psi above the limit. A feature without any finite value scores 0."""
    names = features or shared_features(reference, current)
    # Read by both measures several times over; the number of ranges follows the number of counted values.
    values = spill(_values(reference, current, names), "drift")
    levels = levels_for(values.count() // max(1, len(names)))
    every = reference.sparkSession.createDataFrame([(n,) for n in names], "feature string")
    return (
        every.join(psi(values, levels=levels), "feature", "left")
        .join(ks(values, levels), "feature", "left")
        .select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"), F.coalesce("ks", F.lit(0.0)).alias("ks"))
        .withColumn("drifted", F.col("psi") > limit)
    )


def drift_summary(report: DataFrame, limit: float = SHARE_LIMIT) -> DataFrame:
    """(n_features, n_drifted, drift_share, dataset_drift); a share of exactly the limit is no drift."""
    return report.agg(F.count("*").alias("n_features"), F.count_if("drifted").alias("n_drifted")).withColumn("drift_share", F.coalesce(F.col("n_drifted") / F.nullif(F.col("n_features"), F.lit(0)), F.lit(0.0))).withColumn("dataset_drift", F.col("drift_share") > limit)


def freeze_reference(features: DataFrame, path: str) -> None:
    """Keep the features of today as what later ones are compared with."""
    replace_table(features, path)


def drift_check(reference: DataFrame, current: DataFrame, summary_path: str | None = None) -> tuple[DataFrame, int]:
    """(report, exit status): 1 if the dataset has drifted, else 0; the summary is also written as JSON."""
    report = drift_report(reference, current)
    summary = drift_summary(report)
    drifted = json.loads(json_summary(summary, summary_path)).get("dataset_drift")
    return report, int(bool(drifted))
