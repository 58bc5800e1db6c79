"""Time splits and evaluation metrics of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.columns import us, with_row
from gaugeflow.functions.running import exact_quantiles, running_sums

NAN = float("nan")


def time_split(df: DataFrame, test_share: float = 0.2, time: str = "event_timestamp") -> tuple[DataFrame, DataFrame]:
    """(train, test): rows up to and after the quantile ``1 - test_share`` of the row times.

    The quantile is interpolated over rows. Rows without time are in neither.
    """
    at = us(time).cast("double")
    cutoff = exact_quantiles(df.select(at.alias("t")), (), "t", (1 - test_share,)).select(F.col("quantiles")[0].alias("c")).scalar()
    return df.where(at <= cutoff), df.where(at > cutoff)


def time_split3(df: DataFrame, test_share: float = 0.2, validation_share: float = 0.1, time: str = "event_timestamp") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, validation, test) in time order; the validation share is of all rows."""
    rest, test = time_split(df, test_share, time)
    train, validation = time_split(rest, validation_share / (1 - test_share), time)
    return train, validation, test


def _curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(s, pos, neg, pos_before, neg_before, p, n) per distinct score; rows with NULL label or score don't count."""
    y = F.col(label).cast("int")
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    totals = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n"))
    return with_row(running_sums(counts, (), "s", ("pos", "neg")), totals)


def ranking_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row (roc_auc, average_precision): NaN where only one class occurs; ties share a threshold.

    The area counts a tie as half; the average precision is the step sum over the distinct thresholds.
    """
    above_p, above_n = F.col("p") - F.col("pos_before"), F.col("n") - F.col("neg_before")
    both = _curve(df, label, score).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("wins"),
        F.sum(F.col("pos") * above_p / (above_p + above_n)).alias("steps"),
        F.max("p").alias("p"),
        F.max("n").alias("n"),
    )
    usable = (F.col("p") > 0) & (F.col("n") > 0)
    return both.select(F.when(usable, F.col("wins") / (F.col("p") * F.col("n"))).otherwise(F.lit(NAN)).alias("roc_auc"), F.when(usable, F.col("steps") / F.col("p")).otherwise(F.lit(NAN)).alias("average_precision"))


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row (n, positive_rate, precision, recall, f1) at an inclusive threshold; a division by zero gives 0."""
    y, hit = F.col(label).cast("boolean"), F.col(score) >= threshold
    c = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).agg(F.count("*").alias("n"), F.count_if(y).alias("p"), F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"))
    over = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    return c.select(
        "n",
        over("p", F.col("n")).alias("positive_rate"),
        over("tp", F.col("tp") + F.col("fp")).alias("precision"),
        over("tp", F.col("p")).alias("recall"),
        F.coalesce(2 * F.col("tp") / F.nullif(F.col("tp") + F.col("fp") + F.col("p"), F.lit(0)), F.lit(0.0)).alias("f1"),
    )


def precision_at_fraction(df: DataFrame, label: str, score: str, fraction: float, row_id: str) -> DataFrame:
    """One row (n_flagged, precision, recall) when the share ``fraction`` of highest scores is flagged.

    max(1, fraction * n) rows are flagged, halves rounded to even; ties at the last score go to the lower ``row_id``.
    Whole scores are counted first, and only the rows of the last score are ranked one by one.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s"), F.col(row_id).alias("id"))
    counts = rows.groupBy("s").agg(F.count("*").alias("m"), F.sum("y").alias("pos"))
    totals = counts.agg(F.sum("m").alias("n"), F.sum("pos").alias("p")).withColumn("k", F.greatest(F.lit(1), F.bround(F.lit(fraction) * F.col("n"), 0).cast("long")))
    ranked = with_row(running_sums(counts, (), "s", ("m", "pos")), totals)
    above = F.col("n") - F.col("m_before") - F.col("m")
    last = ranked.where((above < F.col("k")) & (above + F.col("m") >= F.col("k"))).select("s", "k", "n", "p", (F.col("k") - above).alias("need"), (F.col("p") - F.col("pos_before") - F.col("pos")).alias("won"))
    tied = running_sums(rows.join(F.broadcast(last.select("s")), "s").groupBy("id").agg(F.count("*").alias("m"), F.sum("y").alias("y")), (), "id", ("m",))
    extra = with_row(tied, last.select("need")).where(F.col("m_before") < F.col("need")).agg(F.sum("y").alias("more"))
    return with_row(last, extra).select(F.col("k").alias("n_flagged"), ((F.col("won") + F.coalesce("more", F.lit(0))) / F.col("k")).alias("precision"), F.coalesce((F.col("won") + F.coalesce("more", F.lit(0))) / F.nullif(F.col("p"), F.lit(0)), F.lit(0.0)).alias("recall"))


def regression_metrics(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """One row (n, rmse, mae, r2); r2 is NaN for a constant target, everything is NaN without rows."""
    e = F.col(target).cast("double") - F.col(predicted).cast("double")
    s = df.where(F.col(target).isNotNull() & F.col(predicted).isNotNull()).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(F.col(target).cast("double")).alias("var"))
    nan = F.lit(NAN)
    return s.select("n", F.coalesce(F.sqrt("mse"), nan).alias("rmse"), F.coalesce("mae", nan).alias("mae"), F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).otherwise(nan).alias("r2"))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """One row (weight): negatives per positive, at least 1; 1 without positives. NULL labels don't count."""
    y = F.col(label).cast("boolean")
    c = df.agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))
    return c.select(F.greatest(F.lit(1.0), F.coalesce(F.col("n") / F.nullif(F.col("p"), F.lit(0)), F.lit(1.0))).alias("weight"))


def fit_statistics(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, median, mean, std): exact medians for imputation, mean and population deviation for scaling.

    NULL and NaN don't count.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("x")).select("x.*").where(F.col("value").isNotNull() & ~F.isnan("value"))
    medians = exact_quantiles(long, ("feature",), "value", (0.5,)).select("feature", F.col("quantiles")[0].alias("median"))
    return medians.join(long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")), "feature")


def request_metrics(df: DataFrame, group: tuple[str, ...], latency: str, buckets: tuple[float, ...] = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)) -> DataFrame:
    """Counter and cumulative histogram per group: requests, latency_sum and le_<bucket> counts."""
    cells = [F.count_if(F.col(latency) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in buckets]
    return df.groupBy(*group).agg(F.count("*").alias("requests"), F.sum(latency).alias("latency_sum"), *cells)


def histogram_quantile(hist: DataFrame, q: float, buckets: tuple[float, ...] = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)) -> DataFrame:
    """Add ``quantile``: linear within the bucket that holds rank q * requests; the last bound beyond it; NULL without requests."""
    rank = F.lit(q) * F.col("requests")
    out = F.lit(float(buckets[-1]))
    for i in range(len(buckets) - 1, -1, -1):
        hi, low_bound = F.col(f"le_{str(buckets[i]).replace('.', '_')}"), (buckets[i - 1] if i else 0.0)
        lo = F.col(f"le_{str(buckets[i - 1]).replace('.', '_')}") if i else F.lit(0)
        out = F.when(hi >= rank, F.lit(low_bound) + (buckets[i] - low_bound) * F.coalesce((rank - lo) / F.nullif(hi - lo, F.lit(0)), F.lit(1.0))).otherwise(out)
    return hist.withColumn("quantile", F.when(F.col("requests") > 0, out))


def request_rates(df: DataFrame, time: str, group: tuple[str, ...], failed: Column, window_us: int = 300_000_000) -> DataFrame:
    """(group, window_start_us, requests, rate, errors, error_rate): counts of each window and their number per second.

    Rows with NULL time are left out; a window without requests has no row.
    """
    start = F.floor(us(time) / window_us).cast("long") * window_us
    counts = df.where(F.col(time).isNotNull()).groupBy(*group, start.alias("window_start_us")).agg(F.count("*").alias("requests"), F.count_if(failed).alias("errors"))
    per_second = lambda c: F.col(c) / F.lit(window_us / 1e6)
    return counts.select(*group, "window_start_us", "requests", per_second("requests").alias("rate"), "errors", per_second("errors").alias("error_rate"))
