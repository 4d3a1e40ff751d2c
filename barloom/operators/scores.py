"""Statistics of a score table (y in 0/1, p in 0..1): discrimination, calibration, drift, thresholds, stability.

Scores are grouped by value before anything is ordered, so cumulative tables have one row per distinct score. They are summed in two levels
of range buckets, not in one window over all scores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.plans.blocks import previous, running, runnings
from barloom.plans.quantiles import quantile_values

TINY = 1e-6
Z95 = 1.959963984540054


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score table from labelled documents: y is quality, p a fixed logistic of length, in order of doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality is not null")
    p = F.round(1 / (1 + F.exp(-(F.ln(F.col("n_chars") + 1) - 7) / 2)), 3)
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("y"), p.alias("p"))


def running_by_score(scores: DataFrame, buckets: int = 1000, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per distinct p (and group) with pos, neg and tp, fp: positives and negatives at or above it."""
    per = scores.groupBy(*by, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).withColumn("down", -F.col("p")).withColumn("group", F.xxhash64(F.lit(0), *by))
    bucket = F.floor(F.col("down") * buckets)
    run = runnings(per, {"tp": (F.col("pos"), "sum"), "fp": (F.col("neg"), "sum")}, "group", bucket, "down")
    return run.select(*by, "p", "pos", "neg", "tp", "fp")


def auc_ap(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision."""
    run = running_by_score(scores, by=by)
    # each tie group's trapezoid needs only its own counts and the running ones
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    precision = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    n, m = F.sum("pos"), F.sum("neg")
    return run.groupBy(*by).agg(F.when((n > 0) & (m > 0), area / (n * m)).alias("auc"), F.when(n > 0, precision / n).alias("ap"), n.alias("n_pos"), m.alias("n_neg"))


def losses(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Log loss, Brier score, and expected calibration error over equal-width bins, the last one closed."""
    p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15))
    per = scores.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n"),
        F.sum("p").alias("sp"),
        F.sum("y").alias("sy"),
        F.sum(-(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))).alias("ll"),
        F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sb"),
    )
    n = F.sum("n")
    return per.agg((F.sum("ll") / n).alias("logloss"), (F.sum("sb") / n).alias("brier"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("ece"), n.alias("n"))


def murphy(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Reliability, resolution, uncertainty and within-bin variance of the binned Brier score."""
    per = scores.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"), F.sum("y").alias("sy"), F.var_pop("p").alias("vp"))
    total = per.agg(F.sum("n").alias("total"), (F.sum("sy") / F.sum("n")).alias("rate"))
    with_total = per.join(F.broadcast(total), F.lit(True))
    share = F.col("n") / F.col("total")
    return with_total.agg(
        F.sum(share * F.pow(F.col("mp") - F.col("my"), 2)).alias("reliability"),
        F.sum(share * F.pow(F.col("my") - F.col("rate"), 2)).alias("resolution"),
        F.max(F.col("rate") * (1 - F.col("rate"))).alias("uncertainty"),
        F.sum(share * F.col("vp")).alias("within_bin"),
    )


def psi(scores: DataFrame, is_first: Column, bins: int = 10) -> DataFrame:
    """Population stability index between the rows of is_first and the others; empty bins count as TINY."""
    per = scores.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count_if(is_first).alias("a"), F.count_if(~is_first).alias("b"))
    every = scores.sparkSession.range(bins).select(F.col("id").alias("bin")).join(per, "bin", "left").select("bin", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    total = every.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    share = lambda x, n: F.greatest(F.try_divide(x, n), F.lit(TINY))
    a, b = share(F.col("a"), F.col("na")), share(F.col("b"), F.col("nb"))
    return every.join(F.broadcast(total), F.lit(True)).agg(F.sum((a - b) * F.ln(a / b)).alias("psi"))


def ks(scores: DataFrame, is_first: Column) -> DataFrame:
    """Largest distance between the distribution functions of p in the rows of is_first and in the others."""
    run = running_by_score(scores.select("p", F.when(is_first, 1).otherwise(0).alias("y")))
    ends = run.agg(F.max("tp").alias("n1"), F.max("fp").alias("n0"))
    return run.join(F.broadcast(ends), F.lit(True)).agg(F.max(F.abs(F.try_divide("tp", "n1") - F.try_divide("fp", "n0"))).alias("ks"))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval; (0, 1) for no trials, pinned for none or all hits."""
    share, trials = hits / n, 1 + z * z / n
    centre, half = (share + z * z / (2 * n)) / trials, z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / trials
    low = F.when(n == 0, 0.0).when(hits == 0, 0.0).otherwise(centre - half)
    return low, F.when(n == 0, 1.0).when(hits == n, 1.0).otherwise(centre + half)


def precision_by(scores: DataFrame, by: list[str], threshold: float) -> DataFrame:
    per = scores.filter(F.col("p") >= threshold).groupBy(*by).agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return per.select(*by, "n", "hits", (F.col("hits") / F.col("n")).alias("precision"), low.alias("low"), high.alias("high"))


def threshold_sweep(scores: DataFrame, thresholds: list[float], win: float = 1.0, loss: float = 1.0) -> DataFrame:
    """At every threshold: rows at or above it, precision, recall, share of rows, and expected value of acting on them."""
    # each score counts at all thresholds up to it: one group per step of the grid, then running sums over the grid
    grid = sorted(thresholds)
    step = sum((F.when(F.col("p") >= t, 1).otherwise(0) for t in grid), F.lit(0))
    per = scores.groupBy(step.alias("step")).agg(F.count("*").alias("c"), F.sum("y").alias("s"))
    table = scores.sparkSession.createDataFrame([(i, t) for i, t in enumerate(grid, 1)], "step int, threshold double")
    every = table.join(per, "step", "left")
    down = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = per.agg(F.sum("c").alias("rows"), F.sum("s").alias("positives"))
    run = every.withColumn("n", F.coalesce(F.sum("c").over(down), F.lit(0))).withColumn("hits", F.coalesce(F.sum("s").over(down), F.lit(0))).join(F.broadcast(total), F.lit(True))
    precision = F.try_divide("hits", "n")
    return run.select("threshold", "n", "hits", precision.alias("precision"), F.try_divide("hits", "positives").alias("recall"), F.try_divide("n", "rows").alias("rate"), (precision * win - (1 - precision) * loss).alias("ev"))


def kelly_bins(scores: DataFrame, bins: int = 10, odds: float = 1.0) -> DataFrame:
    """Per equal-frequency bin of p: rows, hit rate with Wilson interval and Kelly fraction. Edges that coincide merge bins."""
    cuts = sorted(set(quantile_values(scores, "p", [i / bins for i in range(1, bins)])))
    bin_ = sum((F.when(F.col("p") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).alias("bin")
    per = scores.groupBy(bin_).agg(F.count("*").alias("n"), F.sum("y").alias("hits"), F.avg("p").alias("mean_p"))
    low, high = wilson(F.col("hits"), F.col("n"))
    rate = F.col("hits") / F.col("n")
    return per.select("bin", "n", "hits", "mean_p", rate.alias("rate"), low.alias("low"), high.alias("high"), ((odds * rate - (1 - rate)) / odds).alias("kelly"))


def lift(scores: DataFrame) -> DataFrame:
    """At every distinct score, going down: share of rows taken, precision among them and lift over the base rate."""
    run = running_by_score(scores)
    total = run.agg(F.max("tp").alias("n1"), F.max("fp").alias("n0"))
    taken = F.col("tp") + F.col("fp")
    return run.join(F.broadcast(total), F.lit(True)).select(
        "p", taken.alias("n"), (taken / (F.col("n1") + F.col("n0"))).alias("share"), (F.col("tp") / taken).alias("precision"), F.try_divide(F.col("tp") / taken, F.try_divide(F.col("n1"), F.col("n1") + F.col("n0"))).alias("lift")
    )


def page_hinkley(series: DataFrame, key: str, order: str, x: str, delta: float = 0.005, threshold: float = 1.0, rows_in_bucket: int = 1000) -> DataFrame:
    """Page-Hinkley statistic for an upward shift of the mean: rows with ph and alarm. order is a whole number, by which buckets of rows are cut."""
    bucket = F.floor(F.col(order) / rows_in_bucket)
    step = lambda df, name, value, how="sum": running(df, name, value, key, bucket, order, how)
    df = runnings(series, {"_s": (F.col(x), "sum"), "_n": (F.lit(1), "sum")}, key, bucket, order)
    df = step(df, "_c", F.col(x) - F.col("_s") / F.col("_n") - delta)
    df = step(df, "_low", F.col("_c"), "min")
    ph = F.col("_c") - F.least("_low", F.lit(0.0))
    return df.withColumn("ph", ph).withColumn("alarm", F.col("ph") > threshold).drop("_s", "_n", "_c", "_low")


def turnover(series: DataFrame, key: str, order: str, threshold: float, rows_in_bucket: int = 1000) -> DataFrame:
    """Of the decision p >= threshold, per key: share of rows, changes, runs and mean length of an active run."""
    df = previous(series.withColumn("on", (F.col("p") >= threshold).cast("int")), "before", F.col("on"), key, F.floor(F.col(order) / rows_in_bucket), order)
    starts = F.count_if((F.col("on") == 1) & (F.coalesce("before", F.lit(0)) == 0))
    return df.groupBy(key).agg(F.avg("on").alias("active_rate"), F.count_if(F.col("on") != F.col("before")).alias("changes"), starts.alias("runs"), F.try_divide(F.sum("on"), starts).alias("mean_run"))


def cohorts(scores: DataFrame, threshold: float) -> DataFrame:
    """Rows in each of TP, FP, TN, FN; all four are listed."""
    name = F.when(F.col("p") >= threshold, F.when(F.col("y") == 1, "TP").otherwise("FP")).otherwise(F.when(F.col("y") == 1, "FN").otherwise("TN"))
    names = scores.sparkSession.createDataFrame([(x,) for x in ("TP", "FP", "TN", "FN")], "cohort string")
    return names.join(scores.groupBy(name.alias("cohort")).agg(F.count("*").alias("n")), "cohort", "left").select("cohort", F.coalesce("n", F.lit(0)).alias("n"))


def uncertainty(samples: DataFrame, column: str = "ps") -> DataFrame:
    """From an array of class-1 probabilities: entropy of their mean (total), mean of their entropies (data), and the difference (knowledge)."""
    part = lambda v: F.when(v <= 0, 0.0).otherwise(-v * F.ln(v))
    entropy = lambda v: part(v) + part(1 - v)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    df = samples.withColumn("mean_p", mean(F.col(column))).withColumn("data", mean(F.transform(column, entropy)))
    return df.withColumn("total", entropy(F.col("mean_p"))).withColumn("knowledge", F.greatest(F.col("total") - F.col("data"), F.lit(0.0)))
