"""Audits of score tables: thresholds, gates, uncertainty cells, contributions by cohort, drift over time, deflated Sharpe ratios, diagnostics of a strategy's premises.

Each is one or two aggregations. Cuts at quantiles come to the driver as a few numbers; windows of time are found by exploding each row into the few windows that hold it.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import norm_cdf
from barloom.operators import scores
from barloom.plans.blocks import previous, running
from barloom.plans.quantiles import quantile_values, quantiles


def cuts(df: DataFrame, x: str, bins: int) -> list[float]:
    """Inner edges of equal-frequency bins of x; edges that coincide are one."""
    *inner, top = quantile_values(df, x, [*[i / bins for i in range(1, bins)], 1.0]) or [None]
    return sorted(q for q in set(inner) if q < top)


def bucket(x: Column, edges: list[float]) -> Column:
    """Number of the right-closed bin of x; null for null."""
    return F.when(x.isNotNull(), sum((F.when(x > e, 1).otherwise(0) for e in edges), F.lit(0)))


def top_q_threshold(df: DataFrame, q: float) -> DataFrame:
    """threshold: the q-quantile of p."""
    return quantiles(df, "p", [q]).select(F.get("q", F.lit(0)).alias("threshold"))


def conditional_cap(df: DataFrame, threshold: float, q: float) -> DataFrame:
    """cap: the q-quantile of unc among rows whose p reaches the threshold."""
    return quantiles(df.filter(F.col("p") >= threshold), "unc", [q]).select(F.get("q", F.lit(0)).alias("cap"))


def gate_overlap(df: DataFrame, threshold: float, cap: float) -> DataFrame:
    """Rows that pass the score gate, the uncertainty gate and both."""
    a, b = F.col("p") >= threshold, F.coalesce(F.col("unc") <= cap, F.lit(False))
    return df.agg(F.count("*").alias("n"), F.count_if(a).alias("n_score"), F.count_if(b).alias("n_unc"), F.count_if(a & b).alias("n_both"))


def hit_heatmap(df: DataFrame, bins_p: int = 5, bins_unc: int = 5) -> DataFrame:
    """Hit rate with Wilson interval in equal-frequency cells of p and unc."""
    cells = [bucket(F.col(x), cuts(df, x, n)).alias(f"{x}_bin") for x, n in (("p", bins_p), ("unc", bins_unc))]
    per = df.groupBy(*cells).agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    low, high = scores.wilson(F.col("hits"), F.col("n"))
    return per.select("p_bin", "unc_bin", "n", "hits", (F.col("hits") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def variance_reliability(df: DataFrame, predicted: str, observed: str, bins: int = 10) -> DataFrame:
    """Mean predicted and observed variance in equal-frequency bins of the predicted one."""
    return df.groupBy(bucket(F.col(predicted), cuts(df, predicted, bins)).alias("bin")).agg(F.count("*").alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(observed).alias("mean_observed"))


def _contributions(df: DataFrame, names: list[str], array: str) -> DataFrame:
    labels = F.array(*map(F.lit, names))
    return df.select("cohort", *[c for c in ("w", "replicate") if c in df.columns], F.posexplode(array).alias("at", "value")).withColumn("feature", F.get(labels, F.col("at")))


def cohort_contributions(df: DataFrame, names: list[str], array: str = "contributions") -> DataFrame:
    """Mean of each feature's contribution in each cohort."""
    return _contributions(df, names, array).groupBy("cohort", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean_contribution"))


def effect_sizes(df: DataFrame, names: list[str], array: str = "contributions") -> DataFrame:
    """Difference of a feature's mean contribution between false positives and false negatives, in pooled deviations."""
    rows = _contributions(df, names, array)
    of = lambda c, f: f(F.when(F.col("cohort") == c, F.col("value")))
    per = rows.groupBy("feature").agg(*[of(c, f).alias(f"{n}_{c.lower()}") for c in ("FP", "FN") for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    pooled = ((F.col("n_fp") - 1) * F.col("var_fp") + (F.col("n_fn") - 1) * F.col("var_fn")) / F.greatest(F.col("n_fp") + F.col("n_fn") - 2, F.lit(1))
    std = F.sqrt(F.greatest(pooled, F.lit(1e-18)))
    return per.select("feature", "n_fp", "n_fn", (F.col("mean_fp") - F.col("mean_fn")).alias("difference"), std.alias("pooled_std"), ((F.col("mean_fp") - F.col("mean_fn")) / std).alias("effect_size"))


def contribution_difference_samples(drawn: DataFrame, names: list[str], array: str = "contributions") -> DataFrame:
    """replicate, feature and difference of weighted mean contributions between false positives and false negatives."""
    rows = _contributions(drawn, names, array)
    mean = lambda c: F.sum(F.when(F.col("cohort") == c, F.col("w") * F.col("value"))) / F.sum(F.when(F.col("cohort") == c, F.col("w")))
    return rows.groupBy("replicate", "feature").agg((mean("FP") - mean("FN")).alias("difference"))


def time_windows(df: DataFrame, ts: str, window_days: int, step_days: int) -> DataFrame:
    """df once for each window [window_start, window_end) of time that holds the row; windows begin at the first ts, step_days apart, and the last ends no later than a step past the last ts."""
    ends = df.agg(F.min(ts).alias("first"), F.max(ts).alias("last")).first()
    if ends.first is None:
        return df.withColumns({"window_start": F.col(ts), "window_end": F.col(ts)})
    day, step, window = 86_400_000_000, step_days * 86_400_000_000, window_days * 86_400_000_000
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    since = micros(F.col(ts)) - micros(F.lit(ends.first))
    span = micros(F.lit(ends.last)) - micros(F.lit(ends.first))
    last = F.least(F.floor(since / step), F.floor((span + step - window) / step))
    first = F.greatest(F.floor((since - window) / step) + 1, F.lit(0))
    at = df.withColumn("_i", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    start = F.timestamp_micros(micros(F.lit(ends.first)) + F.col("_i") * step).cast("timestamp_ntz")
    return at.withColumns({"window_start": start, "window_end": F.timestamp_micros(micros(F.lit(ends.first)) + F.col("_i") * step + window_days * day).cast("timestamp_ntz")}).drop("_i")


def windowed_scores(windows: DataFrame, bins: int = 10, min_rows: int = 1) -> DataFrame:
    """For each window: rows, positives, Brier score and its reliability, resolution and uncertainty, and calibration error."""
    per = windows.groupBy("window_start", "window_end", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("c"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sb"))
    total = per.groupBy(F.col("window_start").alias("w"), F.col("window_end").alias("e")).agg(F.sum("c").alias("n"), F.sum("sy").alias("n_pos")).filter(F.col("n") >= min_rows)
    joined = per.join(total, (F.col("window_start") == F.col("w")) & (F.col("window_end") == F.col("e")))
    rate, share = F.col("n_pos") / F.col("n"), F.col("c") / F.col("n")
    gap, move = (F.col("sp") - F.col("sy")) / F.col("c"), F.col("sy") / F.col("c") - rate
    return joined.groupBy("window_start", "window_end", "n", "n_pos").agg(
        (F.sum("sb") / F.max("n")).alias("brier"), F.sum(share * F.abs(gap)).alias("ece"), F.sum(share * gap * gap).alias("reliability"), F.sum(share * move * move).alias("resolution"), F.max(rate * (1 - rate)).alias("uncertainty")
    )


def windowed_drift(reference: DataFrame, windows: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index of each window's scores against the reference's, over equal-width bins."""
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")
    ref = reference.groupBy(bin_).agg(F.count("*").alias("r"))
    total = reference.count()
    every = reference.sparkSession.range(bins).select(F.col("id").alias("bin")).join(ref, "bin", "left").select("bin", F.greatest(F.coalesce("r", F.lit(0)) / max(total, 1), F.lit(scores.TINY)).alias("a"))
    sizes = windows.groupBy("window_start", "window_end").agg(F.count("*").alias("n"))
    per = windows.groupBy(F.col("window_start").alias("w"), bin_).agg(F.count("*").alias("c")).withColumnRenamed("bin", "b")
    grid = sizes.crossJoin(F.broadcast(every))
    full = grid.join(per, (F.col("window_start") == F.col("w")) & (F.col("bin") == F.col("b")), "left")
    share = F.greatest(F.coalesce("c", F.lit(0)) / F.col("n"), F.lit(scores.TINY))
    return full.groupBy("window_start", "window_end", "n").agg(F.sum((F.col("a") - share) * F.ln(F.col("a") / share)).alias("psi"))


def windowed_ks(reference: DataFrame, windows: DataFrame, min_rows: int = 1, buckets: int = 1000) -> DataFrame:
    """For each window of time_windows(): n, ks (the largest distance between the distribution functions of its p and of the reference's) and ks_pvalue (by the limiting distribution, with the usual correction for small samples).

    Between two scores of a window only the reference's function rises, so it is looked at on both sides of each of the window's scores. Functions are running counts over distinct scores, in two levels.
    """
    at = lambda d: F.floor(F.col("p") * buckets)  # noqa: E731,ARG005
    ours = windows.filter("p is not null").groupBy("window_start", "window_end", "p").agg(F.count("*").alias("c"))
    ours = running(ours.withColumn("_w", F.struct("window_start", "window_end")), "upto", F.col("c"), "_w", at(ours), "p")
    theirs = reference.filter("p is not null").groupBy("p").agg(F.count("*").alias("r"))
    every = theirs.unionByName(ours.select("p", F.lit(0).cast("long").alias("r"))).groupBy("p").agg(F.sum("r").alias("r")).withColumn("_all", F.lit(0))
    every = running(every, "before", F.col("r"), "_all", at(every), "p").select(F.col("p").alias("q"), "r", "before")
    met = ours.join(every, F.col("p") == F.col("q"))
    sizes = ours.groupBy(F.col("_w").alias("_v")).agg(F.sum("c").alias("n")).filter(F.col("n") >= min_rows)
    total = theirs.agg(F.sum("r").alias("total"))
    met = met.join(sizes, F.col("_w") == F.col("_v")).crossJoin(total)
    own, ref = (lambda x: F.col(x) / F.col("n")), (lambda x: x / F.col("total"))
    gap = F.greatest(F.abs(own("upto") - ref(F.col("before"))), F.abs((F.col("upto") - F.col("c")) / F.col("n") - ref(F.col("before") - F.col("r"))))
    per = met.groupBy("window_start", "window_end", "n", "total").agg(F.max(gap).alias("ks"))
    root = F.sqrt(F.col("n") * F.col("total") / (F.col("n") + F.col("total")))
    reach = (root + 0.12 + 0.11 / root) * F.col("ks")
    tail = sum((2 * (-1) ** (j - 1) * F.exp(-2 * j * j * reach * reach) for j in range(1, 41)), F.lit(0.0))
    # below this the alternating sum has not converged, and the chance is one
    return per.select("window_start", "window_end", "n", "ks", F.when(reach < 0.2, 1.0).otherwise(F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0))).alias("ks_pvalue"))


def expected_max_sharpe(trials: int) -> float:
    """Expected largest of so many independent standard normal ratios."""
    if trials < 1:
        raise ValueError("trials must be 1 at least")
    if trials == 1:
        return 0.0
    gamma, normal = 0.5772156649015329, NormalDist()
    return (1 - gamma) * normal.inv_cdf(1 - 1 / trials) + gamma * normal.inv_cdf(1 - 1 / (trials * math.e))


def deflated_sharpe(returns: DataFrame, x: str, trials: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Sharpe ratio of x per group, bias-corrected skewness and kurtosis, and the chance that it beats the best of so many trials."""
    n, mean = F.count(x), F.avg(x)
    per = returns.groupBy(*by).agg(n.alias("n"), mean.alias("mean"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n = F.col("n")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3)) + 3
    per = per.filter("n >= 4 and std > 1e-18").select(*by, "n", (F.col("mean") / F.col("std")).alias("sharpe"), skew.alias("skew"), kurt.alias("kurtosis"))
    best = expected_max_sharpe(trials)
    spread = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurtosis") - 1) / 4 * F.col("sharpe") * F.col("sharpe")
    z = F.when(spread > 0, (F.col("sharpe") - best) * F.sqrt(n - 1) / F.sqrt(spread))
    return per.withColumn("expected_max_sharpe", F.lit(best)).withColumn("deflated_z", z).withColumn("deflated_prob", norm_cdf(F.col("deflated_z")))


def score_agreement(df: DataFrame, a: str, b: str, threshold: float, buckets: int = 1000) -> DataFrame:
    """Two models' scores of the same rows: Pearson and Spearman correlation (average ranks), distances, and rows on which their decisions differ."""
    ranked = df
    for c in (a, b):
        # ranks from counts per distinct value, summed in two levels
        per = df.groupBy(F.col(c).alias(f"v_{c}")).agg(F.count("*").alias(f"n_{c}")).withColumn("_all", F.lit(0))
        per = running(per, f"upto_{c}", F.col(f"n_{c}"), "_all", F.floor(F.col(f"v_{c}") * buckets), f"v_{c}").drop("_all")
        ranked = ranked.join(per.withColumn(f"r_{c}", F.col(f"upto_{c}") - (F.col(f"n_{c}") - 1) / 2), F.col(c) == F.col(f"v_{c}"))
    gap = F.abs(F.col(a) - F.col(b))
    middle = quantiles(df, gap, [0.5]).select(F.get("q", F.lit(0)).alias("median_abs_diff"))
    return ranked.agg(
        F.count("*").alias("n"), F.corr(a, b).alias("pearson"), F.corr(f"r_{a}", f"r_{b}").alias("spearman"), F.avg(gap).alias("mean_abs_diff"), F.count_if((F.col(a) >= threshold) != (F.col(b) >= threshold)).alias("n_disagree"),
    ).crossJoin(middle)


# ---- premises of a strategy -----------------------------------------------------------------------------------------------------


def uncertainty_premise(df: DataFrame, top: float = 0.2, uplift: float = 0.04, min_rows: int = 50) -> DataFrame:
    """Whether, among the top scores, rows of low uncertainty are right more often: value is the difference of their hit rates."""
    cut = next(iter(quantile_values(df, "p", [1 - top])), None)
    chosen = df.filter(F.col("p") >= F.lit(cut))
    middle = next(iter(quantile_values(chosen, "unc", [0.5])), None)
    low, high = F.col("unc") <= F.lit(middle), F.col("unc") > F.lit(middle)
    per = chosen.agg(F.count_if(low).alias("n_low"), F.count_if(high).alias("n_high"), (F.avg(F.when(low, F.col("y"))) - F.avg(F.when(high, F.col("y")))).alias("value"))
    return per.withColumn("passed", F.coalesce((F.col("n_low") >= min_rows) & (F.col("n_high") >= min_rows) & (F.col("value") >= uplift), F.lit(False)))


def regime_premise(df: DataFrame, regime: str, top: float = 0.1, regime_top: float = 0.3, uplift: float = 0.05, min_rows: int = 50) -> DataFrame:
    """Whether top scores are right more often in the highest regimes: value is the difference from all top scores."""
    cut, high = (next(iter(quantile_values(df, x, [1 - share])), None) for x, share in (("p", top), (regime, regime_top)))
    chosen, here = F.col("p") >= F.lit(cut), F.col(regime) >= F.lit(high)
    per = df.agg(F.count_if(chosen & here).alias("n"), (F.avg(F.when(chosen & here, F.col("y"))) - F.avg(F.when(chosen, F.col("y")))).alias("value"))
    return per.withColumn("passed", F.coalesce((F.col("n") >= min_rows) & (F.col("value") >= uplift), F.lit(False)))


def persistence_premise(df: DataFrame, key: str, order: str, quantile: float = 0.7, lift: float = 1.5, rows_in_bucket: int = 1000) -> DataFrame:
    """Whether high scores follow one another: value is the chance of a high score after one, over the share of high scores."""
    cut = next(iter(quantile_values(df, "p", [quantile])), None)
    marked = df.withColumn("on", F.when(F.col("p") > F.lit(cut), 1).otherwise(0))
    marked = previous(marked, "before", F.col("on"), key, F.floor(F.col(order) / rows_in_bucket), order)
    after = F.avg(F.when(F.col("before") == 1, F.col("on")))
    per = marked.agg(F.sum("on").alias("n_above"), (after / F.avg("on")).alias("value"))
    return per.withColumn("passed", F.coalesce(F.col("value") >= lift, F.lit(False)))


def signal_premise(df: DataFrame, regime: str, parts: int = 3, least: float = 0.55) -> DataFrame:
    """AUC of p within each equal-frequency part of the regime, and whether it reaches the least."""
    named = df.withColumn("part", bucket(F.col(regime), cuts(df, regime, parts)))
    return scores.auc_ap(named, by=("part",)).select("part", "auc", "n_pos", "n_neg", F.coalesce(F.col("auc") >= least, F.lit(False)).alias("passed"))
