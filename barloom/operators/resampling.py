"""Bootstrap bands of score-table statistics.

A replicate gives every row, or every block of consecutive rows, a Poisson(1) weight drawn from a hash of (seed, unit, replicate): the scalable form of drawing with
replacement. No row moves, nothing is drawn on the driver, and reruns agree. Rows are summed by score (or bin) and replicate before anything is ordered, so what is sorted is one row
per distinct score and replicate, in two levels of buckets. A replicate with one class only has no value and is left out of its band.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.plans.blocks import previous, running, runnings

#: Share of an interval, and the largest weight that a row can draw.
LEVEL, MOST = 0.95, 11
BUCKETS = 1000


#: The Poisson(1) distribution function at 0, 1, ..
CDF = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(MOST)]


def poisson(u: Column) -> Column:
    """The inverse of the Poisson(1) distribution function at u in [0, 1)."""
    return sum((F.when(u >= total, 1).otherwise(0) for total in CDF), F.lit(0))


def uniform(*parts) -> Column:
    """A number in [0, 1) from 32 bits of the MD5 of parts."""
    text = F.concat_ws("|", *[F.lit(str(x)) if not isinstance(x, Column) else x.cast("string") for x in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2**32


def resampled(df: DataFrame, unit: str, replicates: int, seed: int = 1, block: int | None = None) -> DataFrame:
    """df once for each replicate in which its weight w is above 0. With block, rows of so many consecutive numbers of unit share a weight; where blocks start differs by replicate."""
    spread = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    if block is None:
        drawn = F.col(unit)
    else:
        start = F.floor(uniform(seed, "start", F.col("replicate")) * block)
        drawn = F.floor((F.col(unit) + start) / block)
    return spread.withColumn("w", poisson(uniform(seed, drawn, F.col("replicate")))).filter("w > 0")


def by_score(drawn: DataFrame) -> DataFrame:
    """replicate, p, pos and neg (weights), and tp, fp: weights at or above p."""
    per = drawn.groupBy("replicate", "p").agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w") * (1 - F.col("y"))).alias("neg")).withColumn("down", -F.col("p"))
    bucket = F.floor(F.col("down") * BUCKETS)
    return runnings(per, {"tp": (F.col("pos"), "sum"), "fp": (F.col("neg"), "sum")}, "replicate", bucket, "down")


def _with_totals(run: DataFrame) -> DataFrame:
    ends = run.groupBy(F.col("replicate").alias("r")).agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return run.join(ends, F.col("replicate") == F.col("r")).drop("r").filter("np > 0 and nn > 0")


def bands(samples: DataFrame, values: list[str], by: tuple[str, ...] = (), level: float = LEVEL) -> DataFrame:
    """Lower bound, median and upper bound of values over the replicates, by group, with their number."""
    at = [(1 - level) / 2, 0.5, (1 + level) / 2]
    cut = [F.percentile(v, q).alias(f"{v}_{n}") for v in values for n, q in zip(("low", "median", "high"), at)]
    return samples.groupBy(*by).agg(F.count(values[0]).alias("n_effective"), *cut)


def auc_samples(drawn: DataFrame) -> DataFrame:
    """replicate, auc (ties count half) and ap."""
    run = _with_totals(by_score(drawn))
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / F.max(F.col("np") * F.col("nn"))
    precision = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("np")
    return run.groupBy("replicate").agg(area.alias("auc"), precision.alias("ap"))


def loss_samples(drawn: DataFrame, bins: int = 10) -> DataFrame:
    """replicate, brier, logloss, ece, and the parts of the Brier score: reliability, resolution, uncertainty."""
    p, y, w = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15)), F.col("y"), F.col("w")
    per = drawn.groupBy("replicate", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.sum("w").alias("n"), F.sum(w * F.col("p")).alias("sp"), F.sum(w * y).alias("sy"), F.sum(w * (F.col("p") - y) * (F.col("p") - y)).alias("sb"), F.sum(-w * (y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("ll")
    )
    total = per.groupBy(F.col("replicate").alias("r")).agg(F.sum("n").alias("total"), (F.sum("sy") / F.sum("n")).alias("rate"))
    per = per.join(total, F.col("replicate") == F.col("r"))
    gap, step = (F.col("sp") - F.col("sy")) / F.col("n"), F.col("sy") / F.col("n") - F.col("rate")
    share = F.col("n") / F.col("total")
    return per.groupBy("replicate").agg(
        (F.sum("sb") / F.sum("n")).alias("brier"), (F.sum("ll") / F.sum("n")).alias("logloss"), F.sum(share * F.abs(gap)).alias("ece"),
        F.sum(share * gap * gap).alias("reliability"), F.sum(share * step * step).alias("resolution"), F.max(F.col("rate") * (1 - F.col("rate"))).alias("uncertainty"),
    )


def _steps(points: DataFrame, x: str, y: str) -> DataFrame:
    """replicate, x and y of a curve's points in order of x with those of the point before (none: x 0 and y null)."""
    points = points.select("replicate", F.col(x).alias("x"), F.col(y).alias("y")).withColumn("_order", F.struct("x", "y"))
    points = previous(points, "_before", F.struct("x", "y"), "replicate", F.floor(F.col("x") * BUCKETS), "_order")
    return points.select("replicate", "x", "y", F.coalesce("_before.x", F.lit(0.0)).alias("x0"), F.col("_before.y").alias("y0"))


def roc_samples(drawn: DataFrame, grid: list[float]) -> DataFrame:
    """replicate, x (false positive rate) and tpr: straight lines between the curve's points, the highest at an equal rate."""
    run = _with_totals(by_score(drawn)).select("replicate", (F.col("fp") / F.col("nn")).alias("fpr"), (F.col("tp") / F.col("np")).alias("tpr"))
    steps = _steps(run.groupBy("replicate", "fpr").agg(F.max("tpr").alias("tpr")), "fpr", "tpr")
    table = F.array(*map(F.lit, grid))
    # every point of the grid falls in one step
    here = F.filter(table, lambda g: (g <= F.col("x")) & ((g > F.col("x0")) | (F.col("y0").isNull())))
    at = steps.select("replicate", "x", "x0", "y", "y0", F.explode(here).alias("g")).fillna(0.0, ["y0"])
    line = F.when(F.col("x") > F.col("x0"), F.col("y0") + (F.col("y") - F.col("y0")) * (F.col("g") - F.col("x0")) / (F.col("x") - F.col("x0"))).otherwise(F.col("y"))
    return at.select("replicate", F.col("g").alias("x"), line.alias("tpr"))


def pr_samples(drawn: DataFrame, grid: list[float]) -> DataFrame:
    """replicate, x (recall) and precision: the highest at that recall or beyond."""
    run = _with_totals(by_score(drawn)).select("replicate", (F.col("tp") / F.col("np")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    every = run.select("replicate", "precision", F.explode(F.filter(F.array(*map(F.lit, grid)), lambda g: g <= F.col("recall"))).alias("x"))
    return every.groupBy("replicate", "x").agg(F.max("precision").alias("precision"))


def partial_area(samples: DataFrame, value: str, end: float) -> DataFrame:
    """replicate and area: the mean height of a curve over an even grid from 0 to end, by trapezoids."""
    ends = samples.groupBy("replicate").agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.min_by(value, "x").alias("first"), F.max_by(value, "x").alias("last"))
    return ends.select("replicate", ((F.col("s") - (F.col("first") + F.col("last")) / 2) / (F.col("n") - 1)).alias("area"))


def calibration_samples(drawn: DataFrame, bins: int = 10) -> DataFrame:
    """replicate, bin and rate, the share of positives in it."""
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return drawn.groupBy("replicate", bin_).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("rate"))


def sweep_samples(drawn: DataFrame, thresholds: list[float], win: float = 1.0, loss: float = 1.0) -> DataFrame:
    """replicate, threshold, precision, recall, rate and ev of acting on scores at or above the threshold."""
    grid = F.array(*map(F.lit, sorted(thresholds)))
    total = drawn.groupBy(F.col("replicate").alias("r")).agg(F.sum("w").alias("rows"), F.sum(F.col("w") * F.col("y")).alias("positives"))
    per = drawn.groupBy("replicate", "p").agg(F.sum("w").alias("c"), F.sum(F.col("w") * F.col("y")).alias("s"))
    at = per.select("replicate", "c", "s", F.explode(F.filter(grid, lambda t: t <= F.col("p"))).alias("threshold")).groupBy("replicate", "threshold").agg(F.sum("c").alias("n"), F.sum("s").alias("hits"))
    precision = F.col("hits") / F.col("n")
    joined = at.join(total, F.col("replicate") == F.col("r"))
    return joined.select("replicate", "threshold", precision.alias("precision"), F.try_divide("hits", "positives").alias("recall"), (F.col("n") / F.col("rows")).alias("rate"), (precision * win - (1 - precision) * loss).alias("ev"))


def shuffled_labels(scores: DataFrame, unit: str, replicates: int, seed: int = 7) -> DataFrame:
    """Rows (replicate, p, y, w = 1) in which the labels are dealt to the scores anew, all of them, by two hash orders."""
    spread = scores.select(unit, "p", "y", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).withColumn("one", F.lit(1))
    numbered = lambda tag: running(spread.withColumn("turn", uniform(seed, tag, F.col(unit), F.col("replicate"))), "place", F.col("one"), "replicate", F.floor(F.col("turn") * BUCKETS), "turn")
    a, b = numbered("p").select("replicate", "place", "p"), numbered("y").select("replicate", "place", "y")
    return a.join(b, ["replicate", "place"]).withColumn("w", F.lit(1)).drop("place")
