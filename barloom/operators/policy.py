"""Scores, gates and sizers of a strategy as column expressions, and what they decide row by row.

A gate is a boolean column that is never null: what is missing keeps the gate shut, but for uncertainty ranks, whose gate it leaves open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from barloom.functions.order import WaveletMatrix
from barloom.functions.rolling import Rows
from barloom.operators.passage import by_series, numbers
from barloom.plans.blocks import in_blocks, running


def _shut(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def raw_score() -> Column:
    return F.col("p")


def residual_score(base_rate: Column) -> Column:
    """Probability in excess of the base rate of its regime."""
    return F.col("p") - base_rate


def ensemble_score() -> Column:
    return F.col("mean_p")


def score_above(score: Column, threshold: float) -> Column:
    return _shut(score >= threshold)


def regime_high(rank: Column, least: float) -> Column:
    return _shut(rank >= least)


def uncertainty_below(rank: Column, most: float) -> Column:
    return F.coalesce(rank <= most, F.lit(True))


def uncertainty_capped(unc: Column, cap: float) -> Column:
    return _shut(unc <= cap)


def no_cluster_loss(cluster_pnl: Column, most: float) -> Column:
    return _shut(cluster_pnl >= -most)


def kelly(p: Column, odds: float) -> Column:
    """Share of capital for a bet that pays odds to one; 0 where the edge is not positive or p is missing."""
    return F.coalesce(F.greatest((odds * p - (1 - p)) / odds, F.lit(0.0)), F.lit(0.0)) if odds > 0 else F.lit(0.0)


def kelly_size(p: Column, odds: float, fraction: float = 0.25) -> Column:
    return fraction * kelly(p, odds)


def bayesian_kelly_size(samples: Column, fallback: Column, odds: float, quantile: float = 0.25, fraction: float = 0.25) -> Column:
    """A low quantile (linear between order statistics) of the Kelly shares of an array of probabilities; point Kelly where there are none."""
    ordered = F.array_sort(F.transform(samples, lambda p: (odds * p - (1 - p)) / odds))
    at = (F.size(ordered) - 1) * F.lit(quantile)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    cut = low + (high - low) * (at - F.floor(at))
    return F.when(F.coalesce(F.size(samples), F.lit(0)) > 0, F.greatest(fraction * cut, F.lit(0.0))).otherwise(kelly_size(fallback, odds, fraction))


def volatility_target(size: Column, sigma: Column, target: float, floor: float = 1e-6, most: float = 4.0) -> Column:
    """size scaled so that its expected volatility is the target, by at most a multiple; unscaled where sigma is missing."""
    return F.when(sigma.isNull(), size).otherwise(size * F.greatest(F.least(F.lit(target) / F.greatest(sigma, F.lit(floor)), F.lit(most)), F.lit(0.0)))


def clipped(size: Column, most: float) -> Column:
    return F.least(F.greatest(size, F.lit(0.0)), F.lit(most))


def cluster_marginal(held: Column, target: float, first: float | None = None) -> Column:
    """What is left of a cluster's target size; first, where nothing is held."""
    opening = target if first is None else max(0.0, min(first, target))
    return F.when(held <= 0, F.lit(opening)).otherwise(F.greatest(target - held, F.lit(0.0)))


def trailing_rank(df: DataFrame, name: str, x: str, window: int, least: int, rows: Rows | None = None) -> DataFrame:
    """df with the share of the up to window rows before each whose x is at most its own; null with fewer than least of them that have one."""

    def make(table: pa.Table) -> dict[str, np.ndarray]:
        values = numbers(table, x)
        at = np.arange(len(values))
        lo = np.maximum(at - window, 0)
        there = np.concatenate([[0], np.cumsum(~np.isnan(values))])
        seen = there[at] - there[lo]
        known = (seen >= least) & ~np.isnan(values)
        return {name: np.where(known, WaveletMatrix(values).count_at_most(lo, at, values) / np.maximum(seen, 1), np.nan)}

    return by_series(df, rows or Rows(), make, [StructField(name, DoubleType())])


def trailing_base_rate(df: DataFrame, name: str, rank: str, y: str, bins: int, window: int, least: int, keys: tuple[str, ...] = ("symbol",), order: str = "k", rows_in_bucket: int = 1000) -> DataFrame:
    """df with the mean of y over the window earlier rows of the same bin of rank; null with fewer than least of them.

    The rows of a bin are numbered in two levels, and their windows run in blocks of these numbers.
    """
    bin_ = F.least(F.floor(F.col(rank) * bins), F.lit(bins - 1))
    df = df.withColumns({"_bin": F.struct(*keys, bin_.alias("bin")), "_one": F.lit(1)})
    df = running(df, "_place", F.col("_one"), "_bin", F.floor(F.col(order) / rows_in_bucket), order)

    def work(d: DataFrame, rows: Rows) -> DataFrame:
        before = rows.spec.rowsBetween(-window, -1)
        return d.withColumn(name, F.when(F.col("_bin.bin").isNotNull() & (F.count(y).over(before) >= least), F.avg(y).over(before)))

    return in_blocks(df, work, window, key="_bin", order="_place").drop("_bin", "_one", "_place")
