"""Metrics of score tables as mergeable aggregates, with a registry for users' own.

A metric has parts, which are mapped from a row (or, if it is ordered, from a distinct score with the positives and negatives at it and at or above it), merged by weighted sums, and finished from these sums. One plan thus serves the
whole table, groups, windows of time and bootstrap replicates alike: a replicate is one more group, whose rows weigh what it drew. All metrics asked for share one aggregation, and all ordered ones a second
one over rows summed by score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import audits
from barloom.operators.resampling import BUCKETS, LEVEL, resampled
from barloom.plans.blocks import runnings

Get = Callable[[str], Column]


@dataclass(frozen=True)
class Metric:
    """parts: by name what a row (columns p, y and others of the table) or a score (pos, neg, tp, fp) adds. finish: the metric from get(part), get("n") (weight), get("pos") and get("neg") (weights of both classes)."""

    name: str
    parts: dict[str, Column]
    finish: Callable[[Get], Column]
    ordered: bool = False


METRICS: dict[str, Metric] = {}


def register_metric(name: str, parts: Callable[[], dict[str, Column]], finish: Callable[[Get], Column], ordered: bool = False) -> None:
    """Add a metric; its name must be new. parts is called when a session is there."""
    if name in METRICS:
        raise ValueError(f"{name} is registered already")
    METRICS[name] = (parts, finish, ordered)


def _metric(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"no metric is named {name}")
    parts, finish, ordered = METRICS[name]
    return Metric(name, parts(), finish, ordered)


def _log_losses() -> dict[str, Column]:
    p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15))
    return {"loss": -(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))}


_BINS = 10


def _calibration() -> dict[str, Column]:
    bin_ = F.least(F.floor(F.col("p") * _BINS), F.lit(_BINS - 1))
    return {f"gap{b}": F.when(bin_ == b, F.col("p") - F.col("y")).otherwise(0.0) for b in range(_BINS)}


register_metric("brier", lambda: {"square": (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))}, lambda get: get("square") / get("n"))
register_metric("logloss", _log_losses, lambda get: get("loss") / get("n"))
register_metric("ece", _calibration, lambda get: sum((F.abs(get(f"gap{b}")) for b in range(_BINS)), F.lit(0.0)) / get("n"))
register_metric("auc", lambda: {"area": F.col("neg") * (F.col("tp") - F.col("pos") / 2)}, lambda get: get("area") / (get("pos") * get("neg")), ordered=True)
register_metric("ap", lambda: {"precision": F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))}, lambda get: get("precision") / get("pos"), ordered=True)


def _joined(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Groups of both, null ones too."""
    if not by:
        return left.crossJoin(right)
    other = right.select(*[F.col(c).alias(f"_by_{c}" if c in by else c) for c in right.columns])
    return left.join(other, [left[c].eqNullSafe(other[f"_by_{c}"]) for c in by]).drop(*[f"_by_{c}" for c in by])


def evaluate(df: DataFrame, metrics: list[str], by: tuple[str, ...] = (), weight: str | None = None, both_classes: bool = True) -> DataFrame:
    """by, n (rows), n_pos (their weight among positives, if weighted), base_rate and the metrics of every group of df (p, y). With both_classes, groups of one class have no metric; without by there is one row."""
    wanted = [_metric(m) for m in metrics]
    w = F.lit(1) if weight is None else F.col(weight)
    plain, ordered = [m for m in wanted if not m.ordered], [m for m in wanted if m.ordered]
    # the sums are named by metric and part, so that users' parts can't clash
    sums = [F.sum(w * x).alias(f"_{m.name}_{part}") for m in plain for part, x in m.parts.items()]
    groups = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("_n"), F.sum(w * F.col("y")).alias("_pos"), F.sum(w * (1 - F.col("y"))).alias("_neg"), *sums)
    if ordered:
        key = F.struct(*by) if by else F.lit(0)
        per = df.groupBy(*by, "p").agg(F.sum(w * F.col("y")).alias("pos"), F.sum(w * (1 - F.col("y"))).alias("neg")).withColumns({"_key": key, "_down": -F.col("p")})
        run = runnings(per, {"tp": (F.col("pos"), "sum"), "fp": (F.col("neg"), "sum")}, "_key", F.floor(F.col("_down") * BUCKETS), "_down")
        groups = _joined(groups, run.groupBy(*by).agg(*[F.sum(x).alias(f"_{m.name}_{part}") for m in ordered for part, x in m.parts.items()]), by)

    def value(m: Metric) -> Column:
        got = m.finish(lambda part: F.col(f"_{part}") if part in ("n", "pos", "neg") else F.col(f"_{m.name}_{part}"))
        return F.when((F.col("_pos") > 0) & (F.col("_neg") > 0), got) if both_classes else got

    return groups.select(*by, "n", F.col("_pos").alias("n_pos"), F.try_divide("_pos", "_n").alias("base_rate"), *[value(m).alias(m.name) for m in wanted])


def with_bands(df: DataFrame, metrics: list[str], unit: str, replicates: int, seed: int = 1, block: int | None = None, by: tuple[str, ...] = (), min_rows: int = 1, min_pos: int = 1, level: float = LEVEL) -> DataFrame:
    """evaluate() of groups with enough rows and positives and both classes, each metric with _low and _high, its bounds over bootstrap replicates (resampling.resampled, whose unit and block these are), and n_effective, the replicates that had both classes."""
    points = evaluate(df, metrics, by).filter((F.col("n") >= min_rows) & (F.col("n_pos") >= min_pos) & (F.col("n_pos") < F.col("n")))
    kept = _joined(df, points.select(*by), by) if by else df
    samples = evaluate(resampled(kept, unit, replicates, seed, block), metrics, (*by, "replicate"), "w")
    at = {"low": (1 - level) / 2, "high": (1 + level) / 2}
    # a group has as many values as replicates
    bounds = samples.groupBy(*by).agg(F.count(metrics[0]).alias("n_effective"), *[F.percentile(m, q).alias(f"{m}_{end}") for m in metrics for end, q in at.items()])
    return _joined(points, bounds, by)


def by_regime(df: DataFrame, regime: str, metrics: list[str], unit: str, replicates: int, parts: int = 3, **how) -> DataFrame:
    """with_bands() of each equal-frequency part of a column."""
    return with_bands(df.withColumn("part", audits.bucket(F.col(regime), audits.cuts(df, regime, parts))).filter("part is not null"), metrics, unit, replicates, by=("part",), **how)


def rolling(df: DataFrame, ts: str, window_days: int, step_days: int, metrics: list[str], unit: str, replicates: int, **how) -> DataFrame:
    """with_bands() of each window of time."""
    return with_bands(audits.time_windows(df, ts, window_days, step_days), metrics, unit, replicates, by=("window_start", "window_end"), **how)
