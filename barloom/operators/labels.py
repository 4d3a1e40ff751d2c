"""Forward barrier labels, label memory, sample weights and purged splits.

Everything is a window over rows (symbol, k), or an aggregate and an equi-join: no positional joins and no pairwise overlaps. Rows are those of a grid, numbered by k without
gaps. Functions that take rows work in blocks (plans.blocks) as well as over whole series; those that look back without end take two levels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import Rows, safe_log_ratio, with_windows
from barloom.operators.passage import barrier_ahead
from barloom.plans.blocks import BLOCK_ROWS, carry, in_blocks, previous, running
from barloom.plans.quantiles import quantiles


def barrier_labels(bars: DataFrame, horizon: int, barrier: float, price: str = "high", rows: Rows | None = None) -> DataFrame:
    """bars with m_k, the best log return over the next horizon bars, y (whether it reaches the barrier) and tau_k, the bars until it does.

    The last horizon bars have no label. A window with a missing price has y = 0 and no m_k.
    """
    df = barrier_ahead(bars, rows or Rows(), horizon, barrier, price)
    mature = F.col("_rows") == horizon
    df = df.withColumn("m_k", F.when(mature & (F.col("_prices") == horizon), safe_log_ratio("_best", "close")))
    y = F.when(mature, F.when(F.col("m_k") >= barrier, 1).otherwise(0))
    return df.withColumn("y", y).withColumn("tau_k", F.when(F.col("y") == 1, F.col("_tau"))).withColumn("phi", F.lit(float(barrier))).drop("_rows", "_prices", "_best", "_tau")


def past_target(labelled: DataFrame, horizon: int, windows: tuple[int, ...], rows: Rows | None = None) -> DataFrame:
    """Memory of mature labels: the last one, and hit rates over windows (of what is there)."""
    rows = rows or Rows()
    df = labelled.withColumn("hit__prev", rows.lag(F.col("y"), horizon).cast("double"))
    rates = {f"hit__rate__h__w{w}": F.avg("hit__prev").over(rows.frame(w)) for w in windows}
    return df.withColumns(rates)


def since_hit(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df (from past_target) with hit__since, the rows since the last mature hit."""
    df = carry(df, "_hit", F.when(F.col("hit__prev") == 1, F.col("k")), "symbol", F.floor(F.col("k") / block_rows), "k")
    return df.withColumn("hit__since", F.col("k") - F.col("_hit")).drop("_hit")


def target_autocorrelation(labelled: DataFrame, horizon: int, w: int, lags: tuple[int, ...], rows: Rows | None = None) -> DataFrame:
    """Rolling correlation of mature labels with earlier ones; a window not longer than a lag and one row has none."""
    rows = rows or Rows()
    df = labelled.withColumn("_mature", rows.lag(F.col("y"), horizon).cast("double"))
    df = df.withColumns({f"_lag{n}": rows.lag(F.col("_mature"), n) for n in lags})
    return with_windows(df, rows, {f"hit__acf{n}__h__w{w}": rows.corr("_mature", f"_lag{n}", w) if w > n + 1 else F.lit(None).cast("double") for n in lags}).drop("_mature", *[f"_lag{n}" for n in lags])


def block_features(bars: DataFrame, size: int) -> DataFrame:
    """One row per symbol and block of size bars (block 0 is the first bar alone): its range, return and volume, and the block before's return."""
    block = F.ceil(F.col("k") / size).alias("block")
    per = bars.groupBy("symbol", block).agg(
        F.max("high").alias("block_high"), F.min("low").alias("block_low"), F.sum("volume").alias("block_volume"), F.min_by("open", "k").alias("block_open"), F.max_by("close", "k").alias("block_close")
    )
    order = Window.partitionBy("symbol").orderBy("block")
    ret = safe_log_ratio("block_close", "block_open")
    return per.withColumn("block_ret", ret).withColumn("block_ret_prev", F.lag(ret).over(order))


def quality_flags(bars: DataFrame, rows: Rows | None = None) -> DataFrame:
    """bars with byte flags for impossible prices and for gaps before a bar."""
    rows = rows or Rows()
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.least("open", "high", "low", "close") <= 0)
    gap = F.coalesce(F.col("ts") != F.lag("ts").over(rows.spec) + F.expr("interval 1 hour"), F.lit(False))
    return bars.withColumns({"data__bad_ohlc__f__w0": F.coalesce(bad, F.lit(True)).cast("byte"), "data__gap__f__w0": gap.cast("byte")})


def impute(df: DataFrame, fills: dict[str, float], flagged: Sequence[str] | None = None) -> DataFrame:
    """Fill what is missing and flag it in undef__ columns.

    They are made for the columns in flagged, whatever the rows are; without it for columns with anything missing only, which takes a pass.
    """
    if flagged is None:
        gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in fills]).first().asDict() if fills else {}
        flagged = [c for c, n in gaps.items() if n]
    flags = {f"undef__{c}": F.col(c).isNull().cast("byte") for c in flagged}
    return df.withColumns(flags).withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def distance_weights(labelled: DataFrame, strength: float = 1.0, cap: float = 4.0, q: float = 0.5) -> DataFrame:
    """w_distance: exponential in how far beyond the class's q-quantile of distance from the barrier a row lies, capped."""
    rows = labelled.filter("m_k is not null").withColumn("distance", F.abs(F.col("m_k") - F.col("phi")))
    scale = quantiles(rows, "distance", [q], ("y",)).select("y", F.get("q", F.lit(0)).alias("scale"))
    weight = F.exp(F.least(strength * F.col("distance") / F.when(F.col("scale") > 0, F.col("scale")), F.lit(math.log(cap))))
    return rows.join(F.broadcast(scale), "y").withColumn("w_distance", F.coalesce(weight, F.lit(1.0))).drop("scale")


def _ranked(df: DataFrame) -> DataFrame:
    """df with _rank, the row's number within its symbol, and _n, the symbol's rows."""
    ends = df.groupBy(F.col("symbol").alias("_symbol")).agg(F.min("k").alias("_low"), F.count("*").alias("_n"))
    return df.join(ends, F.col("symbol") == F.col("_symbol")).withColumn("_rank", F.col("k") - F.col("_low")).drop("_symbol", "_low")


def time_weights(labelled: DataFrame, oldest: float = 0.5, decay: float = 0.99) -> DataFrame:
    """w_time: geometric decay over the oldest part of each symbol's rows, the older the less; 1 for the others."""
    df = _ranked(labelled)
    return df.withColumn("w_time", F.pow(F.lit(decay), F.greatest(F.floor(F.col("_n") * oldest) - F.col("_rank"), F.lit(0)).cast("double"))).drop("_rank", "_n")


def training_weights(labelled: DataFrame, normalize: bool = False, **options) -> DataFrame:
    """w: the product of w_distance and w_time, on request scaled to a mean of 1."""
    df = distance_weights(time_weights(labelled), **options).withColumn("w", F.col("w_distance") * F.col("w_time"))
    if normalize:
        df = df.crossJoin(F.broadcast(df.agg(F.avg("w").alias("_mean")))).withColumn("w", F.col("w") / F.col("_mean")).drop("_mean")
    return df


def uniqueness(labelled: DataFrame, horizon: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """symbol, k and u: the mean of 1 / (labels that cover a bar) over the bars k + 1 .. k + horizon that a label looks at.

    A bar is covered by the labels of the horizon rows before it, so overlaps are counted without a join of labels with each other.
    """

    def work(df: DataFrame, rows: Rows) -> DataFrame:
        df = df.withColumn("_cover", F.count("y").over(rows.spec.rowsBetween(-horizon, -1)))
        share = F.when(F.col("_cover") > 0, 1 / F.col("_cover")).otherwise(0.0)
        return df.withColumn("u", F.sum(share).over(rows.spec.rowsBetween(1, horizon)) / horizon)

    made = in_blocks(labelled.select("symbol", "k", "y"), work, 2 * horizon, block_rows, ahead=horizon)
    return made.filter("y is not null").select("symbol", "k", "u")


def purged_split(labelled: DataFrame, horizon: int, train: float = 0.7, val: float = 0.15, embargo: int = 0) -> DataFrame:
    """split of every row in time order per symbol: train, val or test; null where its label overlaps the next part, or in an embargo after one.

    Parts are contiguous, so only the rows up to horizon before a cut can overlap what follows: intervals that touch do not.
    """
    df = _ranked(labelled).withColumnRenamed("_rank", "_i").withColumn("_a", F.bround(F.col("_n") * train, 0)).withColumn("_b", F.bround(F.col("_n") * (train + val), 0))
    part = F.when(F.col("_i") < F.col("_a"), "train").when(F.col("_i") < F.col("_b"), "val").otherwise("test")
    cut = lambda c: (F.col("_i") < F.col(c)) & (F.col("_i") > F.col(c) - horizon)
    late = lambda c: (F.col("_i") >= F.col(c)) & (F.col("_i") < F.col(c) + embargo)
    return df.withColumn("split", F.when(~(cut("_a") | cut("_b") | late("_a") | late("_b")), part)).drop("_i", "_n", "_a", "_b")


def streaks(df: DataFrame, x: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """event__run_*: direction, length and sum of the current run of equal signs; zero and null end a run and belong to none."""
    bucket = F.floor(F.col("k") / block_rows)
    df = df.withColumn("_sign", F.when(x > 0, 1).when(x < 0, -1).otherwise(0)).withColumn("_x", F.coalesce(x, F.lit(0.0)))
    df = previous(df, "_before", F.col("_sign"), "symbol", bucket, "k")
    df = running(df, "_total", F.col("_x"), "symbol", bucket, "k")
    starts = (F.col("_sign") != F.coalesce("_before", F.lit(0))) | (F.col("_sign") == 0)
    df = carry(df, "_start", F.when(starts, F.struct("k", (F.col("_total") - F.col("_x")).alias("total"))), "symbol", bucket, "k")
    live = F.col("_sign") != 0
    length = F.when(live, F.col("k") - F.col("_start.k") + 1).otherwise(0).cast("int")
    total = F.when(live, F.col("_total") - F.col("_start.total")).otherwise(0.0)
    return df.withColumns({"event__run_dir__f__w0": F.col("_sign").cast("byte"), "event__run_len__f__w0": length, "event__run_cumret__f__w0": total}).drop("_sign", "_x", "_before", "_total", "_start")
