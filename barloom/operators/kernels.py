"""Windowed series that no single frame function gives: recursions, drawups, pivots, patterns, curves. All are window expressions.

Each takes a DataFrame with the rows' keys and order and adds columns; steps that build on each other are projections of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import EPS, root, Rows, settled, with_windows

#: A carried value that has decayed to this share is nothing beside double precision's reach two chunks on.
_FADED = 1e-12


@dataclass(frozen=True)
class Recursion:
    """y = alpha * x + (1 - alpha) * y of the row before, from row start on, where y is seed (x itself if there is none). x must not be null from start on."""

    name: str
    x: Column
    alpha: float
    seed: Column | None = None
    start: int = 0


def recursive_means(df: DataFrame, wanted: list[Recursion], rows: Rows | None = None) -> DataFrame:
    """df with all the recursive means, made side by side.

    A recursion is no frame, but it fades: rows are cut into chunks long enough for what is carried through one to shrink to 1e-12.
    Within a chunk the sum is a running sum of inversely weighted values; what comes before is the last value of the chunk before (and, shrunk
    once, of the one before that). So a chunk is a task's unit, not a series.
    """
    rows = rows or Rows()
    sizes = [max(8, math.ceil(math.log(_FADED) / math.log(1 - r.alpha))) for r in wanted]
    # x may itself look at other rows, so it is a column of its own first
    df = df.withColumns({f"_x{i}": r.x for i, r in enumerate(wanted)} | {f"_seed{i}": r.x if r.seed is None else r.seed for i, r in enumerate(wanted)})
    at = [F.col(rows.order) - r.start for r in wanted]
    df = df.withColumns({f"_chunk{i}": F.floor(at[i] / n) for i, n in enumerate(sizes)})
    df = df.withColumns({f"_place{i}": (at[i] - F.col(f"_chunk{i}") * n).cast("double") for i, n in enumerate(sizes)})
    local = {}
    for i, r in enumerate(wanted):
        value = F.when(at[i] == 0, F.col(f"_seed{i}")).when(at[i] > 0, r.alpha * F.col(f"_x{i}"))
        own = Window.partitionBy(*rows.keys, f"_chunk{i}").orderBy(rows.order).rowsBetween(Window.unboundedPreceding, 0)
        place = F.col(f"_place{i}")
        local[f"_local{i}"] = F.when(at[i] >= 0, F.sum(value * F.pow(F.lit(1 - r.alpha), -place)).over(own) * F.pow(F.lit(1 - r.alpha), place))
    df = made = df.withColumns(local)
    same = [F.col(c).eqNullSafe(F.col(f"_k{j}")) for j, c in enumerate(rows.keys)]
    for i, (r, n) in enumerate(zip(wanted, sizes)):
        keep = 1 - r.alpha
        ends = df.filter(F.col(f"_place{i}") == n - 1).select(*[F.col(c).alias(f"_k{j}") for j, c in enumerate(rows.keys)], (F.col(f"_chunk{i}") + 1).alias("_next"), F.col(f"_local{i}").alias("_end"))
        by = Window.partitionBy(*[f"_k{j}" for j in range(len(rows.keys))]).orderBy("_next")
        ends = ends.withColumn("_end", F.col("_end") + keep**n * F.coalesce(F.lag("_end").over(by), F.lit(0.0)))
        made = made.join(ends, [*same, F.col(f"_chunk{i}") == F.col("_next")], "left")
        y = F.col(f"_local{i}") + F.coalesce(F.col("_end"), F.lit(0.0)) * F.pow(F.lit(keep), F.col(f"_place{i}") + 1)
        made = made.withColumn(r.name, y).drop("_next", "_end", *[f"_k{j}" for j in range(len(rows.keys))])
    return made.drop(*[f"_{c}{i}" for i in range(len(wanted)) for c in ("x", "seed", "chunk", "place", "local")])


def recursive_mean(df: DataFrame, name: str, x: Column, alpha: float, seed: Column | None = None, start: int = 0, rows: Rows | None = None) -> DataFrame:
    return recursive_means(df, [Recursion(name, x, alpha, seed, start)], rows)


def by_span(name: str, x: Column, span: float) -> Recursion:
    return Recursion(name, x, 2 / (span + 1))


def by_half_life(name: str, x: Column, half_life: float) -> Recursion:
    return Recursion(name, x, 1 - 2 ** (-1 / half_life))


def ewm(df: DataFrame, name: str, x: Column, span: float | None = None, half_life: float | None = None, rows: Rows | None = None) -> DataFrame:
    return recursive_means(df, [by_span(name, x, span) if span is not None else by_half_life(name, x, half_life)], rows)


def rsi(df: DataFrame, name: str, w: int, rows: Rows | None = None) -> DataFrame:
    """Wilder's RSI of r, seeded at row w with the mean of rows 1..w; a null return counts as 0."""
    rows = rows or Rows()
    r = F.coalesce(F.col("r"), F.lit(0.0))
    df = df.withColumns({"_gain": F.when(r > 0, r).otherwise(0.0), "_loss": F.when(r < 0, -r).otherwise(0.0)})
    df = recursive_means(df, [Recursion(f"{side}_mean", F.col(side), 1 / w, F.avg(side).over(rows.frame(w)), w) for side in ("_gain", "_loss")], rows)
    ratio = F.col("_gain_mean") / (F.col("_loss_mean") + EPS)
    return df.withColumn(name, 100 - 100 / (1 + ratio)).drop("_gain", "_loss", "_gain_mean", "_loss_mean")


def permutation_entropy(df: DataFrame, name: str, x: Column, w: int, rows: Rows | None = None) -> DataFrame:
    """Normalised entropy of the orders of three consecutive values over w rows; null with fewer than 30 patterns or a gap."""
    rows = rows or Rows()
    if w - 2 < 30:
        return df.withColumn(name, F.lit(None).cast("double"))
    a, b = rows.lag(x, 2), rows.lag(x, 1)
    # of equal values the earlier one counts as smaller
    code = F.when(a.isNotNull() & b.isNotNull() & x.isNotNull(), F.when(a > b, 4).otherwise(0) + F.when(b > x, 2).otherwise(0) + F.when(a > x, 1).otherwise(0))
    df = df.withColumn("_code", code)
    # codes 1 and 6 contradict themselves and never occur
    seen = [c for c in range(8) if c not in (1, 6)]
    df = df.withColumns({f"_code{c}": F.when(F.col("_code").isNotNull(), F.when(F.col("_code") == c, 1.0).otherwise(0.0)) for c in seen})
    df = with_windows(df, rows, {f"_share{c}": rows.mean(f"_code{c}", w - 2) for c in seen})
    part = lambda s: F.when(s > 1e-9, -s * F.ln(s)).otherwise(F.when(s.isNotNull(), 0.0))
    entropy = sum((part(F.col(f"_share{c}")) for c in seen), F.lit(0.0)) / math.log(6)
    return df.withColumn(name, entropy).drop("_code", *[f"_{n}{c}" for c in seen for n in ("code", "share")])


def drawups(df: DataFrame, up: str, down: str, x: Column, w: int, rows: Rows | None = None) -> DataFrame:
    """Largest rise from an earlier low, and largest fall from an earlier high, within w rows.

    A window is put together from runs of 1, 2, 4, .. rows: of two neighbouring ones the rise is the larger of theirs and the later high less the
    earlier low. That takes log2(w) steps, whatever w.
    """
    rows = rows or Rows()
    together = lambda a, b: F.when(
        a.isNotNull() & b.isNotNull(),
        F.struct(
            F.least(a.lo, b.lo).alias("lo"), F.greatest(a.hi, b.hi).alias("hi"), F.greatest(a.up, b.up, b.hi - a.lo).alias("up"), F.greatest(a.down, b.down, a.hi - b.lo).alias("down")
        ),
    )
    df = df.withColumn("_run", F.when(x.isNotNull(), F.struct(x.alias("lo"), x.alias("hi"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))))
    size, done, found = 1, 0, False
    while size <= w:
        if w & size:
            # this run lies before the rows that are done
            part = F.lag("_run", done).over(rows.spec) if done else F.col("_run")
            df = df.withColumn("_part", part)
            df = df.withColumn("_all", together(F.col("_part"), F.col("_all")) if found else F.col("_part"))
            done, found = done + size, True
        df = df.withColumn("_before", F.lag("_run", size).over(rows.spec)).withColumn("_run", together(F.col("_before"), F.col("_run")))
        size *= 2
    return df.withColumns({up: F.col("_all.up"), down: F.col("_all.down")}).drop("_run", "_part", "_all", "_before")


def pivots(df: DataFrame, q: int, w: int, horizon: int, rows: Rows | None = None) -> DataFrame:
    """Distance to, and age of, the last swing low and high that q rows on either side confirm; none within w rows: no distance, age w."""
    rows = rows or Rows()
    around = rows.spec.rowsBetween(-q, q)
    df = with_windows(df, rows, {"_scale": root(rows.mean("rs", w)) * math.sqrt(horizon) + EPS})
    scale = F.col("_scale")
    for side, x, best, sign in (("low", F.col("ln_low"), F.min, 1), ("high", F.col("ln_high"), F.max, -1)):
        is_pivot = (F.count(x).over(around) == 2 * q + 1) & (x == best(x).over(around))
        df = df.withColumn("_pivot", F.when(is_pivot, F.struct(F.col(rows.order).alias("k"), x.alias("x"))))
        df = df.withColumn("_confirmed", F.lag("_pivot", q).over(rows.spec)).withColumn("_last", rows.last_known(F.col("_confirmed")))
        age = F.col(rows.order) - F.col("_last.k")
        df = df.withColumns(
            {
                f"pivot__last_{side}_dist_z__f__w{w}__q{q}": F.when(age <= w, sign * (F.col("p") - F.col("_last.x")) / scale),
                f"pivot__last_{side}_age__f__w{w}__q{q}": F.when(age <= w, age.cast("double")).otherwise(float(w)),
            }
        ).drop("_pivot", "_confirmed", "_last")
    return df.drop("_scale")


def drawups_at(df: DataFrame, up: str, down: str, x: Column, w: int, every: int, rows: Rows | None = None) -> DataFrame:
    """drawups() on rows whose number is divisible by every, null on the others."""
    rows = rows or Rows()
    df = drawups(df, up, down, x, w, rows)
    here = F.col(rows.order) % every == 0
    return df.withColumns({c: F.when(here, F.col(c)) for c in (up, down)})


def ewm_features(df: DataFrame, half_lives: Iterable[int], spans: Iterable[tuple[int, int]], horizon: int, funding_span: int | None = None, rows: Rows | None = None) -> DataFrame:
    """df with the features of recursive means, all made side by side.

    By half life: the means of price and squared return up to the row before, and the price's distance from the one in units of the other. By pair of spans: the difference of two
    means of the log price. funding_span: the mean of the funding rate in per cent.
    """
    rows, half_lives, spans = rows or Rows(), list(half_lives), list(spans)
    square = F.coalesce(F.col("r") * F.col("r"), F.lit(0.0))
    wanted = [x for h in half_lives for x in (by_half_life(f"_price{h}", F.col("p"), h), by_half_life(f"_square{h}", square, h))]
    wanted += [by_span(f"_span{n}", F.col("p"), n) for n in sorted({n for pair in spans for n in pair})]
    if funding_span:
        wanted.append(by_span(f"funding__ewma__f__w{funding_span}", F.col("funding_rate") * 100, funding_span))
    df = recursive_means(df, wanted, rows)
    mu, sigma = "eq__mu_ewm__f__h{}".format, "eq__sigma_r_ewm__f__h{}".format
    df = df.withColumns({mu(h): rows.lag(f"_price{h}") for h in half_lives} | {sigma(h): F.sqrt(rows.lag(f"_square{h}")) for h in half_lives})
    made = {f"eq__ewm_innov_hz__f__h{h}": settled(F.col("p") - F.col(mu(h))) / (F.col(sigma(h)) * math.sqrt(horizon) + EPS) for h in half_lives}
    made |= {f"logp__ema_spread__f__w0__fast{a}__slow{b}": F.col(f"_span{a}") - F.col(f"_span{b}") for a, b in spans}
    return df.withColumns(made).drop(*[w.name for w in wanted if w.name.startswith("_")])


def derivatives_base(df: DataFrame) -> DataFrame:
    """Basis and futures flow of bars joined with a futures series."""
    basis = F.col("close_fut") - F.col("close")
    return df.withColumns(
        {
            "basis_abs": basis,
            "basis_pct": F.when(F.col("close") > 0, basis / F.col("close") * 100),
            "tb_ratio_fut": F.when(F.col("volume_fut") > 0, F.col("taker_buy_base_fut") / F.col("volume_fut")),
            "net_vol_fut": 2 * F.col("taker_buy_base_fut") - F.col("volume_fut"),
        }
    )
