"""Rule-based strategies over score paths: candidate entries with their exits, the ledger of those that are taken, and reports on ledgers.

Where a position would be closed depends on the rows after its entry only, so every candidate's exit is a forward window, in blocks of rows. Which candidates are taken
depends on the positions that are open; that choice alone is sequential, over the pairs (entry row, exit row) of one symbol and strategy. Everything about a finished
ledger is plain aggregation.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from barloom.functions.order import WaveletMatrix
from barloom.functions.rolling import Rows, safe_log_ratio
from barloom.operators.audits import bucket, cuts
from barloom.operators.passage import Ahead, by_series, numbers
from barloom.plans.blocks import BLOCK_ROWS, in_blocks, previous, running
from barloom.plans.intervals import interval_join
from barloom.plans.quantiles import quantiles
from barloom.plans.shipping import ship

LEDGER = ("symbol", "strategy", "k_entry", "k_exit", "entry_price", "exit_price", "size", "exit_reason", "gross_log_return", "p_entry")


@dataclass(frozen=True)
class Strategy:
    """Enter long at the close where p reaches threshold, unless max_open positions are open; leave at a log return of take or -stop, or after horizon rows."""

    name: str
    threshold: float
    take: float
    stop: float
    horizon: int
    max_open: int = 1
    size: float = 1.0


def candidates(path: DataFrame, strategies: list[Strategy], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """LEDGER's columns and max_open of every row that a strategy would enter at, were no position open; k_exit is null where the rows end before.

    Where a row reaches both barriers the stop counts. A missing score opens nothing.
    """
    longest = max(s.horizon for s in strategies)
    ship(path.sparkSession)
    schema = f"symbol {path.schema['symbol'].dataType.simpleString()}, spec int, k_entry long, k_exit long, entry_price double, hit int, exit_close double, p_entry double"
    names = [c.split()[0] for c in schema.split(", ")]

    def exits(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        close, high, low, p = (numbers(table, c) for c in ("close", "high", "low", "p"))
        k, own = table.column("k").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
        above, below = Ahead(high), Ahead(-low)
        found = []
        for n, s in enumerate(strategies):
            at = np.flatnonzero(own & (p >= s.threshold))
            take, stop = close[at] * math.exp(s.take), close[at] * math.exp(-s.stop)
            took = above.first(at, lambda v, level=take: v >= level, s.horizon)
            stopped = below.first(at, lambda v, level=stop: -v <= level, s.horizon) if s.stop > 0 else np.zeros(len(at), np.int64)
            ends = np.where(at + s.horizon < len(k), s.horizon, 0)
            never = longest + 1
            rows = np.minimum.reduce([np.where(x > 0, x, never) for x in (took, stopped, ends)])
            hit = np.where(rows == never, -1, np.where(stopped == rows, 0, np.where(took == rows, 1, 2)))
            out = np.minimum(at + rows, len(k) - 1)
            done = hit >= 0
            found.append([np.full(len(at), n), k[at], np.where(done, k[out], -1), close[at], hit, np.where(done, close[out], np.nan), p[at]])
        columns = [np.concatenate(c) for c in zip(*found)]
        symbol = pa.array([table.column("symbol")[0].as_py()] * len(columns[0]), table.schema.field("symbol").type)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([symbol, *[pa.array(c, from_pandas=True).cast(t) for c, t in zip(columns, kinds)]], names=names)

    def work(df: DataFrame, rows: Rows) -> DataFrame:
        own = F.col("_block") == F.floor(F.col("k") / block_rows)
        # in_blocks() keeps the rows of a block's own; these all are
        made = df.withColumn("own", own).groupBy(*rows.keys).applyInArrow(exits, schema)
        return made.withColumn("k", F.col("k_entry")).withColumn("_block", F.floor(F.col("k") / block_rows))

    rows = in_blocks(path.select("symbol", "k", "close", "high", "low", "p"), work, 0, block_rows, ahead=longest)
    of = lambda name: F.element_at(F.array(*[F.lit(getattr(s, name)) for s in strategies]), F.col("spec") + 1)
    hit, entry = F.col("hit"), F.col("entry_price")
    price = F.when(hit == 0, entry * F.exp(-of("stop"))).when(hit == 1, entry * F.exp(of("take"))).when(hit == 2, F.col("exit_close"))
    reason = F.when(hit == 0, "sl").when(hit == 1, "tp").when(hit == 2, "expiry")
    return rows.select(
        "symbol", of("name").alias("strategy"), "k_entry", F.when(hit >= 0, F.col("k_exit")).alias("k_exit"), "entry_price", price.alias("exit_price"), of("size").alias("size"),
        reason.alias("exit_reason"), safe_log_ratio(price, "entry_price").alias("gross_log_return"), "p_entry", of("max_open").alias("max_open"),
    )


def taken(entries: np.ndarray, exits: np.ndarray, most: int) -> np.ndarray:
    """Which of the entries, in order, find fewer than most positions open; exits are done before entries of the same row."""
    open_: list[int] = []
    out = np.zeros(len(entries), bool)
    for i, (a, b) in enumerate(zip(entries.tolist(), exits.tolist())):
        while open_ and open_[0] <= a:
            heapq.heappop(open_)
        if len(open_) < most:
            heapq.heappush(open_, b)
            out[i] = True
    return out


def _choose(table: pa.Table) -> pa.Table:
    table = table.sort_by("k_entry")
    exits = table.column("k_exit").fill_null(np.iinfo(np.int64).max).to_numpy()
    return table.filter(pa.array(taken(table.column("k_entry").to_numpy(), exits, table.column("max_open")[0].as_py())))


def simulate(path: DataFrame, strategies: list[Strategy], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Closed positions of every strategy on rows (symbol, k, close, high, low, p); positions open at the end stay out."""
    ship(path.sparkSession)
    found = candidates(path, strategies, block_rows)
    chosen = found.groupBy("symbol", "strategy").applyInArrow(_choose, found.schema)
    return chosen.filter("k_exit is not null").select(*LEDGER)


def report(ledger: DataFrame, cost: float = 0.0, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Trades, share that took profit, net return, its deviation per trade (n - 1) and the ratio of mean to it."""
    net = (F.col("gross_log_return") - cost) * F.col("size")
    return ledger.groupBy(*by).agg(
        F.count("*").alias("trades"),
        (F.count_if(F.col("exit_reason") == "tp") / F.count("*")).alias("hit_rate"),
        F.sum(net).alias("net_return"),
        F.stddev_samp(net).alias("per_trade_std"),
        F.try_divide(F.avg(net), F.stddev_samp(net)).alias("sharpe"),
        F.avg((F.col("k_exit") - F.col("k_entry")).cast("double")).alias("mean_held"),
    )


def composition(ledger: DataFrame) -> DataFrame:
    """Trades and gross return by strategy and exit reason."""
    return ledger.groupBy("strategy", "exit_reason").agg(F.count("*").alias("trades"), F.sum("gross_log_return").alias("gross"))


def open_book(ledger: DataFrame, path: DataFrame, edges: list[float], width: int = 512) -> DataFrame:
    """What is open at each row of path (symbol, k, close) for each of the symbol's strategies: n_open, sum_mtm and worst_mtm (log returns at the row's close, unweighted) and in_bin_0, .., the positions by their return.

    A position is open from its entry row to its exit row, both included. Bins are [edge, next edge); what lies beyond the edges is in the first or last bin. Positions without a price above zero, and rows without a
    close above zero, count nowhere. Rows without open positions have zeros and no worst_mtm. Positions and rows meet by an interval join, so a long position is no long task.
    """
    if len(edges) < 2:
        raise ValueError("edges must bound one bin at least")
    held = ledger.filter("entry_price > 0").select("symbol", "strategy", "k_entry", "k_exit", "entry_price")
    steps = path.select("symbol", "k", "close").join(ledger.select("symbol", "strategy").distinct(), "symbol")
    met = interval_join(steps, held, ["symbol", "strategy"], "k", "k_entry", "k_exit", width)
    met = met.withColumn("mtm", safe_log_ratio("close", "entry_price")).filter("mtm is not null")
    place = sum((F.when(F.col("mtm") >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    bins = range(len(edges) - 1)
    per = met.groupBy("symbol", "strategy", "k").agg(F.count("*").alias("n_open"), F.sum("mtm").alias("sum_mtm"), F.min("mtm").alias("worst_mtm"), *[F.count_if(place == n).alias(f"in_bin_{n}") for n in bins])
    zero = ["n_open", "sum_mtm", *[f"in_bin_{n}" for n in bins]]
    return steps.drop("close").join(per, ["symbol", "strategy", "k"], "left").fillna(0, zero)


def _by_exit(ledger: DataFrame) -> DataFrame:
    """Realised return of each strategy per exit row."""
    return ledger.groupBy("strategy", "k_exit").agg(F.sum(F.col("gross_log_return") * F.col("size")).alias("step"))


def equity(ledger: DataFrame, rows_in_bucket: int = 1000) -> DataFrame:
    """strategy, k_exit, and the realised return up to and with the positions that exit there."""
    return running(_by_exit(ledger), "equity", F.col("step"), "strategy", F.floor(F.col("k_exit") / rows_in_bucket), "k_exit").select("strategy", "k_exit", "equity")


def drawdown(ledger: DataFrame, rows_in_bucket: int = 1000) -> DataFrame:
    """Largest fall of each strategy's realised return from its earlier high, which starts at zero."""
    run = running(equity(ledger, rows_in_bucket), "high", F.col("equity"), "strategy", F.floor(F.col("k_exit") / rows_in_bucket), "k_exit", "max")
    run = run.withColumn("fall", F.greatest("high", F.lit(0.0)) - F.col("equity"))
    return run.groupBy("strategy").agg(F.max("fall").alias("max_drawdown"), F.max_by("equity", "k_exit").alias("final_return"))


def headline(ledger: DataFrame, steps_a_year: float, cost: float = 0.0) -> DataFrame:
    """report() with the Sharpe ratio of the returns per exit row over a year of so many steps, and the largest fall; best first."""
    per = _by_exit(ledger.withColumn("gross_log_return", F.col("gross_log_return") - cost)).groupBy(F.col("strategy").alias("s")).agg(F.when((F.count("*") >= 2) & (F.stddev_samp("step") > 1e-12), F.avg("step") / F.stddev_samp("step") * math.sqrt(steps_a_year)).alias("annual_sharpe"))
    falls = drawdown(ledger).select(F.col("strategy").alias("d"), "max_drawdown")
    joined = report(ledger, cost).join(per, F.col("strategy") == F.col("s")).join(falls, F.col("strategy") == F.col("d")).drop("s", "d")
    return joined.orderBy(F.desc_nulls_last("annual_sharpe"))


def regime_attribution(ledger: DataFrame, regime: str, cost: float = 0.0, parts: int = 3) -> DataFrame:
    """Trades, share that took profit, and mean and total net return in equal-frequency parts of a column of the ledger."""
    net = (F.col("gross_log_return") - cost) * F.col("size")
    return ledger.withColumn("part", bucket(F.col(regime), cuts(ledger, regime, parts))).groupBy("part").agg(
        F.count("*").alias("trades"), (F.count_if(F.col("exit_reason") == "tp") / F.count("*")).alias("hit_rate"), F.avg(net).alias("mean_net"), F.sum(net).alias("net")
    )


def clusters(ledger: DataFrame, rows_in_bucket: int = 1000) -> DataFrame:
    """Runs of overlapping positions of a symbol and strategy: first and last row, positions, net return and how the last one ended.

    Positions are merged by their intervals; a position that starts where all others have ended begins a cluster.
    """
    # islands in two levels: how far the positions before reach, and how many clusters have begun
    df = ledger.withColumns({"_series": F.struct("symbol", "strategy"), "_order": F.struct("k_entry", "k_exit")})
    bucket_ = F.floor(F.col("k_entry") / rows_in_bucket)
    df = running(df, "_upto", F.col("k_exit"), "_series", bucket_, "_order", "max")
    df = previous(df, "_reach", F.col("_upto"), "_series", bucket_, "_order")
    df = df.withColumn("_starts", F.when(F.col("_reach").isNull() | (F.col("k_entry") >= F.col("_reach")), 1).otherwise(0))
    df = running(df, "cluster", F.col("_starts"), "_series", bucket_, "_order")
    return df.groupBy("symbol", "strategy", "cluster").agg(
        F.min("k_entry").alias("k_first"), F.max("k_exit").alias("k_last"), F.count("*").alias("entries"), F.sum(F.col("gross_log_return") * F.col("size")).alias("pnl"), F.max_by("exit_reason", F.struct("k_exit", "k_entry")).alias("end_reason")
    )


def cluster_summary(log: DataFrame) -> DataFrame:
    """Per strategy: clusters, their duration, entries and returns, and how they ended."""
    held = (F.col("k_last") - F.col("k_first")).cast("double")
    middle = quantiles(log, held, [0.5], ("strategy",)).select(F.col("strategy").alias("_s"), F.get("q", F.lit(0)).alias("median_duration"))
    per = log.groupBy("strategy").agg(
        F.count("*").alias("n_clusters"), F.avg(held).alias("mean_duration"), F.avg("entries").alias("mean_entries"), F.avg("pnl").alias("mean_pnl"), F.max("pnl").alias("max_pnl"),
        F.min("pnl").alias("min_pnl"), *[F.count_if(F.col("end_reason") == r).alias(f"n_{r}") for r in ("tp", "sl", "expiry")],
    )
    return per.join(middle, F.col("strategy") == F.col("_s")).drop("_s")


def time_to_take(ledger: DataFrame, bars: DataFrame, take: float, look_ahead: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """ledger with held (rows to the exit) and would_take (rows until the high reaches the entry price times e^take, within look_ahead; null if it does not, or if there is no bar at the entry).

    Entries meet the block of bars that their row is in, which also holds the look_ahead rows after it.
    """
    ship(ledger.sparkSession)
    names = ledger.columns
    block = F.floor(F.col("k_entry") / block_rows)
    entries = ledger.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("entry"), F.col("symbol").alias("_s"), block.alias("_b"), "k_entry", "entry_price")
    path = bars.select(F.col("symbol").alias("_s"), "k", "high").withColumn("_b", F.explode(F.sequence(F.floor(F.greatest(F.col("k") - look_ahead, F.lit(0)) / block_rows), F.floor(F.col("k") / block_rows))))

    def run(found: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        k, at = rows.column("k").to_numpy(), found.column("k_entry").to_numpy()
        place = np.searchsorted(k, at)
        there = (place < len(k)) & (k[np.minimum(place, len(k) - 1)] == at) if len(k) else np.zeros(len(at), bool)
        level = numbers(found, "entry_price") * math.exp(take)
        hit = np.zeros(len(at), np.int64)
        hit[there] = Ahead(numbers(rows, "high")).first(place[there], lambda v: v >= level[there], look_ahead)
        return pa.Table.from_arrays([found.column("entry"), pa.array(np.where(hit > 0, hit, np.nan), from_pandas=True).cast(pa.int64())], names=["entry", "would_take"])

    schema = StructType([entries.schema["entry"], StructField("would_take", LongType())])
    met = entries.groupBy("_s", "_b").cogroup(path.groupBy("_s", "_b")).applyInArrow(run, schema)
    return met.select("entry.*", (F.col("entry.k_exit") - F.col("entry.k_entry")).alias("held"), "would_take")


def time_to_take_summary(df: DataFrame) -> DataFrame:
    """Of the positions that did not take profit: how many would have, and after how many rows."""
    late = F.when(F.col("exit_reason") != "tp", F.col("would_take"))
    other, shares = F.count_if(F.col("exit_reason") != "tp"), (0.25, 0.5, 0.75, 0.95)
    cuts = quantiles(df, late, list(shares), ("strategy",)).select(F.col("strategy").alias("_s"), *[F.get("q", F.lit(i)).alias(f"rows_p{round(100 * q)}") for i, q in enumerate(shares)])
    per = df.groupBy("strategy").agg(
        F.count("*").alias("n_closed"), F.count_if(F.col("exit_reason") == "tp").alias("n_tp"), other.alias("n_other"), F.count(late).alias("n_eventually"), F.coalesce(F.try_divide(F.count(late), other), F.lit(0.0)).alias("share_eventually"),
    )
    return per.join(cuts, F.col("strategy") == F.col("_s")).drop("_s")


def entry_rank(ledger: DataFrame, bars: DataFrame, reach: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """ledger with entry_rank: the share of the other closes within reach rows of the entry that are below it; null where there is no other."""

    def work(df: DataFrame, rows: Rows) -> DataFrame:
        def make(table: pa.Table) -> dict[str, np.ndarray]:
            close = numbers(table, "close")
            at = np.arange(len(close))
            lo, hi = np.maximum(at - reach, 0), np.minimum(at + reach + 1, len(close))
            there = np.concatenate([[0], np.cumsum(~np.isnan(close))])
            others = there[hi] - there[lo] - 1
            # below is at most the next smaller double
            below = WaveletMatrix(close).count_at_most(lo, hi, np.nextafter(close, -np.inf))
            return {"entry_rank": np.where((others > 0) & ~np.isnan(close), below / np.maximum(others, 1), np.nan)}

        return by_series(df, rows, make, [StructField("entry_rank", DoubleType())])

    path = in_blocks(bars.select("symbol", "k", "close"), work, reach, block_rows, ahead=reach).select(F.col("symbol").alias("_s"), F.col("k").alias("_k"), "entry_rank")
    return ledger.join(path, (F.col("symbol") == F.col("_s")) & (F.col("k_entry") == F.col("_k"))).drop("_s", "_k")


def trade_sample(ledger: DataFrame, each: int, seed: int = 0) -> DataFrame:
    """Of every strategy the trades with the best and the worst returns and some at random, so many each, with the group that chose them."""
    # returns that differ in rounding only are equal
    earned = F.round("gross_log_return", 9)
    groups = {"best": earned.desc(), "worst": earned.asc(), "random": F.md5(F.concat_ws("|", F.lit(str(seed)), "symbol", F.col("k_entry").cast("string")))}
    out = None
    for name, by in groups.items():
        order = Window.partitionBy("strategy").orderBy(by, "symbol", "k_entry")
        part = ledger.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each).withColumn("chosen", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.drop("place")


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """Log return of each symbol from its first to its last close."""
    per = bars.groupBy("symbol").agg(F.min_by("close", "ts").alias("first"), F.max_by("close", "ts").alias("last"))
    return per.select("symbol", safe_log_ratio("last", "first").alias("log_return"))
