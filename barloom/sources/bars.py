"""Regular-grid bars: built from trades, repaired, validated, joined as-of with slower series.

Scale: aggregation into bars pre-aggregates before its shuffle. The grid of a symbol is generated, numbers included, from its first and last bar, so missing minutes are
never looked for pairwise. The last close before a gap and as-of values are found in two levels, so a long series is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.rolling import Rows, safe_log_ratio
from barloom.plans.blocks import BLOCK_ROWS, carry, previous

PRICES = ("open", "high", "low", "close")
#: Steps of a grid that are made from one array.
STRETCH = 4096
AMOUNTS = ("volume", "quote_volume", "num_trades", "taker_buy_base")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: symbol (event type), ts, price, quantity and whether the taker bought."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value is not null")
    return events.select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), (1 + F.col("event_id") % 10).cast("double").alias("qty"), (F.col("event_id") % 2 == 0).alias("taker_buys"))


def to_bars(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """One bar per symbol and unit of time that has trades; trades of one instant are in order of event_id."""
    at = F.struct("ts", "event_id")
    return ticks.groupBy("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("qty").alias("volume"),
        F.sum(F.col("price") * F.col("qty")).alias("quote_volume"),
        F.count("*").cast("double").alias("num_trades"),
        F.coalesce(F.sum(F.when(F.col("taker_buys"), F.col("qty"))), F.lit(0.0)).alias("taker_buy_base"),
    )


def clean(bars: DataFrame) -> DataFrame:
    """NaN and infinite numbers become null, once and for all."""
    fix = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c)
    return bars.select(*[fix(c) if t == "double" else F.col(c) for c, t in bars.dtypes])


def fill_grid(bars: DataFrame, step: str = "1 hour", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every step between a symbol's first and last bar; what is missing is a flat bar at the last close without volume.

    filled marks such bars; k numbers a symbol's bars from 0.
    """
    ends = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    # stretches first, dealt out, then the steps of each, so that no array holds a whole series
    stretch = F.expr(f"interval {step} * {STRETCH}")
    starts = ends.select("symbol", "b", F.posexplode(F.sequence("a", "b", stretch)).alias("_stretch", "_from")).repartition("symbol", "_stretch")
    upto = F.least(F.col("b"), F.col("_from") + F.expr(f"interval {step} * {STRETCH - 1}"))
    grid = starts.select("symbol", "_stretch", F.posexplode(F.sequence("_from", upto, F.expr(f"interval {step}"))).alias("_place", "ts"))
    grid = grid.select("symbol", (F.col("_stretch") * STRETCH + F.col("_place")).alias("k"), "ts")
    joined = grid.join(bars, ["symbol", "ts"], "left").withColumn("filled", F.col("close").isNull())
    joined = carry(joined, "_last", F.col("close"), "symbol", F.floor(F.col("k") / block_rows), "k")
    prices = {c: F.when(F.col("filled"), F.col("_last")).otherwise(F.col(c)) for c in PRICES}
    amounts = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in AMOUNTS if c in bars.columns}
    return joined.withColumns(prices | amounts).drop("_last")


def validate(bars: DataFrame) -> DataFrame:
    """Counts of what is wrong with the bars of each symbol."""
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.col("low")) | (F.least(*PRICES) <= 0)
    zero = F.col("volume") == 0
    gaps = previous(bars, "_before", F.col("ts"), "symbol", F.date_trunc("week", "ts"), "ts").withColumn("late", F.col("ts") > F.col("_before") + F.expr("interval 1 hour"))
    return gaps.groupBy("symbol").agg(
        F.count("*").alias("n_bars"),
        F.count_if(bad).alias("n_bad"),
        F.count_if(zero).alias("n_empty"),
        (F.count("*") - F.count_distinct("ts")).alias("n_repeated"),
        F.count_if("late").alias("n_gaps"),
    )


def as_of(left: DataFrame, right: DataFrame, columns: list[str], key: str = "symbol", ts: str = "ts", bucket: str = "week", within: str | None = None) -> DataFrame:
    """Each left row with the columns of the last right row of its key at or before its ts, or none if that is more than within (an interval) ago.

    Both sides are ordered together, in buckets of time, and the right side's last row is carried on, so there is no range join.
    """
    extra = [F.col(f"`{c}`") for c in left.columns]
    found = F.struct(F.col(ts).alias("_at"), *columns)
    a = left.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*extra).alias("_left"), F.lit(None).cast(right.select(found.alias("s")).schema["s"].dataType).alias("_right"))
    b = right.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), found.alias("_right"))
    both = carry(a.unionByName(b), "_found", F.col("_right"), "_k", F.date_trunc(bucket, "_t"), ["_t", "_side"]).filter("_side = 1")
    fresh = F.lit(True) if within is None else F.col("_found._at") >= F.col("_t") - F.expr(f"interval {within}")
    return both.select("_left.*", *[F.when(fresh, F.col(f"_found.{c}")).alias(c) for c in columns])


def _log(x: Column, when: Column | None = None) -> Column:
    return F.when(x > 0 if when is None else when, F.ln(x))


def base_series(bars: DataFrame, rows: Rows | None = None) -> DataFrame:
    """bars with the series that features are made of; null wherever one is undefined."""
    order = (rows or Rows()).spec
    spread = F.col("high") - F.col("low")
    per_range = lambda x: F.when(spread > 0, x / spread)
    per_volume = lambda x: F.when(F.col("volume") > 0, x / F.col("volume"))
    before = F.lag("close").over(order)
    first = bars.withColumns(
        {
            "p": _log(F.col("close")),
            "rho": safe_log_ratio("high", "low", F.col("high") > F.col("low")),
            "r_oc": safe_log_ratio("close", "open"),
            "g": safe_log_ratio("open", before),
            "logvol": F.log1p("volume"),
            "logtrades": F.log1p("num_trades"),
            "logquotevol": F.log1p("quote_volume"),
            "b": per_volume(F.col("taker_buy_base")),
            "clv": per_range(2 * F.col("close") - F.col("high") - F.col("low")),
            "bodyfrac": per_range(F.abs(F.col("close") - F.col("open"))),
            "wickup": per_range(F.col("high") - F.greatest("open", "close")),
            "wickdn": per_range(F.least("open", "close") - F.col("low")),
            "vwap": per_volume(F.col("quote_volume")),
            "qpertrade": F.when(F.col("num_trades") > 0, F.col("quote_volume") / F.col("num_trades")),
        }
    )
    return first.withColumns(
        {
            "r": F.col("p") - F.lag("p").over(order),
            "ofi": 2 * F.col("b") - 1,
            "vwapdev": safe_log_ratio("close", "vwap"),
        }
    )


def kline_rows(rows: DataFrame, column: str = "kline") -> DataFrame:
    """Typed bars of an exchange's rows (arrays of strings: open time in ms, four prices, volume, close time in ms, quote volume, trades, taker volume).

    What is no number becomes null. A bar whose close time is null is not closed and goes; of several rows of one time the last closed one counts.
    """
    at = lambda i, kind: F.get(column, F.lit(i)).try_cast(kind)
    ms = lambda i: F.timestamp_millis(at(i, "bigint")).cast("timestamp_ntz")
    keep = [c for c in rows.columns if c != column]
    names = {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "quote_volume": 7, "num_trades": 8, "taker_buy_base": 9}
    typed = rows.select(*[F.col(f"`{c}`") for c in keep], ms(0).alias("open_time"), ms(6).alias("ts"), *[at(i, "double").alias(c) for c, i in names.items()])
    by = [*keep, "open_time"]
    best = typed.filter("ts is not null and open_time is not null").groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.max_by(F.struct("ts", *names), F.struct("ts", "volume")).alias("bar"))
    return clean(best.select(*[F.col(f"`{c}`") for c in by], "bar.*"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired hourly bars of every symbol."""
    return fill_grid(clean(to_bars(trades(spark, sf_dir))))
