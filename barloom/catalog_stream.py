"""Queries of the stream: the events table is replayed in files, with what goes wrong in a feed, and compared with SQL over the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalog import _BARS, _BASE, _families, _near, _r, query, rounded
from barloom.operators import features
from barloom.plans.tables import new_path
from barloom.sources import bars as bar_source
from barloom.streaming.guards import Guard
from barloom.streaming.session import read_rows, stream_features

#: Hours of a slice, which is replayed as one file of bars and one of slower values.
SLICE = 180
MAX_GAP, WARMUP, STREAM_BLOCK, MAX_AGE, STREAM_HORIZON, STREAM_BARRIER = 24, 30, 8, 36, 6, 0.4
GUARD = Guard(max_gap=MAX_GAP, warmup=WARMUP, block=STREAM_BLOCK, restart=True, horizon=STREAM_HORIZON, barrier=STREAM_BARRIER, snapshots=("rate", "interest"), max_age=MAX_AGE * 3600, context=("p",))
STREAM_WINDOWS = (5, 10)
_done: dict[tuple[str, str], str] = {}


def _hour(ts: str):
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") / 3_600_000_000)


def feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars as a bad feed sends them, and slower values, with the slice that each comes in: bars are missing, contradict themselves, and come again a slice later."""
    bars = bar_source.to_bars(bar_source.trades(spark, sf_dir)).withColumn("h", _hour("ts"))
    bars = bars.filter(((F.col("h") * 7 + F.length("symbol") * 3) % 10 != 0) & ~((F.length("symbol") == 4) & (F.col("h") % 240).between(100, 139)))
    bars = bars.withColumns(
        {
            "high": F.when(F.col("h") % 11 == 3, F.col("close") * 0.999).otherwise(F.col("high")),
            "taker_buy_base": F.when(F.col("h") % 13 == 5, F.col("volume") * 2).otherwise(F.col("taker_buy_base")),
            "volume": F.when(F.col("h") % 29 == 7, -F.col("volume")).otherwise(F.col("volume")),
            "p": (F.col("h") % 100) / 100.0,
        }
    )
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value is not null and event_id % 5 = 0 or event_id % 7 = 0")
    slower = events.groupBy(F.col("event_type").alias("symbol"), "ts").agg(F.max(F.expr("case when event_id % 5 = 0 then value end")).alias("rate"), F.max(F.expr("case when event_id % 7 = 0 then cast(event_id % 100 as double) end")).alias("interest"))
    first = bars.agg(F.min("h").alias("h")).first().h or 0
    at = F.floor((F.col("h") - first) / SLICE)
    again = F.when(F.col("h") % 17 == 0, F.array(at, at + 1)).otherwise(F.array(at))
    return bars.withColumn("slice", F.explode(again)).drop("h"), slower.withColumn("slice", F.greatest(F.floor((_hour("ts") - first) / SLICE), F.lit(0)))


def replay(spark: SparkSession, sf_dir: str) -> str:
    """Run the feed through the stream, a slice a micro-batch, and give the folder of its results; once in an application for each sf_dir."""
    key = spark.sparkContext.applicationId, sf_dir
    if key in _done:
        return _done[key]
    top = new_path(spark, "replay")
    bars, slower = feed(spark, sf_dir)
    bars, slower = bars.persist(), slower.persist()
    for n in range((bars.agg(F.max("slice")).first()[0] or 0) + 1):
        bars.filter(F.col("slice") == n).drop("slice").coalesce(1).write.mode("append").parquet(f"{top}/bars")
        slower.filter(F.col("slice") == n).drop("slice").coalesce(1).write.mode("append").parquet(f"{top}/slower")
    bars.unpersist(), slower.unpersist()
    # few symbols and small files: the state's partitions, fixed when a stream begins, are as few
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", 4)
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    stream_features(session, f"{top}/bars", f"{top}/out", f"{top}/state", ["rolling"], STREAM_WINDOWS, guard=GUARD, snapshots_dir=f"{top}/slower").awaitTermination()
    _done[key] = f"{top}/out"
    return _done[key]


_SENT = f"""{_BARS},
sent0 AS (SELECT *, epoch(ts)::BIGINT // 3600 AS h FROM raw),
sent AS (
  SELECT symbol, ts, h, open, CASE WHEN h % 11 = 3 THEN close * 0.999 ELSE high END AS high, low, close, CASE WHEN h % 29 = 7 THEN -volume ELSE volume END AS volume,
         quote_volume, num_trades, CASE WHEN h % 13 = 5 THEN volume * 2 ELSE taker_buy_base END AS taker_buy_base, (h % 100) / 100.0 AS p
  FROM sent0 WHERE (h * 7 + length(symbol) * 3) % 10 <> 0 AND NOT (length(symbol) = 4 AND h % 240 BETWEEN 100 AND 139)),
sliced AS (SELECT *, (h - min(h) OVER ()) // {SLICE} AS slice, least(open, high, low, close) > 0 AS good FROM sent),
mended AS (
  SELECT symbol, ts, h, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close, greatest(volume, 0) AS volume, quote_volume, num_trades, least(taker_buy_base, greatest(volume, 0)) AS taker_buy_base, p,
         high < greatest(open, close) OR low > least(open, close) OR volume < 0 OR taker_buy_base > greatest(volume, 0) AS repaired
  FROM sliced WHERE good),
cut AS (SELECT *, h - lag(h) OVER (PARTITION BY symbol ORDER BY h) - 1 > {MAX_GAP} AS wide FROM mended),
parts AS (SELECT *, sum(CASE WHEN wide THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY h) AS segment FROM cut),
hours AS (SELECT symbol, segment, min(h) AS h0, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM parts GROUP BY symbol, segment),
guarded AS (
  SELECT g.symbol, g.ts, g.segment::BIGINT AS segment, epoch(g.ts)::BIGINT // 3600 - h0 AS k, p.close IS NULL AS filled, coalesce(repaired, false) AS repaired,
         epoch(g.ts)::BIGINT // 3600 - h0 + 1 - ({STREAM_BLOCK} - h0 % {STREAM_BLOCK}) % {STREAM_BLOCK} >= {WARMUP} AS ready,
         last_value(p.close IGNORE NULLS) OVER (PARTITION BY g.symbol, g.segment ORDER BY g.ts) AS seen, p.* EXCLUDE (symbol, ts, h, segment, repaired, wide)
  FROM hours g LEFT JOIN parts p ON g.symbol = p.symbol AND g.segment = p.segment AND g.ts = p.ts),
whole AS (
  SELECT symbol, ts, segment, k, filled, repaired, ready, p, coalesce(open, seen) AS open, coalesce(high, seen) AS high, coalesce(low, seen) AS low, seen AS close, coalesce(volume, 0) AS volume,
         coalesce(quote_volume, 0) AS quote_volume, coalesce(num_trades, 0) AS num_trades, coalesce(taker_buy_base, 0) AS taker_buy_base FROM guarded)"""

_SLOWER = """, slower AS (
  SELECT event_type AS symbol, ts, max(CASE WHEN event_id % 5 = 0 THEN value END) AS rate, max(CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 100 AS DOUBLE) END) AS interest
  FROM events WHERE value IS NOT NULL AND event_id % 5 = 0 OR event_id % 7 = 0 GROUP BY 1, 2),
both_sides AS (SELECT symbol, ts, 0 AS side, NULL AS segment, rate, interest FROM slower UNION ALL SELECT symbol, ts, 1, segment, NULL, NULL FROM whole),
known AS (
  SELECT *, last_value(rate IGNORE NULLS) OVER w AS rate_then, last_value(CASE WHEN rate IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS rate_at,
         last_value(interest IGNORE NULLS) OVER w AS interest_then, last_value(CASE WHEN interest IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS interest_at
  FROM both_sides WINDOW w AS (PARTITION BY symbol ORDER BY ts, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
joined AS (
  SELECT symbol, ts, CASE WHEN ts - rate_at <= INTERVAL {age} HOUR THEN rate_then END AS rate, CASE WHEN ts - interest_at <= INTERVAL {age} HOUR THEN interest_then END AS interest FROM known WHERE side = 1)""".format(age=MAX_AGE)


@query(
    "stream_grid",
    f"""WITH {_SENT} SELECT symbol, ts, segment, k, filled, repaired, ready, {", ".join(f"{_r(c)} AS {c}" for c in ("open", "high", "low", "close", "volume", "num_trades", "taker_buy_base"))} FROM whole""",
)
def stream_grid(spark, sf_dir: str) -> DataFrame:
    return rounded(read_rows(spark, replay(spark, sf_dir), "bar").select("symbol", "ts", "segment", "k", "filled", "repaired", "ready", "open", "high", "low", "close", "volume", "num_trades", "taker_buy_base"))


@query("stream_as_of", f"WITH {_SENT}{_SLOWER} SELECT symbol, ts, {_r('rate')} AS rate, {_r('interest')} AS interest FROM joined")
def stream_as_of(spark, sf_dir: str) -> DataFrame:
    return rounded(read_rows(spark, replay(spark, sf_dir), "bar").select("symbol", "ts", "rate", "interest"))


@query(
    "stream_rejects",
    f"""WITH {_SENT}, resent AS (SELECT symbol, ts, h, good, slice + 1 AS slice FROM sliced WHERE h % 17 = 0),
    known_until AS (SELECT r.symbol, r.ts, r.good, (SELECT max(s.ts) FROM sliced s WHERE s.symbol = r.symbol AND s.good AND s.slice < r.slice) AS last FROM resent r)
    SELECT symbol, ts, CASE WHEN NOT good THEN 'price' WHEN ts = last THEN 'repeated' ELSE 'late' END AS reason FROM known_until
    UNION ALL SELECT symbol, ts, 'price' FROM sliced WHERE NOT good""",
)
def stream_rejects(spark, sf_dir: str) -> DataFrame:
    return read_rows(spark, replay(spark, sf_dir), "reject").select("symbol", "ts", "reason")


@query(
    "stream_labels",
    f"""WITH {_SENT}, ahead AS (
      SELECT symbol, ts AS entry_ts, segment, p, close, max(high) OVER w AS best, count(*) OVER w AS n, max(ts) OVER w AS ts FROM whole
      WINDOW w AS (PARTITION BY symbol, segment ORDER BY k ROWS BETWEEN 1 FOLLOWING AND {STREAM_HORIZON} FOLLOWING))
    SELECT symbol, entry_ts, ts, segment, {_r("p")} AS p, {_r("ln(best / close)")} AS m_k, CAST(ln(best / close) >= {STREAM_BARRIER} AS INTEGER) AS y FROM ahead WHERE n = {STREAM_HORIZON}""",
)
def stream_labels(spark, sf_dir: str) -> DataFrame:
    return rounded(read_rows(spark, replay(spark, sf_dir), "label").select("symbol", "entry_ts", "ts", "segment", "p", "m_k", "y"))


_STREAM_BARS = f"{_SENT}, stream_bars AS (SELECT symbol || '#' || segment AS symbol, ts, filled, ready, k, open, high, low, close, volume, quote_volume, num_trades, taker_buy_base FROM whole)"
_STREAM_BASE = _BASE.replace(_BARS, _STREAM_BARS).replace("FROM bars),\nb1 AS", "FROM stream_bars),\nb1 AS")
_ROLLING = _families(STREAM_WINDOWS)["rolling"]


@query("stream_features", f"WITH {_STREAM_BASE}, made AS (SELECT symbol, k, ready, {', '.join(f'{e} AS {chr(34)}{n}{chr(34)}' for n, e in _ROLLING.items())} FROM x) SELECT symbol, k, {_near(_ROLLING)} FROM made WHERE ready")
def stream_features_query(spark, sf_dir: str) -> DataFrame:
    made = spark.read.parquet(f"{replay(spark, sf_dir)}/features")
    names = [f.name(w) for f in features.select("rolling") for w in STREAM_WINDOWS]
    return rounded(made.select(F.concat("symbol", F.lit("#"), "segment").alias("symbol"), "k", *names))
