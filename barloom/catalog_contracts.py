"""Queries of contracts and of the versioned store, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.catalog import _BARS, query
from barloom.plans.tables import new_path
from barloom.sources import bars as bar_source
from barloom.sources.contracts import Column, Contract
from barloom.sources.store import Store

EVENTS = Contract("events", (Column("event_id", "bigint", nullable=False), Column("value", "double", nullable=False, low=1.0, high=200.0), Column("event_type", "string", values=("click", "view", "purchase", "signup")), Column("props", nullable=False)))
ORDERS = Contract("orders", (Column("o_orderkey", nullable=False, low=1), Column("o_totalprice", low=1000.0, high=400_000.0), Column("o_orderstatus", values=("O", "F")), Column("o_custkey", high=1000)))
#: Raw bars: hours without trades are gaps.
BARS = Contract("bars", (*[Column(c, "double", nullable=False, low=0.5) for c in ("open", "high", "low", "close")], Column("volume", low=6.0)), key="symbol", time="ts", step=3600, bucket_steps=100)


def _counts(table: str, rules: dict[tuple[str, str], str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{rule}' AS rule, count(*) FILTER ({sql}) AS n FROM {table}""" for (c, rule), sql in rules.items())


_EVENT_RULES = {
    ("event_id", "null"): "event_id IS NULL", ("value", "null"): "value IS NULL", ("value", "not finite"): "NOT isfinite(value)", ("value", "below"): "value < 1", ("value", "above"): "value > 200",
    ("event_type", "not listed"): "event_type NOT IN ('click', 'view', 'purchase', 'signup')", ("props", "null"): "props IS NULL",
}
_ORDER_RULES = {
    ("o_orderkey", "null"): "o_orderkey IS NULL", ("o_orderkey", "below"): "o_orderkey < 1", ("o_totalprice", "not finite"): "NOT isfinite(o_totalprice)", ("o_totalprice", "below"): "o_totalprice < 1000", ("o_totalprice", "above"): "o_totalprice > 400000",
    ("o_orderstatus", "not listed"): "o_orderstatus NOT IN ('O', 'F')", ("o_custkey", "above"): "o_custkey > 1000",
}
_BAR_RULES = {(c, rule): sql for c in ("open", "high", "low", "close") for rule, sql in (("null", f"{c} IS NULL"), ("not finite", f"NOT isfinite({c})"), ("below", f"{c} < 0.5"))} | {
    ("volume", "not finite"): "NOT isfinite(volume)", ("volume", "below"): "volume < 6", ("ts", "repeated"): "ts = before", ("ts", "off grid"): "epoch(ts)::BIGINT % 3600 <> 0", ("ts", "after a gap"): "ts - before > INTERVAL 1 HOUR",
}
_MARKED = f"{_BARS}, twice AS (SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE hour(ts) % 5 = 2), marked AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM twice)"


def _twice(spark, sf_dir: str) -> DataFrame:
    bars = bar_source.to_bars(bar_source.trades(spark, sf_dir))
    return bars.unionByName(bars.filter(F.hour("ts") % 5 == 2))


@query("contract_events", _counts("events", _EVENT_RULES))
def contract_events(spark, sf_dir: str) -> DataFrame:
    return EVENTS.check(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("contract_orders", _counts("orders", _ORDER_RULES))
def contract_orders(spark, sf_dir: str) -> DataFrame:
    return ORDERS.check(spark.read.parquet(f"{sf_dir}/orders.parquet"))


@query("contract_bars", f"WITH {_MARKED} {_counts('marked', _BAR_RULES)}")
def contract_bars(spark, sf_dir: str) -> DataFrame:
    return BARS.check(_twice(spark, sf_dir))


@query(
    "contract_rejects",
    f"""WITH {_MARKED}, r AS (SELECT symbol, ts, list_filter([{", ".join(f"CASE WHEN {sql} THEN '{c}: {rule}' END" for (c, rule), sql in _BAR_RULES.items() if rule != "after a gap")}], lambda x: x IS NOT NULL) AS broken FROM marked)
    SELECT symbol, ts, array_to_string(broken, ', ') AS broken FROM r WHERE len(broken) > 0""",
)
def contract_rejects(spark, sf_dir: str) -> DataFrame:
    _, bad = BARS.route(_twice(spark, sf_dir))
    return bad.select("symbol", "ts", F.array_join("broken", ", ").alias("broken"))


@query("store_append", f"WITH {_BARS} SELECT symbol, ts, open, close, volume FROM raw")
def store_append(spark, sf_dir: str) -> DataFrame:
    """Bars appended in weeks, each of which sends two days of the one before again, and one batch twice."""
    bars = bar_source.to_bars(bar_source.trades(spark, sf_dir)).select("symbol", "ts", "open", "close", "volume").persist()
    store = Store(spark, new_path(spark, "store"), ("ts", "symbol"))
    first, last = bars.agg(F.min("ts"), F.max("ts")).first()
    step, overlap = F.expr("interval 7 days"), F.expr("interval 2 days")
    weeks = (last - first).days // 7 + 1 if first else 0
    for n in range(weeks):
        begin = F.lit(first) + step * n
        week = bars.filter((F.col("ts") >= begin - overlap) & (F.col("ts") < begin + step))
        for _ in range(2 if n == 1 else 1):
            store.append(week, f"week {n}")
    bars.unpersist()
    return store.load() if weeks else bars
