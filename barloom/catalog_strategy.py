"""Queries of strategies, ledgers, resampling, audits and curves, with their SQL."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.catalog import _BARS, _BINS, _SCORES, _WILSON_HIGH, _WILSON_LOW, BLOCK, _r, query, rounded
from barloom.operators import audits, policy, resampling, scores, strategy
from barloom.plans.blocks import in_blocks
from barloom.sources import bars as bar_source

STRATEGIES = [
    strategy.Strategy("threshold_expiry", 0.6, 0.5, 0.0, 8),
    strategy.Strategy("tp_sl", 0.55, 0.4, 0.4, 12, max_open=2),
    strategy.Strategy("patient", 0.7, 0.8, 0.6, 24, max_open=3, size=0.5),
]


# ---- strategies ----------------------------------------------------------------------------------------------------------------


def _path(spark, sf_dir: str) -> DataFrame:
    p = F.round(F.pmod(F.col("k") * 37 + F.length("symbol") * 11, F.lit(100)) / 100, 2)
    return bar_source.hourly(spark, sf_dir).withColumn("p", p)


def _ledger(spark, sf_dir: str) -> DataFrame:
    return strategy.simulate(_path(spark, sf_dir), STRATEGIES, BLOCK)


_SPECS = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::{'DOUBLE' if isinstance(v, float) else 'INTEGER'}" for v in asdict(x).values()) + ")" for x in STRATEGIES) + ") t(strategy, threshold, take, stop, horizon, max_open, size)"
_LEDGER = f"""{_BARS}, path AS (SELECT *, round(((k * 37 + length(symbol) * 11) % 100) / 100, 2) AS p,
  list({{'k': k, 'high': high, 'low': low, 'close': close}}) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS ahead FROM bars),
specs AS ({_SPECS}),
entries AS (SELECT symbol, s.strategy, k, close, p, size, max_open, close * exp(take) AS tp, CASE WHEN stop > 0 THEN close * exp(-stop) END AS sl, horizon, ahead FROM path, specs s WHERE p >= threshold),
exits AS (SELECT * EXCLUDE (ahead), list_filter(ahead, lambda r: coalesce(r.low <= sl, false) OR r.high >= tp OR r.k >= k + horizon)[1] AS o FROM entries),
found AS (
  SELECT symbol, strategy, k AS k_entry, o.k AS k_exit, close AS entry_price, size, p AS p_entry, max_open,
         CASE WHEN o IS NOT NULL THEN CASE WHEN coalesce(o.low <= sl, false) THEN sl WHEN o.high >= tp THEN tp ELSE o.close END END AS exit_price,
         CASE WHEN o IS NOT NULL THEN CASE WHEN coalesce(o.low <= sl, false) THEN 'sl' WHEN o.high >= tp THEN 'tp' ELSE 'expiry' END END AS exit_reason,
         row_number() OVER (PARTITION BY symbol, strategy ORDER BY k) AS i FROM exits),
walk AS (
  SELECT symbol, strategy, 0::BIGINT AS i, []::BIGINT[] AS held, false AS took FROM (SELECT DISTINCT symbol, strategy FROM found)
  UNION ALL
  SELECT f.symbol, f.strategy, f.i, CASE WHEN len(list_filter(w.held, lambda e: e > f.k_entry)) < f.max_open THEN list_append(list_filter(w.held, lambda e: e > f.k_entry), coalesce(f.k_exit, 9000000000)::BIGINT) ELSE list_filter(w.held, lambda e: e > f.k_entry) END,
         len(list_filter(w.held, lambda e: e > f.k_entry)) < f.max_open
  FROM walk w JOIN found f ON w.symbol = f.symbol AND w.strategy = f.strategy AND f.i = w.i + 1),
ledger AS (
  SELECT f.*, CASE WHEN exit_price > 0 AND entry_price > 0 THEN ln(exit_price / entry_price) END AS gross_log_return FROM found f JOIN walk w ON f.symbol = w.symbol AND f.strategy = w.strategy AND f.i = w.i WHERE w.took AND f.k_exit IS NOT NULL)"""


def _of_ledger(name: str, sql: str):
    return query(name, f"WITH RECURSIVE {_LEDGER}{sql}")


@_of_ledger(
    "sim_baseline",
    f" SELECT symbol, strategy, k_entry, k_exit, {_r('entry_price')} AS entry_price, {_r('exit_price')} AS exit_price, size, exit_reason, {_r('gross_log_return')} AS gross_log_return, p_entry FROM ledger",
)
def sim_baseline(spark, sf_dir: str) -> DataFrame:
    return rounded(_ledger(spark, sf_dir))


_NET = "(gross_log_return - 0.001) * size"


@_of_ledger(
    "sim_report",
    f""" SELECT strategy, count(*) AS trades, {_r("count(*) FILTER (exit_reason = 'tp') / count(*)")} AS hit_rate, {_r(f"sum({_NET})")} AS net_return, {_r(f"stddev_samp({_NET})")} AS per_trade_std,
    {_r(f"avg({_NET}) / stddev_samp({_NET})")} AS sharpe, {_r("avg(k_exit - k_entry)")} AS mean_held FROM ledger GROUP BY strategy""",
)
def sim_report(spark, sf_dir: str) -> DataFrame:
    return rounded(strategy.report(_ledger(spark, sf_dir), cost=0.001))


@_of_ledger("sim_composition", f" SELECT strategy, exit_reason, count(*) AS trades, {_r('sum(gross_log_return)')} AS gross FROM ledger GROUP BY 1, 2")
def sim_composition(spark, sf_dir: str) -> DataFrame:
    return rounded(strategy.composition(_ledger(spark, sf_dir)))


BOOK_EDGES = [-0.5, -0.2, 0.0, 0.2, 0.5]
_BOOK_BINS = [*[f"mtm < {e}" for e in BOOK_EDGES[1:-1]], "true"]


@_of_ledger(
    "sim_open_book",
    f""", steps AS (SELECT b.symbol, l.strategy, b.k, b.close FROM bars b JOIN (SELECT DISTINCT symbol, strategy FROM ledger) l ON b.symbol = l.symbol),
    met AS (SELECT s.symbol, s.strategy, s.k, CASE WHEN s.close > 0 THEN ln(s.close / l.entry_price) END AS mtm FROM steps s JOIN ledger l ON s.symbol = l.symbol AND s.strategy = l.strategy AND s.k BETWEEN l.k_entry AND l.k_exit WHERE l.entry_price > 0),
    binned AS (SELECT *, CASE {" ".join(f"WHEN {c} THEN {n}" for n, c in enumerate(_BOOK_BINS))} END AS bin FROM met WHERE mtm IS NOT NULL),
    per AS (SELECT symbol, strategy, k, count(*) AS n_open, sum(mtm) AS sum_mtm, min(mtm) AS worst_mtm, {", ".join(f"count(*) FILTER (bin = {n}) AS in_bin_{n}" for n in range(len(BOOK_EDGES) - 1))} FROM binned GROUP BY 1, 2, 3)
    SELECT s.symbol, s.strategy, s.k, coalesce(n_open, 0) AS n_open, {_r("coalesce(sum_mtm, 0)")} AS sum_mtm, {_r("worst_mtm")} AS worst_mtm, {", ".join(f"coalesce(in_bin_{n}, 0) AS in_bin_{n}" for n in range(len(BOOK_EDGES) - 1))}
    FROM steps s LEFT JOIN per p ON s.symbol = p.symbol AND s.strategy = p.strategy AND s.k = p.k""",
)
def sim_open_book(spark, sf_dir: str) -> DataFrame:
    return rounded(strategy.open_book(_ledger(spark, sf_dir), bar_source.hourly(spark, sf_dir), BOOK_EDGES, width=4))


_EQUITY = """, step AS (SELECT strategy, k_exit, sum(gross_log_return * size) AS step FROM ledger GROUP BY 1, 2), eq AS (SELECT strategy, k_exit, step, sum(step) OVER (PARTITION BY strategy ORDER BY k_exit) AS equity FROM step),
  fall AS (SELECT *, greatest(max(equity) OVER (PARTITION BY strategy ORDER BY k_exit), 0) - equity AS fall FROM eq)"""


@_of_ledger("sim_equity", f"{_EQUITY} SELECT strategy, k_exit, {_r('equity')} AS equity FROM eq")
def sim_equity(spark, sf_dir: str) -> DataFrame:
    return rounded(strategy.equity(_ledger(spark, sf_dir), 100))


@_of_ledger("sim_drawdown", f"{_EQUITY} SELECT strategy, {_r('max(fall)')} AS max_drawdown, {_r('arg_max(equity, k_exit)')} AS final_return FROM fall GROUP BY 1")
def sim_drawdown(spark, sf_dir: str) -> DataFrame:
    return rounded(strategy.drawdown(_ledger(spark, sf_dir), 100))


@_of_ledger(
    "sim_headline",
    f"""{_EQUITY}, net AS (SELECT strategy, k_exit, sum({_NET}) AS step FROM ledger GROUP BY 1, 2), y AS (SELECT strategy, avg(step) / stddev_samp(step) * sqrt(8760.0) AS annual_sharpe FROM net GROUP BY 1),
    d AS (SELECT strategy, max(fall) AS max_drawdown FROM fall GROUP BY 1)
    SELECT l.strategy, count(*) AS trades, {_r("count(*) FILTER (exit_reason = 'tp') / count(*)")} AS hit_rate, {_r(f"sum({_NET})")} AS net_return, {_r(f"stddev_samp({_NET})")} AS per_trade_std, {_r(f"avg({_NET}) / stddev_samp({_NET})")} AS sharpe,
    {_r("avg(k_exit - k_entry)")} AS mean_held, {_r("any_value(annual_sharpe)")} AS annual_sharpe, {_r("any_value(max_drawdown)")} AS max_drawdown FROM ledger l JOIN y ON l.strategy = y.strategy JOIN d ON l.strategy = d.strategy GROUP BY 1""",
)
def sim_headline(spark, sf_dir: str) -> DataFrame:
    return rounded(strategy.headline(_ledger(spark, sf_dir), 8760.0, cost=0.001))


_EDGES = ", c AS (SELECT list_distinct(quantile_cont(p_entry, [1 / 3::DOUBLE, 2 / 3::DOUBLE])) AS qs, max(p_entry) AS top FROM ledger)"


@_of_ledger(
    "sim_regimes",
    f"{_EDGES} SELECT CAST(len(list_filter(qs, lambda q: q < top AND p_entry > q)) AS INTEGER) AS part, count(*) AS trades, {_r(chr(99) + 'ount(*) FILTER (exit_reason = ' + chr(39) + 'tp' + chr(39) + ') / count(*)')} AS hit_rate, {_r(f'avg({_NET})')} AS mean_net, {_r(f'sum({_NET})')} AS net FROM ledger, c GROUP BY 1",
)
def sim_regimes(spark, sf_dir: str) -> DataFrame:
    return rounded(strategy.regime_attribution(_ledger(spark, sf_dir), "p_entry", cost=0.001))


_CLUSTERS = """, reach AS (SELECT *, max(k_exit) OVER (PARTITION BY symbol, strategy ORDER BY k_entry, k_exit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ledger),
  starts AS (SELECT *, sum(CASE WHEN reach IS NULL OR k_entry >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, strategy ORDER BY k_entry, k_exit ROWS UNBOUNDED PRECEDING) AS cluster FROM reach),
  cl AS (SELECT symbol, strategy, cluster, min(k_entry) AS k_first, max(k_exit) AS k_last, count(*) AS entries, sum(gross_log_return * size) AS pnl, arg_max(exit_reason, (k_exit, k_entry)) AS end_reason FROM starts GROUP BY 1, 2, 3)"""


@_of_ledger(
    "sim_clusters",
    f"""{_CLUSTERS} SELECT strategy, count(*) AS n_clusters, {_r("avg(k_last - k_first)")} AS mean_duration, {_r("quantile_cont(k_last - k_first, 0.5)")} AS median_duration, {_r("avg(entries)")} AS mean_entries, {_r("avg(pnl)")} AS mean_pnl, {_r("max(pnl)")} AS max_pnl,
    {_r("min(pnl)")} AS min_pnl, count(*) FILTER (end_reason = 'tp') AS n_tp, count(*) FILTER (end_reason = 'sl') AS n_sl, count(*) FILTER (end_reason = 'expiry') AS n_expiry FROM cl GROUP BY 1""",
)
def sim_clusters(spark, sf_dir: str) -> DataFrame:
    return rounded(strategy.cluster_summary(strategy.clusters(_ledger(spark, sf_dir))))


_TAKES = """, ahead AS (SELECT symbol, k, list(high) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 48 FOLLOWING) AS highs FROM bars),
  takes AS (SELECT l.*, k_exit - k_entry AS held, nullif(list_position(list_transform(highs, lambda h: h >= entry_price * exp(0.5::DOUBLE)), true), 0)::BIGINT AS would_take FROM ledger l JOIN ahead a ON l.symbol = a.symbol AND l.k_entry = a.k)"""


@_of_ledger("sim_time_to_take", f"{_TAKES} SELECT symbol, strategy, k_entry, exit_reason, held, would_take FROM takes")
def sim_time_to_take(spark, sf_dir: str) -> DataFrame:
    return strategy.time_to_take(_ledger(spark, sf_dir), bar_source.hourly(spark, sf_dir), 0.5, 48, BLOCK).select("symbol", "strategy", "k_entry", "exit_reason", "held", "would_take")


_LATE = "(CASE WHEN exit_reason <> 'tp' THEN would_take END)"


@_of_ledger(
    "sim_take_summary",
    f"""{_TAKES} SELECT strategy, count(*) AS n_closed, count(*) FILTER (exit_reason = 'tp') AS n_tp, count(*) FILTER (exit_reason <> 'tp') AS n_other, count({_LATE}) AS n_eventually, {_r(f"coalesce(count({_LATE}) / nullif(count(*) FILTER (exit_reason <> 'tp'), 0), 0)")} AS share_eventually,
    {", ".join(f"{_r(f'quantile_cont({_LATE}, {q})')} AS rows_p{round(100 * q)}" for q in (0.25, 0.5, 0.75, 0.95))} FROM takes GROUP BY 1""",
)
def sim_take_summary(spark, sf_dir: str) -> DataFrame:
    return rounded(strategy.time_to_take_summary(strategy.time_to_take(_ledger(spark, sf_dir), bar_source.hourly(spark, sf_dir), 0.5, 48, BLOCK)))


@_of_ledger(
    "sim_entry_rank",
    f""", near AS (SELECT symbol, k, close, list(close) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS cs FROM bars)
    SELECT l.symbol, strategy, k_entry, {_r("len(list_filter(cs, lambda c: c < n.close)) / (len(cs) - 1)")} AS entry_rank FROM ledger l JOIN near n ON l.symbol = n.symbol AND l.k_entry = n.k""",
)
def sim_entry_rank(spark, sf_dir: str) -> DataFrame:
    return rounded(strategy.entry_rank(_ledger(spark, sf_dir), bar_source.hourly(spark, sf_dir), 10, BLOCK).select("symbol", "strategy", "k_entry", "entry_rank"))


@_of_ledger(
    "sim_sample",
    """, s AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY round(gross_log_return, 9) DESC, symbol, k_entry) AS best, row_number() OVER (PARTITION BY strategy ORDER BY round(gross_log_return, 9), symbol, k_entry) AS worst,
    row_number() OVER (PARTITION BY strategy ORDER BY md5('0|' || symbol || '|' || k_entry), symbol, k_entry) AS random FROM ledger)
    SELECT symbol, strategy, k_entry, chosen FROM s, (SELECT unnest(['best', 'worst', 'random']) AS chosen) WHERE CASE chosen WHEN 'best' THEN best WHEN 'worst' THEN worst ELSE random END <= 4""",
)
def sim_sample(spark, sf_dir: str) -> DataFrame:
    return strategy.trade_sample(_ledger(spark, sf_dir), 4).select("symbol", "strategy", "k_entry", "chosen")


@query("buy_and_hold", f"WITH {_BARS} SELECT symbol, {_r('CASE WHEN arg_max(close, ts) > 0 AND arg_min(close, ts) > 0 THEN ln(arg_max(close, ts) / arg_min(close, ts)) END')} AS log_return FROM bars GROUP BY 1")
def buy_and_hold(spark, sf_dir: str) -> DataFrame:
    return rounded(strategy.buy_and_hold(bar_source.hourly(spark, sf_dir)))


@_of_ledger(
    "sim_deflated_sharpe",
    f""", m AS (SELECT strategy, count(*) AS n, avg({_NET}) / stddev_samp({_NET}) AS sharpe, skewness({_NET}) AS skew, kurtosis({_NET}) + 3 AS kurtosis FROM ledger GROUP BY 1)
    SELECT strategy, n, {_r("sharpe")} AS sharpe, {_r("skew")} AS skew, {_r("kurtosis")} AS kurtosis, round({audits.expected_max_sharpe(20)!r}, 6) AS expected_max_sharpe,
    {_r(f"(sharpe - {audits.expected_max_sharpe(20)!r}) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe)")} AS deflated_z FROM m""",
)
def sim_deflated_sharpe(spark, sf_dir: str) -> DataFrame:
    net = _ledger(spark, sf_dir).withColumn("net", (F.col("gross_log_return") - 0.001) * F.col("size"))
    return rounded(audits.deflated_sharpe(net, "net", 20, ("strategy",)).select("strategy", "n", "sharpe", "skew", "kurtosis", "expected_max_sharpe", "deflated_z"))


_POLICY = f"""WITH {_SCORES}, u AS (SELECT doc_id, y, p, [p * 0.5, p, p * 0.9] AS ps, round(p * (1 - p), 6) AS unc, (doc_id % 17) / 17.0::DOUBLE AS regime FROM sc),
k AS (SELECT *, list_transform(ps, lambda q: (1.5::DOUBLE * q - (1 - q)) / 1.5::DOUBLE) AS fs FROM u)"""


@query(
    "policy_decisions",
    f"""{_POLICY} SELECT doc_id, {_r("p - 0.3")} AS residual, p >= 0.5 AS by_score, regime >= 0.6 AS by_regime, coalesce(unc <= 0.2, true) AS by_rank, coalesce(unc <= 0.2, false) AS by_cap, {_r("0.25 * greatest((1.5::DOUBLE * p - (1 - p)) / 1.5::DOUBLE, 0)")} AS kelly,
    {_r("greatest(0.25 * quantile_cont_of, 0)")} AS bayesian, {_r("least(greatest(0.25 * greatest((1.5::DOUBLE * p - (1 - p)) / 1.5::DOUBLE, 0) * greatest(least(0.02 / greatest(regime * 0.1, 1e-6), 4), 0), 0), 0.3)")} AS sized,
    {_r("CASE WHEN regime - 0.5 <= 0 THEN 0.5 ELSE greatest(1.0 - (regime - 0.5), 0) END")} AS marginal
    FROM (SELECT *, list_sort(fs)[1] + (list_sort(fs)[2] - list_sort(fs)[1]) * 0.5 AS quantile_cont_of FROM k)""",
)
def policy_decisions(spark, sf_dir: str) -> DataFrame:
    p = F.col("p")
    df = scores.from_documents(spark, sf_dir).withColumns({"ps": F.array(p * 0.5, p, p * 0.9), "unc": F.round(p * (1 - p), 6), "regime": (F.col("doc_id") % 17) / 17})
    size = policy.kelly_size(p, 1.5)
    return rounded(
        df.select(
            "doc_id", policy.residual_score(F.lit(0.3)).alias("residual"), policy.score_above(policy.raw_score(), 0.5).alias("by_score"), policy.regime_high(F.col("regime"), 0.6).alias("by_regime"), policy.uncertainty_below(F.col("unc"), 0.2).alias("by_rank"),
            policy.uncertainty_capped(F.col("unc"), 0.2).alias("by_cap"), size.alias("kelly"), policy.bayesian_kelly_size(F.col("ps"), p, 1.5).alias("bayesian"), policy.clipped(policy.volatility_target(size, F.col("regime") * 0.1, 0.02), 0.3).alias("sized"),
            policy.cluster_marginal(F.col("regime") - 0.5, 1.0, 0.5).alias("marginal"),
        )
    )


@query(
    "policy_ranks",
    f"""WITH {_BARS}, s AS (SELECT symbol, k, volume, CASE WHEN close > open THEN 1 ELSE 0 END AS y, list(volume) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS seen FROM bars),
    r AS (SELECT *, CASE WHEN len(seen) >= 10 THEN len(list_filter(seen, lambda v: v <= volume)) / len(seen) END AS rank FROM s), b AS (SELECT *, least(floor(rank * 3), 2) AS bin FROM r)
    SELECT symbol, k, {_r("rank")} AS rank, {_r("CASE WHEN bin IS NOT NULL AND count(y) OVER w >= 5 THEN avg(y) OVER w END")} AS base_rate FROM b WINDOW w AS (PARTITION BY symbol, bin ORDER BY k ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)""",
)
def policy_ranks(spark, sf_dir: str) -> DataFrame:
    df = in_blocks(bar_source.hourly(spark, sf_dir), lambda df, rows: policy.trailing_rank(df, "rank", "volume", 50, 10, rows), 51, BLOCK)
    df = df.withColumn("y", F.when(F.col("close") > F.col("open"), 1).otherwise(0))
    return rounded(policy.trailing_base_rate(df, "base_rate", "rank", "y", 3, 50, 5).select("symbol", "k", "rank", "base_rate"))


# ---- resampling ------------------------------------------------------------------------------------------------------------------

_REPLICATES, _SEED = 20, 1


def _drawn_sql(block: int | None = None, table: str = "sc", extra: str = "") -> str:
    u = lambda *parts: "(('0x' || substr(md5(" + " || '|' || ".join(parts) + "),1,8))::BIGINT / 4294967296.0::DOUBLE)"
    unit = "doc_id" if block is None else f"CAST(floor((doc_id + floor({u(repr(str(_SEED)), repr('start'), 'replicate')} * {block})) / {block}) AS BIGINT)"
    weight = " + ".join(f"CASE WHEN u >= {c!r}::DOUBLE THEN 1 ELSE 0 END" for c in resampling.CDF)
    return f"""drawn0 AS (SELECT *{extra}, {u(repr(str(_SEED)), unit, 'replicate')} AS u FROM {table}, (SELECT unnest(range({_REPLICATES})) AS replicate)), drawn AS (SELECT *, {weight} AS w FROM drawn0),
    dr AS (SELECT * FROM drawn WHERE w > 0)"""


_BY_SCORE = """per AS (SELECT replicate, p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM dr GROUP BY 1, 2),
  run AS (SELECT *, sum(pos) OVER a AS tp, sum(neg) OVER a AS fp, sum(pos) OVER (PARTITION BY replicate) AS np, sum(neg) OVER (PARTITION BY replicate) AS nn FROM per WINDOW a AS (PARTITION BY replicate ORDER BY p DESC)),
  ok AS (SELECT * FROM run WHERE np > 0 AND nn > 0)"""


def _bands(values: list[str]) -> str:
    return f"count({values[0]}) AS n_effective, " + ", ".join(f"{_r(f'quantile_cont({v}, {q})')} AS {v}_{n}" for v in values for n, q in (("low", "0.025::DOUBLE"), ("median", 0.5), ("high", "0.975::DOUBLE")))


def _drawn(spark, sf_dir: str, block: int | None = None) -> DataFrame:
    return resampling.resampled(scores.from_documents(spark, sf_dir), "doc_id", _REPLICATES, _SEED, block)


_AUC = "s AS (SELECT replicate, sum(neg * (tp - pos / 2)) / max(np * nn) AS auc, sum(pos * tp / (tp + fp)) / max(np) AS ap FROM ok GROUP BY 1)"
for _name, _block in (("boot_auc", None), ("boot_auc_blocks", 50)):
    query(_name, f"WITH {_SCORES}, {_drawn_sql(_block)}, {_BY_SCORE}, {_AUC} SELECT {_bands(['auc', 'ap'])} FROM s")(
        lambda spark, sf_dir, b=_block: rounded(resampling.bands(resampling.auc_samples(_drawn(spark, sf_dir, b)), ["auc", "ap"]))
    )

_LOSSES = ["brier", "logloss", "ece", "reliability", "resolution", "uncertainty"]


@query(
    "boot_losses",
    f"""WITH {_SCORES}, {_drawn_sql()}, b AS (SELECT replicate, least(floor(p * 10), 9) AS bin, sum(w) AS n, sum(w * p) AS sp, sum(w * y) AS sy, sum(w * pow(p - y, 2)) AS sb,
    sum(-w * (y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))) AS ll FROM dr GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER r AS total, sum(sy) OVER r / sum(n) OVER r AS rate FROM b WINDOW r AS (PARTITION BY replicate)),
    s AS (SELECT replicate, sum(sb) / sum(n) AS brier, sum(ll) / sum(n) AS logloss, sum(n / total * abs((sp - sy) / n)) AS ece, sum(n / total * pow((sp - sy) / n, 2)) AS reliability, sum(n / total * pow(sy / n - rate, 2)) AS resolution, max(rate * (1 - rate)) AS uncertainty FROM t GROUP BY 1)
    SELECT {_bands(_LOSSES)} FROM s""",
)
def boot_losses(spark, sf_dir: str) -> DataFrame:
    return rounded(resampling.bands(resampling.loss_samples(_drawn(spark, sf_dir)), _LOSSES))


_X = [0.1, 0.25, 0.5, 0.75, 1.0]
_CURVE = f"""pt AS (SELECT replicate, fp / nn AS x, max(tp / np) AS y FROM ok GROUP BY 1, 2), st AS (SELECT *, coalesce(lag(x) OVER o, 0) AS x0, lag(y) OVER o AS y0 FROM pt WINDOW o AS (PARTITION BY replicate ORDER BY x, y)),
  hit AS (SELECT *, unnest(list_filter({{grid}}, lambda g: g <= x AND (g > x0 OR y0 IS NULL))) AS g FROM st),
  s AS (SELECT replicate, CAST(g AS DOUBLE) AS x, CASE WHEN x > x0 THEN coalesce(y0, 0) + (y - coalesce(y0, 0)) * (g - x0) / (x - x0) ELSE y END AS tpr FROM hit)"""


@query("boot_roc", f"WITH {_SCORES}, {_drawn_sql()}, {_BY_SCORE}, {_CURVE.format(grid=_X)} SELECT x, {_bands(['tpr'])} FROM s GROUP BY x")
def boot_roc(spark, sf_dir: str) -> DataFrame:
    return rounded(resampling.bands(resampling.roc_samples(_drawn(spark, sf_dir), _X), ["tpr"], ("x",)))


_PR = "s AS (SELECT replicate, CAST(g AS DOUBLE) AS x, max(precision) AS precision FROM (SELECT replicate, tp / (tp + fp) AS precision, unnest(list_filter({grid}, lambda g: g <= tp / np)) AS g FROM ok) GROUP BY 1, 2)"


@query("boot_pr", f"WITH {_SCORES}, {_drawn_sql()}, {_BY_SCORE}, {_PR.format(grid=_X)} SELECT x, {_bands(['precision'])} FROM s GROUP BY x")
def boot_pr(spark, sf_dir: str) -> DataFrame:
    return rounded(resampling.bands(resampling.pr_samples(_drawn(spark, sf_dir), _X), ["precision"], ("x",)))


_FINE = [round(0.2 * i / 20, 4) for i in range(21)]
_AREA = "a AS (SELECT replicate, (sum({y}) - (arg_min({y}, x) + arg_max({y}, x)) / 2) / (count(*) - 1) AS area FROM s GROUP BY 1)"


@query("boot_partial_roc", f"WITH {_SCORES}, {_drawn_sql()}, {_BY_SCORE}, {_CURVE.format(grid=_FINE)}, {_AREA.format(y='tpr')} SELECT {_bands(['area'])} FROM a")
def boot_partial_roc(spark, sf_dir: str) -> DataFrame:
    return rounded(resampling.bands(resampling.partial_area(resampling.roc_samples(_drawn(spark, sf_dir), _FINE), "tpr", 0.2), ["area"]))


@query("boot_partial_pr", f"WITH {_SCORES}, {_drawn_sql()}, {_BY_SCORE}, {_PR.format(grid=_FINE)}, {_AREA.format(y='precision')} SELECT {_bands(['area'])} FROM a")
def boot_partial_pr(spark, sf_dir: str) -> DataFrame:
    return rounded(resampling.bands(resampling.partial_area(resampling.pr_samples(_drawn(spark, sf_dir), _FINE), "precision", 0.2), ["area"]))


@query("boot_calibration", f"WITH {_SCORES}, {_drawn_sql()}, s AS (SELECT replicate, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, sum(w * y) / sum(w) AS rate FROM dr GROUP BY 1, 2) SELECT bin, {_bands(['rate'])} FROM s GROUP BY bin")
def boot_calibration(spark, sf_dir: str) -> DataFrame:
    return rounded(resampling.bands(resampling.calibration_samples(_drawn(spark, sf_dir)), ["rate"], ("bin",)))


_SWEEP = [0.2, 0.4, 0.6, 0.8]


@query(
    "boot_sweep",
    f"""WITH {_SCORES}, {_drawn_sql()}, t AS (SELECT replicate AS r, sum(w) AS n_all, sum(w * y) AS positives FROM dr GROUP BY 1), a AS (SELECT replicate, CAST(threshold AS DOUBLE) AS threshold, sum(w) AS n, sum(w * y) AS hits FROM (SELECT *, unnest(list_filter({_SWEEP}, lambda t: t <= p)) AS threshold FROM dr) GROUP BY 1, 2),
    s AS (SELECT replicate, threshold, hits / n AS precision, hits / nullif(positives, 0) AS recall, n / n_all AS rate, 2 * hits / n - 1 AS ev FROM a JOIN t ON replicate = r) SELECT threshold, {_bands(['precision', 'recall', 'rate', 'ev'])} FROM s GROUP BY threshold""",
)
def boot_sweep(spark, sf_dir: str) -> DataFrame:
    return rounded(resampling.bands(resampling.sweep_samples(_drawn(spark, sf_dir), _SWEEP), ["precision", "recall", "rate", "ev"], ("threshold",)))


@query(
    "audit_label_shuffle",
    f"""WITH {_SCORES}, g AS (SELECT *, ('0x' || substr(md5('7|p|' || doc_id || '|' || replicate),1,8))::BIGINT AS a, ('0x' || substr(md5('7|y|' || doc_id || '|' || replicate),1,8))::BIGINT AS b FROM sc, (SELECT unnest(range(10)) AS replicate)),
    x AS (SELECT replicate, p, row_number() OVER (PARTITION BY replicate ORDER BY a) AS place FROM g), z AS (SELECT replicate, y, row_number() OVER (PARTITION BY replicate ORDER BY b) AS place FROM g),
    dr AS (SELECT x.replicate, p, y, 1 AS w FROM x JOIN z ON x.replicate = z.replicate AND x.place = z.place), {_BY_SCORE}, {_AUC} SELECT {_bands(['auc', 'ap'])} FROM s""",
)
def audit_label_shuffle(spark, sf_dir: str) -> DataFrame:
    return rounded(resampling.bands(resampling.auc_samples(resampling.shuffled_labels(scores.from_documents(spark, sf_dir), "doc_id", 10)), ["auc", "ap"]))


# ---- audits ----------------------------------------------------------------------------------------------------------------------

_UNC = f"{_SCORES}, un AS (SELECT *, round(abs(sin(doc_id::DOUBLE)), 3) AS unc, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id % 480) AS ts, (doc_id % 23) / 23.0::DOUBLE AS regime FROM sc)"


def _uncertain(spark, sf_dir: str) -> DataFrame:
    ts = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 480) * 3600).cast("timestamp_ntz")
    return scores.from_documents(spark, sf_dir).withColumns({"unc": F.round(F.abs(F.sin(F.col("doc_id").cast("double"))), 3), "ts": ts, "regime": (F.col("doc_id") % 23) / 23})


def _audit(name: str, sql: str, fn) -> None:
    query(name, f"WITH {_UNC}{sql}")(lambda spark, sf_dir: rounded(fn(_uncertain(spark, sf_dir))))


_audit("th_top_q", f" SELECT {_r('quantile_cont(p, 0.85)')} AS threshold FROM un", lambda d: audits.top_q_threshold(d, 0.85))
_audit("th_conditional_cap", f" SELECT {_r('quantile_cont(unc, 0.5)')} AS cap FROM un WHERE p >= 0.5 AND unc IS NOT NULL", lambda d: audits.conditional_cap(d, 0.5, 0.5))
_audit("th_gate_overlap", " SELECT count(*) AS n, count(*) FILTER (p >= 0.5) AS n_score, count(*) FILTER (unc <= 0.5) AS n_unc, count(*) FILTER (p >= 0.5 AND unc <= 0.5) AS n_both FROM un", lambda d: audits.gate_overlap(d, 0.5, 0.5))


def _edges(x: str, bins: int) -> str:
    return f"(SELECT list_filter(qs, lambda q: q < top) FROM (SELECT list_distinct(quantile_cont({x}, [{', '.join(f'{i} / {bins}::DOUBLE' for i in range(1, bins))}])) AS qs, max({x}) AS top FROM un))"


_audit(
    "m_hit_heatmap",
    f""", c AS (SELECT {_edges('p', 5)} AS qp, {_edges('unc', 5)} AS qu), g AS (SELECT CAST(len(list_filter(qp, lambda q: p > q)) AS INTEGER) AS p_bin, CAST(len(list_filter(qu, lambda q: unc > q)) AS INTEGER) AS unc_bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits FROM un, c GROUP BY 1, 2)
    SELECT p_bin, unc_bin, n, hits, {_r('hits / n')} AS rate, {_r(_WILSON_LOW.format(h='hits', n='n'))} AS low, {_r(_WILSON_HIGH.format(h='hits', n='n'))} AS high FROM g""",
    audits.hit_heatmap,
)
_audit(
    "m_variance_reliability",
    f", v AS (SELECT p, p * (1 - p) AS predicted, pow(p - y, 2) AS observed FROM un), e AS (SELECT list_filter(qs, lambda q: q < top) AS qs FROM (SELECT list_distinct(quantile_cont(predicted, [{', '.join(f'{i} / 10::DOUBLE' for i in range(1, 10))}])) AS qs, max(predicted) AS top FROM v))"
    f" SELECT CAST(len(list_filter(qs, lambda q: predicted > q)) AS INTEGER) AS bin, count(*) AS n, round(avg(predicted), 4) AS mean_predicted, round(avg(observed), 4) AS mean_observed FROM v, e GROUP BY 1",
    lambda d: audits.variance_reliability(d.withColumns({"predicted": F.col("p") * (1 - F.col("p")), "observed": F.pow(F.col("p") - F.col("y"), 2)}), "predicted", "observed").select("bin", "n", *[F.round(c, 4).alias(c) for c in ("mean_predicted", "mean_observed")]),
)
_NAMES = ["length", "parity", "mix"]
_COHORT = "CASE WHEN p >= 0.5 THEN CASE WHEN y = 1 THEN 'TP' ELSE 'FP' END ELSE CASE WHEN y = 1 THEN 'FN' ELSE 'TN' END END"
_CONTRIBUTIONS = f", cc AS (SELECT doc_id, y, p, {_COHORT} AS cohort, [p - 0.5, doc_id % 2, p * (doc_id % 3)] AS cs FROM un), ex AS (SELECT doc_id, cohort, unnest(cs) AS value, unnest({_NAMES}) AS feature FROM cc)"


def _cohorts(d: DataFrame) -> DataFrame:
    name = F.when(F.col("p") >= 0.5, F.when(F.col("y") == 1, "TP").otherwise("FP")).otherwise(F.when(F.col("y") == 1, "FN").otherwise("TN"))
    parts = F.array(F.col("p") - 0.5, (F.col("doc_id") % 2).cast("double"), F.col("p") * (F.col("doc_id") % 3))
    return d.withColumns({"cohort": name, "contributions": parts})


_audit("m_cohort_contributions", f"{_CONTRIBUTIONS} SELECT cohort, feature, count(*) AS n, {_r('avg(value)')} AS mean_contribution FROM ex GROUP BY 1, 2", lambda d: audits.cohort_contributions(_cohorts(d), _NAMES))
_OF = lambda f, c: f"{f}(CASE WHEN cohort = '{c}' THEN value END)"
_audit(
    "m_effect_sizes",
    f"""{_CONTRIBUTIONS}, g AS (SELECT feature, {_OF('count', 'FP')} AS n_fp, {_OF('count', 'FN')} AS n_fn, {_OF('avg', 'FP')} - {_OF('avg', 'FN')} AS difference, {_OF('var_samp', 'FP')} AS v1, {_OF('var_samp', 'FN')} AS v2 FROM ex GROUP BY 1),
    h AS (SELECT *, sqrt(greatest(((n_fp - 1) * v1 + (n_fn - 1) * v2) / greatest(n_fp + n_fn - 2, 1), 1e-18)) AS pooled_std FROM g) SELECT feature, n_fp, n_fn, {_r('difference')} AS difference, {_r('pooled_std')} AS pooled_std, {_r('difference / pooled_std')} AS effect_size FROM h""",
    lambda d: audits.effect_sizes(_cohorts(d), _NAMES),
)


@query(
    "boot_contributions",
    f"""WITH {_UNC}{_CONTRIBUTIONS}, {_drawn_sql(table="ex")}, s AS (SELECT replicate, feature, sum(CASE WHEN cohort = 'FP' THEN w * value END) / sum(CASE WHEN cohort = 'FP' THEN w END) - sum(CASE WHEN cohort = 'FN' THEN w * value END) / sum(CASE WHEN cohort = 'FN' THEN w END) AS difference FROM dr GROUP BY 1, 2)
    SELECT feature, {_bands(['difference'])} FROM s GROUP BY 1""",
)
def boot_contributions(spark, sf_dir: str) -> DataFrame:
    drawn = resampling.resampled(_cohorts(_uncertain(spark, sf_dir)), "doc_id", _REPLICATES, _SEED)
    return rounded(resampling.bands(audits.contribution_difference_samples(drawn, _NAMES), ["difference"], ("feature",)))


_WINDOWED = """, ends AS (SELECT min(ts) AS a, max(ts) AS b FROM un), wn AS (SELECT unnest(generate_series(a, b + INTERVAL 1 DAY - INTERVAL 3 DAY, INTERVAL 1 DAY)) AS window_start FROM ends),
  wi AS (SELECT window_start, window_start + INTERVAL 3 DAY AS window_end, un.* FROM wn JOIN un ON ts >= window_start AND ts < window_start + INTERVAL 3 DAY)"""
_audit(
    "roll_scores",
    f"""{_WINDOWED}, bi AS (SELECT window_start, window_end, least(floor(p * 10), 9) AS bin, count(*) AS c, sum(p) AS sp, sum(y) AS sy, sum(pow(p - y, 2)) AS sb FROM wi GROUP BY 1, 2, 3), t AS (SELECT *, sum(c) OVER w AS n, sum(sy) OVER w AS n_pos FROM bi WINDOW w AS (PARTITION BY window_start))
    SELECT window_start, window_end, CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(n_pos) AS BIGINT) AS n_pos, {_r('sum(sb) / max(n) + 1e-9')} AS brier, {_r('sum(c / n * abs((sp - sy) / c)) + 1e-9')} AS ece, {_r('sum(c / n * pow((sp - sy) / c, 2)) + 1e-9')} AS reliability,
    {_r('sum(c / n * pow(sy / c - n_pos / n, 2)) + 1e-9')} AS resolution, {_r('max(n_pos / n * (1 - n_pos / n)) + 1e-9')} AS uncertainty FROM t WHERE n >= 5 GROUP BY 1, 2""",
    # scores have three digits, so that some results are halves of the last digit kept; the same little thing is added on both sides
    lambda d: audits.windowed_scores(audits.time_windows(d, "ts", 3, 1), min_rows=5).withColumns({c: F.col(c) + 1e-9 for c in ("brier", "ece", "reliability", "resolution", "uncertainty")}),
)
_audit(
    "roll_drift",
    f"""{_WINDOWED}, rf AS (SELECT b.range AS bin, greatest((SELECT count(*) FROM un WHERE least(floor(p * 10), 9) = b.range) / (SELECT count(*) FROM un), 1e-6) AS a FROM range(10) b), sz AS (SELECT window_start, window_end, count(*) AS n FROM wi GROUP BY 1, 2),
    ct AS (SELECT window_start AS w, least(floor(p * 10), 9) AS b, count(*) AS c FROM wi GROUP BY 1, 2) SELECT window_start, window_end, any_value(n) AS n, {_r('sum((a - greatest(coalesce(c, 0) / n, 1e-6)) * ln(a / greatest(coalesce(c, 0) / n, 1e-6)))')} AS psi
    FROM sz, rf LEFT JOIN ct ON w = window_start AND b = bin GROUP BY 1, 2""",
    lambda d: audits.windowed_drift(d, audits.time_windows(d, "ts", 3, 1)),
)
_audit(
    "roll_ks",
    f"""{_WINDOWED}, pts AS (SELECT DISTINCT p FROM un), fr AS (SELECT p, (SELECT count(*) FROM un u WHERE u.p <= pts.p AND u.doc_id % 2 = 0) / (SELECT count(*) FROM un WHERE doc_id % 2 = 0) AS f FROM pts),
    wn2 AS (SELECT window_start, window_end, count(*) AS n FROM wi GROUP BY 1, 2 HAVING count(*) >= 5), fw AS (SELECT w.window_start, w.window_end, n, pts.p, (SELECT count(*) FROM wi WHERE wi.window_start = w.window_start AND wi.p <= pts.p) / n AS g FROM wn2 w, pts),
    k AS (SELECT window_start, window_end, n, max(abs(f - g)) AS ks, (SELECT count(*) FROM un WHERE doc_id % 2 = 0) AS total FROM fw JOIN fr ON fw.p = fr.p GROUP BY 1, 2, 3), l AS (SELECT *, (sqrt(n * total / (n + total)) + 0.12 + 0.11 / sqrt(n * total / (n + total))) * ks AS reach FROM k)
    SELECT window_start, window_end, n, {_r('ks')} AS ks, {_r('CASE WHEN reach < 0.2 THEN 1 ELSE greatest(least(list_sum(list_transform(range(1, 41), lambda j: 2 * pow(-1, j - 1) * exp(-2 * j * j * reach * reach))), 1), 0) END')} AS ks_pvalue FROM l""",
    lambda d: audits.windowed_ks(d.filter("doc_id % 2 = 0"), audits.time_windows(d, "ts", 3, 1), min_rows=5),
)
_audit(
    "roll_auc",
    f"""{_WINDOWED}, pr AS (SELECT a.window_start, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc FROM wi a JOIN wi b ON a.window_start = b.window_start AND a.y = 1 AND b.y = 0 GROUP BY 1)
    SELECT w.window_start, {_r('any_value(auc)')} AS auc, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg FROM wi w LEFT JOIN pr ON pr.window_start = w.window_start GROUP BY 1""",
    lambda d: scores.auc_ap(audits.time_windows(d, "ts", 3, 1), by=("window_start",)).drop("ap"),
)
_audit(
    "audit_agreement",
    f""", ab AS (SELECT p AS a, round(p * 0.8 + unc * 0.2, 3) AS b FROM un), rk AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM ab)
    SELECT count(*) AS n, {_r('corr(a, b)')} AS pearson, {_r('corr(ra, rb)')} AS spearman, {_r('avg(abs(a - b))')} AS mean_abs_diff, {_r('quantile_cont(abs(a - b), 0.5)')} AS median_abs_diff, count(*) FILTER ((a >= 0.5) <> (b >= 0.5)) AS n_disagree FROM rk""",
    lambda d: audits.score_agreement(d.select(F.col("p").alias("a"), F.round(F.col("p") * 0.8 + F.col("unc") * 0.2, 3).alias("b")), "a", "b", 0.5),
)
_audit(
    "premise_uncertainty",
    f""", c AS (SELECT quantile_cont(p, 0.8) AS cut FROM un), ch AS (SELECT un.* FROM un, c WHERE p >= cut), m AS (SELECT quantile_cont(unc, 0.5) AS mid FROM ch), v AS (SELECT count(*) FILTER (unc <= mid) AS n_low, count(*) FILTER (unc > mid) AS n_high, avg(y) FILTER (unc <= mid) - avg(y) FILTER (unc > mid) AS value FROM ch, m)
    SELECT n_low, n_high, {_r('value')} AS value, coalesce(n_low >= 5 AND n_high >= 5 AND value >= 0.04, false) AS passed FROM v""",
    lambda d: audits.uncertainty_premise(d, min_rows=5),
)
_audit(
    "premise_regime",
    f", c AS (SELECT quantile_cont(p, 0.7) AS cp, quantile_cont(regime, 0.7) AS cr FROM un), v AS (SELECT count(*) FILTER (p >= cp AND regime >= cr) AS n, avg(y) FILTER (p >= cp AND regime >= cr) - avg(y) FILTER (p >= cp) AS value FROM un, c) SELECT n, {_r('value')} AS value, coalesce(n >= 5 AND value >= 0.05, false) AS passed FROM v",
    lambda d: audits.regime_premise(d, "regime", top=0.3, min_rows=5),
)
_audit(
    "premise_persistence",
    f""", c AS (SELECT quantile_cont(p, 0.7) AS cut FROM un), o AS (SELECT lang, doc_id, CASE WHEN p > cut THEN 1 ELSE 0 END AS o FROM un, c), l AS (SELECT *, lag(o) OVER (PARTITION BY lang ORDER BY doc_id) AS b FROM o),
    v AS (SELECT CAST(sum(o) AS BIGINT) AS n_above, avg(o) FILTER (b = 1) / avg(o) AS value FROM l) SELECT n_above, {_r('value')} AS value, coalesce(value >= 1.5, false) AS passed FROM v""",
    lambda d: audits.persistence_premise(d, "lang", "doc_id", rows_in_bucket=50),
)
_audit(
    "premise_signal",
    f""", e AS (SELECT {_edges('regime', 3)} AS qs), pa AS (SELECT un.*, CAST(len(list_filter(qs, lambda q: regime > q)) AS INTEGER) AS part FROM un, e), pr AS (SELECT a.part, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc FROM pa a JOIN pa b ON a.part = b.part AND a.y = 1 AND b.y = 0 GROUP BY 1)
    SELECT pa.part, {_r('any_value(auc)')} AS auc, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg, coalesce(any_value(auc) >= 0.55, false) AS passed FROM pa LEFT JOIN pr ON pa.part = pr.part GROUP BY 1""",
    lambda d: audits.signal_premise(d, "regime"),
)


# ---- curves and tables -----------------------------------------------------------------------------------------------------------


@query("m_calibration", f"WITH {_BINS} SELECT CAST(bin AS INTEGER) AS bin, n, {_r('mp')} AS mean_p, {_r('my')} AS rate FROM bins")
def m_calibration(spark, sf_dir: str) -> DataFrame:
    per = scores.from_documents(spark, sf_dir).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin"))
    return rounded(per.agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate")))


@query(
    "m_roc_curve",
    f"""WITH {_SCORES}, t AS (SELECT DISTINCT p FROM sc), n AS (SELECT sum(y) AS np, sum(1 - y) AS nn FROM sc)
    SELECT t.p, {_r("(SELECT sum(y) FROM sc WHERE sc.p >= t.p) / np")} AS tpr, {_r("(SELECT sum(1 - y) FROM sc WHERE sc.p >= t.p) / nn")} AS fpr FROM t, n""",
)
def m_roc_curve(spark, sf_dir: str) -> DataFrame:
    run = scores.running_by_score(scores.from_documents(spark, sf_dir))
    ends = run.agg(F.max("tp").alias("np"), F.max("fp").alias("nn"))
    return rounded(run.join(F.broadcast(ends), F.lit(True)).select("p", F.try_divide("tp", "np").alias("tpr"), F.try_divide("fp", "nn").alias("fpr")))


@query(
    "m_joint_gate",
    f"""WITH {_SCORES}, u AS (SELECT *, round(p * (1 - p), 6) AS unc FROM sc), g AS (SELECT unnest([0.3, 0.5, 0.7]) AS tau_p), h AS (SELECT unnest([0.15, 0.2, 0.25]) AS tau_unc)
    SELECT CAST(tau_p AS DOUBLE) AS tau_p, CAST(tau_unc AS DOUBLE) AS tau_unc, count(*) FILTER (p >= tau_p AND unc <= tau_unc) AS n,
           CAST(coalesce(sum(y) FILTER (p >= tau_p AND unc <= tau_unc), 0) AS BIGINT) AS hits FROM u, g, h GROUP BY 1, 2""",
)
def m_joint_gate(spark, sf_dir: str) -> DataFrame:
    # the grid is a constant, so its cells are columns of one pass and are unfolded afterwards
    df = scores.from_documents(spark, sf_dir).withColumn("unc", F.round(F.col("p") * (1 - F.col("p")), 6))
    cells = [(a, b) for a in (0.3, 0.5, 0.7) for b in (0.15, 0.2, 0.25)]
    passes = lambda a, b: (F.col("p") >= a) & (F.col("unc") <= b)
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("tau_p"), F.lit(b).alias("tau_unc"), F.count_if(passes(a, b)).alias("n"), F.coalesce(F.sum(F.when(passes(a, b), F.col("y"))), F.lit(0)).alias("hits")) for a, b in cells]).alias("cells"))
    return one.select(F.explode("cells").alias("c")).select("c.*")


@query(
    "m_month_balance",
    """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS hits, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) + 0.0 AS rate FROM orders GROUP BY 1""",
)
def m_month_balance(spark, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"))
    hits = F.count_if(F.col("o_orderstatus") == "F")
    return rounded(orders.agg(F.count("*").alias("n"), hits.alias("hits"), (hits / F.count("*")).alias("rate")))


@query(
    "m_feature_health",
    """SELECT o_orderpriority, count(*) AS n, count(*) - count(o_totalprice) AS n_null, round(min(o_totalprice), 6) AS low, round(max(o_totalprice), 6) AS high, round(avg(o_totalprice), 4) AS mean,
    round(stddev_pop(o_totalprice), 4) AS std FROM orders GROUP BY 1""",
)
def m_feature_health(spark, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice")
    per = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority")
    return per.agg(F.count("*").alias("n"), (F.count("*") - F.count(x)).alias("n_null"), F.round(F.min(x), 6).alias("low"), F.round(F.max(x), 6).alias("high"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_pop(x), 4).alias("std"))
