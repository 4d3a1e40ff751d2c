"""Queries of the kernels, with SQL that computes the same by plainer means (self-joins, lists)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.catalog import BLOCK, LONG, _BASE, _E, _O, _RS, _agg, _clip0, _corr, _mean, _near, _over, _settled, query, rounded
from barloom.functions.rolling import Rows
from barloom.operators import features, kernels
from barloom.plans.blocks import in_blocks
from barloom.sources import bars as bar_source


def _series(spark, sf_dir: str) -> DataFrame:
    return in_blocks(bar_source.hourly(spark, sf_dir), lambda df, rows: features.helpers(bar_source.base_series(df, rows), rows), 3, BLOCK)


def _worked(spark, sf_dir: str, work, halo: int) -> DataFrame:
    """A kernel with finite memory over the helper series, in blocks."""
    return in_blocks(_series(spark, sf_dir), work, halo, BLOCK)


def _made(ctes: str, columns: dict[str, str], source: str) -> str:
    cells = ", ".join(f'{e} AS "{n}"' for n, e in columns.items())
    return f"WITH {_BASE}, {ctes} made AS (SELECT symbol, k, {cells} FROM {source}) SELECT symbol, k, {_near(columns)} FROM made"


def _recursion(name: str, x: str, alpha: str, start: int = 0, seed: str | None = None) -> str:
    first = seed or x
    return f"""{name} AS (SELECT a.symbol, a.k, sum(CASE WHEN b.k = {start} THEN b.{first} ELSE {alpha} * b.{x} END * pow(1 - {alpha}, a.k - b.k)) AS y
      FROM s a JOIN s b ON a.symbol = b.symbol AND b.k <= a.k AND b.k >= {start} GROUP BY 1, 2)"""


_HALVES = (30, 120)
_SPANS = sorted({n for pair in features.EMA_SPANS for n in pair})
_EWM_PARTS = {f"p{n}": ("p", f"(2.0 / {n + 1})") for n in _SPANS} | {f"h{n}": ("p", f"(1 - pow(2, -1.0 / {n}))") for n in _HALVES} | {f"q{n}": ("q", f"(1 - pow(2, -1.0 / {n}))") for n in _HALVES} | {"f40": ("f", "(2.0 / 41)")}
_EWM = {f"logp__ema_spread__f__w0__fast{a}__slow{b}": f"p{a} - p{b}" for a, b in features.EMA_SPANS} | {"funding__ewma__f__w40": "f40"}
for _h in _HALVES:
    _mu, _sigma = f"lag(h{_h}) OVER ({_O})", f"sqrt(lag(q{_h}) OVER ({_O}))"
    _EWM |= {f"eq__mu_ewm__f__h{_h}": _mu, f"eq__sigma_r_ewm__f__h{_h}": _sigma, f"eq__ewm_innov_hz__f__h{_h}": _settled(f"p - {_mu}") + f" / ({_sigma} * sqrt(20.0) + {_E})"}


@query(
    "feat_ewm",
    f"WITH {_BASE}, s AS (SELECT symbol, k, p, coalesce(r * r, 0) AS q, sin(CAST(k AS DOUBLE)) / 10 AS f FROM x), "
    + ", ".join(_recursion(f"e_{n}", x, alpha) for n, (x, alpha) in _EWM_PARTS.items())
    + ", j AS (SELECT s.*, " + ", ".join(f"e_{n}.y AS {n}" for n in _EWM_PARTS) + " FROM s " + " ".join(f"JOIN e_{n} ON s.symbol = e_{n}.symbol AND s.k = e_{n}.k" for n in _EWM_PARTS) + "), "
    + "made AS (SELECT symbol, k, " + ", ".join(f'{e} AS "{n}"' for n, e in _EWM.items()) + f" FROM j) SELECT symbol, k, {_near(_EWM)} FROM made",
)
def feat_ewm(spark, sf_dir: str) -> DataFrame:
    df = _series(spark, sf_dir).withColumn("funding_rate", F.sin(F.col("k").cast("double")) / 1000)
    return rounded(kernels.ewm_features(df, _HALVES, features.EMA_SPANS, features.HORIZON, 40).select("symbol", "k", *_EWM))


@query(
    "feat_rsi",
    f"""WITH {_BASE}, g AS (SELECT symbol, k, CASE WHEN r > 0 THEN r ELSE 0 END AS up, CASE WHEN r < 0 THEN -r ELSE 0 END AS down FROM x),
    s AS (SELECT *, avg(up) {_over(14)} AS up0, avg(down) {_over(14)} AS down0 FROM g), {_recursion("u", "up", "(1.0 / 14)", 14, "up0")}, {_recursion("d", "down", "(1.0 / 14)", 14, "down0")},
    made AS (SELECT s.symbol, s.k, 100 - 100 / (1 + u.y / (d.y + {_E})) AS ret__rsi__f__w14 FROM s LEFT JOIN u ON s.symbol = u.symbol AND s.k = u.k LEFT JOIN d ON s.symbol = d.symbol AND s.k = d.k)
    SELECT symbol, k, {_near(["ret__rsi__f__w14"])} FROM made""",
)
def feat_rsi(spark, sf_dir: str) -> DataFrame:
    return rounded(kernels.rsi(_series(spark, sf_dir), "ret__rsi__f__w14", 14).select("symbol", "k", "ret__rsi__f__w14"))


_PE = "pentropy_norm__inst__f__w60__m3__tau1"


@query(
    "feat_entropy",
    f"""WITH {_BASE}, t AS (SELECT symbol, k, CASE WHEN lag(r, 2) OVER ({_O}) IS NOT NULL AND lag(r) OVER ({_O}) IS NOT NULL AND r IS NOT NULL THEN
      CAST(list_grade_up([lag(r, 2) OVER ({_O}), lag(r) OVER ({_O}), r]) AS VARCHAR) END AS code FROM x),
    l AS (SELECT symbol, k, list(code) {_over(58)} AS codes, count(code) {_over(58)} AS n FROM t),
    c AS (SELECT symbol, k, count(*) AS c FROM (SELECT symbol, k, unnest(codes) AS code FROM l WHERE n = 58) GROUP BY symbol, k, code),
    e AS (SELECT symbol, k, -sum(c / 58 * ln(c / 58)) / ln(6) AS {_PE} FROM c GROUP BY 1, 2), made AS (SELECT x.symbol, x.k, {_PE} FROM x LEFT JOIN e ON x.symbol = e.symbol AND x.k = e.k) SELECT symbol, k, {_near([_PE])} FROM made""",
)
def feat_entropy(spark, sf_dir: str) -> DataFrame:
    return rounded(_worked(spark, sf_dir, lambda df, rows: kernels.permutation_entropy(df, _PE, F.col("r"), 60, rows), 62).select("symbol", "k", _PE))


_UP, _DOWN = "excursion__roll_max_drawup__f__w{w}", "excursion__roll_max_drawdown__f__w{w}"
_DRAWN = {_UP.format(w=w): f"CASE WHEN len(l{w}) = {w} THEN list_max(list_transform(range(1, {w + 1}), lambda j: l{w}[j] - list_min(l{w}[1:j]))) END" for w in (10, 21)} | {
    _DOWN.format(w=w): f"CASE WHEN len(l{w}) = {w} THEN list_max(list_transform(range(1, {w + 1}), lambda j: list_max(l{w}[1:j]) - l{w}[j])) END" for w in (10, 21)
}

_UP_AT, _DOWN_AT = "excursion__max_drawup__f__w21", "excursion__max_drawdown__f__w21"
_DRAWN |= {_UP_AT: f"CASE WHEN k % 20 = 0 THEN {_DRAWN[_UP.format(w=21)]} END", _DOWN_AT: f"CASE WHEN k % 20 = 0 THEN {_DRAWN[_DOWN.format(w=21)]} END"}


@query("feat_drawup", _made(f"d AS (SELECT symbol, k, list(p) {_over(10)} AS l10, list(p) {_over(21)} AS l21 FROM x),", _DRAWN, "d"))
def feat_drawup(spark, sf_dir: str) -> DataFrame:
    def work(df: DataFrame, rows: Rows) -> DataFrame:
        for w in (10, 21):
            df = kernels.drawups(df, _UP.format(w=w), _DOWN.format(w=w), F.col("p"), w, rows)
        return kernels.drawups_at(df, _UP_AT, _DOWN_AT, F.col("p"), 21, 20, rows)

    return rounded(_worked(spark, sf_dir, work, 22).select("symbol", "k", *_DRAWN))


_AROUND = f"OVER ({_O} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
_PIVOTS = {}
for _side, _sign in (("low", ""), ("high", "-")):
    _PIVOTS[f"pivot__last_{_side}_dist_z__f__w20__q3"] = f"CASE WHEN k - {_side}_last.k <= 20 AND {_mean('rs', 20)} IS NOT NULL THEN {_sign}(p - {_side}_last.v) / {_RS(20)} END"
    _PIVOTS[f"pivot__last_{_side}_age__f__w20__q3"] = f"CASE WHEN k - {_side}_last.k <= 20 THEN CAST(k - {_side}_last.k AS DOUBLE) ELSE 20.0 END"


@query(
    "feat_pivot",
    _made(
        f"""c AS (SELECT *, CASE WHEN count(ln_low) {_AROUND} = 7 AND ln_low = min(ln_low) {_AROUND} THEN {{'k': k, 'v': ln_low}} END AS lp, CASE WHEN count(ln_high) {_AROUND} = 7 AND ln_high = max(ln_high) {_AROUND} THEN {{'k': k, 'v': ln_high}} END AS hp FROM x),
        d AS (SELECT *, lag(lp, 3) OVER ({_O}) AS lc, lag(hp, 3) OVER ({_O}) AS hc FROM c),
        e AS (SELECT *, last_value(lc IGNORE NULLS) OVER ({_O} ROWS UNBOUNDED PRECEDING) AS low_last, last_value(hc IGNORE NULLS) OVER ({_O} ROWS UNBOUNDED PRECEDING) AS high_last FROM d),""",
        _PIVOTS,
        "e",
    ),
)
def feat_pivot(spark, sf_dir: str) -> DataFrame:
    return rounded(_worked(spark, sf_dir, lambda df, rows: kernels.pivots(df, 3, 20, 20, rows), 30).select("symbol", "k", *_PIVOTS))


def _quad_sql(windows: tuple[int, ...]) -> str:
    """The fits from the windows' values less their first, so that a flat window gives zero."""
    made = {}
    for w in windows:
        u = [j - (w - 1) / 2 for j in range(w)]
        u2, u4 = sum(v * v for v in u), sum(v**4 for v in u)
        dot = lambda weights: f"(CASE WHEN len(l{w}) = {w} THEN list_dot_product(list_transform(l{w}, lambda v: v - l{w}[1]), [" + ", ".join(repr(float(v)) for v in weights) + "]) END)"  # noqa: B023, E731
        vol = f"(sqrt({_clip0(_mean('rs', w))}) * sqrt({w}.0) + {_E})"
        made |= {f"trend__quad_slope_z__f__w{w}": _settled(f"{dot([v / u2 for v in u])} * {w}") + f" / {vol}", f"trend__quad_curv_z__f__w{w}": _settled(f"{dot([(v * v - u2 / w) / (u4 - u2 * u2 / w) for v in u])} * {w * w}") + f" / {vol}"}
    return _made("f AS (SELECT *, " + ", ".join(f"CASE WHEN count(p) {_over(w)} = {w} THEN list(p) {_over(w)} END AS l{w}" for w in windows) + " FROM x),", made, "f")


def _quad_query(name: str, windows: tuple[int, ...]) -> None:
    @query(name, _quad_sql(windows))
    def run(spark, sf_dir: str) -> DataFrame:
        df, names = features.series_features(bar_source.hourly(spark, sf_dir), ["quad_trend"], windows, BLOCK)
        return rounded(df.select("symbol", "k", *names))


_quad_query("feat_quad_trend", (20,))
_quad_query("feat_quad_trend_long", LONG)


def _with_futures(df: DataFrame) -> DataFrame:
    """Futures, open interest, funding, options and a volatility index made from the bars themselves."""
    step = (F.col("k") % 7).cast("double")
    return df.withColumns({"num_trades_fut": F.col("num_trades") * 2 + step, "funding_rate": F.sin(F.col("k").cast("double")) / 1000, "pcr_oi": 1 + step / 10, "pcr_vol": 2 - step / 10, "opt_oi": F.col("volume") * 7, "opt_volume": F.col("quote_volume") * 3, "bvol": 50 + F.cos(F.col("k").cast("double")) * 10, "close_fut": F.col("close") * (1 + step / 1000), "volume_fut": F.col("volume") + step, "taker_buy_base_fut": F.col("taker_buy_base"), "quote_volume_fut": F.col("quote_volume") * 1.5, "oi_usd": F.col("num_trades") * 100 + F.col("volume")})


_FUT = "f AS (SELECT *, close * (1 + k % 7 / 1000.0) AS close_fut, volume + k % 7 AS volume_fut, taker_buy_base AS taker_buy_base_fut, quote_volume * 1.5 AS quote_volume_fut, num_trades * 100 + volume AS oi_usd, num_trades * 2 + k % 7 AS num_trades_fut, sin(CAST(k AS DOUBLE)) / 1000 AS funding_rate, 1 + k % 7 / 10.0::DOUBLE AS pcr_oi, 2 - k % 7 / 10.0::DOUBLE AS pcr_vol, volume * 7 AS opt_oi, quote_volume * 3 AS opt_volume, 50 + cos(CAST(k AS DOUBLE)) * 10 AS bvol FROM x),"
_DERIV = {"basis_abs": "close_fut - close", "basis_pct": "CASE WHEN close > 0 THEN (close_fut - close) / close * 100 END", "tb_ratio_fut": "CASE WHEN volume_fut > 0 THEN taker_buy_base_fut / volume_fut END", "net_vol_fut": "2 * taker_buy_base_fut - volume_fut", "funding__phase__f__w0": "(480 - (hour(ts) * 60 + minute(ts)) % 480) / 480.0"}


@query("deriv_base", _made(_FUT, _DERIV, "f"))
def deriv_base(spark, sf_dir: str) -> DataFrame:
    df, _ = features.series_features(kernels.derivatives_base(_with_futures(bar_source.hourly(spark, sf_dir))), ["funding"], (5,), BLOCK)
    return rounded(df.select("symbol", "k", *_DERIV))


def _pos(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest({x}, 0) END)"


def _moves(w: int) -> str:
    rms = f"sqrt({_pos(_mean('r2', w))})"
    std = f"(CASE WHEN count(d_oi) {_over(w)} = {w} THEN stddev_pop(d_oi) {_over(w)} END)"
    return f"m AS (SELECT *, tanh((p - lag(p, {w}) OVER ({_O})) / ({rms} * sqrt({w}.0) + {_E})) AS dp, tanh((oi_usd - lag(oi_usd, {w}) OVER ({_O})) / ({std} * sqrt({w}.0) + {_E})) AS doi FROM d),"


def _oi_query(name: str, w: int) -> None:
    made = {f"oi__{n}__f__w{w}": f"{_pos(a)} * {_pos(b)}" for n, a, b in (("long_build", "dp", "doi"), ("short_build", "-dp", "doi"), ("short_cover", "dp", "-doi"), ("long_liq", "-dp", "-doi"))}

    @query(name, _made(f"{_FUT} d AS (SELECT *, oi_usd - lag(oi_usd) OVER ({_O}) AS d_oi FROM f), {_moves(w)}", made, "m"))
    def run(spark, sf_dir: str) -> DataFrame:
        df, names = features.series_features(_with_futures(bar_source.hourly(spark, sf_dir)), ["oi_regime"], (w,), BLOCK)
        return rounded(df.select("symbol", "k", *names))


_oi_query("feat_oi_regimes", 10)
_oi_query("feat_oi_regimes_long", 90)


_DERIV_W = (5, 10)
_BASIS = "((close_fut - close) / close * 100)"
_NET = "(2 * taker_buy_base_fut - volume_fut)"
_FULL = lambda fn, x, w: f"(CASE WHEN count({x}) {_over(w)} = {w} THEN {fn}({x}) {_over(w)} END)"
_DERIV_FEATURES = {
    "basis__abs__f__w0": "close_fut - close",
    "basis__pct__f__w0": _BASIS,
    "flow__taker_buy_ratio__f__w0": "CASE WHEN volume_fut > 0 THEN taker_buy_base_fut / volume_fut END",
    "flow__net_vol_btcs__f__w0": _NET,
    "oi__total_usd__f__w0": "oi_usd",
    "basis__ann_yield__f__w0": f"(close_fut - close) / (close + {_E}) * (525600 / greatest(480 - (hour(ts) * 60 + minute(ts)) % 480, 60)::DOUBLE) * 100",
    "liq__avg_trade_size__f__w0": f"CASE WHEN num_trades_fut > 0 THEN volume_fut / (num_trades_fut + {_E}) END",
    "liq__avg_trade_size__f__w15": f"{_agg('sum({})', 'volume_fut', 15)} / ({_agg('sum({})', 'num_trades_fut', 15)} + {_E})",
    "activity__trades_zscore__f__w30": f"CASE WHEN {_agg('stddev_pop({})', 'num_trades_fut', 30)} > 0 THEN (num_trades_fut - {_agg('avg({})', 'num_trades_fut', 30)}) / ({_agg('stddev_pop({})', 'num_trades_fut', 30)} + {_E}) END",
    "liq__fut_vs_spot_vol__f__w0": f"CASE WHEN quote_volume > 0 THEN quote_volume_fut / (quote_volume + {_E}) END",
} | {
    n.format(w=w): e(w)
    for w in _DERIV_W
    for n, e in {
        "basis__chg__f__w{w}": lambda w: f"{_BASIS} - lag({_BASIS}, {w}) OVER ({_O})",
        "basis__mean__f__w{w}": lambda w: _FULL("avg", _BASIS, w),
        "basis__std__f__w{w}": lambda w: _FULL("stddev_pop", _BASIS, w),
        "flow__net_vol_csum__f__w{w}": lambda w: _FULL("sum", _NET, w),
        "oi__chg__f__w{w}": lambda w: f"oi_usd - lag(oi_usd, {w}) OVER ({_O})",
        "oi__chg_pct__f__w{w}": lambda w: f"(oi_usd - lag(oi_usd, {w}) OVER ({_O})) / (lag(oi_usd, {w}) OVER ({_O}) + {_E}) * 100",
        "oi__price_corr__f__w{w}": lambda w: _corr("d_oi", "r", w),
        "oi__vol_ratio__f__w{w}": lambda w: f"CASE WHEN {_FULL('sum', 'quote_volume_fut', w)} > 0 THEN oi_usd / ({_FULL('sum', 'quote_volume_fut', w)} + {_E}) END",
    }.items()
}


_STEP = f"g AS (SELECT *, oi_usd - lag(oi_usd) OVER ({_O}) AS d_oi FROM f),"


@query("feat_derivatives", _made(f"{_FUT} {_STEP}", _DERIV_FEATURES, "g"))
def feat_derivatives(spark, sf_dir: str) -> DataFrame:
    df, names = features.series_features(kernels.derivatives_base(_with_futures(bar_source.hourly(spark, sf_dir))), ["derivatives"], _DERIV_W, BLOCK)
    return rounded(df.select("symbol", "k", *names))


_PHASE = "((480 - (hour(ts) * 60 + minute(ts)) % 480) / 480.0::DOUBLE)"
_MONTH = 120
_FUNDING = {
    "funding__rate__f__w0": "funding_rate * 100",
    "funding__phase__f__w0": _PHASE,
    "funding__phase_sin__f__w0": f"sin(2 * pi() * {_PHASE})",
    "funding__phase_cos__f__w0": f"cos(2 * pi() * {_PHASE})",
    f"funding__trend__f__w{_MONTH}": f"funding_rate - {_agg('avg({})', 'funding_rate', _MONTH)}",
}
_OPTIONS = {
    "opt_pcr__oi__f__w0": "pcr_oi", "opt_pcr__vol__f__w0": "pcr_vol", "opt_oi__total_usd__f__w0": "opt_oi", "opt_vol__24h_usd__f__w0": "opt_volume", "vol_idx__bvol30d__f__w0": "bvol",
    f"opt_pcr__oi_chg__f__w{_MONTH}": f"pcr_oi - lag(pcr_oi, {_MONTH}) OVER ({_O})",
    f"vol_idx__bvol_chg__f__w{_MONTH}": f"bvol - lag(bvol, {_MONTH}) OVER ({_O})",
}
_REALIZED = f"{_agg('stddev_pop({})', 'r', _MONTH)} * sqrt(525600.0) * 100"
_OPTIONS |= {f"vol_realized__30d__f__w{_MONTH}": _REALIZED, f"vol_risk_premium__diff__f__w{_MONTH}": f"bvol - {_REALIZED}", f"vol_risk_premium__ratio__f__w{_MONTH}": f"bvol / ({_REALIZED} + {_E})"}


@query("feat_funding", _made(_FUT, _FUNDING, "f"))
def feat_funding(spark, sf_dir: str) -> DataFrame:
    df, names = features.series_features(_with_futures(bar_source.hourly(spark, sf_dir)), ["funding"], (_MONTH,), BLOCK)
    return rounded(df.select("symbol", "k", *names))


@query("feat_options", _made(_FUT, _OPTIONS, "f"))
def feat_options(spark, sf_dir: str) -> DataFrame:
    df, names = features.series_features(_with_futures(bar_source.hourly(spark, sf_dir)), ["options"], (_MONTH,), BLOCK)
    return rounded(df.select("symbol", "k", *names))


_RMS20 = f"CASE WHEN count(r2) {_over(20)} = 20 THEN sqrt(greatest(avg(r2) {_over(20)}, 0)) END"


@query("feat_vov", _made(f"v AS (SELECT *, {_RMS20} AS rms FROM x),", {f"vol__vov__f__w{w}": _FULL("stddev_pop", "rms", w) for w in (5, 20)}, "v"))
def feat_vov(spark, sf_dir: str) -> DataFrame:
    df, _ = features.series_features(bar_source.hourly(spark, sf_dir), ["rolling", "vov"], (5, 20), BLOCK)
    return rounded(df.select("symbol", "k", "vol__vov__f__w5", "vol__vov__f__w20"))
