"""Every registered query of the series engine, with its SQL.

Queries run over whole tables, in blocks of rows with halos. Each family is registered with short windows and, as feat_<family>_long, with windows beyond
the longest frame, which the operators compute by running totals and doubling. Computed doubles are rounded in both forms, as running and framed sums differ in their last bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import Rows
from barloom.operators import features, labels, passage, scores
from barloom.plans.blocks import in_blocks
from barloom.sources import bars as bar_source

WINDOWS = (5, 10, 20)
#: Longer than any frame, and filled by the 720 bars of a symbol.
LONG = (90, 240)
#: Rows of a block: several for each symbol here.
BLOCK = 200
HORIZON, BARRIER = 5, 0.5
DIGITS = 6
LARGE, HUGE = 1e5, 1e9

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, keep: tuple[str, ...] = (), digits: int = DIGITS) -> DataFrame:
    """Doubles rounded (large ones, from nearly empty denominators, more coarsely), and negative zero made positive."""
    near = lambda c: F.when(F.abs(c) < LARGE, F.round(F.col(c), digits)).when(F.abs(c) < HUGE, F.round(F.col(c) / 1000) * 1000).otherwise(F.round(F.col(c) / 1e6) * 1e6) + F.lit(0.0)
    return df.select(*[near(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


# ---- SQL building blocks -------------------------------------------------------------------------------------------------------

_BARS = """
ev AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS hour, ts, event_id, value, CAST(1 + event_id % 10 AS DOUBLE) AS qty FROM events WHERE value IS NOT NULL),
raw AS (
  SELECT symbol, CAST(hour AS TIMESTAMP) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
         sum(qty) AS volume, sum(value * qty) AS quote_volume, CAST(count(*) AS DOUBLE) AS num_trades, coalesce(sum(qty) FILTER (event_id % 2 = 0), 0.0) AS taker_buy_base
  FROM ev GROUP BY symbol, hour),
grid AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM raw GROUP BY symbol),
held AS (
  SELECT g.symbol, g.ts, r.* EXCLUDE (symbol, ts), r.close IS NULL AS filled,
         last_value(r.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen
  FROM grid g LEFT JOIN raw r ON g.symbol = r.symbol AND g.ts = r.ts),
bars AS (
  SELECT symbol, ts, filled, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k, coalesce(open, seen) AS open, coalesce(high, seen) AS high, coalesce(low, seen) AS low,
         coalesce(close, seen) AS close, coalesce(volume, 0) AS volume, coalesce(quote_volume, 0) AS quote_volume, coalesce(num_trades, 0) AS num_trades, coalesce(taker_buy_base, 0) AS taker_buy_base
  FROM held)"""

_O = "PARTITION BY symbol ORDER BY k"
_BASE = f"""{_BARS},
b0 AS (
  SELECT *, CASE WHEN close > 0 THEN ln(close) END AS p, CASE WHEN high > low AND low > 0 THEN ln(high / low) END AS rho,
         CASE WHEN open > 0 AND close > 0 THEN ln(close / open) END AS r_oc, lag(close) OVER ({_O}) AS prev,
         ln(1 + volume) AS logvol, ln(1 + num_trades) AS logtrades, ln(1 + quote_volume) AS logquotevol,
         CASE WHEN volume > 0 THEN taker_buy_base / volume END AS b, CASE WHEN high > low THEN (2 * close - high - low) / (high - low) END AS clv,
         CASE WHEN high > low THEN abs(close - open) / (high - low) END AS bodyfrac, CASE WHEN high > low THEN (high - greatest(open, close)) / (high - low) END AS wickup,
         CASE WHEN high > low THEN (least(open, close) - low) / (high - low) END AS wickdn, CASE WHEN volume > 0 THEN quote_volume / volume END AS vwap,
         CASE WHEN num_trades > 0 THEN quote_volume / num_trades END AS qpertrade
  FROM bars),
b1 AS (
  SELECT *, p - lag(p) OVER ({_O}) AS r, 2 * b - 1 AS ofi, CASE WHEN vwap > 0 AND close > 0 THEN ln(close / vwap) END AS vwapdev,
         CASE WHEN open > 0 AND prev > 0 THEN ln(open / prev) END AS g
  FROM b0),
x AS (
  SELECT *, abs(r) AS abs_r, r * r AS r2, lag(r) OVER ({_O}) AS r_before, abs(r) * abs(lag(r) OVER ({_O})) AS rr, CASE WHEN r > 0 THEN r * r ELSE 0 END AS up2,
         CASE WHEN r < 0 THEN r * r ELSE 0 END AS down2, CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END AS is_up, p - lag(p, 2) OVER ({_O}) AS move2,
         CASE WHEN high > low AND low > 0 THEN pow(ln(high / low), 2) / (4 * ln(2)) END AS pk,
         CASE WHEN high > low AND low > 0 AND open > 0 AND close > 0 THEN 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) END AS gk,
         CASE WHEN open > 0 AND close > 0 AND low > 0 AND high > 0 THEN ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) END AS rs,
         CASE WHEN low > 0 THEN ln(low) END AS ln_low, CASE WHEN high > 0 THEN ln(high) END AS ln_high, high - low AS span, ofi * abs(r) AS ofi_r,
         CASE WHEN volume >= 0 THEN volume END AS traded, CASE WHEN close > 0 AND volume >= 0 THEN close * volume END AS paid
  FROM b1)"""


def _over(w: int, end: int = 0) -> str:
    tail = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"OVER ({_O} ROWS BETWEEN {w - 1 - end} PRECEDING AND {tail})"


def _agg(fn: str, x: str, w: int, end: int = 0) -> str:
    return f"(CASE WHEN count({x}) {_over(w, end)} = {w} THEN {fn.format(x)} {_over(w, end)} END)"


def _mean(x: str, w: int) -> str:
    return _agg("avg({})", x, w)


def _sum(x: str, w: int) -> str:
    return _agg("sum({})", x, w)


def _std(x: str, w: int) -> str:
    return _agg("stddev_pop({})", x, w)


def _min(x: str, w: int) -> str:
    return _agg("min({})", x, w)


def _max(x: str, w: int) -> str:
    return _agg("max({})", x, w)


def _lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER ({_O})"


def _corr(x: str, y: str, w: int) -> str:
    both = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END"
    m = lambda e: f"avg({e}) {_over(w)}"
    vx, vy = f"({m(f'{x}*{x}')} - {m(x)} * {m(x)})", f"({m(f'{y}*{y}')} - {m(y)} * {m(y)})"
    return f"CASE WHEN count({both}) {_over(w)} = {w} AND {vx} > 0 AND {vy} > 0 THEN ({m(f'{x}*{y}')} - {m(x)} * {m(y)}) / sqrt({vx} * {vy}) END"


def _clip0(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({x}, 0) END)"


def _select(columns: dict[str, str], source: str = "x", base: str = _BASE) -> str:
    cells = ", ".join(f'{e} AS "{n}"' for n, e in columns.items())
    return f"WITH {base}, made AS (SELECT symbol, k, {cells} FROM {source}) SELECT symbol, k, {_near(columns)} FROM made"


def _near(names, digits: int = DIGITS) -> str:
    return ", ".join(f'CASE WHEN abs("{n}") < {LARGE} THEN round("{n}", {digits}) WHEN abs("{n}") < {HUGE} THEN round("{n}" / 1000) * 1000 ELSE round("{n}" / 1e6) * 1e6 END + 0.0 AS "{n}"' for n in names)


def _rnd(e: str) -> str:
    return f"round({e}, {DIGITS}) + 0.0"


def _each(patterns: dict[str, object], windows: tuple[int, ...]) -> dict[str, str]:
    return {n.format(w=w): fn(w) for n, fn in patterns.items() for w in windows}


def _settled(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 1e-11 THEN 0 ELSE {x} END)"


_E = "1e-10"
_RS = lambda w: f"(sqrt({_clip0(_mean('rs', w))}) * sqrt(20.0) + {_E})"
_PRESSURE = lambda w: f"(2 * {_sum('taker_buy_base', w)} / ({_sum('volume', w)} + {_E}) - 1)"
_DRIFT = lambda w: f"tanh((p - {_lag('p', w)}) / (sqrt({_clip0(_mean('r2', w))}) * sqrt({w}.0) + {_E}))"

def _families(windows: tuple[int, ...]) -> dict[str, dict[str, str]]:
    each = lambda patterns: _each(patterns, windows)
    return {
        "activity": {"tb_ratio__inst__f__w0": "b", "ofi__inst__f__w0": "ofi", "qpertrade__inst__f__w0": "qpertrade", "vwapdev__inst__f__w0": "vwapdev"}
        | each(
            {
                "logvol__z__f__w{w}": lambda w: f"CASE WHEN {_std('logvol', w)} > 0 THEN (logvol - {_mean('logvol', w)}) / {_std('logvol', w)} END",
                "liq__quote_per_absret__f__w{w}": lambda w: f"{_sum('quote_volume', w)} / ({_sum('abs_r', w)} + {_E})",
            }
        ),
        "candle": {"clv__inst__f__w0": "clv", "bodyfrac__inst__f__w0": "bodyfrac", "wickup__inst__f__w0": "wickup", "wickdn__inst__f__w0": "wickdn", "gap__inst__f__w0": "g"}
        | each(
            {
                "clv__mean__f__w{w}": lambda w: _mean("clv", w),
                "logp__pos__f__w{w}": lambda w: f"CASE WHEN {_max('p', w)} > {_min('p', w)} THEN (p - {_min('p', w)}) / ({_max('p', w)} - {_min('p', w)}) END",
                "logp__dd__f__w{w}": lambda w: f"{_max('p', w)} - p",
                "logp__du__f__w{w}": lambda w: f"p - {_min('p', w)}",
            }
        ),
        "correlation": each(
            {
                "ret__acf1__f__w{w}": lambda w: _corr("r", "r_before", w),
                "ret__corr_logvol__f__w{w}": lambda w: _corr("r", "logvol", w),
                "absret__corr_logvol__f__w{w}": lambda w: _corr("abs_r", "logvol", w),
                "ret__corr_ofi__f__w{w}": lambda w: _corr("r", "ofi", w),
            }
        ),
        "rolling": each(
            {
                "ret__mean__f__w{w}": lambda w: _mean("r", w),
                "ret__std__f__w{w}": lambda w: _std("r", w),
                "ret__rms__f__w{w}": lambda w: f"sqrt({_clip0(_mean('r2', w))})",
                "absret__mean__f__w{w}": lambda w: _mean("abs_r", w),
                "ret__posfrac__f__w{w}": lambda w: _mean("is_up", w),
                "range__mean__f__w{w}": lambda w: _mean("rho", w),
                "logvol__mean__f__w{w}": lambda w: _mean("logvol", w),
                "logvol__std__f__w{w}": lambda w: _std("logvol", w),
                "ofi__std__f__w{w}": lambda w: _std("ofi", w),
            }
        ),
        "volatility": each(
            {
                "vol__parkinson__f__w{w}": lambda w: f"sqrt({_clip0(_mean('pk', w))})",
                "vol__gk__f__w{w}": lambda w: f"sqrt({_clip0(_mean('gk', w))})",
                "vol__rs__f__w{w}": lambda w: f"sqrt({_clip0(_mean('rs', w))})",
                "vol__bpv_ratio__f__w{w}": lambda w: f"{_mean('r2', w)} / (pi() / 2 * {_mean('rr', w - 1)} + {_E})",
                "vol__semivar_down__f__w{w}": lambda w: f"sqrt({_clip0(_mean('down2', w))})",
                "vol__semivar_up__f__w{w}": lambda w: f"sqrt({_clip0(_mean('up2', w))})",
                "vol__semivar_ratio__f__w{w}": lambda w: f"sqrt({_clip0(_mean('down2', w))}) / (sqrt({_clip0(_mean('up2', w))}) + {_E})",
                "vol__semivar_signed__f__w{w}": lambda w: f"({_sum('up2', w)} - {_sum('down2', w)}) / ({_sum('up2', w)} + {_sum('down2', w)} + {_E})",
                "vol__jump_ratio__f__w{w}": lambda w: f"CASE WHEN {_sum('r2', w)} IS NOT NULL AND {_sum('rr', w - 1)} IS NOT NULL THEN least(greatest(({_sum('r2', w)} - pi() / 2 * {_sum('rr', w - 1)}) / ({_sum('r2', w)} + {_E}), 0), 1) END",
            }
        ),
        "liquidity": each(
            {
                "liq__amihud__f__w{w}": lambda w: f"{_sum('abs_r', w)} / ({_sum('volume', w)} + {_E})",
                "liq__range_per_vol__f__w{w}": lambda w: f"{_sum('span', w)} / ({_sum('volume', w)} + {_E})",
                "ofi__delta__f__w{w}": lambda w: f"ofi - {_lag('ofi', w)}",
                "ofi__max__f__w{w}": lambda w: _max("ofi", w),
                "ofi__min__f__w{w}": lambda w: _min("ofi", w),
                "ofi__ret_interaction__f__w{w}": lambda w: _sum("ofi_r", w),
            }
        ),
        "flow": each(
            {
                "flow__pressure__f__w{w}": _PRESSURE,
                "flow__pressure_cum__f__w{w}": lambda w: f"2 * {_sum('taker_buy_base', w)} - {_sum('volume', w)}",
                "flow__sell_absorption__f__w{w}": lambda w: f"{_clip0('-' + _PRESSURE(w))} * {_clip0(_DRIFT(w))}",
                "flow__buy_exhaustion__f__w{w}": lambda w: f"{_clip0(_PRESSURE(w))} * {_clip0('-' + _DRIFT(w))}",
            }
        ),
        "lag": each({f"{n}__lag{{w}}__f__w0": (lambda w, x=x: _lag(x, w)) for n, x in (("ret", "r"), ("absret", "abs_r"), ("range", "rho"), ("clv", "clv"), ("logvol", "logvol"), ("logtrades", "logtrades"), ("ofi", "ofi"))}),
        "excursion": each({"ret__max1m__f__w{w}": lambda w: _max("r", w), "ret__max2m__f__w{w}": lambda w: _max("move2", w), "ret__min1m__f__w{w}": lambda w: _min("r", w)}),
        "extreme": each(
            {
                "extreme__dist_low_z__f__w{w}": lambda w: f"(p - {_min('ln_low', w)}) / {_RS(w)}",
                "extreme__dist_high_z__f__w{w}": lambda w: f"({_max('ln_high', w)} - p) / {_RS(w)}",
                "extreme__price_rank__f__w{w}": lambda w: f"(CASE WHEN count(p) {_over(w)} = {w} THEN len(list_filter(list(p) {_over(w)}, lambda v: v <= p)) / {w}.0 END)",
            }
        ),
        "quantile": each(
            {f"ret__q{q}__f__w{{w}}": (lambda w, q=q: f"(CASE WHEN k % 20 = 0 THEN {_agg('quantile_cont({}, ' + str(q / 100) + ')', 'r', w)} END)") for q in (10, 50, 90)}
            | {"ret__mad__f__w{w}": lambda w: f"(CASE WHEN k % 20 = 0 THEN {_agg('mad({})', 'r', w)} END)"}
        ),
        "seasonality": {
            f"time__{fn}_{n}__f__w0": f"{fn}(2 * pi() * {x})" for n, x in (("minute", "(hour(ts) * 60 + minute(ts)) / 1440.0"), ("dow", "(isodow(ts) - 1) / 7.0")) for fn in ("sin", "cos")
        },
        "trend": each({"logp__z__f__w{w}": lambda w: f"CASE WHEN {_std('p', w)} > 0 THEN (p - {_mean('p', w)}) / {_std('p', w)} END"}),
    }


def _family(name: str, digits: int = DIGITS, windows: tuple[int, ...] = WINDOWS):
    def run(spark, sf_dir: str) -> DataFrame:
        df, names = features.series_features(bar_source.hourly(spark, sf_dir), [name], windows, BLOCK)
        return rounded(df.select("symbol", "k", *names), digits=digits)

    return run


_FAMILIES = _families(WINDOWS)
for _name, _columns in _FAMILIES.items():
    query(f"feat_{_name}", _select(_columns))(_family(_name))
for _name, _columns in _families(LONG).items():
    if any("{w}" in f.pattern for f in features.select(_name)):
        query(f"feat_{_name}_long", _select({n: x for n, x in _columns.items()}))(_family(_name, windows=LONG))


# equilibrium has two tiers: windows first, then what is derived from them
def _eq_tiers(windows: tuple[int, ...]) -> tuple[dict[str, str], dict[str, str]]:
    first = _each(
        {
            "eq__mu_mean__f__w{w}": lambda w: _agg("avg({})", "p", w, -1),
            "eq__mu_median__f__w{w}": lambda w: _agg("quantile_cont({}, 0.5)", "p", w, -1),
            "eq__mu_range__f__w{w}": lambda w: f"({_agg('max({})', 'p', w, -1)} + {_agg('min({})', 'p', w, -1)}) / 2",
            "eq__mu_vwap__f__w{w}": lambda w: f"CASE WHEN {_agg('sum({})', 'traded', w, -1)} > 0 THEN ln({_agg('sum({})', 'paid', w, -1)} / {_agg('sum({})', 'traded', w, -1)}) END",
            "eq__sigma_r__f__w{w}": lambda w: _agg("stddev_pop({})", "r", w, -1),
            "eq__mu_trend__f__w{w}": lambda w: f"(CASE WHEN count(p) {_over(w, -1)} = {w} THEN regr_intercept(p, k) {_over(w, -1)} + k * regr_slope(p, k) {_over(w, -1)} END)",
            "eq__trend_sresid__f__w{w}": lambda w: f"(CASE WHEN count(p) {_over(w, -1)} = {w} THEN sqrt(greatest(regr_syy(p, k) {_over(w, -1)} - pow(regr_sxy(p, k) {_over(w, -1)}, 2) / regr_sxx(p, k) {_over(w, -1)}, 0) / {w}) END)",
            "eq__mad_p__f__w{w}": lambda w: f"(1.4826 * {_agg('mad({})', 'p', w, -1)})",
        },
        windows,
    )
    second = _each(
        {f"eq__{n}_resid_hz__f__w{{w}}": (lambda w, k=k: _HZ(f'p - "eq__mu_{k}__f__w{w}"', w)) for k, n in (("mean", "mean"), ("vwap", "vwap"), ("range", "range_mid"))}
        | {"eq__median_resid_madz__f__w{w}": lambda w: _settled(f'p - "eq__mu_median__f__w{w}"') + f' / ("eq__mad_p__f__w{w}" + {_E})'}
        | {"eq__proxy_dispersion_hz__f__w{w}": lambda w: (lambda v: f"CASE WHEN len({v}) >= 2 THEN {_HZ(f'list_stddev_pop({v})', w)} END")("list_filter([" + ", ".join(f'"eq__mu_{k}__f__w{w}"' for k in ("mean", "median", "vwap", "range", "trend")) + "], lambda v: v IS NOT NULL)")}
        | {"eq__trend_resid_z__f__w{w}": lambda w: _settled(f'p - "eq__mu_trend__f__w{w}"') + " / (" + _settled(f'"eq__trend_sresid__f__w{w}"') + f" + {_E})"}
        | {f"eq__upside_to_eq_over_phi__via_{k}__f__w{{w}}": (lambda w, k=k: f'("eq__mu_{k}__f__w{w}" - p) / (0.0025 + {_E})') for k in ("trend", "vwap")}
        | {f"eq__barrier_vs_eq_hz__via_{k}__f__w{{w}}": (lambda w, k=k: _HZ(f'"eq__mu_{k}__f__w{w}" - (p + 0.0025)', w)) for k in ("trend", "vwap")},
        windows,
    )
    return first, second


_HZ = lambda e, w: f'{_settled(e)} / ("eq__sigma_r__f__w{w}" * sqrt(20.0) + {_E})'


def _eq_pair_sql(pairs: tuple[tuple[int, int], ...]) -> dict[str, str]:
    up = lambda x, l: f"(CASE WHEN {_HZ(x, l)} IS NOT NULL THEN greatest({_HZ(x, l)}, 0) END)"  # noqa: E731, E741
    made = {}
    for s, l in pairs:  # noqa: E741
        a, b = f'"eq__mu_mean__f__w{s}"', f'"eq__mu_mean__f__w{l}"'
        made |= {f"eq__pullback_rising_eq__f__w{s}__l{l}": f"{up(f'{a} - p', l)} * {up(f'{a} - {b}', l)}", f"eq__above_falling_eq__f__w{s}__l{l}": f"{up(f'p - {a}', l)} * {up(f'{b} - {a}', l)}"}
    return made


def _eq_query(name: str, windows: tuple[int, ...], pairs: tuple[tuple[int, int], ...]) -> None:
    first, second = _eq_tiers(windows)
    second |= _eq_pair_sql(pairs)
    sql = (
        f"WITH {_BASE}, t1 AS (SELECT *, " + ", ".join(f'{e} AS "{n}"' for n, e in first.items()) + " FROM x), t2 AS (SELECT *, " + ", ".join(f'{e} AS "{n}"' for n, e in second.items())
        + f" FROM t1) SELECT symbol, k, {_near(first | second, 3)} FROM t2"
    )

    @query(name, sql)
    def run(spark, sf_dir: str) -> DataFrame:
        df, names = features.series_features(bar_source.hourly(spark, sf_dir), ["equilibrium"], windows, BLOCK)
        return rounded(features.eq_pairs(df, pairs).select("symbol", "k", *names, *_eq_pair_sql(pairs)), digits=3)


_eq_query("feat_equilibrium", WINDOWS, ((5, 10), (5, 20)))
_eq_query("feat_equilibrium_long", LONG, (LONG,))


# ---- bars ----------------------------------------------------------------------------------------------------------------------


@query("bars_grid_fill", f"WITH {_BARS} SELECT symbol, ts, k, filled, open, high, low, close, volume, round(quote_volume, {DIGITS}) AS quote_volume, num_trades, taker_buy_base FROM bars")
def bars_grid_fill(spark, sf_dir: str) -> DataFrame:
    df = bar_source.hourly(spark, sf_dir).withColumn("quote_volume", F.round("quote_volume", DIGITS))
    return df.select("symbol", "ts", F.col("k").cast("long").alias("k"), "filled", "open", "high", "low", "close", "volume", "quote_volume", "num_trades", "taker_buy_base")


@query("bars_from_events", f"WITH {_BARS} SELECT symbol, ts, open, high, low, close, volume, round(quote_volume, {DIGITS}) AS quote_volume, num_trades, taker_buy_base FROM raw")
def bars_from_events(spark, sf_dir: str) -> DataFrame:
    return bar_source.to_bars(bar_source.trades(spark, sf_dir)).withColumn("quote_volume", F.round("quote_volume", DIGITS))


@query(
    "bars_validate",
    f"""WITH {_BARS}, d AS (SELECT *, ts > lag(ts) OVER (PARTITION BY symbol ORDER BY ts) + INTERVAL 1 HOUR AS late FROM raw)
    SELECT symbol, count(*) AS n_bars, count(*) FILTER (high < greatest(open, close) OR low > least(open, close) OR high < low OR least(open, high, low, close) <= 0) AS n_bad,
           count(*) FILTER (volume = 0) AS n_empty, count(*) - count(DISTINCT ts) AS n_repeated, count(*) FILTER (late) AS n_gaps FROM d GROUP BY symbol""",
)
def bars_validate(spark, sf_dir: str) -> DataFrame:
    return bar_source.validate(bar_source.to_bars(bar_source.trades(spark, sf_dir)))


_BASE_COLUMNS = ("p", "r", "rho", "r_oc", "g", "logvol", "logtrades", "logquotevol", "b", "ofi", "clv", "bodyfrac", "wickup", "wickdn", "vwap", "vwapdev", "qpertrade")


@query("base_series", _select({c: c for c in _BASE_COLUMNS}, "b1"))
def base_series(spark, sf_dir: str) -> DataFrame:
    return rounded(in_blocks(bar_source.hourly(spark, sf_dir), bar_source.base_series, 2, BLOCK).select("symbol", "k", *_BASE_COLUMNS))


@query(
    "as_of",
    f"""WITH {_BARS}, o AS (SELECT o_orderdate AS ts, max(o_totalprice) AS price FROM orders GROUP BY 1)
    SELECT b.symbol, b.ts, b.close, s.close AS last_close FROM bars b ASOF LEFT JOIN (SELECT * FROM raw WHERE extract(hour FROM ts) % 6 = 0) s ON b.symbol = s.symbol AND b.ts >= s.ts""",
)
def as_of(spark, sf_dir: str) -> DataFrame:
    bars = bar_source.hourly(spark, sf_dir).select("symbol", "ts", "close")
    slow = bar_source.to_bars(bar_source.trades(spark, sf_dir)).filter("hour(ts) % 6 = 0").select("symbol", "ts", F.col("close").alias("last_close"))
    return bar_source.as_of(bars, slow, ["last_close"])


# ---- labels --------------------------------------------------------------------------------------------------------------------

_AHEAD = f"OVER ({_O} ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING)"
_LABELS = f"""{_BARS}, ahead AS (SELECT *, max(high) {_AHEAD} AS best, list(high) {_AHEAD} AS highs, count(*) {_AHEAD} AS n FROM bars),
l0 AS (SELECT *, CASE WHEN n = {HORIZON} AND close > 0 AND best > 0 THEN ln(best / close) END AS m_k FROM ahead),
l AS (
  SELECT *, CASE WHEN n = {HORIZON} THEN CASE WHEN m_k >= {BARRIER} THEN 1 ELSE 0 END END AS y, CAST({BARRIER} AS DOUBLE) AS phi FROM l0),
lab AS (SELECT *, CASE WHEN y = 1 THEN CAST(list_position(list_transform(highs, lambda h: CASE WHEN h > 0 THEN ln(h / close) >= {BARRIER} ELSE false END), true) AS DOUBLE) END AS tau_k FROM l)"""


def _labelled(spark, sf_dir: str) -> DataFrame:
    return in_blocks(bar_source.hourly(spark, sf_dir), lambda df, rows: labels.barrier_labels(df, HORIZON, BARRIER, rows=rows), 0, BLOCK, ahead=HORIZON)


@query("label_barrier", f"WITH {_LABELS} SELECT symbol, k, y, round(m_k, {DIGITS}) + 0.0 AS m_k, tau_k, phi FROM lab")
def label_barrier(spark, sf_dir: str) -> DataFrame:
    return rounded(_labelled(spark, sf_dir).select("symbol", "k", "y", "m_k", "tau_k", "phi"))


FAR = 480


@query(
    "first_passage",
    f"""WITH {_BARS}, levels AS (SELECT symbol, k, close * 1.5 AS up, close * 0.6 AS down FROM bars),
    hits AS (SELECT l.symbol, l.k, min(CASE WHEN b.high >= up THEN b.k - l.k END) AS rows_up, min(CASE WHEN b.low <= down THEN b.k - l.k END) AS rows_down
      FROM levels l JOIN bars b ON b.symbol = l.symbol AND b.k > l.k AND b.k <= l.k + {FAR} GROUP BY 1, 2)
    SELECT l.symbol, l.k, rows_up, rows_down FROM levels l LEFT JOIN hits h ON l.symbol = h.symbol AND l.k = h.k""",
)
def first_passage(spark, sf_dir: str) -> DataFrame:
    bars = bar_source.hourly(spark, sf_dir).withColumns({"up": F.col("close") * 1.5, "down": F.col("close") * 0.6})
    return passage.first_passage(bars, {"rows_up": ("high", "up")}, {"rows_down": ("low", "down")}, FAR, BLOCK).select("symbol", "k", "rows_up", "rows_down")


@query(
    "past_target",
    f"""WITH {_LABELS}, m AS (SELECT *, CAST(lag(y, {HORIZON}) OVER ({_O}) AS DOUBLE) AS hit__prev FROM lab)
    SELECT symbol, k, hit__prev, {", ".join(f"round(avg(hit__prev) {_over(w)}, {DIGITS}) AS hit__rate__h__w{w}" for w in WINDOWS)},
           k - last_value(CASE WHEN hit__prev = 1 THEN k END IGNORE NULLS) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hit__since FROM m""",
)
def past_target(spark, sf_dir: str) -> DataFrame:
    df = in_blocks(_labelled(spark, sf_dir), lambda df, rows: labels.past_target(df, HORIZON, WINDOWS, rows), HORIZON + max(WINDOWS), BLOCK)
    df = labels.since_hit(df, BLOCK)
    return rounded(df.select("symbol", "k", "hit__prev", *[f"hit__rate__h__w{w}" for w in WINDOWS], F.col("hit__since").cast("long").alias("hit__since")))


@query(
    "target_autocorr",
    f"""WITH {_LABELS}, m AS (SELECT *, CAST(lag(y, {HORIZON}) OVER ({_O}) AS DOUBLE) AS mature FROM lab),
    n AS (SELECT *, lag(mature, 1) OVER ({_O}) AS a, lag(mature, 2) OVER ({_O}) AS b FROM m)
    SELECT symbol, k, round({_corr("mature", "a", 20)}, {DIGITS}) + 0.0 AS hit__acf1__h__w20, round({_corr("mature", "b", 20)}, {DIGITS}) + 0.0 AS hit__acf2__h__w20 FROM n""",
)
def target_autocorr(spark, sf_dir: str) -> DataFrame:
    df = in_blocks(_labelled(spark, sf_dir), lambda df, rows: labels.target_autocorrelation(df, HORIZON, 20, (1, 2), rows), HORIZON + 22, BLOCK)
    return rounded(df.select("symbol", "k", "hit__acf1__h__w20", "hit__acf2__h__w20"))


@query(
    "block_boundary",
    f"""WITH {_BARS}, g AS (SELECT symbol, CAST(ceil(k / {HORIZON}.0) AS BIGINT) AS block, max(high) AS block_high, min(low) AS block_low, sum(volume) AS block_volume,
           arg_min(open, k) AS block_open, arg_max(close, k) AS block_close FROM bars GROUP BY 1, 2)
    SELECT *, round(CASE WHEN block_close > 0 AND block_open > 0 THEN ln(block_close / block_open) END, {DIGITS}) + 0.0 AS block_ret, round(lag(CASE WHEN block_close > 0 AND block_open > 0 THEN ln(block_close / block_open) END) OVER (PARTITION BY symbol ORDER BY block), {DIGITS}) + 0.0 AS block_ret_prev FROM g""",
)
def block_boundary(spark, sf_dir: str) -> DataFrame:
    return rounded(labels.block_features(bar_source.hourly(spark, sf_dir), HORIZON), ("block_high", "block_low", "block_open", "block_close"))


@query("w_time", f"WITH {_LABELS} SELECT symbol, k, round(pow(0.99, greatest(floor(count(*) OVER (PARTITION BY symbol) * 0.5) - k, 0)), {DIGITS}) AS w_time FROM lab")
def w_time(spark, sf_dir: str) -> DataFrame:
    return rounded(labels.time_weights(_labelled(spark, sf_dir)).select("symbol", "k", "w_time"))


@query(
    "w_distance",
    f"""WITH {_LABELS}, d AS (SELECT *, abs(m_k - phi) AS distance FROM lab WHERE m_k IS NOT NULL), s AS (SELECT y, quantile_cont(distance, 0.5) AS scale FROM d GROUP BY y)
    SELECT symbol, k, round(coalesce(exp(least(distance / nullif(scale, 0), ln(4.0))), 1), {DIGITS}) AS w_distance FROM d JOIN s USING (y)""",
)
def w_distance(spark, sf_dir: str) -> DataFrame:
    return rounded(labels.distance_weights(_labelled(spark, sf_dir)).select("symbol", "k", "w_distance"))


@query(
    "w_uniqueness",
    f"""WITH {_LABELS}, own AS (SELECT symbol, k FROM lab WHERE y IS NOT NULL),
    cover AS (SELECT symbol, bar, count(*) AS n FROM (SELECT symbol, unnest(generate_series(k + 1, k + {HORIZON})) AS bar FROM own) GROUP BY 1, 2)
    SELECT o.symbol, o.k, round(avg(1.0 / c.n), {DIGITS}) AS u FROM own o JOIN cover c ON o.symbol = c.symbol AND c.bar BETWEEN o.k + 1 AND o.k + {HORIZON} GROUP BY 1, 2""",
)
def w_uniqueness(spark, sf_dir: str) -> DataFrame:
    return rounded(labels.uniqueness(_labelled(spark, sf_dir), HORIZON, BLOCK))


@query(
    "purged_split",
    f"""WITH {_LABELS}, c AS (SELECT symbol, k, round_even(count(*) OVER (PARTITION BY symbol) * 0.7, 0) AS a, round_even(count(*) OVER (PARTITION BY symbol) * 0.85, 0) AS b FROM lab)
    SELECT symbol, k, CASE WHEN (k < a AND k > a - {HORIZON}) OR (k < b AND k > b - {HORIZON}) OR (k >= a AND k < a + 3) OR (k >= b AND k < b + 3) THEN NULL
           WHEN k < a THEN 'train' WHEN k < b THEN 'val' ELSE 'test' END AS split FROM c""",
)
def purged_split(spark, sf_dir: str) -> DataFrame:
    return labels.purged_split(_labelled(spark, sf_dir), HORIZON, embargo=3).select("symbol", "k", "split")


@query(
    "feat_event",
    f"""WITH {_BASE}, s AS (SELECT *, CASE WHEN r > 0 THEN 1 WHEN r < 0 THEN -1 ELSE 0 END AS d FROM x),
    i AS (SELECT *, CASE WHEN d <> coalesce(lag(d) OVER ({_O}), 0) OR d = 0 THEN 1 ELSE 0 END AS starts FROM s),
    j AS (SELECT *, sum(starts) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM i)
    SELECT symbol, k, CAST(d AS TINYINT) AS event__run_dir__f__w0, CAST(CASE WHEN d <> 0 THEN count(*) OVER w ELSE 0 END AS INTEGER) AS event__run_len__f__w0,
           round(CASE WHEN d <> 0 THEN sum(r) OVER w ELSE 0.0 END, {DIGITS}) + 0.0 AS event__run_cumret__f__w0
    FROM j WINDOW w AS (PARTITION BY symbol, island ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def feat_event(spark, sf_dir: str) -> DataFrame:
    df = labels.streaks(in_blocks(bar_source.hourly(spark, sf_dir), bar_source.base_series, 2, BLOCK), F.col("r"), BLOCK)
    return rounded(df.select("symbol", "k", "event__run_dir__f__w0", "event__run_len__f__w0", "event__run_cumret__f__w0"))


_FLAGSHIP = ("ret__mean", "ret__std", "vol__rs", "logp__pos")


@query(
    "flagship",
    f"WITH {_LABELS}, {_BASE.replace(_BARS + ',', '').lstrip()} SELECT x.symbol, x.k, lab.y, "
    + ", ".join(f'round({(_FAMILIES["rolling"] | _FAMILIES["volatility"] | _FAMILIES["candle"])[f"{n}__f__w{w}"]}, {DIGITS}) + 0.0 AS "{n}__f__w{w}"' for w in WINDOWS for n in _FLAGSHIP).replace("PARTITION BY symbol ORDER BY k", "PARTITION BY x.symbol ORDER BY x.k").replace("(p ", "(x.p ")
    + " FROM x JOIN lab ON x.symbol = lab.symbol AND x.k = lab.k",
)
def flagship(spark, sf_dir: str) -> DataFrame:
    """Features in blocks with halos, so that a long series is many tasks, and the forward label."""
    names = [f"{n}__f__w{w}" for w in WINDOWS for n in _FLAGSHIP]
    df, _ = features.series_features(_labelled(spark, sf_dir), ["rolling", "volatility", "candle"], WINDOWS, BLOCK)
    return rounded(df.select("symbol", "k", "y", *names))


_BARRIER_PAIRS = ((5, 20), LONG)
_ERF = "(CASE WHEN abs({x}) < 4 THEN 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda n: pow(-1, n) * pow({x}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))) WHEN {x} > 0 THEN 1 ELSE -1 END)"


def _cdf(x: str) -> str:
    return f"(0.5 * (1 + {_ERF.format(x=f'(({x}) / sqrt(2))')}))"


def _barrier_sql() -> dict[str, str]:
    made = {}
    for w in (20, LONG[0]):
        vol, drift = f"v{w}", f"m{w}"
        reach = f"({vol} * sqrt(20.0) + {_E})"
        chance = f"{_cdf(f'({drift} * 20 - 0.0025) / {reach}')} + exp(greatest(least(2 * {drift} * 0.0025 / ({vol} * {vol} + {_E}), 50), -50)) * {_cdf(f'(-0.0025 - {drift} * 20) / {reach}')}"
        made |= {
            f"barrier__z_tight__f__w{w}": f"0.0025 / {reach}",
            f"barrier__emax_ratio__f__w{w}": f"{vol} * sqrt(2 * ln(20)) / (0.0025 + {_E})",
            f"barrier__p_hit_drifted__f__w{w}": f"CASE WHEN {drift} IS NOT NULL AND {vol} IS NOT NULL THEN greatest(least({chance}, 1), 0) END",
        }
    a, b = 20, LONG[0]
    return made | {f"vol__ratio__f__ws{a}__wl{b}": f"v{a} / (v{b} + {_E})", "cost__c__h__w0": "0.001::DOUBLE", "barrier__phi__h__w0": "0.0025::DOUBLE"}


@query(
    "feat_barrier",
    f"WITH {_BASE}, v AS (SELECT *, " + ", ".join(f"sqrt(greatest({_mean('rs', w)}, 0)) + 0 * {_mean('rs', w)} AS v{w}, {_mean('r', w)} AS m{w}" for w in (20, LONG[0])) + " FROM x), made AS (SELECT symbol, k, "
    + ", ".join(f'{e} AS "{n}"' for n, e in _barrier_sql().items()) + f" FROM v) SELECT symbol, k, {_near(_barrier_sql(), 4)} FROM made",
)
def feat_barrier(spark, sf_dir: str) -> DataFrame:
    a, b = 20, LONG[0]
    df, _ = features.series_features(bar_source.hourly(spark, sf_dir), ["rolling", "volatility"], (a, b), BLOCK)
    return rounded(features.barrier_aware(df, (a, b), pairs=((a, b),), cost=0.001).select("symbol", "k", *_barrier_sql()), digits=4)


_BLOCK_FEATURES = {
    "ret__inst__h__w0": "p - p0",
    "range__inst__h__w0": "CASE WHEN h > l AND l > 0 THEN ln(h / l) END",
    "logvol__inst__h__w0": "ln(1 + v)",
    "ofi__inst__h__w0": "CASE WHEN v > 0 THEN 2 * b / v - 1 END",
    "block__maxret__h__w0": "hi - p0",
    "block__minret__h__w0": "lo - p0",
    "block__close_to_high__h__w0": f"CASE WHEN h > l AND l > 0 AND close > 0 THEN ln(close / l) / (ln(h / l) + {_E}) END",
    "ret__std__h__w12": f"CASE WHEN count(p - p0) {_over(12)} = 12 THEN stddev_pop(p - p0) {_over(12)} END",
    "ret__std__h__w72": f"CASE WHEN count(p - p0) {_over(72)} = 72 THEN stddev_pop(p - p0) {_over(72)} END",
}


@query(
    "feat_rolling_block",
    f"WITH {_BASE}, w AS (SELECT * EXCLUDE (b), {_max('high', 20)} AS h, {_min('low', 20)} AS l, {_sum('volume', 20)} AS v, {_sum('taker_buy_base', 20)} AS b, {_lag('p', 20)} AS p0, {_max('p', 20)} AS hi, {_min('p', 20)} AS lo FROM x), made AS (SELECT symbol, k, "
    + ", ".join(f'{e} AS "{n}"' for n, e in _BLOCK_FEATURES.items()) + f" FROM w) SELECT symbol, k, {_near(_BLOCK_FEATURES)} FROM made",
)
def feat_rolling_block(spark, sf_dir: str) -> DataFrame:
    work = lambda df, rows: features.rolling_block(bar_source.base_series(df, rows), 20, (12, 72), rows)
    return rounded(in_blocks(bar_source.hourly(spark, sf_dir), work, 95, BLOCK).select("symbol", "k", *_BLOCK_FEATURES))


@query(
    "w_training",
    f"""WITH {_LABELS}, t AS (SELECT *, pow(0.99, greatest(floor(count(*) OVER (PARTITION BY symbol) * 0.5) - k, 0)) AS wt FROM lab),
    d AS (SELECT *, abs(m_k - phi) AS distance FROM t WHERE m_k IS NOT NULL), s AS (SELECT y, quantile_cont(distance, 0.5) AS scale FROM d GROUP BY y),
    w AS (SELECT symbol, k, wt * coalesce(exp(least(distance / nullif(scale, 0), ln(4.0))), 1) AS w FROM d JOIN s USING (y)) SELECT symbol, k, round(w / (SELECT avg(w) FROM w), {DIGITS}) AS w FROM w""",
)
def w_training(spark, sf_dir: str) -> DataFrame:
    return rounded(labels.training_weights(_labelled(spark, sf_dir), normalize=True).select("symbol", "k", "w"))


@query(
    "quality_flags",
    f"""WITH {_BARS} SELECT symbol, ts, CAST(CASE WHEN high < greatest(open, close) OR low > least(open, close) OR least(open, high, low, close) <= 0 THEN 1 ELSE 0 END AS TINYINT) AS data__bad_ohlc__f__w0,
    CAST(CASE WHEN ts <> lag(ts) OVER (PARTITION BY symbol ORDER BY ts) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS TINYINT) AS data__gap__f__w0 FROM raw""",
)
def quality_flags(spark, sf_dir: str) -> DataFrame:
    return labels.quality_flags(bar_source.to_bars(bar_source.trades(spark, sf_dir)), Rows(order="ts")).select("symbol", "ts", "data__bad_ohlc__f__w0", "data__gap__f__w0")


@query(
    "impute_flags",
    f"""WITH {_BASE} SELECT symbol, k, CAST(CASE WHEN r IS NULL THEN 1 ELSE 0 END AS TINYINT) AS undef__r, CAST(CASE WHEN clv IS NULL THEN 1 ELSE 0 END AS TINYINT) AS undef__clv,
    {_rnd("coalesce(r, 0)")} AS r, {_rnd("coalesce(clv, 0.5)")} AS clv, {_rnd("logvol")} AS logvol FROM b1""",
)
def impute_flags(spark, sf_dir: str) -> DataFrame:
    df = in_blocks(bar_source.hourly(spark, sf_dir), bar_source.base_series, 2, BLOCK).select("symbol", "k", "r", "clv", "logvol")
    return rounded(labels.impute(df, {"r": 0.0, "clv": 0.5, "logvol": 0.0}, ["r", "clv"]))


@query(
    "kline_bars",
    """WITH e AS (SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS open_time, ts, value, event_id FROM events),
    b AS (SELECT symbol, open_time, ts, event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS close, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS done FROM e),
    m AS (SELECT *, row_number() OVER (PARTITION BY symbol, open_time ORDER BY date_trunc('millisecond', done) DESC, event_id DESC) AS n FROM b WHERE done IS NOT NULL)
    SELECT symbol, open_time, CAST(date_trunc('millisecond', done) AS TIMESTAMP) AS ts, close, CAST(event_id AS DOUBLE) AS volume FROM m WHERE n = 1""",
)
def kline_bars(spark, sf_dir: str) -> DataFrame:
    """Exchange rows made of events, some without a close time and some with a price that is no number, as typed bars."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = lambda x: x.cast("string")
    price = F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(text(F.col("value")))
    opened, closed = F.date_trunc("hour", "ts"), F.when(F.col("event_id") % 11 != 0, F.col("ts"))
    ms = lambda x: text(F.unix_millis(x.cast("timestamp")))
    rows = e.select(F.col("event_type").alias("symbol"), F.array(ms(opened), price, price, price, price, text(F.col("event_id")), ms(closed), price, F.lit("1"), F.lit("0"), F.lit("0"), F.lit("0")).alias("kline"))
    return bar_source.kline_rows(rows).select("symbol", "open_time", "ts", "close", "volume")


# ---- scores --------------------------------------------------------------------------------------------------------------------

_SCORES = """sc AS (
  SELECT d.doc_id, lang, source, quality AS y, round(1 / (1 + exp(-(ln(n_chars + 1) - 7) / 2)), 3) AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL)"""
_GROUPS = f"""{_SCORES}, g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY p),
run AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM g)"""
_BINS = f"""{_SCORES}, bins AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my, sum(p) AS sp, sum(y) AS sy, var_pop(p) AS vp FROM sc GROUP BY 1)"""
_WILSON_LOW = "CASE WHEN {h} = 0 THEN 0 ELSE ({h} / {n} + 3.841458820694124 / (2 * {n}) - 1.959963984540054 * sqrt({h} / {n} * (1 - {h} / {n}) / {n} + 3.841458820694124 / (4 * {n} * {n}))) / (1 + 3.841458820694124 / {n}) END"
_WILSON_HIGH = "CASE WHEN {h} = {n} THEN 1 ELSE ({h} / {n} + 3.841458820694124 / (2 * {n}) + 1.959963984540054 * sqrt({h} / {n} * (1 - {h} / {n}) / {n} + 3.841458820694124 / (4 * {n} * {n}))) / (1 + 3.841458820694124 / {n}) END"


def _first():
    return F.col("doc_id") % 2 == 0


def _r(e: str) -> str:
    return f"round({e}, {DIGITS}) + 0.0"


def _score_query(name: str, sql: str, fn) -> None:
    query(name, sql)(lambda spark, sf_dir: rounded(fn(scores.from_documents(spark, sf_dir))))


_score_query(
    "m_auc_ap",
    f"""WITH {_SCORES}, pairs AS (SELECT avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc FROM sc a JOIN sc b ON a.y = 1 AND b.y = 0),
    g AS (SELECT p, sum(y) AS pos, count(*) AS c FROM sc GROUP BY p), run AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(c) OVER (ORDER BY p DESC) AS n FROM g)
    SELECT {_r("(SELECT auc FROM pairs)")} AS auc, {_r("sum(pos * tp / n) / sum(pos)")} AS ap, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(c) - sum(pos) AS BIGINT) AS n_neg FROM run""",
    scores.auc_ap,
)
_score_query(
    "m_losses",
    f"""WITH {_BINS} SELECT (SELECT {_r("avg(-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15))))")} FROM sc) AS logloss,
    (SELECT {_r("avg(pow(p - y, 2))")} FROM sc) AS brier, {_r("sum(abs(sp - sy)) / sum(n)")} AS ece, CAST(sum(n) AS BIGINT) AS n FROM bins""",
    scores.losses,
)
_score_query(
    "m_murphy",
    f"""WITH {_BINS}, t AS (SELECT sum(n) AS total, sum(sy) / sum(n) AS rate FROM bins)
    SELECT {_r("sum(n / total * pow(mp - my, 2))")} AS reliability, {_r("sum(n / total * pow(my - rate, 2))")} AS resolution, {_r("max(rate * (1 - rate))")} AS uncertainty, {_r("sum(n / total * vp)")} AS within_bin FROM bins, t""",
    scores.murphy,
)
_score_query(
    "m_psi",
    f"""WITH {_SCORES}, t AS (SELECT count(*) FILTER (doc_id % 2 = 0) AS na, count(*) FILTER (doc_id % 2 <> 0) AS nb FROM sc),
    s AS (SELECT b.range AS bin, greatest((SELECT count(*) FROM sc WHERE doc_id % 2 = 0 AND least(floor(p * 10), 9) = b.range) / na, 1e-6) AS a,
                 greatest((SELECT count(*) FROM sc WHERE doc_id % 2 <> 0 AND least(floor(p * 10), 9) = b.range) / nb, 1e-6) AS c FROM range(10) b, t)
    SELECT {_r("sum((a - c) * ln(a / c))")} AS psi FROM s""",
    lambda s: scores.psi(s, _first()),
)
_score_query(
    "m_ks",
    f"""WITH {_SCORES}, g AS (SELECT p, count(*) FILTER (doc_id % 2 = 0) AS a, count(*) FILTER (doc_id % 2 <> 0) AS b FROM sc GROUP BY p)
    SELECT {_r("max(abs(fa / na - fb / nb))")} AS ks FROM (SELECT sum(a) OVER (ORDER BY p) AS fa, sum(b) OVER (ORDER BY p) AS fb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM g)""",
    lambda s: scores.ks(s, _first()),
)
_score_query(
    "m_wilson_by_cell",
    f"""WITH {_SCORES}, g AS (SELECT lang, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits FROM sc WHERE p >= 0.5 GROUP BY lang)
    SELECT lang, n, hits, {_r("hits / n")} AS precision, {_r(_WILSON_LOW.format(h="hits", n="n"))} AS low, {_r(_WILSON_HIGH.format(h="hits", n="n"))} AS high FROM g""",
    lambda s: scores.precision_by(s, ["lang"], 0.5),
)
_GRID = [round(0.1 * i, 1) for i in range(1, 10)]
_score_query(
    "m_threshold_sweep",
    f"""WITH {_SCORES}, g AS (SELECT unnest({_GRID}) AS threshold), r AS (
      SELECT CAST(threshold AS DOUBLE) AS threshold, (SELECT count(*) FROM sc WHERE p >= threshold) AS n, (SELECT CAST(coalesce(sum(y), 0) AS BIGINT) FROM sc WHERE p >= threshold) AS hits FROM g)
    SELECT threshold, n, hits, {_r("hits / nullif(n, 0)")} AS precision, {_r("hits / (SELECT sum(y) FROM sc)")} AS recall, {_r("n / (SELECT count(*) FROM sc)")} AS rate, {_r("2 * hits / nullif(n, 0) - 1")} AS ev FROM r""",
    lambda s: scores.threshold_sweep(s, _GRID),
)
_score_query(
    "m_kelly_bins",
    f"""WITH {_SCORES}, c AS (SELECT list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cuts FROM sc),
    g AS (SELECT len(list_filter(cuts, lambda q: p >= q)) AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits, avg(p) AS mean_p FROM sc, c GROUP BY 1)
    SELECT CAST(bin AS INTEGER) AS bin, n, hits, {_r("mean_p")} AS mean_p, {_r("hits / n")} AS rate, {_r(_WILSON_LOW.format(h="hits", n="n"))} AS low, {_r(_WILSON_HIGH.format(h="hits", n="n"))} AS high, {_r("2 * hits / n - 1")} AS kelly FROM g""",
    scores.kelly_bins,
)
_score_query(
    "m_lift",
    f"""WITH {_GROUPS} SELECT p, CAST(tp + fp AS BIGINT) AS n, {_r("(tp + fp) / (SELECT count(*) FROM sc)")} AS share, {_r("tp / (tp + fp)")} AS precision,
    {_r("tp / (tp + fp) / (SELECT avg(y) FROM sc)")} AS lift FROM run""",
    scores.lift,
)
_score_query(
    "m_page_hinkley",
    f"""WITH {_SCORES}, d AS (SELECT *, (y - p) - avg(y - p) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - 0.005 AS d FROM sc),
    c AS (SELECT *, sum(d) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS c FROM d),
    h AS (SELECT *, c - least(min(c) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING), 0) AS ph FROM c)
    SELECT lang, doc_id, {_r("ph")} AS ph, ph > 1 AS alarm FROM h""",
    lambda s: scores.page_hinkley(s.withColumn("e", F.col("y") - F.col("p")), "lang", "doc_id", "e").select("lang", "doc_id", "ph", "alarm"),
)
_score_query(
    "m_turnover",
    f"""WITH {_SCORES}, o AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS a FROM sc), l AS (SELECT *, lag(a) OVER (PARTITION BY lang ORDER BY doc_id) AS b FROM o)
    SELECT lang, {_r("avg(a)")} AS active_rate, count(*) FILTER (a <> b) AS changes, count(*) FILTER (a = 1 AND coalesce(b, 0) = 0) AS runs, {_r("sum(a) / nullif(count(*) FILTER (a = 1 AND coalesce(b, 0) = 0), 0)")} AS mean_run FROM l GROUP BY lang""",
    lambda s: scores.turnover(s, "lang", "doc_id", 0.5),
)
_score_query(
    "m_cohorts",
    f"""WITH {_SCORES}, n AS (SELECT unnest(['TP', 'FP', 'TN', 'FN']) AS cohort)
    SELECT cohort, (SELECT count(*) FROM sc WHERE cohort = CASE WHEN p >= 0.5 THEN CASE WHEN y = 1 THEN 'TP' ELSE 'FP' END ELSE CASE WHEN y = 1 THEN 'FN' ELSE 'TN' END END) AS n FROM n""",
    lambda s: scores.cohorts(s, 0.5),
)
_score_query(
    "m_uncertainty",
    f"""WITH {_SCORES}, v AS (SELECT doc_id, [p * 0.5, p, p * 0.9] AS ps FROM sc),
    u AS (SELECT doc_id, list_avg(ps) AS mean_p, list_avg(list_transform(ps, lambda q: CASE WHEN q <= 0 OR q >= 1 THEN 0 ELSE -q * ln(q) - (1 - q) * ln(1 - q) END)) AS data FROM v),
    t AS (SELECT *, CASE WHEN mean_p <= 0 OR mean_p >= 1 THEN 0 ELSE -mean_p * ln(mean_p) - (1 - mean_p) * ln(1 - mean_p) END AS total FROM u)
    SELECT doc_id, {_r("mean_p")} AS mean_p, {_r("data")} AS data, {_r("total")} AS total, {_r("greatest(total - data, 0)")} AS knowledge FROM t""",
    lambda s: scores.uncertainty(s.select("doc_id", F.array(F.col("p") * 0.5, F.col("p"), F.col("p") * 0.9).alias("ps"))).select("doc_id", "mean_p", "data", "total", "knowledge"),
)
