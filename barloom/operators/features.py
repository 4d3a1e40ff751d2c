"""The feature registry: windowed expressions over bars, by family.

A feature is a name pattern, its windows and a function from (rows, window) to a Column. User features are added with register().
Tier 1 reads base and helper columns; tier 2 may read tier-1 columns as well. All features of a tier are made in one projection, so that
they share one sort and, where frames agree, one window operator. Long windows read helper columns that are made once before (functions.rolling).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import clip0, EPS, garman_klass, norm_cdf, parkinson, rogers_satchell, root, Rows, safe_log_ratio, settled, with_windows
from barloom.plans.blocks import BLOCK_ROWS, in_blocks
from barloom.sources.bars import base_series

#: Horizon in bars, and barrier as a log return.
HORIZON, BARRIER = 20, 0.0025
Compute = Callable[[Rows, int], Column]

# Window lengths of the production configuration.
WINDOWS = {
    "f": (3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30, 35, 45, 60, 75, 90, 120, 150, 180, 240, 300, 360, 480, 600, 720, 960, 1440, 1920, 2880, 4320, 10080, 20160),
    "vol_ohlc": (5, 10, 15, 20, 30, 45, 60, 90, 120, 180, 240, 360, 480, 720, 960, 1440, 1920, 2880, 4320),
    "vol_decomp": (60, 90, 120, 180, 240, 360, 480, 720, 960, 1440, 2880, 4320),
    "vol_signed": (60, 120, 240, 480, 960, 1440),
    "breakout": (20, 30, 45, 60, 90, 120, 180, 240, 360, 480, 720, 960, 1440, 1920, 2880, 4320),
    "candle_roll": (10, 15, 20, 30, 45, 60, 90, 120, 180, 240, 360, 480),
    "maxret": (10, 15, 20, 30, 45, 60, 90, 120, 180, 240, 360, 480, 720, 960, 1440),
    "extreme": (30, 60, 120, 240, 480, 960, 1440),
    "excursion": (10, 20, 30, 60, 120, 240, 480, 960, 1440, 2880, 4320, 7200, 10080),
    "bplus": (30, 45, 60, 90, 120, 180, 240, 360, 720, 1440, 2880, 4320),
    "pivot": (240, 480, 960),
    "flow_pressure": (60, 120, 240, 480, 960, 1440),
    "z": (60, 120, 240),
    "equilibrium": (30, 60, 120, 240, 480, 960),
    "corr": (30, 45, 60, 90, 120, 180, 240, 360, 480, 720, 960, 1440),
    "liquidity": (15, 30, 60, 90, 120, 180, 240, 360, 480, 720, 960, 1440),
    "impulse": (5, 10, 15, 20, 30, 45, 60, 90, 120, 180, 240, 360),
    "logp_z": (30, 45, 60, 90, 120, 180, 240, 360, 480, 720, 960, 1440, 2880, 4320),
    "quad_trend": (30, 60, 120, 240, 480),
    "oi_regime": (60, 240, 480),
    "barrier": (10, 20, 30, 45, 60, 90, 120, 180, 240, 360, 480, 720, 960, 1440, 2880, 4320),
    "rsi": (7, 10, 14, 20, 30, 45, 60, 90, 120, 180, 240, 360),
    "entropy": (60, 120, 240, 720),
    "lags": (*range(1, 25), 26, 27, 28, 30, 32, 35, 40, 42, 45, 50, 55, 60, 66, 75, 84, 90, 105, 120, 150, 180, 240, 300, 360, 480, 600, 720, 960, 1440, 2880, 4320, 5760, 7200, 10080, 14400),
    "half_lives": (30, 120, 480),
}
# Pairs of a short and a long window, swing widths, spans of mean spreads.
EQ_PAIRS = ((30, 240), (60, 480), (120, 960))
VOL_PAIRS = ((10, 60), (10, 240), (20, 120), (20, 480), (30, 180), (60, 360), (60, 1440), (120, 720), (120, 2880), (240, 1440), (240, 4320), (720, 4320))
PIVOT_Q = (5, 15)
EMA_SPANS = ((10, 60), (20, 120), (60, 240))


@dataclass(frozen=True)
class Feature:
    family: str
    pattern: str
    windows: tuple[int, ...]
    compute: Compute = field(repr=False)
    tier: int = 1

    def name(self, w: int) -> str:
        return self.pattern.format(w=w)


REGISTRY: dict[str, Feature] = {}


def register(family: str, pattern: str, windows: str | Iterable[int], compute: Compute, tier: int = 1) -> Feature:
    """Add a feature; its pattern must be new."""
    if pattern in REGISTRY:
        raise ValueError(f"{pattern} is registered already")
    made = Feature(family, pattern, WINDOWS[windows] if isinstance(windows, str) else tuple(windows), compute, tier)
    REGISTRY[pattern] = made
    return made


def helpers(df: DataFrame, rows: Rows) -> DataFrame:
    """Row-wise series that several features roll over."""
    r, before = F.col("r"), rows.lag(F.col("r"))
    none = F.lit(0.0)
    return df.withColumns(
        {
            "abs_r": F.abs(r),
            "r2": r * r,
            "r_before": before,
            "rr": F.abs(r) * F.abs(before),
            "up2": F.when(r > 0, r * r).otherwise(none),
            "down2": F.when(r < 0, r * r).otherwise(none),
            "is_up": F.when(r > 0, 1.0).otherwise(none),
            "move2": F.col("p") - rows.lag(F.col("p"), 2),
            "pk": parkinson(),
            "gk": garman_klass(),
            "rs": rogers_satchell(),
            "ln_low": F.when(F.col("low") > 0, F.ln("low")),
            "ln_high": F.when(F.col("high") > 0, F.ln("high")),
            "span": F.col("high") - F.col("low"),
            "ofi_r": F.col("ofi") * F.abs(r),
            "traded": F.when(F.col("volume") >= 0, F.col("volume")),
            "paid": F.when((F.col("close") > 0) & (F.col("volume") >= 0), F.col("close") * F.col("volume")),
        }
    )


def _plain(name: str) -> Compute:
    return lambda rows, w: F.col(name)


def _of(method: str, name: str) -> Compute:
    return lambda rows, w: getattr(rows, method)(name, w)


def _ratio(a: str, b: str) -> Compute:
    return lambda rows, w: rows.sum(a, w) / (rows.sum(b, w) + EPS)


for _pattern, _name in (("tb_ratio__inst__f__w0", "b"), ("ofi__inst__f__w0", "ofi"), ("qpertrade__inst__f__w0", "qpertrade"), ("vwapdev__inst__f__w0", "vwapdev")):
    register("activity", _pattern, (0,), _plain(_name))
register("activity", "logvol__z__f__w{w}", "z", _of("z", "logvol"))
register("activity", "liq__quote_per_absret__f__w{w}", "z", _ratio("quote_volume", "abs_r"))

for _name in ("clv", "bodyfrac", "wickup", "wickdn"):
    register("candle", f"{_name}__inst__f__w0", (0,), _plain(_name))
register("candle", "gap__inst__f__w0", (0,), _plain("g"))
register("candle", "clv__mean__f__w{w}", "candle_roll", _of("mean", "clv"))


def _position(rows: Rows, w: int) -> Column:
    low, high = rows.min("p", w), rows.max("p", w)
    return F.when(high > low, (F.col("p") - low) / (high - low))


register("candle", "logp__pos__f__w{w}", "breakout", _position)
register("candle", "logp__dd__f__w{w}", "breakout", lambda rows, w: rows.max("p", w) - F.col("p"))
register("candle", "logp__du__f__w{w}", "breakout", lambda rows, w: F.col("p") - rows.min("p", w))

for _pattern, _x, _y in (("ret__acf1__f__w{w}", "r", "r_before"), ("ret__corr_logvol__f__w{w}", "r", "logvol"), ("absret__corr_logvol__f__w{w}", "abs_r", "logvol"), ("ret__corr_ofi__f__w{w}", "r", "ofi")):
    register("correlation", _pattern, "corr", lambda rows, w, x=_x, y=_y: rows.corr(x, y, w))

for _pattern, _method, _name in (
    ("ret__mean__f__w{w}", "mean", "r"), ("ret__std__f__w{w}", "std", "r"), ("absret__mean__f__w{w}", "mean", "abs_r"), ("ret__posfrac__f__w{w}", "mean", "is_up"),
    ("range__mean__f__w{w}", "mean", "rho"), ("logvol__mean__f__w{w}", "mean", "logvol"), ("logvol__std__f__w{w}", "std", "logvol"), ("ofi__std__f__w{w}", "std", "ofi"),
):
    register("rolling", _pattern, "f", _of(_method, _name))
register("rolling", "ret__rms__f__w{w}", "f", lambda rows, w: root(rows.mean("r2", w)))

for _name in ("pk", "gk", "rs"):
    _long = {"pk": "parkinson", "gk": "gk", "rs": "rs"}[_name]
    register("volatility", f"vol__{_long}__f__w{{w}}", "vol_ohlc", lambda rows, w, n=_name: root(rows.mean(n, w)))
register("volatility", "vol__bpv_ratio__f__w{w}", "vol_decomp", lambda rows, w: rows.mean("r2", w) / (math.pi / 2 * rows.mean("rr", w - 1) + EPS))
register("volatility", "vol__semivar_down__f__w{w}", "vol_decomp", lambda rows, w: root(rows.mean("down2", w)))
register("volatility", "vol__semivar_up__f__w{w}", "vol_decomp", lambda rows, w: root(rows.mean("up2", w)))
register("volatility", "vol__semivar_ratio__f__w{w}", "vol_decomp", lambda rows, w: root(rows.mean("down2", w)) / (root(rows.mean("up2", w)) + EPS))


def _signed(rows: Rows, w: int) -> Column:
    up, down = rows.sum("up2", w), rows.sum("down2", w)
    return (up - down) / (up + down + EPS)


def _jump(rows: Rows, w: int) -> Column:
    realized, bipower = rows.sum("r2", w), math.pi / 2 * rows.sum("rr", w - 1)
    share = (realized - bipower) / (realized + EPS)
    return F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


register("volatility", "vol__semivar_signed__f__w{w}", "vol_signed", _signed)
register("volatility", "vol__jump_ratio__f__w{w}", "vol_signed", _jump)

register("liquidity", "liq__amihud__f__w{w}", "liquidity", _ratio("abs_r", "volume"))
register("liquidity", "liq__range_per_vol__f__w{w}", "liquidity", _ratio("span", "volume"))
register("liquidity", "ofi__delta__f__w{w}", "impulse", lambda rows, w: F.col("ofi") - rows.lag(F.col("ofi"), w))
register("liquidity", "ofi__max__f__w{w}", "impulse", _of("max", "ofi"))
register("liquidity", "ofi__min__f__w{w}", "impulse", _of("min", "ofi"))
register("liquidity", "ofi__ret_interaction__f__w{w}", "impulse", _of("sum", "ofi_r"))


def _pressure(rows: Rows, w: int) -> Column:
    return 2 * rows.sum("taker_buy_base", w) / (rows.sum("volume", w) + EPS) - 1


def _drift(rows: Rows, w: int) -> Column:
    rms = root(rows.mean("r2", w))
    return F.tanh((F.col("p") - rows.lag(F.col("p"), w)) / (rms * math.sqrt(w) + EPS))


register("flow", "flow__pressure__f__w{w}", "flow_pressure", _pressure)
register("flow", "flow__pressure_cum__f__w{w}", "flow_pressure", lambda rows, w: 2 * rows.sum("taker_buy_base", w) - rows.sum("volume", w))
register("flow", "flow__sell_absorption__f__w{w}", "flow_pressure", lambda rows, w: clip0(-_pressure(rows, w)) * clip0(_drift(rows, w)))
register("flow", "flow__buy_exhaustion__f__w{w}", "flow_pressure", lambda rows, w: clip0(_pressure(rows, w)) * clip0(-_drift(rows, w)))

for _pattern, _name in (("ret__lag{w}__f__w0", "r"), ("absret__lag{w}__f__w0", "abs_r"), ("range__lag{w}__f__w0", "rho"), ("clv__lag{w}__f__w0", "clv"), ("logvol__lag{w}__f__w0", "logvol"), ("logtrades__lag{w}__f__w0", "logtrades"), ("ofi__lag{w}__f__w0", "ofi")):
    register("lag", _pattern, "lags", lambda rows, w, n=_name: rows.lag(F.col(n), w))

register("excursion", "ret__max1m__f__w{w}", "maxret", _of("max", "r"))
register("excursion", "ret__max2m__f__w{w}", "maxret", _of("max", "move2"))
register("excursion", "ret__min1m__f__w{w}", "maxret", _of("min", "r"))


def _rs_scale(rows: Rows, w: int) -> Column:
    return root(rows.mean("rs", w)) * math.sqrt(HORIZON) + EPS


register("extreme", "extreme__dist_low_z__f__w{w}", "extreme", lambda rows, w: (F.col("p") - rows.min("ln_low", w)) / _rs_scale(rows, w))
register("extreme", "extreme__dist_high_z__f__w{w}", "extreme", lambda rows, w: (rows.max("ln_high", w) - F.col("p")) / _rs_scale(rows, w))
register("extreme", "extreme__price_rank__f__w{w}", "extreme", _of("rank", "p"))

for _q in (10, 50, 90):
    register("quantile", f"ret__q{_q}__f__w{{w}}", "bplus", lambda rows, w, q=_q: rows.quantile("r", w, q / 100, HORIZON))
register("quantile", "ret__mad__f__w{w}", "bplus", lambda rows, w: rows.mad("r", w, HORIZON))

def _phase(unit: str) -> Column:
    """Angle of the time of day or of the week, which starts on Monday."""
    if unit == "minute":
        return 2 * math.pi * (F.hour("ts") * 60 + F.minute("ts")) / 1440
    return 2 * math.pi * F.weekday("ts") / 7


for _unit in ("minute", "dow"):
    register("seasonality", f"time__sin_{_unit}__f__w0", (0,), lambda rows, w, u=_unit: F.sin(_phase(u)))
    register("seasonality", f"time__cos_{_unit}__f__w0", (0,), lambda rows, w, u=_unit: F.cos(_phase(u)))

register("trend", "logp__z__f__w{w}", "logp_z", _of("z", "p"))


_EQ = "equilibrium"
# windows that end at the row before: each is made at its last row, and carried to the next one in a tier of its own
_EQ_MADE: dict[str, Compute] = {
    "mean": lambda rows, w: rows.mean("p", w),
    "median": lambda rows, w: rows.quantile("p", w, 0.5),
    "range": lambda rows, w: (rows.max("p", w) + rows.min("p", w)) / 2,
    "vwap": lambda rows, w: F.when(rows.sum("traded", w) > 0, F.ln(rows.sum("paid", w) / rows.sum("traded", w))),
    "sigma": lambda rows, w: rows.std("r", w),
    "trend": lambda rows, w: (lambda mean, slope, _: mean + slope * (w + 1) / 2)(*rows.line("p", w)),
    "sresid": lambda rows, w: rows.line("p", w)[2],
    "mad": lambda rows, w: 1.4826 * rows.mad("p", w),
}
_EQ_NAMES = {"sigma": "eq__sigma_r__f__w{w}", "sresid": "eq__trend_sresid__f__w{w}", "mad": "eq__mad_p__f__w{w}"}
for _kind, _made in _EQ_MADE.items():
    register("equilibrium", f"_here_{_kind}_{{w}}", _EQ, _made, tier=0)
    register("equilibrium", _EQ_NAMES.get(_kind, f"eq__mu_{_kind}__f__w{{w}}"), _EQ, lambda rows, w, k=_kind: rows.lag(f"_here_{k}_{w}"))


def _per_sigma(x: Column, w: int) -> Column:
    return settled(x) / (F.col(f"eq__sigma_r__f__w{w}") * math.sqrt(HORIZON) + EPS)


for _kind, _name in (("mean", "mean"), ("vwap", "vwap"), ("range", "range_mid")):
    register("equilibrium", f"eq__{_name}_resid_hz__f__w{{w}}", _EQ, lambda rows, w, k=_kind: _per_sigma(F.col("p") - F.col(f"eq__mu_{k}__f__w{w}"), w), tier=2)
register("equilibrium", "eq__trend_resid_z__f__w{w}", _EQ, lambda rows, w: settled(F.col("p") - F.col(f"eq__mu_trend__f__w{w}")) / (settled(F.col(f"eq__trend_sresid__f__w{w}")) + EPS), tier=2)
register("equilibrium", "eq__median_resid_madz__f__w{w}", _EQ, lambda rows, w: settled(F.col("p") - F.col(f"eq__mu_median__f__w{w}")) / (F.col(f"eq__mad_p__f__w{w}") + EPS), tier=2)
for _kind in ("trend", "vwap"):
    register("equilibrium", f"eq__upside_to_eq_over_phi__via_{_kind}__f__w{{w}}", _EQ, lambda rows, w, k=_kind: (F.col(f"eq__mu_{k}__f__w{w}") - F.col("p")) / (BARRIER + EPS), tier=2)
    register("equilibrium", f"eq__barrier_vs_eq_hz__via_{_kind}__f__w{{w}}", _EQ, lambda rows, w, k=_kind: _per_sigma(F.col(f"eq__mu_{k}__f__w{w}") - (F.col("p") + BARRIER), w), tier=2)


def _dispersion(rows: Rows, w: int) -> Column:
    """Spread of the estimates of fair value that are there, two at least."""
    known = F.array_compact(F.array(*[F.col(f"eq__mu_{k}__f__w{w}") for k in ("mean", "median", "vwap", "range", "trend")]))
    n, total = F.size(known), lambda f: F.aggregate(F.transform(known, f), F.lit(0.0), lambda a, v: a + v)
    mean = total(lambda v: v) / n
    return F.when(n >= 2, _per_sigma(F.sqrt(total(lambda v: (v - mean) * (v - mean)) / n), w))


register("equilibrium", "eq__proxy_dispersion_hz__f__w{w}", _EQ, _dispersion, tier=2)

# reads ret__rms__f__w20 of the rolling family
register("vov", "vol__vov__f__w{w}", "vol_decomp", _of("std", "ret__rms__f__w20"), tier=2)

for _pattern, _name in (("basis__abs__f__w0", "basis_abs"), ("basis__pct__f__w0", "basis_pct"), ("flow__taker_buy_ratio__f__w0", "tb_ratio_fut"), ("flow__net_vol_btcs__f__w0", "net_vol_fut"), ("oi__total_usd__f__w0", "oi_usd")):
    register("derivatives", _pattern, (0,), _plain(_name))
register("derivatives", "basis__chg__f__w{w}", (5,), lambda rows, w: F.col("basis_pct") - rows.lag(F.col("basis_pct"), w))
register("derivatives", "basis__mean__f__w{w}", (5, 60), _of("mean", "basis_pct"))
register("derivatives", "basis__std__f__w{w}", (5, 60), _of("std", "basis_pct"))
register("derivatives", "flow__net_vol_csum__f__w{w}", (5, 10, 20), _of("sum", "net_vol_fut"))
register("derivatives", "liq__fut_vs_spot_vol__f__w0", (0,), lambda rows, w: F.when(F.col("quote_volume") > 0, F.col("quote_volume_fut") / (F.col("quote_volume") + EPS)))
register("derivatives", "oi__chg__f__w{w}", (60,), lambda rows, w: F.col("oi_usd") - rows.lag(F.col("oi_usd"), w))
register("derivatives", "oi__chg_pct__f__w{w}", (60,), lambda rows, w: (F.col("oi_usd") - rows.lag(F.col("oi_usd"), w)) / (rows.lag(F.col("oi_usd"), w) + EPS) * 100)


def _oi_per_volume(rows: Rows, w: int) -> Column:
    traded = rows.sum("quote_volume_fut", w)
    return F.when(traded > 0, F.col("oi_usd") / (traded + EPS))


register("derivatives", "oi__vol_ratio__f__w{w}", (60,), _oi_per_volume)


register("derivatives", "oi__price_corr__f__w{w}", (120,), lambda rows, w: rows.corr("oi_step", "r", w))

_FUNDING_MINUTES = 480


def _minutes_to_funding() -> Column:
    return (_FUNDING_MINUTES - (F.hour("ts") * 60 + F.minute("ts")) % _FUNDING_MINUTES).cast("double")


# the settlement ahead counts as an hour away at least
register("derivatives", "basis__ann_yield__f__w0", (0,), lambda rows, w: (F.col("close_fut") - F.col("close")) / (F.col("close") + EPS) * (525_600 / F.greatest(_minutes_to_funding(), F.lit(60.0))) * 100)
register("derivatives", "liq__avg_trade_size__f__w0", (0,), lambda rows, w: F.when(F.col("num_trades_fut") > 0, F.col("volume_fut") / (F.col("num_trades_fut") + EPS)))
register("derivatives", "liq__avg_trade_size__f__w15", (0,), lambda rows, w: rows.sum("volume_fut", 15) / (rows.sum("num_trades_fut", 15) + EPS))
register("derivatives", "activity__trades_zscore__f__w30", (0,), lambda rows, w: F.when(rows.std("num_trades_fut", 30) > 0, (F.col("num_trades_fut") - rows.mean("num_trades_fut", 30)) / (rows.std("num_trades_fut", 30) + EPS)))

register("funding", "funding__rate__f__w0", (0,), lambda rows, w: F.col("funding_rate") * 100)
register("funding", "funding__phase__f__w0", (0,), lambda rows, w: _minutes_to_funding() / _FUNDING_MINUTES)
register("funding", "funding__phase_sin__f__w0", (0,), lambda rows, w: F.sin(2 * math.pi * _minutes_to_funding() / _FUNDING_MINUTES))
register("funding", "funding__phase_cos__f__w0", (0,), lambda rows, w: F.cos(2 * math.pi * _minutes_to_funding() / _FUNDING_MINUTES))
register("funding", "funding__trend__f__w{w}", (4320,), lambda rows, w: F.col("funding_rate") - rows.mean("funding_rate", w))

for _pattern, _name in (("opt_pcr__oi__f__w0", "pcr_oi"), ("opt_pcr__vol__f__w0", "pcr_vol"), ("opt_oi__total_usd__f__w0", "opt_oi"), ("opt_vol__24h_usd__f__w0", "opt_volume"), ("vol_idx__bvol30d__f__w0", "bvol")):
    register("options", _pattern, (0,), _plain(_name))
register("options", "opt_pcr__oi_chg__f__w{w}", (1440,), lambda rows, w: F.col("pcr_oi") - rows.lag("pcr_oi", w))
register("options", "vol_idx__bvol_chg__f__w{w}", (1440,), lambda rows, w: F.col("bvol") - rows.lag("bvol", w))
# a month of minutes, by the year's share of a minute
register("options", "vol_realized__30d__f__w{w}", (43200,), lambda rows, w: rows.std("r", w) * math.sqrt(525_600) * 100)
register("options", "vol_risk_premium__diff__f__w{w}", (43200,), lambda rows, w: F.col("bvol") - F.col(f"vol_realized__30d__f__w{w}"), tier=2)
register("options", "vol_risk_premium__ratio__f__w{w}", (43200,), lambda rows, w: F.col("bvol") / (F.col(f"vol_realized__30d__f__w{w}") + EPS), tier=2)

for _slope, _name in ((0, "slope"), (1, "curv")):
    register("quad_trend", f"trend__quad_{_name}_z__f__w{{w}}", "quad_trend", lambda rows, w, k=_slope: settled(rows.parabola("p", w)[k] * w ** (k + 1)) / (root(rows.mean("rs", w)) * math.sqrt(w) + EPS))


def _oi_regime(price: int, interest: int) -> Compute:
    """Price and open interest up or down together or apart: a product of two saturated moves, of these signs."""

    def compute(rows: Rows, w: int) -> Column:
        move = F.tanh((F.col("p") - rows.lag("p", w)) / (root(rows.mean("r2", w)) * math.sqrt(w) + EPS))
        open_ = F.tanh((F.col("oi_usd") - rows.lag("oi_usd", w)) / (rows.std("oi_step", w) * math.sqrt(w) + EPS))
        return clip0(price * move) * clip0(interest * open_)

    return compute


for _name, _price, _interest in (("long_build", 1, 1), ("short_build", -1, 1), ("short_cover", 1, -1), ("long_liq", -1, -1)):
    register("oi_regime", f"oi__{_name}__f__w{{w}}", "oi_regime", _oi_regime(_price, _interest))


def eq_pairs(df: DataFrame, pairs: Iterable[tuple[int, int]] = EQ_PAIRS) -> DataFrame:
    """df, which has the equilibrium family for these windows, with price below a rising short equilibrium, and above a falling one, by pair."""
    made = {}
    for s, l in pairs:  # noqa: E741
        short, long = F.col(f"eq__mu_mean__f__w{s}"), F.col(f"eq__mu_mean__f__w{l}")
        made[f"eq__pullback_rising_eq__f__w{s}__l{l}"] = clip0(_per_sigma(short - F.col("p"), l)) * clip0(_per_sigma(short - long, l))
        made[f"eq__above_falling_eq__f__w{s}__l{l}"] = clip0(_per_sigma(F.col("p") - short, l)) * clip0(_per_sigma(long - short, l))
    return df.withColumns(made)


def barrier_aware(df: DataFrame, windows: Iterable[int], phi: float = BARRIER, horizon: int = HORIZON, pairs: Iterable[tuple[int, int]] = (), cost: float = 0.0) -> DataFrame:
    """df, which has vol__rs (and, where a drift is wanted, ret__mean) for these windows, with how far the barrier is for the volatility of each.

    p_hit_drifted is the chance that a Brownian motion with the window's drift and volatility passes phi within horizon rows, without a lower wall.
    """
    made = {}
    for w in windows:
        vol = F.col(f"vol__rs__f__w{w}")
        reach = vol * math.sqrt(horizon) + EPS
        made[f"barrier__z_tight__f__w{w}"] = phi / reach
        made[f"barrier__emax_ratio__f__w{w}"] = vol * math.sqrt(2 * math.log(horizon)) / (phi + EPS)
        if f"ret__mean__f__w{w}" in df.columns:
            drift = F.col(f"ret__mean__f__w{w}")
            power = F.greatest(F.least(2 * drift * phi / (vol * vol + EPS), F.lit(50.0)), F.lit(-50.0))
            chance = norm_cdf((drift * horizon - phi) / reach) + F.exp(power) * norm_cdf((-phi - drift * horizon) / reach)
            made[f"barrier__p_hit_drifted__f__w{w}"] = F.when(chance.isNotNull(), F.greatest(F.least(chance, F.lit(1.0)), F.lit(0.0)))
    made |= {f"vol__ratio__f__ws{s}__wl{l}": F.col(f"vol__rs__f__w{s}") / (F.col(f"vol__rs__f__w{l}") + EPS) for s, l in pairs}
    return df.withColumns(made | {"cost__c__h__w0": F.lit(float(cost)), "barrier__phi__h__w0": F.lit(float(phi))})


def rolling_block(df: DataFrame, size: int, windows: Iterable[int], rows: Rows | None = None) -> DataFrame:
    """df with the features of the block of size rows that ends at each row; its first price is the close before it."""
    rows = rows or Rows()
    df = with_windows(df, rows, {"_h": rows.max("high", size), "_l": rows.min("low", size), "_v": rows.sum("volume", size), "_b": rows.sum("taker_buy_base", size), "_p0": rows.lag("p", size), "_hi": rows.max("p", size), "_lo": rows.min("p", size)})
    span = safe_log_ratio("_h", "_l", F.col("_h") > F.col("_l"))
    df = df.withColumns(
        {
            "ret__inst__h__w0": F.col("p") - F.col("_p0"),
            "range__inst__h__w0": span,
            "logvol__inst__h__w0": F.log1p("_v"),
            "ofi__inst__h__w0": F.when(F.col("_v") > 0, 2 * F.col("_b") / F.col("_v") - 1),
            "block__maxret__h__w0": F.col("_hi") - F.col("_p0"),
            "block__minret__h__w0": F.col("_lo") - F.col("_p0"),
            "block__close_to_high__h__w0": safe_log_ratio("close", "_l") / (span + EPS),
        }
    )
    df = with_windows(df, rows, {f"ret__std__h__w{w}": rows.std("ret__inst__h__w0", w) for w in windows})
    return df.drop("_h", "_l", "_v", "_b", "_p0", "_hi", "_lo")


def select(family: str | None = None, tier: int | None = None) -> list[Feature]:
    return [f for f in REGISTRY.values() if family in (None, f.family) and tier in (None, f.tier)]


def warmup(features: Iterable[Feature], windows: Iterable[int] | None = None) -> int:
    """Rows before the first one at which all features can be there, in steps of returns and lags."""
    return 3 + max((max(windows or f.windows) for f in features), default=0)


def add_features(base: DataFrame, families: Iterable[str], windows: Iterable[int] | None = None, rows: Rows | None = None) -> tuple[DataFrame, list[str]]:
    """base (from base_series) with the features of some families, and their names; windows replace the registered ones."""
    rows = rows or Rows()
    chosen = [f for f in REGISTRY.values() if f.family in set(families)]
    names: list[str] = []
    df = helpers(base, rows)
    if "oi_usd" in df.columns:
        df = df.withColumn("oi_step", F.col("oi_usd") - rows.lag("oi_usd"))
    for tier in sorted({f.tier for f in chosen}):
        made = {}
        for f in chosen:
            if f.tier == tier:
                own = f.windows if windows is None or "{w}" not in f.pattern else tuple(windows)
                made |= {f.name(w): f.compute(rows, w) for w in own}
        df = with_windows(df, rows, made)
        names += [n for n in made if not n.startswith("_")]
    return df.drop(*[c for c in df.columns if c.startswith("_here_")]), names


def series_features(bars: DataFrame, families: Iterable[str], windows: Iterable[int] | None = None, block_rows: int = BLOCK_ROWS, direct: int | None = None) -> tuple[DataFrame, list[str]]:
    """bars with their base series and the features of some families, and the features' names, in blocks of rows with as many before them as the features look back."""
    families, names = list(families), []

    def work(df: DataFrame, rows: Rows) -> DataFrame:
        made, found = add_features(base_series(df, rows), families, windows, rows)
        names[:] = found
        return made

    halo = 24 + warmup([f for f in REGISTRY.values() if f.family in set(families)], windows)
    return in_blocks(bars, work, halo, block_rows, direct=direct), names
