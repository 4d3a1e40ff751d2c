"""Window functions over ordered rows: strict frames of w rows, null unless all of them are there.

A frame function is O(w) a row in Spark, so each has two forms. Up to `direct` rows it is a frame. A longer window reads helper columns that
add_long() makes once for a series, whatever the number of windows: running totals (of the values less the block's first, so that no digits are lost),
whose difference over w rows is a sum, mean, deviation, correlation or straight line; and extremes over 2, 4, 8, .. rows, two of which cover a window.
Order statistics of long windows (quantile, median distance, rank) are read from a wavelet matrix of a block's rows (functions.order), in numpy over Arrow.
Long series are cut into blocks of rows with a halo first (plans.blocks), which also keeps running totals short.

Series of long windows are named by their columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.functions.order import WaveletMatrix
from barloom.plans.shipping import ship

EPS = 1e-10
#: Differences of logarithms below this are the rounding of sums.
ROUNDING = 1e-11
#: Longest window that is computed as a frame of its own.
DIRECT = 64
#: Share of a mean square below which a variance is rounding noise.
_NOISE = 1e-12
#: Windows that are asked about at once.
_AT_ONCE = 1 << 16

Series = str | Column


def _col(x: Series) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _name(x: Series) -> str:
    if not isinstance(x, str):
        raise TypeError("a long window needs the name of a column")
    return x


@dataclass(frozen=True)
class Rows:
    """Window functions over the rows of a key in order of k."""

    keys: tuple[str, ...] = ("symbol",)
    order: str = "k"
    direct: int = DIRECT
    #: Helper columns that long windows have asked for, which add_long() makes.
    asked: set[tuple] = field(default_factory=set, compare=False, repr=False)
    _made: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def spec(self) -> WindowSpec:
        # made once: many columns over one window are asked for
        if "spec" not in self._made:
            self._made["spec"] = Window.partitionBy(*self.keys).orderBy(self.order)
        return self._made["spec"]

    def frame(self, w: int, end: int = 0) -> WindowSpec:
        return self.spec.rowsBetween(end - w + 1, end)

    @property
    def so_far(self) -> WindowSpec:
        return self.spec.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, x: Series, n: int = 1) -> Column:
        return F.lag(x, n).over(self.spec) if n else _col(x)

    def _asks(self, *what) -> Column:
        self.asked.add(what)
        if what not in self._made:
            self._made[what] = F.col("_long_" + "_".join(map(str, what)).replace(".", "p"))
        return self._made[what]

    def _over(self, w: int, *what) -> Column:
        """The difference of a running total over w rows, a helper column too: sums, means and deviations share it."""
        self._asks(*what)
        return self._asks("over", w, *what)

    def full(self, x: Series, w: int, value: Column) -> Column:
        """value where all w rows of x are there."""
        if w <= self.direct:
            return F.when(F.count(_col(x)).over(self.frame(w)) == w, value)
        return F.when(self._over(w, "n", _name(x)) == w, value)

    def sum(self, x: Series, w: int) -> Column:
        if w <= self.direct:
            return self.full(x, w, F.sum(_col(x)).over(self.frame(w)))
        return self.full(x, w, self._over(w, "t", _name(x)))

    def mean(self, x: Series, w: int) -> Column:
        if w <= self.direct:
            return self.full(x, w, F.avg(_col(x)).over(self.frame(w)))
        return self.sum(x, w) / w

    def _variance(self, x: str, w: int) -> Column:
        mean, square = self._over(w, "c", x) / w, self._over(w, "cc", x, x) / w
        spread = square - mean * mean
        return F.when(spread > _NOISE * square, spread).otherwise(F.when(spread.isNotNull(), 0.0))

    def std(self, x: Series, w: int) -> Column:
        """Population standard deviation."""
        if w <= self.direct:
            return self.full(x, w, F.stddev_pop(_col(x)).over(self.frame(w)))
        return self.full(x, w, F.sqrt(self._variance(_name(x), w)))

    def min(self, x: Series, w: int) -> Column:
        return self.full(x, w, F.min(_col(x)).over(self.frame(w)) if w <= self.direct else self._asks("min", _name(x), w))

    def max(self, x: Series, w: int) -> Column:
        return self.full(x, w, F.max(_col(x)).over(self.frame(w)) if w <= self.direct else self._asks("max", _name(x), w))

    def quantile(self, x: Series, w: int, q: float, every: int = 1) -> Column:
        """Linear interpolation between order statistics, on every so many rows."""
        if w <= self.direct:
            return self._some(self.full(x, w, F.percentile(_col(x), q).over(self.frame(w))), every)
        return self._asks("quantile", _name(x), w, every, q)

    def mad(self, x: Series, w: int, every: int = 1) -> Column:
        """Median distance from the median, on every so many rows."""
        if w > self.direct:
            return self._asks("mad", _name(x), w, every)
        values = F.collect_list(_col(x)).over(self.frame(w))
        middle = median(F.array_sort(values))
        return self._some(self.full(x, w, median(F.array_sort(F.transform(values, lambda v: F.abs(v - middle))))), every)

    def rank(self, x: Series, w: int) -> Column:
        """Share of the window's values that are at most the current one."""
        if w > self.direct:
            return self._asks("rank", _name(x), w, 1)
        return self.full(x, w, F.size(F.filter(F.collect_list(_col(x)).over(self.frame(w)), lambda v: v <= _col(x))) / w)

    def _some(self, value: Column, every: int) -> Column:
        return value if every == 1 else F.when(F.col(self.order) % every == 0, value)

    def corr(self, x: Series, y: Series, w: int) -> Column:
        """Pearson correlation; null where either side has no variance."""
        both = F.when(_col(x).isNotNull() & _col(y).isNotNull(), 1)
        if w <= self.direct:
            over = lambda c: F.avg(c).over(self.frame(w))
            x, y = _col(x), _col(y)
            vx, vy = over(x * x) - over(x) * over(x), over(y * y) - over(y) * over(y)
            return self.full(both, w, F.when((vx > 0) & (vy > 0), (over(x * y) - over(x) * over(y)) / F.sqrt(vx * vy)))
        x, y = _name(x), _name(y)
        vx, vy = self._variance(x, w), self._variance(y, w)
        together = self._over(w, "cc", x, y) / w - self._over(w, "c", x) / w * self._over(w, "c", y) / w
        there = (self._over(w, "n", x) == w) & (self._over(w, "n", y) == w)
        return F.when(there & (vx > 0) & (vy > 0), together / F.sqrt(vx * vy))

    def line(self, x: Series, w: int) -> tuple[Column, Column, Column]:
        """Mean of w rows, slope a row and residual deviation of a straight line through them."""
        # rows are evenly spaced, so the variance of their numbers is fixed
        var_k = (w * w - 1) / 12
        if w <= self.direct:
            # the covariance is summed from deviations, which is exact for a flat window
            over, x = self.frame(w), _col(x)
            mean, spread, slope = F.avg(x).over(over), F.var_pop(x).over(over), F.covar_pop(F.col(self.order), x).over(over) / var_k
        else:
            x = _name(x)
            c, spread = self._over(w, "c", x) / w, self._variance(x, w)
            mean = self.mean(x, w)
            # numbers are counted back from the window's middle
            middle = self._asks("u") - (w - 1) / 2
            slope = F.when(spread > 0, (self._over(w, "uc", x) / w - middle * c) / var_k).otherwise(0.0)
        return tuple(self.full(x, w, v) for v in (mean, slope, F.sqrt(F.greatest(spread - slope * slope * var_k, F.lit(0.0)))))

    def parabola(self, x: Series, w: int) -> tuple[Column, Column]:
        """Coefficients of the line and the square of a quadratic through w rows, counted from their middle; 0 for a flat window."""
        u = [j - (w - 1) / 2 for j in range(w)]
        u2, u4 = sum(v * v for v in u), sum(v**4 for v in u)
        if w <= self.direct:
            # the weights sum to zero, so the window's first value can go first
            seen = F.collect_list(_col(x)).over(self.frame(w))
            values = F.transform(seen, lambda v: v - F.get(seen, F.lit(0)))
            dot = lambda weights: F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            made = dot([v / u2 for v in u]), dot([(v * v - u2 / w) / (u4 - u2 * u2 / w) for v in u])
        else:
            x = _name(x)
            m = self._asks("u") - (w - 1) / 2
            s0, s1, s2 = self._over(w, "c", x), self._over(w, "uc", x), self._over(w, "uuc", x)
            flat = self._variance(x, w) == 0
            made = tuple(F.when(flat, 0.0).otherwise(v) for v in ((s1 - m * s0) / u2, (s2 - 2 * m * s1 + m * m * s0 - u2 / w * s0) / (u4 - u2 * u2 / w)))
        return tuple(self.full(x, w, v) for v in made)

    def z(self, x: Series, w: int) -> Column:
        std = self.std(x, w)
        return F.when(std > 0, (_col(x) - self.mean(x, w)) / std)

    def last_known(self, x: Column) -> Column:
        return F.last(x, ignorenulls=True).over(self.so_far)

    def add_long(self, df: DataFrame) -> DataFrame:
        """df with the helper columns that long windows have asked for; drop_long() removes them."""
        if not self.asked:
            return df
        asked = sorted(self.asked - {("u",)}, key=str)
        self.asked.clear()
        kinds = {k: sorted({a[1:] for a in asked if a[0] == k}, key=str) for k in ("n", "t", "c", "cc", "uc", "uuc", "min", "max")}
        name = lambda *what: "_long_" + "_".join(map(str, what)).replace(".", "p")
        new = lambda made: df.withColumns({c: x for c, x in made.items() if c not in df.columns}) if made else df
        centred = sorted({x for k in ("c", "cc", "uc", "uuc") for a in kinds[k] for x in a})
        whole = self.spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        if centred:
            df = new({name("v", x): F.coalesce(F.col(x) - F.first(x, ignorenulls=True).over(whole), F.lit(0.0)) for x in centred} | {name("u"): (F.col(self.order) - F.first(self.order).over(self.spec)).cast("double")})
        v, u, total = lambda x: F.col(name("v", x)), F.col(name("u")), lambda x: F.sum(x).over(self.so_far)
        df = new(
            {name("n", x): F.count(x).over(self.so_far).cast("double") for (x,) in kinds["n"]}
            | {name("t", x): total(F.coalesce(F.col(x), F.lit(0)).cast("double")) for (x,) in kinds["t"]}
            | {name("c", x): total(v(x)) for (x,) in kinds["c"]}
            | {name("cc", x, y): total(v(x) * v(y)) for x, y in kinds["cc"]}
            | {name("uc", x): total(u * v(x)) for (x,) in kinds["uc"]}
            | {name("uuc", x): total(u * u * v(x)) for (x,) in kinds["uuc"]}
        )
        before = lambda w, what: F.coalesce(F.lag(F.col(name(*what)), w).over(self.spec), F.lit(0.0))
        df = new({name(*a): F.col(name(*a[2:])) - before(a[1], a[2:]) for a in asked if a[0] == "over"})
        # extremes over runs of size rows, doubled
        best = {"min": F.least, "max": F.greatest}
        longest = {}
        for k in best:
            for x, w in kinds[k]:
                longest[k, x] = max(w, longest.get((k, x), 0))
        size = 1 << (max(1, min(self.direct, 16)).bit_length() - 1)
        df = new({name("run", k, x, size): getattr(F, k)(x).over(self.frame(size)) for k, x in longest})
        while any(2 * size <= w for w in longest.values()):
            run = lambda k, x: F.col(name("run", k, x, size))
            df = new({name("run", k, x, 2 * size): best[k](run(k, x), F.lag(run(k, x), size).over(self.spec)) for (k, x), w in longest.items() if 2 * size <= w})
            size *= 2
        made = {}
        for k in best:
            for x, w in kinds[k]:
                part = 1 << (w.bit_length() - 1)
                run = F.col(name("run", k, x, part))
                made[name(k, x, w)] = best[k](run, F.lag(run, w - part).over(self.spec)) if w > part else run
        df = new(made)
        ordered = [(name(*a), *a) for a in asked if a[0] in ("quantile", "mad", "rank") and name(*a) not in df.columns]
        return _order_statistics(df, self, ordered) if ordered else df


def drop_long(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_long_")])


def with_windows(df: DataFrame, rows: Rows, columns: dict[str, Column]) -> DataFrame:
    """df.withColumns(columns), where columns were made by rows and may hold long windows."""
    return drop_long(rows.add_long(df).withColumns(columns))


def order_statistic(x: np.ndarray, k: np.ndarray, kind: str, w: int, every: int, *more, tree: WaveletMatrix | None = None) -> np.ndarray:
    """Quantile, median distance from the median or rank over w rows that end at rows whose k is divisible; NaN elsewhere and where a value is missing. tree is that of x."""
    out = np.full(len(x), np.nan)
    missing = np.cumsum(np.concatenate([[0], np.isnan(x)]))
    ends = np.arange(w - 1, len(x))
    ends = ends[(k[ends] % every == 0) & (missing[ends + 1] == missing[ends + 1 - w])]
    tree = tree or WaveletMatrix(x)
    for a in range(0, len(ends), _AT_ONCE):
        at = ends[a : a + _AT_ONCE]
        if kind == "quantile":
            out[at] = tree.quantile(at - w + 1, w, more[0])
        elif kind == "rank":
            out[at] = tree.count_at_most(at - w + 1, at + 1, x[at]) / w
        else:
            out[at] = tree.median_distance(at - w + 1, w)
    return out


def _order_statistics(df: DataFrame, rows: Rows, asked: Iterable[tuple]) -> DataFrame:
    ship(df.sparkSession)
    asked, order = list(asked), rows.order
    schema = StructType([*df.schema.fields, *[StructField(a[0], DoubleType()) for a in asked]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        k = table.column(order).to_numpy()
        trees = {}
        for column, kind, x, *more in asked:
            if x not in trees:
                values = table.column(x).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
                trees[x] = values, WaveletMatrix(values)
            made = order_statistic(trees[x][0], k, kind, *more, tree=trees[x][1])
            table = table.append_column(column, pa.array(made, from_pandas=True))
        return table

    return df.groupBy(*rows.keys).applyInArrow(run, schema)


def median(ordered: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def clip0(x: Column) -> Column:
    """max(0, x) that keeps null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def settled(x: Column) -> Column:
    """0 for a difference of logarithms of prices that is nothing but the rounding of means, which a nearly empty denominator would make large."""
    return F.when(F.abs(x) < ROUNDING, 0.0).otherwise(x)


def root(x: Column) -> Column:
    return F.sqrt(clip0(x))


def safe_log_ratio(num: Series, den: Series, when: Column | None = None) -> Column:
    """ln(num / den) where both are above zero (and when holds), else null."""
    num, den = _col(num), _col(den)
    sound = (num > 0) & (den > 0)
    return F.when(sound if when is None else sound & when, F.ln(num / den))


def norm_cdf(x: Column) -> Column:
    """Distribution function of the standard normal, through an error function good to 1e-15.

    Below 3 the series of erf with positive terms, exp(-x^2) * sum of 2^n x^(2n+1) / (2n+1)!!; beyond it the continued fraction of erfc.
    """
    a = F.abs(x) / math.sqrt(2)
    # the sum from its last term inwards: 1 + 2 a^2 / 3 * (1 + 2 a^2 / 5 * (..))
    series = F.lit(1.0)
    for n in range(60, 0, -1):
        series = 1 + 2 * a * a / (2 * n + 1) * series
    inner = 2 / math.sqrt(math.pi) * a * F.exp(-a * a) * series
    # erfc(a) = exp(-a^2) / sqrt(pi) / (a + 1/2 / (a + 1 / (a + 3/2 / (a + ..))))
    tail = a
    for n in range(40, 0, -1):
        tail = a + (n / 2) / tail
    outer = 1 - F.exp(-a * a) / math.sqrt(math.pi) / tail
    erf = F.when(a < 2.5, inner).otherwise(outer)
    return F.when(x.isNotNull(), 0.5 * (1 + F.signum(x) * erf))


def rogers_satchell() -> Column:
    ratio = lambda a, b: safe_log_ratio(a, b)
    return ratio("high", "close") * ratio("high", "open") + ratio("low", "close") * ratio("low", "open")


def parkinson() -> Column:
    high_low = safe_log_ratio("high", "low", F.col("high") > F.col("low"))
    return high_low * high_low / (4 * math.log(2))


def garman_klass() -> Column:
    high_low, close_open = safe_log_ratio("high", "low", F.col("high") > F.col("low")), safe_log_ratio("close", "open")
    return 0.5 * high_low * high_low - (2 * math.log(2) - 1) * close_open * close_open
