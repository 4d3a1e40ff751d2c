"""When a series first passes a level within the rows ahead.

The greatest value of the next 1, 2, 4, 8, .. rows of every row is made by doubling. The first row that passes a level is then found by descent: from the longest of these stretches down, one that does not reach the level
is skipped. That takes log2(horizon) steps a question instead of the horizon's values, and one array of rows for each step. All is numpy over blocks of rows that hold the rows ahead
of their own (plans.blocks), many questions at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from barloom.functions.rolling import Rows
from barloom.plans.blocks import BLOCK_ROWS, in_blocks
from barloom.plans.shipping import ship

_NEVER = -np.inf


class Ahead:
    """The rows after each row of a series, to be asked for their greatest value and for the first that passes. Missing values pass nothing."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        first = np.append(np.where(np.isnan(values), _NEVER, values)[1:], _NEVER) if self.n else np.zeros(0)
        #: at j: the greatest of the next 2**j rows
        self.best = [first]

    def _upto(self, horizon: int) -> int:
        """The levels that stretches of so many rows need."""
        while 2 << (len(self.best) - 1) <= horizon:
            half, size = self.best[-1], 1 << (len(self.best) - 1)
            later = np.full(self.n, _NEVER)
            later[: max(self.n - size, 0)] = half[size:]
            self.best.append(np.maximum(half, later))
        return horizon.bit_length()

    def greatest(self, horizon: int) -> np.ndarray:
        """The greatest of the next horizon rows of every row, or of as many as there are; -inf if none has a value."""
        top = self._upto(horizon) - 1
        rest = horizon - (1 << top)
        later = np.full(self.n, _NEVER)
        later[: max(self.n - rest, 0)] = self.best[top][rest:]
        return np.maximum(self.best[top], later)

    def first(self, at: np.ndarray, passes: Callable[[np.ndarray], np.ndarray], horizon: int) -> np.ndarray:
        """For each of some rows the rows until the first of the next horizon whose value passes, 0 if none does. passes(values) says which pass, one value for each of at; what is greater than a passing value must pass too."""
        skipped = np.zeros(len(at), np.int64)
        for j in reversed(range(self._upto(horizon))):
            there = np.minimum(at + skipped, self.n - 1)
            skip = (skipped + (1 << j) <= horizon) & ~passes(self.best[j][there])
            skipped += np.where(skip, 1 << j, 0)
        found = (skipped < horizon) & (at + skipped + 1 < self.n)
        return np.where(found, skipped + 1, 0)


def count_ahead(present: np.ndarray, horizon: int) -> np.ndarray:
    """How many of the next horizon rows are present."""
    total = np.concatenate([[0], np.cumsum(present)])
    n = len(present)
    return total[np.minimum(np.arange(n) + 1 + horizon, n)] - total[np.arange(n) + 1]


def numbers(table: pa.Table, column: str) -> np.ndarray:
    """A column as doubles, with NaN for null."""
    return table.column(column).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)


def by_series(df: DataFrame, rows: Rows, make: Callable[[pa.Table], dict[str, np.ndarray]], columns: list[StructField]) -> DataFrame:
    """df with columns that make() finds from the rows of a key in order; NaN becomes null."""
    ship(df.sparkSession)
    order = rows.order
    kinds = {f.name: pa.float64() if isinstance(f.dataType, DoubleType) else pa.int64() for f in columns}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        for name, values in make(table).items():
            table = table.append_column(name, pa.array(values, from_pandas=True).cast(kinds[name]))
        return table

    return df.groupBy(*rows.keys).applyInArrow(run, StructType([*df.schema.fields, *columns]))


def log_gain(values: np.ndarray, base: np.ndarray) -> np.ndarray:
    """ln(values / base), NaN where either is not above zero."""
    good = (values > 0) & (base > 0) & np.isfinite(values)
    return np.log(np.where(good, values, 1.0) / np.where(good, base, 1.0)) + np.where(good, 0.0, np.nan)


def barrier_ahead(df: DataFrame, rows: Rows, horizon: int, barrier: float, price: str, base: str = "close") -> DataFrame:
    """df with _rows and _prices (how many of the next horizon rows there are, and have a price), _best (the greatest price) and _tau (rows until the log gain over base reaches the barrier)."""

    def make(table: pa.Table) -> dict[str, np.ndarray]:
        values, own = numbers(table, price), numbers(table, base)
        ahead, at = Ahead(values), np.arange(len(values))
        best = ahead.greatest(horizon)
        # a comparison with NaN is false: nothing passes
        tau = ahead.first(at, lambda v: log_gain(v, own) >= barrier, horizon)
        return {"_rows": np.minimum(horizon, len(values) - 1 - at), "_prices": count_ahead(~np.isnan(values), horizon), "_best": np.where(np.isneginf(best), np.nan, best), "_tau": np.where(tau > 0, tau, np.nan)}

    return by_series(df, rows, make, [StructField("_rows", LongType()), StructField("_prices", LongType()), StructField("_best", DoubleType()), StructField("_tau", DoubleType())])


def first_passage(bars: DataFrame, up: dict[str, tuple[str, str]], down: dict[str, tuple[str, str]], horizon: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """bars with, by name, the rows until a series first reaches a level that each row has; null where it does not within horizon rows.

    up, down: by name the series and the column of levels; a series reaches a level from below or from above. Missing values and levels reach nothing.
    """
    names = [*up, *down]

    def work(df: DataFrame, rows: Rows) -> DataFrame:
        def make(table: pa.Table) -> dict[str, np.ndarray]:
            known, out = {}, {}
            for sign, asked in ((1, up), (-1, down)):
                for name, (series, level) in asked.items():
                    if (sign, series) not in known:
                        known[sign, series] = Ahead(sign * numbers(table, series))
                    levels = sign * numbers(table, level)
                    out[name] = known[sign, series].first(np.arange(len(levels)), lambda v, levels=levels: v >= levels, horizon)
            return out

        return by_series(df, rows, make, [StructField(n, LongType()) for n in names])

    made = in_blocks(bars, work, 0, block_rows, ahead=horizon)
    return made.withColumns({n: F.when(F.col(n) > 0, F.col(n)) for n in names})
