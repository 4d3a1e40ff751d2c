"""Adaptive windowing: where the mean of a series has changed, without a window length to choose.

Rows come in batches of clock consecutive ones. The window is an exponential histogram: at most ROOM buckets of each size of 1, 2, 4, .. batches, each with its rows, mean and squared deviations, the oldest two of a size merged when there is one too many. After each
batch every border between buckets is tested: if the means on both sides differ by more than the bound (delta is the chance of a false alarm), the oldest bucket is forgotten, and so on until none does; such a batch has an alarm.

Two levels: batches are summed up by Spark, in parallel and pre-aggregated, so what one task reads of a series in order is one row for clock rows. The window itself is sequential; it keeps O(log batches) buckets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from barloom.plans.shipping import ship

ROOM = 5
#: Rows of a window below which nothing is tested, and of either side of a border.
GRACE, LEAST = 10, 5


class Window:
    """The histogram: sizes[i] holds the buckets of 2**i batches, the newest last, as (rows, mean, squared deviations)."""

    def __init__(self, delta: float, grace: int = GRACE):
        self.delta, self.grace = delta, grace
        self.sizes: list[list[tuple[float, float, float]]] = []

    @staticmethod
    def merged(a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        step = b[1] - a[1]
        return n, a[1] + step * b[0] / n, a[2] + b[2] + step * step * a[0] * b[0] / n

    def total(self) -> tuple[float, float, float]:
        whole = (0.0, 0.0, 0.0)
        for buckets in reversed(self.sizes):
            for bucket in buckets:
                whole = self.merged(whole, bucket)
        return whole

    def add(self, bucket: tuple) -> bool:
        """Take a batch in; whether it made the window forget something."""
        for i in range(len(self.sizes) + 1):
            if i == len(self.sizes):
                self.sizes.append([])
            self.sizes[i].append(bucket)
            if len(self.sizes[i]) <= ROOM:
                break
            bucket = self.merged(self.sizes[i].pop(0), self.sizes[i].pop(0))
        changed = False
        while self._cut():
            oldest = next(b for b in reversed(self.sizes) if b)
            oldest.pop(0)
            while self.sizes and not self.sizes[-1]:
                self.sizes.pop()
            changed = True
        return changed

    def _cut(self) -> bool:
        """Whether the means on both sides of any border differ too much."""
        buckets = np.array([b for size in reversed(self.sizes) for b in size])
        if len(buckets) < 2:
            return False
        n, _, squares = self.total()
        if n < self.grace:
            return False
        count, total = np.cumsum(buckets[:, 0])[:-1], np.cumsum(buckets[:, 0] * buckets[:, 1])
        rest = n - count
        tested = (count >= LEAST) & (rest >= LEAST)
        if not tested.any():
            return False
        gap = np.abs(total[:-1] / count - (total[-1] - total[:-1]) / rest)
        chance, harmonic = math.log(2 * math.log(n) / self.delta), 1 / count + 1 / rest
        bound = np.sqrt(2 * harmonic * (squares / n) * chance) + 2 / 3 * harmonic * chance
        return bool((gap > bound)[tested].any())


def adwin(series: DataFrame, key: str, order: str, x: str | Column, delta: float = 0.002, clock: int = 32, grace: int = GRACE) -> DataFrame:
    """key, batch, alarm, width (rows in the window after the batch) and mean (of the window) for every batch of clock consecutive numbers of order that has a value; missing values (null, NaN) count nowhere.

    Squared deviations of a batch are merged from parts, so where tasks divide the rows shows in the last bits only.
    """
    ship(series.sparkSession)
    value = (F.col(x) if isinstance(x, str) else x).cast("double")
    value = F.when(~F.isnan(value), value)
    batch = F.floor(F.col(order) / clock).alias("batch")
    per = series.groupBy(F.col(key).alias("key"), batch).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("squares")).filter("n > 0")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        window = Window(delta, grace)
        alarms, widths, means = [], [], []
        for bucket in zip(*(table.column(c).to_pylist() for c in ("n", "mean", "squares"))):
            alarms.append(window.add(bucket))
            n, mean, _ = window.total()
            widths.append(int(n)), means.append(mean)
        columns = [table.column("key"), table.column("batch"), pa.array(alarms, pa.bool_()), pa.array(widths, pa.int64()), pa.array(means, pa.float64())]
        return pa.Table.from_arrays(columns, names=["key", "batch", "alarm", "width", "mean"])

    schema = StructType([per.schema["key"], per.schema["batch"], StructField("alarm", BooleanType()), StructField("width", LongType()), StructField("mean", DoubleType())])
    return per.groupBy("key").applyInArrow(run, schema).withColumnRenamed("key", key)
