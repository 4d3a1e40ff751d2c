"""Cut long series into blocks of rows that are worked on apart.

One series in one window partition is one task, however long it is. Every feature looks back (and a label ahead) a known number of rows, so a block needs only its own
rows and that many around it (its halo). Rows are copied into the halos that need them, windows run per (symbol, block), and the
copies are dropped. This is exact for finite windows. What looks back without end (running totals, the last known value) takes two levels: a window within each
block, and one over the blocks, which have one row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import Rows

#: Rows of a block.
BLOCK_ROWS = 20_000


def in_blocks(df: DataFrame, work: Callable[[DataFrame, Rows], DataFrame], halo: int, block_rows: int = BLOCK_ROWS, key: str = "symbol", order: str = "k", direct: int | None = None, ahead: int = 0) -> DataFrame:
    """work(df, rows) as if over whole series, on blocks of block_rows rows with halo rows before them and ahead rows after."""
    own = F.floor(F.col(order) / block_rows)
    # the blocks that a row is in, or in the halo of
    first, last = F.floor(F.greatest(F.col(order) - ahead, F.lit(0)) / block_rows), F.floor((F.col(order) + halo) / block_rows)
    spread = df.withColumn("_block", F.explode(F.sequence(F.least(own, first), last)))
    rows = Rows((key, "_block"), order) if direct is None else Rows((key, "_block"), order, direct)
    return work(spread, rows).filter(F.col("_block") == own).drop("_block")


def _levels(df: DataFrame, name: str, key: str, bucket: Column, order: list, within: Callable, per_bucket: Column, over_buckets: Callable, join: Callable) -> DataFrame:
    df = df.withColumn("_lv_bucket", bucket)
    spec = Window.partitionBy(key, "_lv_bucket").orderBy(*order)
    df = df.withColumn("_lv_own", within(spec))
    ends = df.groupBy(F.col(key).alias("_lv_key"), F.col("_lv_bucket").alias("_lv_at")).agg(per_bucket.alias("_lv_end"))
    earlier = Window.partitionBy("_lv_key").orderBy("_lv_at").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_lv_key", "_lv_at", over_buckets(earlier).alias("_lv_before"))
    joined = df.join(ends, F.col(key).eqNullSafe(F.col("_lv_key")) & F.col("_lv_bucket").eqNullSafe(F.col("_lv_at")))
    return joined.withColumn("_lv_made", join(F.col("_lv_own"), F.col("_lv_before"))).drop("_lv_bucket", "_lv_own", "_lv_key", "_lv_at", "_lv_before").withColumnRenamed("_lv_made", name)


def carry(df: DataFrame, name: str, value: Column, key: str, bucket: Column, order: str | list) -> DataFrame:
    """df with the last value that is there at or before each row; bucket grows with order."""
    order = [order] if isinstance(order, str) else order
    df = df.withColumn("_lv_value", value)
    last = F.max_by("_lv_value", F.when(F.col("_lv_value").isNotNull(), F.struct(*order)))
    made = _levels(df, name, key, bucket, order, lambda spec: F.last("_lv_value", ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, 0)), last, lambda w: F.last("_lv_end", ignorenulls=True).over(w), F.coalesce)
    return made.drop("_lv_value")


def previous(df: DataFrame, name: str, value: Column, key: str, bucket: Column, order: str) -> DataFrame:
    """df with the value of the row before each."""
    df = df.withColumn("_lv_value", F.struct(value.alias("v")))
    # a struct is there even where its value is null
    made = _levels(df, "_lv_found", key, bucket, [order], lambda spec: F.lag("_lv_value").over(spec), F.max_by("_lv_value", order), lambda w: F.last("_lv_end").over(w), F.coalesce)
    return made.withColumn(name, F.col("_lv_found.v")).drop("_lv_value", "_lv_found")


def runnings(df: DataFrame, columns: dict[str, tuple[Column, str]], key: str, bucket: Column, order: str) -> DataFrame:
    """df with running sums, mins or maxs up to each row, by name the value and which; bucket grows with order. They are made side by side."""
    fns = {"sum": F.sum, "min": F.min, "max": F.max}
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
    df = df.withColumn("_lv_value", F.struct(*[v.alias(n) for n, (v, _) in columns.items()]))
    of = lambda col, over=None: F.struct(*[(fns[how](F.col(f"{col}.`{n}`")) if over is None else fns[how](F.col(f"{col}.`{n}`")).over(over)).alias(n) for n, (_, how) in columns.items()])
    within = lambda spec: of("_lv_value", spec.rowsBetween(Window.unboundedPreceding, 0))
    made = _levels(df, "_lv_found", key, bucket, [order], within, of("_lv_value"), lambda w: of("_lv_end", w), lambda own, before: F.struct(*[both[how](own[n], before[n]).alias(n) for n, (_, how) in columns.items()]))
    return made.withColumns({n: F.col(f"_lv_found.`{n}`") for n in columns}).drop("_lv_value", "_lv_found")


def running(df: DataFrame, name: str, value: Column, key: str, bucket: Column, order: str, how: str = "sum") -> DataFrame:
    """runnings() of one column."""
    return runnings(df, {name: (value, how)}, key, bucket, order)
