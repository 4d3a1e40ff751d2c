"""Exact quantiles of columns of any length, by groups, from counts that merge.

F.percentile keeps all distinct values of a group in one buffer. Here each wanted order statistic has a bracket of values that holds it, at first the whole range. A pass counts the rows of every bracket in BUCKETS parts of it, pre-aggregated in
all tasks, and narrows it to the part in which the wanted rank falls. Parts are even in value and, every second pass, even in the logarithm, so that a few huge values do not keep all others in one part. A bracket with
one value left is done; one with at most AT_MOST rows is sorted. Uniform values need one pass for each factor of BUCKETS in AT_MOST / rows. What a pass leaves is one row a group and quantile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.tables import removed, written

BUCKETS, AT_MOST = 4096, 10_000


def _even(x: Column, lo: Column, hi: Column, buckets: int, by_size: bool) -> Column:
    """The part of [lo, hi], lo < hi, that x is in; lo and hi never share one."""
    if by_size:
        # grows with x over all doubles: the exponent, with the sign
        size = lambda v: F.signum(v) * F.when(v == 0, 0.0).otherwise(F.log2(F.abs(v)) + 1080)
        x, lo, hi = size(x), size(lo), size(hi)
        span = hi - lo
    else:
        # halves, as the difference of two doubles may be none
        x, lo, hi = x / 2, lo / 2, hi / 2
        span = hi - lo
    return F.when(span > 0, F.least(F.floor((x - lo) / span * buckets), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")


def quantiles(df: DataFrame, x: str | Column, qs: list[float], by: tuple[str, ...] = (), buckets: int = BUCKETS, at_most: int = AT_MOST) -> DataFrame:
    """by, n (values that are there) and q, the array of the quantiles of x by linear interpolation; null where there is no value. Null and NaN are no values; without by there is one row.

    The work is done when this returns; what it returns is one stored row a group.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    value = (F.col(x) if isinstance(x, str) else x).cast("double")
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], F.when(~F.isnan(value), value).alias("_x")).persist()
    same = lambda a, b: [a[k].eqNullSafe(b[f"_o{k}"]) for k in keys]
    renamed = lambda d: d.select(*[F.col(c).alias(f"_o{c}") for c in d.columns])
    made_here: list[DataFrame] = []
    try:
        groups = rows.groupBy(*keys).agg(F.count("_x").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")) if keys else rows.agg(F.count("_x").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        groups = written(groups, "quantiles")
        made_here.append(groups)
        at = [F.lit(q) * (F.col("n") - 1) for q in qs]
        ranks = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
        wanted = groups.filter("n > 0").select(*keys, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
        turn = 0
        while True:
            wide = wanted.filter((F.col("inside") > at_most) & (F.col("lo") < F.col("hi")))
            if wide.isEmpty():
                break
            brackets = renamed(wide.select(*keys, "lo", "hi", "below").distinct())
            met = rows.join(brackets, [*same(rows, brackets), F.col("_x").between(F.col("_olo"), F.col("_ohi"))])
            part = _even(F.col("_x"), F.col("_olo"), F.col("_ohi"), buckets, turn % 2 == 1)
            held = [f"_o{k}" for k in keys] + ["_olo", "_obelow"]
            parts = met.groupBy(*held, part.alias("part")).agg(F.count("*").alias("c"), F.min("_x").alias("part_lo"), F.max("_x").alias("part_hi"))
            upto = F.sum("c").over(Window.partitionBy(*held).orderBy("part")) + F.col("_obelow")
            parts = parts.withColumn("upto", upto)
            found = wide.join(parts, [*same(wide, parts), F.col("lo") == F.col("_olo"), F.col("rank") < F.col("upto"), F.col("rank") >= F.col("upto") - F.col("c")])
            found = found.select(*keys, "rank", F.col("part_lo").alias("lo"), F.col("part_hi").alias("hi"), (F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("inside"))
            narrow = wanted.filter((F.col("inside") <= at_most) | (F.col("lo") >= F.col("hi")))
            wanted, turn = written(narrow.unionByName(found), "quantiles"), turn + 1
            made_here.append(wanted)
        few = renamed(wanted.filter("lo < hi").select(*keys, "lo", "hi").distinct())
        sorted_ = rows.join(few, [*same(rows, few), F.col("_x").between(F.col("_olo"), F.col("_ohi"))]).groupBy(*[f"_o{k}" for k in keys], "_olo").agg(F.sort_array(F.collect_list("_x")).alias("_sorted"))
        told = wanted.join(sorted_, [*same(wanted, sorted_), F.col("lo") == F.col("_olo")], "left")
        told = told.select(*keys, F.struct("rank", F.coalesce(F.get("_sorted", (F.col("rank") - F.col("below")).cast("int")), F.col("lo")).alias("value")).alias("told"))
        values = renamed(told.groupBy(*keys).agg(F.map_from_entries(F.collect_list("told")).alias("values")) if keys else told.agg(F.map_from_entries(F.collect_list("told")).alias("values")))
        made = groups.join(values, same(groups, values), "left") if keys else groups.crossJoin(values)
        of = lambda rank: F.element_at("_ovalues", rank.cast("long"))

        def interpolated(a: Column) -> Column:
            low, high = F.floor(a), F.ceil(a)
            # rounded as SQL's quantile_cont rounds it: among equal values and neighbouring doubles the last bit decides on which side of a cut rows fall
            between = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), of(low), high - a, (a - low) * of(high)).cast("double")
            return F.when(low == high, of(low)).otherwise(between)

        q = F.when(F.col("n") > 0, F.array(*map(interpolated, at)))
        return written(made.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "n", q.alias("q")), "quantiles")
    finally:
        rows.unpersist()
        for table in made_here:
            removed(table)


def quantile_values(df: DataFrame, x: str | Column, qs: list[float]) -> list[float]:
    """The quantiles of a whole column as numbers; empty if it has no values."""
    return quantiles(df, x, qs).first().q or []
