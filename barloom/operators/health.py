"""Health of feature columns: where values are missing, how they are spread, whether they are constant or drift, summed up by family and as a list of issues.

One pass keeps the runs of missing values of all columns. Within a block of rows numpy finds, for every column, the missing rows before the first value and after the last, and the number and the longest of the runs between; blocks are then folded in their order,
where a run that reaches a block's end joins the one that begins the next. So runs of any length are found while a task holds one block. A second pass, over rows of (column, value), takes moments and thirds of the series; it is
pre-aggregated before its shuffle. Medians come from plans.quantiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from barloom.plans.blocks import BLOCK_ROWS
from barloom.plans.quantiles import quantiles
from barloom.plans.shipping import ship

#: Parts of a series, in order, whose means and deviations are compared.
THIRDS = 3
_RUNS = ("rows", "valid", "nulls", "nans", "infs", "lead", "trail", "runs", "longest")


def missing_runs(missing: np.ndarray) -> tuple[int, int, int, int]:
    """Missing values before the first value and after the last (all of them if there is none), and the number and the longest of the runs between."""
    there = np.flatnonzero(~missing)
    if not len(there):
        return len(missing), len(missing), 0, 0
    gaps = np.diff(there) - 1
    return int(there[0]), int(len(missing) - 1 - there[-1]), int((gaps > 0).sum()), int(gaps.max(initial=0))


def _family(name: Column) -> Column:
    return F.substring_index(name, "__", 1)


def missing_patterns(df: DataFrame, columns: list[str], key: str = "symbol", order: str = "k", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, name, n, n_valid, n_null, n_nan, n_inf, n_leading, n_trailing, n_runs and longest_run (of missing values between valid ones) and pattern: clean, all_missing, leading, trailing, edge or scattered. order numbers the rows without gaps.

    NaN is missing, an infinite number is not. A series without any value has n leading and n trailing missing ones.
    """
    ship(df.sparkSession)
    schema = StructType([StructField("_key", df.schema[key].dataType), StructField("_block", LongType()), StructField("name", StringType()), *[StructField(c, LongType()) for c in _RUNS]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_order")
        rows = []
        for i, name in enumerate(columns):
            column = table.column(f"_c{i}")
            values = column.to_numpy(zero_copy_only=False).astype(float)
            nulls, infs = column.null_count, int(np.isinf(values).sum())
            missing = np.isnan(values)
            lead, trail, runs, longest = missing_runs(missing)
            rows.append((name, len(values), int((~missing).sum()), nulls, int(missing.sum()) - nulls, infs, lead, trail, runs, longest))
        names, *numbers = zip(*rows)
        first = lambda c: pa.array([table.column(c)[0].as_py()] * len(rows), table.schema.field(c).type)
        return pa.Table.from_arrays([first("_key"), first("_block").cast(pa.int64()), pa.array(names), *[pa.array(n, pa.int64()) for n in numbers]], names=schema.fieldNames())

    cells = [F.col(f"`{c}`").cast("double").alias(f"_c{i}") for i, c in enumerate(columns)]
    blocks = df.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.floor(F.col(order) / block_rows).alias("_block"), *cells).groupBy("_key", "_block").applyInArrow(run, schema)
    # one entry a block; open is the run of missing rows that may go on, and lead is that before the first value
    parts = F.array_sort(F.collect_list(F.struct("_block", "valid", "rows", "lead", "trail", "runs", "longest")))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("seen", "lead", "open", "runs", "longest")])

    def fold(s: Column, b: Column) -> Column:
        joined = s["open"] + b["lead"]
        inner = (s["seen"] > 0) & (joined > 0)
        some = F.struct(
            (s["seen"] + b["valid"]).alias("seen"), F.when(s["seen"] > 0, s["lead"]).otherwise(joined).alias("lead"), b["trail"].alias("open"),
            (s["runs"] + b["runs"] + F.when(inner, 1).otherwise(0)).alias("runs"), F.greatest(s["longest"], b["longest"], F.when(inner, joined).otherwise(0)).alias("longest"),
        )
        none = F.struct(s["seen"].alias("seen"), s["lead"].alias("lead"), (s["open"] + b["rows"]).alias("open"), s["runs"].alias("runs"), s["longest"].alias("longest"))
        return F.when(b["valid"] > 0, some).otherwise(none)

    per = blocks.groupBy("_key", "name").agg(*[F.sum(c).alias(c) for c in ("rows", "valid", "nulls", "nans", "infs")], F.aggregate(parts, zero, fold).alias("s"))
    lead, trail = F.col("n_leading"), F.col("n_trailing")
    per = per.select(
        F.col("_key").alias(key), "name", F.col("rows").alias("n"), F.col("valid").alias("n_valid"), F.col("nulls").alias("n_null"), F.col("nans").alias("n_nan"), F.col("infs").alias("n_inf"),
        F.when(F.col("valid") == 0, F.col("rows")).otherwise(F.col("s.lead")).alias("n_leading"), F.col("s.open").alias("n_trailing"), F.col("s.runs").alias("n_runs"), F.col("s.longest").alias("longest_run"),
    )
    nothing = (F.col("n_valid") == 0) & (F.col("n") > 0)
    pattern = F.when(F.col("n_valid") == F.col("n"), "clean").when(nothing, "all_missing").when(F.col("n_runs") > 0, "scattered").when((lead > 0) & (trail > 0), "edge").when(lead > 0, "leading").otherwise("trailing")
    return per.withColumn("pattern", pattern)


def feature_health(df: DataFrame, columns: list[str], key: str = "symbol", order: str = "k", constant: float = 1e-12, outlier: float = 1e4, drift: float = 1.0, spread: float = 100.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """missing_patterns() with family, missing_rate, undef_rate (mean of the column's undef__ flag), mean, std, min, max and skew of the finite values, whether they are constant (imputed, if more than half are), outlier_ratio (the largest absolute value over the median of those that are not 0) and
    mean_drift and std_ratio between thirds of the series, with is_extreme_outlier and is_non_stationary.

    A constant column, one of fewer than 10 rows a third, or one with a third of fewer than two values drifts by 0 and a ratio of 1. Ratios over zero are infinite.
    """
    runs = missing_patterns(df, columns, key, order, block_rows)
    ends = df.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"), F.count("*").alias("_rows"))
    flags = {c: F.col(f"`undef__{c}`").cast("double") if f"undef__{c}" in df.columns else F.lit(0.0) for c in columns}
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("x"), flags[c].alias("undef")) for c in columns])
    part = F.least(F.floor((F.col(order) - F.col("_first")) / F.greatest(F.floor(F.col("_rows") / THIRDS), F.lit(1))), F.lit(THIRDS - 1))
    long = df.join(ends, df[key].eqNullSafe(ends["_key"])).select("_key", part.alias("part"), F.explode(cells).alias("c")).select("_key", "part", "c.*")
    finite = F.when(~F.isnan("x") & (F.abs("x") != float("inf")), F.col("x"))
    long = long.withColumn("x", finite)
    thirds = long.groupBy("_key", "name", "part").agg(F.count("x").alias("c"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).groupBy(F.col("_key").alias("_k2"), F.col("name").alias("_n2")).agg(
        F.min("c").alias("least"), F.count("*").alias("parts"), (F.max("m") - F.min("m")).alias("mean_gap"), F.min("s").alias("s_low"), F.max("s").alias("s_high")
    )
    moments = long.groupBy("_key", "name").agg(F.avg("undef").alias("undef_rate"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.skewness("x").alias("skew"))
    middle = quantiles(long.filter("x <> 0"), F.abs("x"), [0.5], ("_key", "name")).select(F.col("_key").alias("_k3"), F.col("name").alias("_n3"), F.get("q", F.lit(0)).alias("middle"))
    same = lambda a, k, n: (F.col("_key").eqNullSafe(F.col(k))) & (F.col("name") == F.col(n))  # noqa: E731,ARG005
    made = moments.join(thirds, same(moments, "_k2", "_n2")).join(middle, same(moments, "_k3", "_n3"), "left")
    made = made.select(F.col("_key").alias("_of"), F.col("name").alias("_name"), "undef_rate", "mean", "std", "min", "max", "skew", "least", "parts", "mean_gap", "s_low", "s_high", "middle")
    df = runs.join(made, runs[key].eqNullSafe(made["_of"]) & (F.col("name") == F.col("_name")))
    infinite = F.lit(float("inf"))
    still = (F.col("n_valid") > 1) & (F.col("std") < constant)
    biggest = F.greatest(F.abs("min"), F.abs("max"))
    ratio = F.when(F.col("n_valid") < 2, 0.0).when(F.col("middle") > 0, biggest / F.col("middle")).otherwise(0.0)
    moves = ~still & (F.col("n") >= THIRDS * 10) & (F.col("std") > 0) & (F.col("least") >= 2) & (F.col("parts") == THIRDS)
    drifted = F.when(moves, F.col("mean_gap") / F.col("std")).otherwise(0.0)
    widened = F.when(moves, F.when(F.col("s_low") > 0, F.col("s_high") / F.col("s_low")).when(F.col("s_high") > 0, infinite).otherwise(1.0)).otherwise(1.0)
    df = df.withColumns({"family": _family(F.col("name")), "missing_rate": (F.col("n_null") + F.col("n_nan")) / F.col("n"), "is_constant": F.coalesce(still, F.lit(False)), "outlier_ratio": ratio, "mean_drift": F.coalesce(drifted, F.lit(0.0)), "std_ratio": F.coalesce(widened, F.lit(1.0))})
    df = df.withColumns({"is_imputed_constant": F.col("is_constant") & (F.col("undef_rate") > 0.5), "is_extreme_outlier": F.coalesce(F.col("outlier_ratio") > outlier, F.lit(False)), "is_non_stationary": (F.col("mean_drift") > drift) | (F.col("std_ratio") > spread)})
    return df.drop("_of", "_name", "least", "parts", "mean_gap", "s_low", "s_high", "middle")


def summarize_by_family(health: DataFrame) -> DataFrame:
    """Per family: features (over all keys), rates of missing and imputed values, and how many features have each trouble."""
    count = lambda c, name: F.count_if(c).alias(name)
    return health.groupBy("family").agg(
        F.count("*").alias("n_features"), F.avg("undef_rate").alias("avg_undef_rate"), F.max("undef_rate").alias("max_undef_rate"), F.max("missing_rate").alias("max_missing_rate"), F.sum("n_nan").alias("n_nan"),
        count(F.col("pattern") == "scattered", "n_scattered"), count(F.col("is_imputed_constant"), "n_imputed_constant"), count(F.col("is_constant") & ~F.col("is_imputed_constant"), "n_organic_constant"), count(F.col("is_extreme_outlier"), "n_extreme_outlier"),
        count(F.col("is_non_stationary"), "n_non_stationary"), count(F.col("n_inf") > 0, "n_with_inf"), F.avg("std").alias("avg_std"), F.avg(F.abs("skew")).alias("avg_abs_skew"),
    )


def flag_issues(health: DataFrame, max_undef_rate: float = 0.5, max_abs_skew: float = 20.0) -> DataFrame:
    """The rows of feature_health() with an issue, and which: the first that applies."""
    constant = F.col("is_constant")
    issue = (
        F.when(F.col("n_nan") > 0, "residual_nan").when(F.col("n_inf") > 0, "inf").when(F.col("pattern") == "scattered", "scattered_missing").when(F.col("pattern") == "all_missing", "all_missing").when(F.col("is_extreme_outlier"), "extreme_outlier")
        .when(F.col("is_imputed_constant"), "imputed_constant").when(F.col("is_non_stationary"), "non_stationary").when(constant, "organic_constant").when(F.col("undef_rate") > max_undef_rate, "high_undef").when(F.abs("skew") > max_abs_skew, "heavy_skew")
    )
    return health.withColumn("issue", issue).filter("issue is not null")
