"""Permutation importance in blocks of time: how much worse a score becomes when one feature's values are dealt to other rows, within blocks of consecutive rows and across all of them.

A feature whose loss comes only when values leave their time owes its worth to when a row was, not to its value. Nothing is drawn on the driver: every row has a place by its order in time and one by a hash of
(seed, feature, replicate, row); it takes the value of the row whose hash place is its own place, by an equi-join that moves both sides. Places are running counts in two levels, so a block is no one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import metrics
from barloom.operators.resampling import BUCKETS, uniform
from barloom.plans.blocks import running
from barloom.plans.tables import written

WITHIN, ACROSS = "within", "across"


def permuted(df: DataFrame, features: list[str], order: str, blocks: int, repeats: int, seed: int = 42, rows_in_bucket: int = 1000) -> DataFrame:
    """The rows of df for each feature, mode (within, across) and replicate, with that feature's values dealt anew.

    order, a whole number that no two rows share, is the order of time; blocks are as even as they can be.
    """
    if blocks < 1:
        raise ValueError("blocks must be 1 at least")
    rows = running(df.withColumns({"_all": F.lit(0), "_one": F.lit(1)}), "_place", F.col("_one"), "_all", F.floor(F.col(order) / rows_in_bucket), order)
    n = df.count()
    if 0 < n < blocks:
        raise ValueError("there are fewer rows than blocks")
    # row i is in block i * blocks // n, which begins at the row of the least i that is
    place, block = F.col("_place") - 1, F.floor((F.col("_place") - 1) * blocks / max(n, 1))
    rows = written(rows.withColumns({"_place": place, "_block": block}).drop("_all", "_one"), "permuted")
    start = F.ceil(F.col("_block") * n / blocks)
    modes = F.array(F.struct(F.lit(WITHIN).alias("mode"), F.col("_block").alias("part"), (F.col("_place") - start + 1).alias("own")), F.struct(F.lit(ACROSS).alias("mode"), F.lit(-1).cast("long").alias("part"), (F.col("_place") + 1).alias("own")))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value")) for f in features])
    spread = rows.withColumns({"_cell": F.explode(cells), "replicate": F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))}).withColumn("_mode", F.explode(modes))
    spread = spread.select("*", F.col("_cell.feature").alias("feature"), F.col("_cell.value").alias("_value"), F.col("_mode.mode").alias("mode"), F.col("_mode.part").alias("_part"), F.col("_mode.own").alias("_own")).drop("_cell", "_mode")
    key = F.concat_ws("|", "feature", "replicate", "_part")
    # some of many rows draw equal numbers; these take turns in order of time
    turn = F.struct(uniform(seed, F.col("feature"), F.col("replicate"), F.col(order)).alias("drawn"), F.col(order).alias("at"))
    givers = spread.select("_value", key.alias("_key"), turn.alias("_turn"), F.lit(1).alias("_one"))
    givers = running(givers, "_taken", F.col("_one"), "_key", F.floor(F.col("_turn.drawn") * BUCKETS), "_turn").select("_key", "_taken", F.col("_value").alias("_given"))
    # what Spark takes for the size of these is that of the file before its rows were multiplied, which it would broadcast
    met = spread.withColumn("_own_key", key).join(givers.hint("merge"), (F.col("_own_key") == F.col("_key")) & (F.col("_own") == F.col("_taken")))
    dealt = met.withColumns({f: F.when(F.col("feature") == f, F.col("_given")).otherwise(F.col(f"`{f}`")) for f in features})
    return dealt.select(*df.columns, "feature", "mode", "replicate")


def block_importance(df: DataFrame, features: list[str], score: Column, order: str, metric: str = "ap", blocks: int = 8, repeats: int = 3, seed: int = 42) -> DataFrame:
    """feature, drop_within_mean, drop_within_std, drop_across_mean, drop_across_std and ratio (across over within; null where within is nothing): what a metric (operators.metrics) of score, an expression over the features, loses.

    df has the features and y. Nothing is fitted: the score is given.
    """
    base = metrics.evaluate(df.withColumn("p", score), [metric]).first()[metric]
    dealt = permuted(df, features, order, blocks, repeats, seed).withColumn("p", score)
    per = metrics.evaluate(dealt, [metric], ("feature", "mode", "replicate")).withColumn("drop", F.lit(base) - F.col(metric))
    of = lambda mode: F.when(F.col("mode") == mode, F.col("drop"))
    got = per.groupBy("feature").agg(*[fn(of(mode)).alias(f"drop_{mode}_{name}") for mode in (WITHIN, ACROSS) for name, fn in (("mean", F.avg), ("std", F.stddev_pop))])
    return got.withColumn("ratio", F.when(F.abs("drop_within_mean") > 1e-12, F.col("drop_across_mean") / F.col("drop_within_mean")))
