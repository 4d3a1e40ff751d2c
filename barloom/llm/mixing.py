"""Mix sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed shuffled order, gone through max_passes times. As in a packet network, documents are served in
packets of at most PACKET words. A packet's virtual finish time is the cumulative word count of its source up to and with it, divided by the source's
target. All packets are range-sorted by virtual finish time, whatever their source, and the order is cut where the running total of words meets the
budget, within a packet if need be. What a document gives are the words of its packets before the cut; targets decide nothing else. At the cut every
source is within a packet or two of its target, however long its documents are.

Defined results: null or blank text has size 0 and takes 0; a null source is a source of its own, ordered
last; repeated rows count each on its own; an empty table gives an empty table; further columns of the input
are not read by mixed() and pass through mix(), whatever their names.

Scale: one scan of the text. Only (doc_id, source, size, order) and packets (source, finish time, words) are shuffled. Running sums use two levels:
documents fall in sqrt(rows) slices of the shuffled order, slices are summed per source, and a window then
runs within one source and slice, so no task holds a whole source, however hot; packets are summed per range partition first, then
within. As the packets of a source are served in its own order, what is served of it is one number per source, which goes back to its documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native_text import word_count
from .storage import materialize, scope, whole_rows

WEIGHTS = (3, 1, 2)
#: Total budget as a share of all sizes, and the most often that a source may be gone through.
BUDGET_SHARE = 1.5
MAX_PASSES = 2
#: Most words of a document that are served at once.
PACKET = 512
_HASH_DIGITS = 8


def source_targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_passes: int = MAX_PASSES) -> DataFrame:
    """Rows (source, source_size) with target: budget shared by weight, cut at max_passes sizes, excess reshared.

    With sources ordered by cap over weight the cut ones come first, so one pass of running sums finds the
    level at which the rest share what is left. One row per source goes through one task.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", "rank")
    cap, weight = F.col("cap"), F.col("weight")
    left = F.lit(float(budget_share)) * F.col("total") - F.col("cap_before")
    return (
        per_source.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("cap", F.col("source_size") * max_passes)
        .withColumn("ratio", cap / weight)
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", left / F.col("weight_left"))
        .withColumn("first_open", F.first(F.when(cap > weight * F.col("level"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("source", "source_size", F.when(F.col("first_open").isNull() | (cap <= weight * F.col("first_open")), cap.cast("double")).otherwise(weight * F.col("first_open")).alias("target"))
    )


def _turn() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))


def _columns() -> list[Column]:
    return [F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), _turn().alias("turn")]


def schedule(sized: DataFrame, carry: DataFrame | None = None, **shares) -> DataFrame:
    """One row per document of sized (a table of _columns()): doc_id, source, size, source_size, target, start (words of its source before it).

    With carry, the documents themselves, a struct column row holds the whole input row, which then goes through the last shuffle.
    """
    slices = max(1, math.isqrt(sized.count()))
    slice_no = F.floor(F.conv(F.substring("turn", 1, _HASH_DIGITS), 16, 10).cast("long") * slices / 16**_HASH_DIGITS)
    per_slice = sized.groupBy("source", slice_no.alias("slice")).agg(F.sum("size").alias("slice_size"))
    before = F.coalesce(F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = source_targets(per_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size")), **shares)
    slice_rows = per_slice.withColumn("before", before).alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    slice_rows = slice_rows.select(F.col("s.source").alias("slice_source"), F.col("slice").alias("slice_no"), "before", "source_size", "target")
    rows = (sized if carry is None else whole_rows(carry, *_columns())).withColumn("slice", slice_no)
    joined = rows.join(slice_rows, F.col("source").eqNullSafe(F.col("slice_source")) & (F.col("slice") == F.col("slice_no")))
    within = Window.partitionBy("source", "slice").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("before") + F.sum("size").over(within) - F.col("size")
    return joined.select("doc_id", "source", "size", "source_size", "target", start.alias("start"), *([] if carry is None else ["row"]))


def packets(rows: DataFrame, max_passes: int = MAX_PASSES, packet: int = PACKET) -> DataFrame:
    """source, finish (virtual finish time) and words of every packet of scheduled rows, in every pass over their source."""
    cuts = F.sequence(F.lit(0), F.col("size") - 1, F.lit(packet))
    served = rows.filter("size > 0").select("source", "size", "start", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))).alias("pass"))
    served = served.select("*", F.explode(cuts).alias("at"))
    stop = F.least(F.col("at") + packet, F.col("size"))
    finish = (F.col("start") + F.col("source_size") * F.col("pass") + stop) / F.col("target")
    return served.select("source", F.when(F.col("target") > 0, finish).otherwise(F.lit(float("inf"))).alias("finish"), (stop - F.col("at")).alias("words"))


def served_words(queue: DataFrame, budget: Column) -> DataFrame:
    """served_source and served: the words of each source in packets (source, finish, words) before the cut.

    The queue is range-sorted by finish time and cut where its running total meets the budget, a column of one number.
    """
    order = [F.col("finish"), F.col("source").asc_nulls_last()]
    ranged = materialize(queue.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("part_words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("part").agg(F.sum("words").alias("part_words")).select(F.col("part").alias("part_no"), before.alias("part_before"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("part_before") + F.coalesce(F.sum("words").over(within), F.lit(0))
    placed = ranged.join(parts, F.col("part") == F.col("part_no")).withColumn("total", total)
    taken = F.greatest(F.lit(0), F.least(F.col("words"), budget - F.col("total")))
    return placed.groupBy(F.col("source").alias("served_source")).agg(F.sum(taken).cast("long").alias("served"))


def _served(docs: DataFrame, carry: bool, max_passes: int = MAX_PASSES, budget_share: float = BUDGET_SHARE, packet: int = PACKET, **options) -> DataFrame:
    """schedule() with served, the words of a document's source that the mix takes."""
    shares = options | {"max_passes": max_passes, "budget_share": budget_share}
    with scope(docs.sparkSession) as kept:
        sized = materialize(docs.select(*_columns()))
        plan = materialize(schedule(sized, **shares))
        size = plan.agg(F.sum("size")).first()[0] or 0
        budget = F.lit(math.floor(min(budget_share, max_passes) * size))
        done = materialize(served_words(packets(plan, max_passes, packet), budget))
        kept += [done, sized if carry else plan]
    rows = schedule(sized, docs, **shares) if carry else plan
    found = rows.join(done, F.col("source").eqNullSafe(F.col("served_source")), "left")
    return found.withColumn("served", F.coalesce("served", F.lit(0).cast("long"))).drop("served_source")


def _taken(passes: int) -> list[Column]:
    """Words taken of a document in each pass over its source."""
    return [F.greatest(F.lit(0), F.least(F.col("size"), F.col("served") - F.col("start") - F.col("source_size") * p)).cast("long") for p in range(passes)]


def mixed(docs: DataFrame, max_passes: int = MAX_PASSES, **options) -> DataFrame:
    """schedule() with taken (words over all passes), copies (passes that take any word) and virtual_finish (of the first pass)."""
    rows = _served(docs, False, max_passes, **options)
    parts = _taken(max_passes)
    rows = rows.withColumn("taken", sum(parts[1:], parts[0])).withColumn("copies", sum((F.when(x > 0, 1).otherwise(0) for x in parts[1:]), F.when(parts[0] > 0, 1).otherwise(0)))
    return rows.withColumn("virtual_finish", F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target"))).drop("served")


def mix(docs: DataFrame, max_passes: int = MAX_PASSES, **options) -> DataFrame:
    """The mix itself: whole rows of docs, repeated as often as they are taken, in order of virtual finish time.

    A document that the budget cuts stays whole here. Documents without words are in no mix.
    """
    rows = _served(docs, True, max_passes, **options)
    finish = (F.col("start") + F.col("size")) / F.col("target")
    passes = F.array_compact(F.array(*[F.when(x > 0, finish + F.col("source_size") * p / F.col("target")) for p, x in enumerate(_taken(max_passes))]))
    return rows.select("row", F.explode(passes).alias("virtual_finish")).orderBy("virtual_finish", "row.doc_id").select("row.*")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "virtual_finish")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS turn
  FROM documents),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM per_source),
filled AS (
  SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cap_before,
         CAST(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_left FROM weighted),
levels AS (SELECT *, (CAST(1.5 AS DOUBLE) * total - cap_before) / weight_left AS level FROM filled),
opened AS (
  SELECT *, first_value(CASE WHEN cap > weight * level THEN level END IGNORE NULLS)
         OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_open FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN first_open IS NULL OR cap <= weight * first_open THEN CAST(cap AS DOUBLE) ELSE weight * first_open END AS target FROM opened),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.turn, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (SELECT *, unnest(range(0, size, 512)) AS begun FROM (SELECT *, unnest([0, 1]) AS pass FROM placed) WHERE size > 0),
packets AS (
  SELECT source, least(begun + 512, size) - begun AS words, CASE WHEN target > 0 THEN (start + source_size * pass + least(begun + 512, size)) / target ELSE 'inf'::DOUBLE END AS finish FROM passes),
queue AS (
  SELECT source, words, CAST(sum(words) OVER (ORDER BY finish, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - words AS total FROM packets),
served AS (
  SELECT source, CAST(sum(greatest(0, least(words, (SELECT CAST(floor(1.5 * sum(size)) AS BIGINT) FROM sized) - total))) AS BIGINT) AS served FROM queue GROUP BY source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, coalesce(served, 0) - start)) + greatest(0, least(size, coalesce(served, 0) - start - source_size)) AS BIGINT) AS taken,
       CASE WHEN target > 0 THEN (start + size) / target END AS virtual_finish
FROM placed p LEFT JOIN served v ON p.source IS NOT DISTINCT FROM v.source
"""
