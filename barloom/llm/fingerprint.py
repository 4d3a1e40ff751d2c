"""Canonical exact digests of documents.

Canonical text: NFKC, full Unicode case folding, NFKC again, every run of white space one space, none at the
ends. Fingerprint: 128 bits, two XXH64 of the canonical text with different seeds. Documents are then grouped by
fingerprint, and within a group the canonical texts are compared byte by byte; one that differs from the
group's least (a hash collision) gets the SHA-256 of its canonical text added to its
fingerprint, and so does any other text with that canonical text. Equal fingerprints of documents thus mean equal canonical texts. Likeness is 1 where
fingerprints are equal, else 0: an exact digest knows no degrees.

Normalisation and folding are the ICU routines that Spark ships for its collations, called by Spark SQL's own
java_method expression: no Python runs on the executors.

Defined results: null text is empty text; empty texts share a fingerprint; repeated rows each give a row; an empty
table gives an empty table; other columns are not read. A null doc_id comes last in descending order.

Scale: neighbours in doc_id order are found with one shuffle of the text into sqrt(rows), at most MAX_RANGES, ranges of doc_id (bounds from
approximate quantiles, one constant array of the plan), each range also getting the largest rows of the range below; what is known of the ranges is one
row each, which MAX_RANGES bounds. The byte comparison
is a minimum and a maximum, pre-aggregated before its one shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native_text import text_or_empty
from .storage import materialize

_WHITE = r"[\s\p{Z}\x85]+"
#: Ranges of doc_id at most; each has one row in a broadcast table (24 bytes) and one bound in the plan.
MAX_RANGES = 1 << 16


def canonical(text: Column) -> Column:
    """The canonical form of a non-null text."""
    icu = lambda x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = icu(F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), icu(text), F.lit(True)))
    return F.trim(F.regexp_replace(folded, _WHITE, " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 hexadecimal digits."""
    part = lambda *x: F.lpad(F.lower(F.hex(F.xxhash64(*x))), 16, "0")
    return F.concat(part(canon), part(F.lit("wide"), canon))


def collisions(docs: DataFrame, hash_of=digest) -> DataFrame | None:
    """suffix (SHA-256) of the canonical texts whose bytes differ from the least of their fingerprint; None: no such.

    Bytes are compared while grouping: the least and the greatest canonical text of a fingerprint are equal if all are.
    Both are pre-aggregated in every task, so a hot group sends one row per task.
    """
    hashed = docs.select(canonical(text_or_empty()).alias("canon")).withColumn("fp", hash_of(F.col("canon")))
    spans = hashed.groupBy("fp").agg(F.min("canon").alias("least"), F.max("canon").alias("greatest"))
    mixed = materialize(spans.filter("least <> greatest").select(F.col("fp").alias("group_fp"), "least"))
    if mixed.isEmpty():
        return None
    differing = hashed.join(mixed, (F.col("fp") == F.col("group_fp")) & (F.col("canon") != F.col("least")))
    return differing.select(F.sha2("canon", 256).alias("suffix")).distinct()


def fingerprints(docs: DataFrame, hash_of=digest) -> DataFrame:
    """doc_id and verified fingerprint of every document."""
    rows = docs.select("doc_id", canonical(text_or_empty()).alias("canon"))
    rows = rows.select("doc_id", hash_of(F.col("canon")).alias("fingerprint"), F.sha2("canon", 256).alias("canon_sha"))
    return verified(rows, collisions(docs, hash_of))


def verified(rows: DataFrame, found: DataFrame | None, fingerprint: str = "fingerprint", sha: str = "canon_sha") -> DataFrame:
    """rows with the suffix of found added to the fingerprints of the canonical texts, known by their SHA-256, that have one; sha goes."""
    if found is None:
        return rows.drop(sha)
    other = found.select(F.col("suffix").alias("own_suffix"))
    joined = rows.join(other, F.col(sha) == F.col("own_suffix"), "left")
    return joined.withColumn(fingerprint, F.concat(fingerprint, F.coalesce(F.concat(F.lit(":"), "own_suffix"), F.lit("")))).drop("own_suffix", sha)


def _range_of(bounds: list[int]) -> Column:
    """Number of sorted bounds that are at most doc_id, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    # one literal that the optimizer folds, however many bounds there are
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))]
    step = lambda at, s: F.when((at + s <= len(bounds)) & (F.get(table, at + s - 1) <= F.col("doc_id")), at + s).otherwise(at)
    return F.coalesce(F.aggregate(F.array(*steps), F.lit(0), step), F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text: the text of the next document in descending doc_id, after the last the first's.

    Rows of equal doc_id follow one another in order of their texts.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    ids = docs.select("doc_id")
    parts = min(MAX_RANGES, max(1, math.isqrt(ids.count())))
    quantiles = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts).alias("q")).first().q if parts > 1 else []
    bounds = sorted(set(quantiles or []))
    part = _range_of(bounds)
    # one row for each range: where its largest rows are needed as well
    tops = ids.withColumn("part", part).groupBy("part").agg(F.max("doc_id").alias("top"))
    up = Window.orderBy("part")
    tops = tops.select("top", F.coalesce(F.lead("part").over(up), F.min("part").over(Window.partitionBy())).alias("to_part"), F.lead("part").over(up).isNull().alias("wraps"))
    own = texts.select("doc_id", "text", part.alias("part"), F.lit(False).alias("wraps"), F.lit(True).alias("own"))
    lent = texts.join(F.broadcast(tops), F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", "text", F.col("to_part").alias("part"), "wraps", F.lit(False).alias("own"))
    # what is lent by the range below comes after a range's own rows
    order = Window.partitionBy("part").orderBy(F.col("own").desc(), "wraps", F.col("doc_id").desc_nulls_last(), "text")
    return own.unionByName(lent).withColumn("next_text", F.lead("text").over(order)).filter("own").select("doc_id", "text", "next_text")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[canonical(F.col(c)).alias(c) for c in ("text", "edited", "next_text")])
    rows = rows.withColumns({"fingerprint": digest(F.col("text")), "edited_fingerprint": digest(F.col("edited")), "next_fingerprint": digest(F.col("next_text"))})
    found = collisions(docs)
    if found is not None:
        rows = rows.withColumns({f"{c}_sha": F.sha2(c, 256) for c in ("text", "edited", "next_text")})
        for c, sha in (("fingerprint", "text_sha"), ("edited_fingerprint", "edited_sha"), ("next_fingerprint", "next_text_sha")):
            rows = verified(rows, found, c, sha)
    alike = lambda other: F.when(F.col("fingerprint") == F.col(other), 1.0).otherwise(0.0)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("edited_fingerprint").alias("near_edited"), alike("next_fingerprint").alias("near_next"))
