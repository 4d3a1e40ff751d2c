"""Join points with the intervals that hold them, without comparing every pair.

An interval is copied to the buckets of its key that it touches, a point is in one bucket, and the two meet by (key, bucket); the exact test follows within. Intervals of very different lengths have buckets of
different widths: an interval goes to the narrowest level at which it touches at most TOUCHES buckets, and a point asks one bucket of each level that is in use. Copies thus stay within
TOUCHES an interval, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that an interval is copied to at most, and how much wider each level's buckets are.
TOUCHES, WIDER = 64, 32
_LEVELS = 9


def _level(length: Column, width: int) -> Column:
    """The narrowest level at which an interval of this length touches at most TOUCHES buckets."""
    fits = [length < min((TOUCHES - 1) * width * WIDER**n, 1 << 62) for n in range(_LEVELS)]
    level = F.lit(_LEVELS)
    for n in reversed(range(_LEVELS)):
        level = F.when(fits[n], n).otherwise(level)
    return level


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of points and spans (columns of both, the keys once) of equal keys where start <= at <= end; at, start and end are whole numbers, width is that of the narrowest buckets.

    A null key or bound meets nothing; a span whose end lies before its start holds nothing.
    """
    spans = spans.filter(F.col(start) <= F.col(end)).withColumn("_level", _level(F.col(end) - F.col(start), width))
    wide = lambda level: F.lit(width) * F.pow(F.lit(float(WIDER)), level).cast("long")
    bucket = lambda x, level: F.floor(F.col(x) / wide(level))
    spans = spans.withColumn("_bucket", F.explode(F.sequence(bucket(start, F.col("_level")), bucket(end, F.col("_level")))))
    # one row a level: at most _LEVELS + 1
    levels = sorted(r["_level"] for r in spans.select("_level").distinct().collect())
    points = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))).withColumn("_bucket", bucket(at, F.col("_level")))
    met = points.join(spans, [*keys, "_level", "_bucket"])
    return met.filter(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_bucket")
