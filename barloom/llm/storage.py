"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.tables import hadoop_path, shared_dir

#: Paths written in the scopes that are open, the innermost last.
_scopes: list[list[str]] = []
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Like checkpoint() the result survives lost executors and has no lineage, but it is compressed and
    column-pruned. The files stay until drop_tables(), or until the end of a scope() that does not keep them.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[table] = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = hadoop_path(spark, path)
    fs.delete(at, True)


def _collect(spark: SparkSession) -> None:
    """Have the driver collect the plans of finished jobs now.

    Spark removes their shuffles and broadcasts only then; left to itself the driver's heap grows to its limit first, with one round of a long loop after the other.
    """
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that materialize() writes within go at its end, all but those that the caller adds to the list, and what Spark holds of the jobs that wrote them."""
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        stay = {_path_of[df] for df in kept}
        for path in _scopes.pop():
            if path not in stay:
                _delete(spark, path)
            elif _scopes:
                _scopes[-1].append(path)
        _collect(spark)


def drop_tables(spark: SparkSession) -> None:
    """Remove all tables that materialize() wrote in this application."""
    _delete(spark, shared_dir(spark))


def whole_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """The rows of docs as one struct column, row, beside columns of ours, whose names thus can't clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)
