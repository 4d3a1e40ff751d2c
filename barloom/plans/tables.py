"""Folders and tables that driver and executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset and everything runs in this process, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="barloom-"))
    return f"{named.rstrip('/')}/barloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once as Parquet and read back: no lineage, and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[table] = path
    return table


def removed(table: DataFrame) -> None:
    """Remove the files of a table that written() has made and nothing reads any more."""
    fs, at = hadoop_path(table.sparkSession, _path_of.pop(table))
    fs.delete(at, True)


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop_path(spark, path)
    return fs.exists(at)
