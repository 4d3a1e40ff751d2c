"""Bars as a stream: guarded, joined with slower series, turned into features on the tail, and labelled when the labels are known; equal to what a batch makes of the same bars.

Guards hold state for each symbol (streaming.guards). Windows of features are row counts, which streaming windows can't express, so each micro-batch works on its new bars and as many stored ones
before them as the features look back. Bars are on a grid, so these are bars of known days, and only their folders are read. All results are written by batch id, so a batch that is
run again replaces its own rows.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.functions.rolling import Rows
from barloom.operators import features
from barloom.plans.shipping import ship
from barloom.plans.tables import exists, hadoop_path
from barloom.sources import bars as source
from barloom.streaming.guards import Guard, guarded, timestamp


def _source(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_guarded(spark: SparkSession, bars_dir: str, out_dir: str, checkpoint_dir: str, guard: Guard, snapshots_dir: str | None = None, files_per_batch: int = 1, then=None) -> StreamingQuery:
    """Start a query that reads files of bars (and of slower values) as they come and writes out_dir/rows, by kind (bar, label, reject), day and batch.

    then(session, batch_id) runs after each batch.
    """
    ship(spark)
    slower = _source(spark, snapshots_dir, files_per_batch) if snapshots_dir else None
    rows = guarded(_source(spark, bars_dir, files_per_batch), guard, slower)
    rows = rows.withColumns({"ts": timestamp("at"), "entry_ts": timestamp("entry_at")}).drop("at", "entry_at").withColumn("day", F.to_date("ts"))

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # overwriting one batch's partitions only makes a batch that is run again replace itself
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "day", "batch").parquet(f"{out_dir}/rows")
        if then is not None:
            then(session, batch_id)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def _of_batch(spark: SparkSession, out_dir: str, kind: str, batch_id: int) -> DataFrame | None:
    """What a batch has written of a kind."""
    path = f"{out_dir}/rows/kind={kind}/day=*/batch={batch_id}"
    fs, at = hadoop_path(spark, path)
    return spark.read.option("basePath", f"{out_dir}/rows").parquet(path) if fs.globStatus(at) else None


def stream_features(spark: SparkSession, bars_dir: str, out_dir: str, checkpoint_dir: str, families: list[str], windows: tuple[int, ...], files_per_batch: int = 1, guard: Guard = Guard(), snapshots_dir: str | None = None) -> StreamingQuery:
    """Start stream_guarded(), which also writes out_dir/features/batch=N, the features of the ready bars, and out_dir/rejects/batch=N."""
    halo = features.warmup([f for f in features.REGISTRY.values() if f.family in families], windows)

    def step(session: SparkSession, batch_id: int) -> None:
        rejects = _of_batch(session, out_dir, "reject", batch_id)
        if rejects is not None:
            rejects.select("symbol", "ts", "reason").write.mode("overwrite").parquet(f"{out_dir}/rejects/batch={batch_id}")
        fresh = _of_batch(session, out_dir, "bar", batch_id)
        if fresh is None:
            return
        # bars are on a grid, so the rows that features look back at lie within a known time
        ends = fresh.agg(F.min("ts").alias("first"), F.max("day").alias("last")).first()
        began = (ends["first"] - timedelta(seconds=guard.step * halo)).date()
        days = [f"{out_dir}/rows/kind=bar/day={began + timedelta(days=n)}" for n in range((ends["last"] - began).days + 1)]
        stored = session.read.option("basePath", f"{out_dir}/rows").parquet(*[d for d in days if exists(session, d)]).filter(F.col("batch") <= batch_id)
        first = fresh.groupBy(F.col("symbol").alias("_symbol"), F.col("segment").alias("_segment")).agg(F.min("k").alias("_first"))
        both = stored.join(first, (F.col("symbol") == F.col("_symbol")) & (F.col("segment") == F.col("_segment")) & (F.col("k") >= F.col("_first") - halo))
        rows = Rows(("symbol", "segment"))
        made, names = features.add_features(source.base_series(both, rows), families, windows, rows)
        made.filter((F.col("batch") == batch_id) & F.col("ready")).select("symbol", "ts", "segment", "k", *guard.snapshots, *names).write.mode("overwrite").parquet(f"{out_dir}/features/batch={batch_id}")

    return stream_guarded(spark, bars_dir, out_dir, checkpoint_dir, guard, snapshots_dir, files_per_batch, step)


def read_rows(spark: SparkSession, out_dir: str, kind: str) -> DataFrame | None:
    """The rows of a kind that a stream has written, with batch and day."""
    return spark.read.option("basePath", f"{out_dir}/rows").parquet(f"{out_dir}/rows/kind={kind}") if exists(spark, f"{out_dir}/rows/kind={kind}") else None
