"""Parameter tables fed by a stream of updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.schema import PARAM_LONG, UPDATE


def read_updates(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Updates as they arrive as parquet files in ``path``."""
    r = spark.readStream.schema(UPDATE)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def live_table(updates: DataFrame) -> DataFrame:
    """The summed cells, kept as state. No watermark: late updates are never dropped."""
    return updates.groupBy("row_id", "col_id").agg(F.sum("delta").alias("value"))


def tumbling(updates: DataFrame, ts: str, width: str, late: str | None = None) -> DataFrame:
    """Sum and count of the updates by window of event time. With ``late`` state is evicted and later rows are dropped."""
    u = updates.withColumn(ts, F.col(ts).cast("timestamp"))
    u = u.withWatermark(ts, late) if late else u
    return u.groupBy(F.window(ts, width)).agg(F.sum("delta").alias("total"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "total", "n")


def sliding(updates: DataFrame, ts: str, width: str, slide: str) -> DataFrame:
    u = updates.withColumn(ts, F.col(ts).cast("timestamp"))
    return u.groupBy(F.window(ts, width, slide)).agg(F.sum("delta").alias("total"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "total", "n")


def sessions(updates: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    u = updates.withColumn(ts, F.col(ts).cast("timestamp"))
    return u.groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class SnapshotSink:
    """foreachBatch body: folds each micro-batch into versioned snapshots and hands on what changed.

    Version v lies in ``path``/version=v and holds all batches up to v, so a batch that is
    run again after a failure rewrites its own version from the one before, and nothing counts twice.
    """

    def __init__(self, spark: SparkSession, path: str, on_push: Callable[[DataFrame, int], None] | None = None):
        self.spark, self.path, self.on_push = spark, path.rstrip("/"), on_push

    def version(self, v: int) -> DataFrame:
        if v < 0:
            return self.spark.createDataFrame([], PARAM_LONG)
        return self.spark.read.schema(PARAM_LONG).parquet(f"{self.path}/version={v}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        updates = batch.groupBy("row_id", "col_id").agg(F.sum("delta").alias("delta")).where("delta <> 0")
        before = self.version(batch_id - 1)
        both = before.select("row_id", "col_id", F.col("value").alias("delta")).unionByName(updates)
        both.groupBy("row_id", "col_id").agg(F.sum("delta").alias("value")).write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")
        if self.on_push:
            self.on_push(self.version(batch_id).join(updates.select("row_id").distinct(), "row_id", "left_semi"), batch_id)
