"""Work placement and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row_placement(row_id: Column, channels: int, clients: int) -> tuple[Column, Column]:
    """Channel and client that own a row."""
    return row_id % channels, F.floor(row_id / channels) % clients


def workload_ranges(spark: SparkSession, rows: int, workers: int, batches: int) -> DataFrame:
    """Contiguous ranges [begin, end) of the workers, the last taking the remainder, and batch sizes."""
    size = rows // workers
    w = spark.range(workers).withColumnRenamed("id", "worker")
    end = F.when(F.col("worker") == workers - 1, F.lit(rows)).otherwise((F.col("worker") + 1) * size)
    return w.select("worker", (F.col("worker") * size).alias("begin"), end.cast("bigint").alias("end")).withColumn("batch", F.ceil((F.col("end") - F.col("begin")) / batches).cast("bigint"))


def minibatch_schedule(ranges: DataFrame, steps: int) -> DataFrame:
    """(worker, step, idx): the rows of each step; the index wraps at the end of a worker's range."""
    s = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    s = s.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("batch") - 1)).alias("k"))
    idx = F.col("begin") + F.pmod(F.col("step") * F.col("batch") + F.col("k"), F.col("end") - F.col("begin"))
    return s.select("worker", F.col("step").cast("bigint").alias("step"), "k", idx.alias("idx"))


def stripe(col: Column, n: int) -> Column:
    return F.pmod(col, F.lit(n))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the keys, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)


def sample_k(df: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """``k`` rows without replacement, chosen by hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(k)


def bernoulli(df: DataFrame, share: float, seed: int, *keys: str) -> DataFrame:
    """Each row with probability ``share``, chosen by hash."""
    return df.where(uniform(seed, *[F.col(k) for k in keys]) < share)


def split_trees(trees: int, workers: int) -> list[int]:
    """Trees of each worker: the floor, and one more for as many as remain."""
    base, more = divmod(trees, workers)
    return [base + (i < more) for i in range(workers)]


def draws(spark: SparkSession, n: int, k: int, seed: int) -> DataFrame:
    """``k`` draws with replacement of 0 .. n - 1: draw, idx. Draw i is a hash of seed and i, so that reruns and partitions do not matter."""
    word = F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("id").cast("string"))), 1, 8)
    return spark.range(k).select(F.col("id").alias("draw"), F.pmod(F.conv(word, 16, 10).cast("bigint"), F.lit(n)).alias("idx"))


def sample_with_replacement(df: DataFrame, n: int, k: int, seed: int, index: str) -> DataFrame:
    """``draw`` and the row of each draw, of ``df`` whose column ``index`` counts its ``n`` rows from 0."""
    return draws(df.sparkSession, n, k, seed).join(df, F.col("idx") == F.col(index)).drop("idx")


def range_join(points: DataFrame, ranges: DataFrame, at: str, begin: str, end: str, width: float) -> DataFrame:
    """The points in each range, begin <= at < end: an equi-join on bins of ``width``, filtered; no cross join.

    A range is in as many bins as it covers, so ``width`` should be about the length of the ranges.
    """
    bins = F.sequence(F.floor(F.col(begin) / width), F.floor(F.col(end) / width))
    cut = ranges.where(F.col(begin) < F.col(end)).withColumn("range_bin", F.explode(bins))
    met = points.withColumn("range_bin", F.floor(F.col(at) / width)).join(cut, "range_bin")
    return met.where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("range_bin")
