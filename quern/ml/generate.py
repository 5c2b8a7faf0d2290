"""Seeded data with known answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.partition import uniform


def _normal(seed: int, *keys):
    """Standard normal by hash (Box-Muller)."""
    u, v = uniform(seed, *keys), uniform(seed + 1, *keys)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-9)))) * F.cos(v * (2 * np.pi))


def blobs(spark: SparkSession, k: int, dim: int, n: int, seed: int = 0) -> DataFrame:
    """point_id, cluster, features: centres uniform in (-10, 10), unit noise."""
    cluster = F.pmod(F.col("id"), F.lit(k))
    x = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: uniform(seed, cluster, j) * 20 - 10 + _normal(seed + 7, F.col("id"), j))
    return spark.range(n).select(F.col("id").alias("point_id"), cluster.cast("int").alias("cluster"), x.alias("features"))


def block_diagonal(spark: SparkSession, width: int, blocks: int) -> DataFrame:
    """col_id, values: block i holds the value i + 1 on its rows."""
    b = F.floor(F.col("id") / width)
    x = F.transform(F.sequence(F.lit(0), F.lit(width * blocks - 1)), lambda j: F.when(F.floor(j / width) == b, (b + 1).cast("double")).otherwise(0.0))
    return spark.range(width * blocks).select(F.col("id").alias("col_id"), x.alias("values"))


def dictionary_mix(spark: SparkSession, m: int, n: int, atoms: int, nnz: int, seed: int = 0) -> DataFrame:
    """col_id, values: sums of ``nnz`` unit-norm atoms."""
    d = np.random.default_rng(seed).standard_normal((atoms, m))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    book = F.lit([[float(v) for v in r] for r in d])
    picks = F.transform(F.sequence(F.lit(0), F.lit(nnz - 1)), lambda j: F.floor(uniform(seed, F.col("id"), j) * atoms).cast("int"))
    x = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.aggregate(picks, F.lit(0.0), lambda a, p: a + F.get(F.get(book, p), i)))
    return spark.range(n).select(F.col("id").alias("col_id"), x.alias("values"))


def sparse_classification(spark: SparkSession, rows: int, dim: int, nnz: int, labels: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """key, ids, vals, label: quantiles of a sparse linear score, a share ``noise`` of labels drawn anew."""
    from pyspark.sql.window import Window

    ids = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(nnz - 1)), lambda j: F.floor(uniform(seed, F.col("id"), j) * dim).cast("int"))))
    d = spark.range(rows).select(F.col("id").alias("key"), ids.alias("ids"))
    d = d.withColumn("vals", F.transform("ids", lambda i: uniform(seed + 1, F.col("key"), i)))
    d = d.withColumn("score", F.aggregate(F.zip_with("ids", "vals", lambda i, v: v * (uniform(seed + 2, i) * 2 - 1)), F.lit(0.0), lambda a, v: a + v))
    d = d.withColumn("label", F.ntile(labels).over(Window.orderBy("score", "key")) - 1)  # a fixture; small by design
    anew = F.floor(uniform(seed + 4, F.col("key")) * labels).cast("int")
    return d.withColumn("label", F.when(uniform(seed + 3, F.col("key")) < noise, anew).otherwise(F.col("label"))).drop("score")


def random_mlp_rows(spark: SparkSession, n: int, dim: int, classes: int, seed: int = 0) -> DataFrame:
    """key, label, features with no signal."""
    x = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.floor(uniform(seed, F.col("id"), j) * 1000) / 10000)
    return spark.range(n).select(F.col("id").alias("key"), F.floor(uniform(seed + 1, F.col("id")) * classes).cast("int").alias("label"), x.alias("features"))
