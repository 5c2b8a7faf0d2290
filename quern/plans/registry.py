"""Where queries register with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as an update log over 8 rows and 16 columns, from 4 workers; a day is a clock."""
    e = read(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") % 4).alias("worker"), (F.dayofmonth("ts") - 1).cast("bigint").alias("clk"), (F.col("user_id") % 8).alias("row_id"),
        (F.col("event_id") % 16).alias("col_id"), F.col("value").alias("delta"), "event_id", "event_type", "ts",
    )


U = """u AS (SELECT event_id % 4 AS worker, CAST(day(ts) - 1 AS BIGINT) AS clk, user_id % 8 AS row_id, event_id % 16 AS col_id,
  value AS delta, event_id, event_type, ts FROM events)"""


def r6(x, digits: int = 6):
    """Rounded, so that the order of summation does not show; -0 is 0."""
    return F.round(x, digits) + F.lit(0.0)


def vectors(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label", *more)


V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
#: Fixed weights of unit i and place k: ((7 i + 3 k) mod 11 - 5) / 50.
WSQL = "(((({i}) * 7 + ({k}) * 3) % 11) - 5) / 50.0"


def weight(i, k):
    return (((i * 7 + k * 3) % 11) - 5) / 50.0


def weight_vector(i: int, dim: int = 64):
    return F.array(*[F.lit(weight(i, k)) for k in range(dim)])


def sql_weights(i, dim: int = 64) -> str:
    return f"list_transform(range({dim}), lambda k: CAST({WSQL.format(i=i, k='k')} AS DOUBLE))"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what hangs on its partitions is the same at each read."""
    import uuid

    from quern.operators.table import shared_folder

    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
