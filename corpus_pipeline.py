"""A corpus pipeline over ``documents``: each stage applies one operator of quern.llm to all rows it is given.

Languages are identified and set in ``lang``, texts without one go; of identical texts one
stays; of near-duplicates (five-word shingles, similarity of 0.8 or more) one stays; secrets
are replaced in the texts; what is left is packed into sequences. Every stage but the last
returns the columns of ``documents``. Nulls, ties, repeated rows and empty tables: see the
operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import materialize
from quern.llm.exact_dedup import drop_exact_copies
from quern.llm.language_id import keep_identified
from quern.llm.minhash import drop_near_duplicates
from quern.llm.packing import pack_documents
from quern.llm.secret_scan import redact_documents


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, part=(80, 100))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: SQL can't express language ID, MinHash and packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
