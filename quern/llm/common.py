"""Helpers shared by the training-data operators: scratch tables, row ids, sessions."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: By application, the folder made where spark.checkpoint.dir is unset; the setting itself can't be changed in a running session.
_made: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset a temporary one is made, in local mode only: executors elsewhere could not read it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _made:
            _made[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
        where = _made[app]
    return where.rstrip("/")


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder, with these options of the writer, and read it back.

    Cuts lineage and fixes values such as monotonically_increasing_id(), so that a
    recomputed task cannot disagree with an earlier one.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quern-{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


class Scratch:
    """Materialized tables that an operator needs for a while only."""

    def __init__(self, spark: SparkSession, **options: str):
        self.spark, self.tables, self.options = spark, [], options

    def keep(self, table: DataFrame) -> DataFrame:
        """``table``, which materialize() has given; it goes with clear()."""
        self.tables.append(table)
        return table

    def materialize(self, df: DataFrame, tag: str) -> DataFrame:
        return self.keep(materialize(df, tag, **self.options))

    def clear(self, *tables: DataFrame) -> None:
        """Delete ``tables``, or all. Whatever is read from now on must be written elsewhere already."""
        jvm = self.spark._jvm
        for t in tables or self.tables:
            p = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.tables = [t for t in self.tables if tables and all(t is not x for x in tables)]


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """``df``, read from files and not joined or exploded since, with the long column ``name``: number of the file and index of the row in it."""
    files = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())  # one name a file
    path, at, number, file = (free_name(df, f"row_{x}") for x in ("path", "at", "number", "file"))
    numbers = df.sparkSession.createDataFrame(list(enumerate(files)), f"{number} long, {file} string")
    placed = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(at))
    met = placed.join(F.broadcast(numbers), F.col(path) == F.col(file))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], F.shiftleft(number, 33).bitwiseOR(F.col(at)).alias(name))


#: Bytes of one Arrow batch handed to a Python worker; it holds a batch two or three times over.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to BATCH_BYTES, so that a worker's memory does not depend on the length of texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return freed memory of this process to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(), with batches of bounded bytes, by workers that give memory back at the end of a task."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return small_batches(df).mapInArrow(lean, schema)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(col):
    return F.coalesce(col.cast("string"), F.lit(""))


#: Characters beyond ASCII that lower() might change: capitals, letter-like numbers and signs, unassigned ones.
MAY_CHANGE = r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Cn}]]"


def lower_ascii(col):
    """Lower-case A-Z and nothing else.

    lower() is the same where no other character of the text can change, and much faster
    than the character map that the other texts take.
    """
    ascii_only = F.octet_length(col) == F.char_length(col)
    return F.when(ascii_only | ~col.rlike(MAY_CHANGE), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of one block of a membership filter: what bitmap_construct_agg packs into 4 KiB.
BLOCK_BITS = 32768


def hash_filter(hashes: DataFrame, max_blocks: int = 8192, bits_per_key: int = 32) -> tuple[DataFrame, int]:
    """A one-hash Bloom filter of the long column ``h``: (block, bits) rows, 32 MiB at most, and the block count."""
    blocks, keys = 1, hashes.count() * bits_per_key
    while blocks < max_blocks and blocks * BLOCK_BITS < keys:
        blocks *= 2
    placed = hashes.select(F.expr(f"pmod(h, {blocks}L)").alias("block"), F.expr(f"shiftrightunsigned(h, 24) & {BLOCK_BITS - 1}L").alias("pos"))
    return placed.groupBy("block").agg(F.bitmap_construct_agg("pos").alias("bits")), blocks


def maybe_in(df: DataFrame, hash_col: str, bloom: tuple[DataFrame, int], flag: str) -> DataFrame:
    """``df`` with ``flag``: false only where the hash is surely not in the filter. The filter is broadcast (bounded)."""
    bits, blocks = bloom
    b, bm = free_name(df, "filter_block"), free_name(df, "filter_bits")
    probed = df.withColumn(b, F.expr(f"pmod(`{hash_col}`, {blocks}L)")).join(
        F.broadcast(bits.select(F.col("block").alias(b), F.col("bits").alias(bm))), b, "left"
    )
    pos = F.expr(f"shiftrightunsigned(`{hash_col}`, 24) & {BLOCK_BITS - 1}L")
    byte = F.conv(F.hex(F.substring(F.col(bm), (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    hit = F.col(bm).isNotNull() & (F.getbit(byte, (pos % 8).cast("int")) == 1)
    return probed.withColumn(flag, F.coalesce(hit, F.lit(False))).select(*[F.col(f"`{c}`") for c in df.columns], flag)
