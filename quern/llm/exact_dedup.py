"""Exact document dedup by a two-pass Bloom filter (DataFrame functions only).

Pass 1 hashes every text into a blocked Bloom filter whose bits are counted; the
bits that were hit twice form a second filter, which holds every repeated hash.
That filter has a fixed largest size and is broadcast. Pass 2 probes it: a row
whose bits are not all set has no copy and passes straight through; only the
others shuffle, as (id, sha256), and are grouped exactly. An over-full filter
costs more shuffled rows, never a wrong result.

Defined results: a null text counts as empty; texts are equal when identical after
lower-casing A-Z; of equal texts the row with the largest id stays (null ids are
smallest, and of rows that repeat the id too one stays); an empty table gives an
empty result; other columns are carried untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import free_name, lower_ascii, materialize, table, text_or_empty

#: Bits of one Bloom block: what bitmap_construct_agg packs into 4 KiB.
BLOCK_BITS = 32768
#: Most blocks, so the broadcast filter stays within 64 MiB whatever the input.
MAX_BLOCKS = 16384
#: Bits per row while the filter is below its bound.
BITS_PER_ROW = 64


def _bloom_key(text_col: str):
    """A hash on which equal texts agree; lower() folds more than A-Z, which only adds false positives."""
    return F.xxhash64(F.lower(text_or_empty(F.col(text_col))))


def _block_and_bits(h: str, blocks: int) -> tuple:
    """Block number and the two bit positions within it, from disjoint bits of the hash."""
    block = F.expr(f"pmod({h}, {blocks}L)")
    first = F.expr(f"shiftrightunsigned({h}, 20) & {BLOCK_BITS - 1}L")
    second = F.expr(f"shiftrightunsigned({h}, 40) & {BLOCK_BITS - 1}L")
    return block, first, second


def _bit_is_set(bitmap: str, pos: str):
    byte = F.expr(f"cast(conv(hex(substring({bitmap}, cast({pos} div 8 as int) + 1, 1)), 16, 10) as bigint)")
    return F.lit(1) == F.getbit(byte, F.expr(f"cast({pos} % 8 as int)"))


def repeated_filter(df: DataFrame, text_col: str = "text", rows: int | None = None) -> tuple[DataFrame, int]:
    """Pass 1: (block, bits) rows holding every bit that two or more rows hit, and the block count."""
    rows = df.count() if rows is None else rows
    blocks = min(MAX_BLOCKS, 2 ** max(0, math.ceil(math.log2(max(1, rows * BITS_PER_ROW / BLOCK_BITS)))))
    hashed = df.select(_bloom_key(text_col).alias("h"))
    block, first, second = _block_and_bits("h", blocks)
    hits = hashed.select(block.alias("block"), F.explode(F.array_distinct(F.array(first, second))).alias("pos"))
    twice = hits.groupBy("block", "pos").count().where("count >= 2")
    bits = twice.groupBy("block").agg(F.bitmap_construct_agg(F.col("pos").cast("bigint")).alias("bits"))
    return bits, blocks


def tag_possible_copies(df: DataFrame, text_col: str, flag: str) -> DataFrame:
    """Pass 2: add ``flag``, true for each row whose hash may be repeated. No shuffle of ``df``."""
    bits, blocks = repeated_filter(df, text_col)
    h, b, p1, p2 = (free_name(df, f"bloom_{x}") for x in ("hash", "block", "first", "second"))
    bm = free_name(df, "bloom_bits")
    block, first, second = _block_and_bits(f"`{h}`", blocks)
    probed = (
        df.withColumn(h, _bloom_key(text_col))
        .withColumns({b: block, p1: first, p2: second})
        .join(F.broadcast(bits.select(F.col("block").alias(b), F.col("bits").alias(bm))), b, "left")
    )
    maybe = F.col(bm).isNotNull() & _bit_is_set(f"`{bm}`", f"`{p1}`") & _bit_is_set(f"`{bm}`", f"`{p2}`")
    return probed.withColumn(flag, F.coalesce(maybe, F.lit(False))).select(*[F.col(f"`{c}`") for c in df.columns], flag)


def text_digest(text_col: str):
    return F.sha2(lower_ascii(text_or_empty(F.col(text_col))).cast("binary"), 256)


def exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    slim = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    marked = tag_possible_copies(slim, "text", "maybe").select(
        "doc_id", F.monotonically_increasing_id().alias("uid"), text_digest("text").alias("text_sha256"), "maybe"
    )
    marked = materialize(marked, "copies")
    alone = marked.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    suspects = marked.where("maybe")
    groups = suspects.groupBy(F.col("text_sha256").alias("sha")).agg(
        F.max(F.struct("doc_id", "uid")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    # Written first, so that both sides of the join are plain exchanges and AQE can split a hot text.
    groups = materialize(groups, "copy-groups")
    grouped = suspects.join(groups, suspects.text_sha256 == groups.sha, "left").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Rows without a possible copy never shuffle."""
    flag, sha = free_name(df, "maybe_copy"), free_name(df, "copy_sha256")
    tagged = tag_possible_copies(df, text_col, flag)
    columns = [F.col(f"`{c}`") for c in df.columns]
    alone = tagged.where(~F.col(flag)).select(*columns)
    suspects = tagged.where(F.col(flag)).withColumn(sha, text_digest(text_col))
    s, k = (free_name(suspects, f"keep_{x}") for x in ("sha256", "id"))
    keep = suspects.groupBy(F.col(sha).alias(s)).agg(F.max(f"`{id_col}`").alias(k))
    keep = materialize(keep, "copy-keepers")
    # The id is part of the join key, which spreads a hot text over all tasks.
    stay = suspects.join(keep, (F.col(sha) == F.col(s)) & F.col(f"`{id_col}`").eqNullSafe(F.col(k)), "left_semi")
    stay = stay.dropDuplicates([sha]).select(*columns)
    return alone.unionByName(stay)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


ORACLE_OP5 = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
