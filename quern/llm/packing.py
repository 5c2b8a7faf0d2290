"""Best-fit packing of tokenised documents into fixed-size sequences.

Vector best-fit: a sequence has three capacities - tokens, documents and attention cost
(sum of squared piece lengths) - and a piece goes to a bin that it fits under every one
of them. Among those the bin is chosen by ``rule``: ``norm`` takes the smallest weighted
norm of what is left after placing, ``dot`` the largest weighted dot product of the
piece's needs and the bin's residuals. Pieces are placed from the longest down.

A piece's three needs follow from its length alone, and so does the choice of bin. So
the packing is planned on the driver from the histogram of lengths - at most ``capacity``
rows, whatever the corpus - over classes of bins in the same state. The plan is a list of
(length, rank range) -> (bins, offset) segments, of a size that does not depend on the
number of pieces either; each piece looks up its own rank in it. Nothing but the counts
of lengths by task is shuffled to rank the pieces.

Defined results: a null text is an empty one, of which only the end token remains; rows
that repeat are packed as often as they occur; a null id stays null; an empty table gives
an empty result; documents longer than a sequence are cut into full pieces, of which the
first takes the remainder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import map_arrow, materialize, table

#: Entries kept in a worker's word cache before it starts afresh.
CACHE_WORDS = 400_000
SPECIAL = "<|endoftext|>"


class _Irregular(Exception):
    """A word next to other white space, which a split at single spaces would cut wrongly."""


class _Words(dict):
    """Little-endian uint32 ids of ``prefix + word``, computed on first use."""

    def __init__(self, encode, prefix: str):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Irregular
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = _pack(self.encode(self.prefix + word))
        return out


def _pack(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


class ByteTokenizer:
    """Ids of a byte-level BPE vocabulary, as packed bytes.

    The pre-tokenizer never joins characters across a single space between two
    non-spaces, so each space-led word is encoded once and remembered. Texts with
    other white space at such a space, or the special token, are encoded whole.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # The same vocabulary as the tokenizers file; several times as fast on single words.
        self.fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.path, self._whole = path, None
        self.first, self.rest = _Words(self.fast, ""), _Words(self.fast, " ")

    def whole(self, text: str) -> bytes:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return _pack(self._whole.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            return self.whole(text)
        words = text.split(" ")
        try:
            if len(words) == 1:
                return _pack(self.fast(text))
            # The last word may end in white space: nothing follows it.
            last = " " + words[-1]
            if len(last) == 1 or last[1].isspace():
                raise _Irregular
            tail = self.rest[words[-1]] if not last[-1].isspace() else _pack(self.fast(last))
            if not words[0]:
                return b"".join([*map(self.rest.__getitem__, words[1:-1]), tail])
            return b"".join([self.first[words[0]], *map(self.rest.__getitem__, words[1:-1]), tail])
        except _Irregular:
            return _pack(self.fast(text))


@lru_cache(maxsize=2)
def _tokenizer(path: str, ranks_path: str, pattern: str) -> ByteTokenizer:
    return ByteTokenizer(path, ranks_path, pattern)


def cut(total: int, capacity: int) -> list[int]:
    """Piece lengths of a document of ``total`` tokens; only the first may be shorter."""
    if total <= capacity:
        return [total]
    first = total % capacity or capacity
    return [first] + [capacity] * ((total - first) // capacity)


def tokenize_pieces(
    df: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None, ranks_path: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, task, rank (among the task's pieces of that length)."""
    import public_tokenizers as public

    path, ranks_path = path or public.path("byte_bpe_50k.json"), ranks_path or public.path("byte_bpe_50k.tiktoken")
    pattern, end = public.PATTERN, _pack([end_id])
    kind = df.schema[id_col].dataType
    slim = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, ranks_path, pattern)
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            take: list[int] = []
            texts = batch.column(1)
            for i in range(batch.num_rows):
                ids = tokenizer.encode(texts[i].as_py()) + end
                start = 0
                for piece, length in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((piece, start, length, crc, task, seen[length]))
                    take.append(i)
                    seen[length] += 1
                    start += length
            if rows:
                cols = [pa.array(c) for c in zip(*rows)]
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(take)), *(c.cast(t) for c, t in zip(cols, types))], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                )

    return map_arrow(slim, pieces, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, task long, rank long")


def plan_bins(
    histogram: dict[int, int],
    capacity: int,
    max_documents: int | None = None,
    max_attention: int | None = None,
    rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Segments (length, first rank, last rank + 1, first bin, pieces a bin, offset) and the number of bins.

    ``histogram``: number of pieces by length. Bins in the same state form a class of
    consecutive numbers; placing pieces splits a class in at most three.
    """
    limits = (capacity, max_documents or capacity, max_attention or capacity * capacity)
    scale = [w / (c * c) for w, c in zip(weights, limits)]
    classes: list[tuple[tuple[int, int, int], int, int]] = []  # residuals, first bin, number of bins
    segments, bins = [], 0
    for length in sorted(histogram, reverse=True):
        need, left, done = (length, 1, length * length), histogram[length], 0
        if any(n > c for n, c in zip(need, limits)):
            raise ValueError(f"a piece of {length} tokens fits no bin of {limits}")
        while left:
            fits = [(i, c) for i, c in enumerate(classes) if all(r >= n for r, n in zip(c[0], need))]
            if fits:
                if rule == "norm":
                    score = lambda c: sum(s * (r - n) ** 2 for s, r, n in zip(scale, c[0], need))
                else:
                    score = lambda c: -sum(s * r * n for s, r, n in zip(scale, c[0], need))
                at, (residual, first, count) = min(fits, key=lambda x: (score(x[1]), x[1][1]))
                classes.pop(at)
            else:
                residual, first, count = limits, bins, left
            # A best fit fills one bin before it takes the next; by dot product each bin gets one piece in turn.
            most = min(r // n for r, n in zip(residual, need)) if rule == "norm" else 1
            used = min(count, -(-left // most))
            placed = min(left, used * most)
            full, over = divmod(placed, most)
            if not fits:
                count, bins = used, bins + used
            segments.append((length, done, done + placed, first, most, capacity - residual[0]))
            after = lambda k: tuple(r - k * n for r, n in zip(residual, need))  # noqa: E731, B023
            if full:
                classes.append((after(most), first, full))
            if over:
                classes.append((after(over), first + full, 1))
            if used < count:
                classes.append((residual, first + used, count - used))
            done, left = done + placed, left - placed
    return segments, bins


def assign(pieces: DataFrame, capacity: int, **how) -> DataFrame:
    """``pieces``, each with its sequence_id and offset."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").count()
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    segments, _ = plan_bins(sizes, capacity, **how)
    plan = spark.createDataFrame(
        pd.DataFrame(segments, columns=["plan_length", "rank_from", "rank_to", "bin", "per_bin", "at"]).astype("int64"),
        "plan_length long, rank_from long, rank_to long, bin long, per_bin long, at long",
    )
    before = counts.select(
        F.col("length").alias("b_length"), F.col("task").alias("b_task"),
        F.expr("sum(count) over (partition by length order by task) - count").alias("before"),
    )
    # Written first: a plain exchange on both sides lets AQE broadcast it or split a frequent length.
    before = materialize(before, "piece-ranks")
    ranked = pieces.join(before, (F.col("length") == F.col("b_length")) & (F.col("task") == F.col("b_task"))).withColumn("rank", F.col("rank") + F.col("before"))
    j = F.col("rank") - F.col("rank_from")
    # The plan's size depends on ``capacity`` alone, not on the number of pieces.
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(j / F.col("per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + (j % F.col("per_bin")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(df: DataFrame, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Tokenise, cut and pack every row; see the module for how and for the cases that are defined."""
    pieces = materialize(tokenize_pieces(df, capacity, id_col, text_col), "pieces")
    return assign(pieces, capacity, **how)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=1024)
