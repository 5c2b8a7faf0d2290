"""Nearest neighbours by cosine with randomly rotated one-bit codes.

Every vector is scaled to unit length, the mean of all unit vectors is taken off, and the
rest is rotated at random into ``bits`` dimensions. Of each coordinate only the sign is
kept, packed; with it go correction scalars: the rest's length, its inner product with
the sign vector, and its unit vector's with the mean. From code and scalars the inner
product with a rotated query is estimated without bias, and its error is within
``sigmas`` standard errors, a bound that follows from the same scalars. A vector is
reranked, on the original vectors in double precision, only if its upper bound reaches
the k-th best score known so far, so that what the bounds rule out cannot be an answer.

Queries go in blocks of a fixed number, each broadcast and held against all codes; a task
returns its k best of each query, of which the k best remain. Copies of one vector are
candidates like any others.

Defined results: vectors that are null, zero, hold null or non-finite components, or have
another number of components than most, take no part, nor do rows without an id. Every row
whose id is divisible by ``every`` is a query, also if it repeats; only the query's own
row is no candidate of it. Fewer candidates give fewer ranks; no rows give none. Equal
scores rank by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import materialize, table

BITS = 256
SIGMAS = 3.0
#: Queries held against all codes at a time; their vectors are broadcast.
QUERY_BLOCK = 2048
_TILE = 64


def rotation(dim: int, bits: int = BITS, seed: int = 17) -> np.ndarray:
    """dim x bits matrix with orthonormal rows: a random rotation of the zero-padded vector."""
    bits = max(bits, dim)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths, without overflow."""
    top = np.abs(x).max(axis=1, keepdims=True)
    y = x / top
    size = np.sqrt((y * y).sum(axis=1, keepdims=True))
    return y / size, (size * top)[:, 0]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS) -> tuple[DataFrame, int, np.ndarray]:
    """The index: vec_id, uid, v, code, rest, fit, along of every valid row; the dimension and the mean unit vector."""
    rows = _valid(df, id_col, vector_col)
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = top["d"] if top else 1
    rows = rows.where(F.size("v") == dim)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for b in batches:
            if b.num_rows:
                total += _units(_matrix(b.column(0), dim))[0].sum(axis=0)
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total), pa.array(np.full(dim, float(n)))], ["i", "s", "n"])

    parts = rows.select("v").mapInArrow(sums, "i long, s double, n double").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    mean = np.array([r["s"] / max(r["n"], 1.0) for r in parts]) if parts else np.zeros(dim)
    turn = rotation(dim, bits)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u, _ = _units(_matrix(b.column(2), dim))
            y = (u - mean) @ turn
            rest = np.sqrt((y * y).sum(axis=1))
            packed = np.packbits(y >= 0, axis=1)
            fit = np.abs(y).sum(axis=1) / np.where(rest > 0, rest, 1) / np.sqrt(y.shape[1])
            more = [pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(rest), pa.array(fit), pa.array(u @ mean)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], ["vec_id", "uid", "v", "code", "rest", "fit", "along"])

    numbered = rows.select("vec_id", F.monotonically_increasing_id().alias("uid"), "v")
    index = numbered.mapInArrow(codes, "vec_id long, uid long, v array<double>, code binary, rest double, fit double, along double")
    return materialize(index, "codes"), dim, mean


class _Block:
    """A block of queries, prepared; the same on every executor."""

    def __init__(self, ids: np.ndarray, uids: np.ndarray, x: np.ndarray, mean: np.ndarray, bits: int, k: int, sigmas: float):
        self.ids, self.uids, self.x, self.mean, self.k, self.sigmas = ids, uids, x, mean, k, sigmas
        self.unit, self.size = _units(x)
        self.turned = ((self.unit - mean) @ rotation(x.shape[1], bits)).astype(np.float32)
        self.rest = np.sqrt((self.turned.astype(np.float64) ** 2).sum(axis=1))
        self.along = self.unit @ mean

    def exact(self, u: np.ndarray, rows: np.ndarray, queries: np.ndarray, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        dot = (x[rows] * self.x[queries]).sum(axis=1)
        plain = dot / (size[rows] * self.size[queries])
        # Lengths out of double's comfortable range: the unit vectors' product.
        return np.where(np.isfinite(plain) & (np.abs(dot) > 1e-290), plain, (u[rows] * self.unit[queries]).sum(axis=1))

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, k = self.x.shape[1], self.k
        best: list[tuple[np.ndarray, ...]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(0, len(self.ids), _TILE)]
        known = np.full(len(self.ids), -np.inf)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ids, uids = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = _matrix(b.column(2), dim)
            u, size = _units(x)
            codes = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(n, -1)
            signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
            d = signs.shape[1]
            rest, fit, along = (b.column(i).to_numpy() for i in (4, 5, 6))
            gain = np.where(fit > 0, 1 / (np.where(fit > 0, fit, 1) * np.sqrt(d)), 0)  # unit rest: est = <signs, q> * gain
            spread = rest * np.sqrt(np.maximum(1 / np.where(fit > 0, fit, 1) ** 2 - 1, 0)) * self.sigmas / np.sqrt(max(d - 1, 1))
            for t, a in enumerate(range(0, len(self.ids), _TILE)):
                q = slice(a, a + _TILE)
                est = (signs @ self.turned[q].T) * (gain * rest)[:, None] + along[:, None] + self.along[q] - self.mean @ self.mean
                est[uids[:, None] == self.uids[q][None, :]] = -np.inf
                m = min(n, 2 * k)
                first = np.argpartition(-est, m - 1, axis=0)[:m]
                cols = np.broadcast_to(np.arange(est.shape[1]), first.shape)
                sure = np.where(np.isfinite(est[first, cols]), self.exact(u, first.ravel(), cols.ravel() + a, x, size).reshape(first.shape), -np.inf)
                if m >= k:
                    known[q] = np.maximum(known[q], np.sort(sure, axis=0)[-k])
                rows, queries = np.nonzero((est + spread[:, None] * self.rest[q] >= known[q] - 1e-9) & np.isfinite(est))
                found = (self.exact(u, rows, queries + a, x, size), ids[rows], uids[rows], queries + a)
                best[t] = self._top(tuple(np.concatenate(z) for z in zip(best[t], found)))
                score, _, _, at = best[t]
                full = np.flatnonzero(np.bincount(at, minlength=len(self.ids)) >= k)
                worst = np.full(len(self.ids), np.inf)
                np.minimum.at(worst, at, score)
                known[full] = np.maximum(known[full], worst[full])
        score, ids, uids, at = (np.concatenate(z) for z in zip(*best))
        columns = [self.uids[at], self.ids[at], ids, uids, score]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_uid", "query_id", "vec_id", "uid", "score"])

    def _top(self, pairs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        score, ids, uids, at = pairs
        order = np.lexsort((uids, ids, -score, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at, "left")
        order = order[place < self.k]
        return score[order], ids[order], uids[order], pairs[3][order]


def nearest(
    df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS, sigmas: float = SIGMAS, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of each query, by the rows of ``df``."""
    spark = df.sparkSession
    index, dim, mean = encode(df, id_col, vector_col, bits)
    queries = index.where(F.col("vec_id") % every == 0).select("vec_id", "uid", "v")
    blocks = max(1, -(-queries.count() // query_block))
    found = None
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == i).toPandas().sort_values("uid")
        if not len(rows):
            continue
        block = _Block(rows["vec_id"].to_numpy(np.int64), rows["uid"].to_numpy(np.int64), np.array(rows["v"].tolist(), np.float64).reshape(-1, dim), mean, bits, k, sigmas)
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from shared.value.search(batches)

        part = materialize(index.mapInArrow(search, "query_uid long, query_id long, vec_id long, uid long, score double"), "neighbours")
        found = part if found is None else found.unionByName(part)
        shared.unpersist()
    if found is None:
        found = spark.createDataFrame([], "query_uid long, query_id long, vec_id long, uid long, score double")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)
