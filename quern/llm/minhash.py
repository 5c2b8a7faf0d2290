"""Near-duplicate documents by MinHash, banding, verification and connected components.

1. Texts become sets of hashed word shingles (64 bits), sets become signatures of
   ``bands * rows`` universal hash minima. Equal sets are one from here on.
2. Banding: sets that agree on a whole band of minima share a bucket.
3. In each bucket all members are compared with its representative - by signature, then
   exactly on full sets - and links become components (large-star, small-star). Buckets
   whose members are by then in one component are done.
4. The others are cut into blocks of about ``BLOCK`` sets; each pair of blocks is a cell of
   its own, which compares the full sets of different components and returns no more
   links than join them. So no link that banding proposes is lost, a large bucket is dealt
   over many tasks of bounded size, and its pairs are never rows.

With 30 bands of 5 a pair at similarity 0.85 shares no bucket with probability 2e-8, and
one at 0.8 with 7e-6. The signature test lets pass what is within six standard errors.

Defined results: A-Z are lower-cased, words are separated by space and \\t\\n\\v\\f\\r; a text
of fewer words than a shingle is one shingle; a null text or one without words has an
empty set and is linked with nothing; rows with equal sets are linked, whatever their
ids; null ids are ignored when a component takes its smallest id; an empty table gives an
empty result; other columns are carried untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import free_name, hash_filter, map_arrow, materialize, maybe_in, table, text_or_empty
from quern.llm.components import connected_components

BANDS, ROWS = 30, 5
SHINGLE = 5
#: Characters that are made into sets at a time; they bound a worker's memory.
CHARS = 1_000_000
#: Sets in a block of a bucket; two blocks are compared at a time.
BLOCK = 256
#: Entries of the dense part of a cell's incidence matrix that is multiplied at a time.
DENSE = 4_000_000
_U = np.uint64
_BASE, _SEED = _U(0x9E3779B97F4A7C15), 20240517


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts, for a whole batch at a time."""

    def __init__(self, width: int = SHINGLE):
        self.width = width
        rng = np.random.default_rng(_SEED)
        self.byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        self.byte[65:91] = self.byte[97:123]  # A-Z count as a-z
        self.place = rng.integers(0, 1 << 63, max(width, 2) + 1, dtype=np.uint64) * _U(2) + _U(1)
        self.inverse = _U(pow(int(_BASE), -1, 1 << 64))
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            upto, chars = at, 0
            while upto < len(texts) and (upto == at or chars + len(texts[upto] or "") <= CHARS):
                chars += len(texts[upto] or "")
                upto += 1
            yield from self._batch(texts[at:upto])
            at = upto

    def _batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        x = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        blank = self.space[x]
        start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        # Polynomial word hashes by prefix sums, all modulo 2^64.
        power = np.cumprod(np.full(len(x), _BASE))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[x] * power)])
        back = np.cumprod(np.full(len(x), self.inverse))
        word = _mix((prefix[end] - prefix[start]) * back[start] + (end - start).astype(np.uint64))
        sizes = np.array([len(r) + 1 for r in raw], np.int64)
        first = 1 + np.cumsum(sizes) - sizes
        low = np.searchsorted(start, first)
        high = np.append(low[1:], len(start))
        k = self.width
        if len(word) >= k:
            n = len(word) - k + 1
            rolled = np.zeros(n, np.uint64)
            for i in range(k):
                rolled += word[i : i + n] * self.place[i]
            rolled = _mix(rolled)
        for a, b in zip(low, high):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                yield _mix((word[a:b] * self.place[: b - a]).sum(keepdims=True) + _U(int(b - a)))
            else:
                yield np.zeros(0, np.uint64)


class MinHasher:
    """Strongly universal multiply-shift minima of 32 bits."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(_SEED + 1)
        self.a = rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64) * _U(2) + _U(1)
        self.b = rng.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64)

    def signature(self, s: np.ndarray) -> np.ndarray:
        x, out = s >> _U(32), None
        for i in range(0, len(x), 1024):
            least = (self.a * x[None, i : i + 1024] + self.b).min(axis=1) >> _U(32)
            out = least if out is None else np.minimum(out, least)
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """Bucket keys, texts x bands, of signatures, texts x minima."""
        parts = signatures.reshape(len(signatures), self.bands, self.rows)
        key = np.full(parts.shape[:2], 0, np.uint64) + np.arange(1, self.bands + 1, dtype=np.uint64)
        for i in range(self.rows):
            key = _mix(key * _BASE + parts[:, :, i])
        return key.view(np.int64)


def _sketch(df: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, uid, th (hash of the text), n (set size), digest (of the set), sig (a byte of each minimum), keys."""
    kind = df.schema["doc_id"].dataType.simpleString()
    slim = df.select("doc_id", F.monotonically_increasing_id().alias("uid"), _text_hash("text").alias("th"), F.col("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minima = Shingler(width), MinHasher(bands, rows)
        for b in batches:
            sizes, digests, sigs = [], [], np.zeros((b.num_rows, bands * rows), np.uint64)
            for i, s in enumerate(shingler.sets(b.column(3).to_pylist())):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    sigs[i] = minima.signature(s)
            keys = minima.keys(sigs)
            low = (sigs & _U(255)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * bands, pa.int32()), pa.array(keys.ravel()))
            columns = [*b.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in low], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "th", "n", "digest", "sig", "keys"])

    return map_arrow(slim, sketch, f"doc_id {kind}, uid long, th long, n long, digest binary, sig binary, keys array<long>")


def _text_hash(col: str):
    return F.xxhash64(text_or_empty(F.col(f"`{col}`")))


def _similar_signatures(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose signatures may belong to sets of similarity ``least`` or more."""
    a = sets.select(F.col("uid").alias("ua"), F.col("sig").alias("sa"))
    b = sets.select(F.col("uid").alias("ub"), F.col("sig").alias("sb"))
    both = pairs.join(a, F.col("u") == F.col("ua")).join(b, F.col("v") == F.col("ub")).select("u", "v", "sa", "sb")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            minima = x.shape[1]
            slack = 6 * (least * (1 - least) / minima) ** 0.5
            same = (x == y).mean(axis=1)
            keep = pa.array((same - 1 / 256) / (1 - 1 / 256) >= least - slack)
            yield b.select(["u", "v"]).filter(keep)

    return map_arrow(both, test, "u long, v long")


def _full_sets(df: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(uid, members) of the sets in ``wanted`` (uid, th, digest), from the texts: only possible ones are read into sets."""
    hashed = maybe_in(df.select("text", _text_hash("text").alias("th")), "th", hash_filter(wanted.select(F.col("th").alias("h"))), "wanted").where("wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in batches:
            found = [s.tobytes() for s in shingler.sets(b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in found], pa.binary()), pa.array(found, pa.binary())], ["h", "d", "members"])

    # Copies of one text agree on (th, digest); one of them is enough.
    found = map_arrow(hashed.select("text", "th"), sets, "h long, d binary, members binary").groupBy("h", "d").agg(F.first("members").alias("members"))
    return wanted.join(found, (F.col("th") == F.col("h")) & (F.col("digest") == F.col("d"))).select("uid", "members")


def _linked(pairs: DataFrame, sets: DataFrame, df: DataFrame, width: int, part: tuple[int, int]) -> DataFrame:
    """The pairs whose full sets have similarity part[0] / part[1] or more."""
    ends = pairs.select(F.col("u").alias("end")).unionByName(pairs.select(F.col("v").alias("end"))).distinct()
    wanted = materialize(sets.join(ends, sets.uid == F.col("end"), "left_semi").select("uid", "th", "digest"), "wanted")
    full = materialize(_full_sets(df, wanted, width), "full-sets")
    a = full.select(F.col("uid").alias("ua"), F.col("members").alias("ma"))
    b = full.select(F.col("uid").alias("ub"), F.col("members").alias("mb"))
    # The second join is by the representative; its rows may be many, its set is small.
    both = pairs.join(a, F.col("v") == F.col("ua")).join(b, F.col("u") == F.col("ub")).select("u", "v", "ma", "mb")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                same = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(part[1] * same >= part[0] * (len(x) + len(y) - same))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, test, "u long, v long")


def _cell_links(left: DataFrame, sets: DataFrame, df: DataFrame, width: int, part: tuple[int, int]) -> DataFrame:
    """Links (u, v) between components, from members (key, uid, comp, c) of buckets of c members."""
    ends = left.select(F.col("uid").alias("end")).distinct()
    wanted = materialize(sets.join(ends, sets.uid == F.col("end"), "left_semi").select("uid", "th", "digest"), "wanted")
    full = materialize(_full_sets(df, wanted, width), "full-sets").withColumnRenamed("uid", "id")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    placed = left.select("key", "uid", "comp", blocks.alias("blocks"), F.pmod(F.xxhash64("uid"), blocks).cast("int").alias("i"))
    cells = placed.select("key", "uid", "comp", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    cells = cells.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "uid", "comp")
    met = cells.join(full, F.col("uid") == F.col("id")).select("cell", "comp", "members")
    dealt = met.repartition("cell").sortWithinPartitions("cell")

    def links(comps: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        root = {c: c for c in comps}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        n, sizes = len(sets), np.array([len(s) for s in sets])
        _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = times[code] > 1
        row, column = np.repeat(np.arange(n), sizes)[common], (np.cumsum(times > 1) - 1)[code[common]]
        by_column = np.argsort(column, kind="stable")
        row, column = row[by_column], column[by_column]
        columns = int(column[-1]) + 1 if len(column) else 0
        same, width = np.zeros((n, n), np.int64), max(1, min(columns, DENSE // n))
        for a in range(0, columns, width):
            i, j = np.searchsorted(column, [a, a + width])
            x = np.zeros((n, width), np.float32)
            x[row[i:j], column[i:j] - a] = 1
            same += (x @ x.T).astype(np.int64)
        hit = np.triu(part[1] * same >= part[0] * (sizes[:, None] + sizes - same), 1)
        out = []
        for i, j in zip(*(a.tolist() for a in np.nonzero(hit))):
            a, b = find(comps[i]), find(comps[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((comps[i], comps[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, comps, sets = None, [], []

        def flush() -> pa.RecordBatch:
            found = links(comps, sets) if len(set(comps)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for b in batches:
            for cell, comp, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if cell != last and comps:
                    out = flush()
                    if out.num_rows:
                        yield out
                    comps, sets = [], []
                last = cell
                comps.append(comp)
                sets.append(np.frombuffer(body, np.uint64))
        if comps:
            yield flush()

    return map_arrow(dealt, run, "u long, v long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: tuple[int, int] = (85, 100), width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``df``: doc_id, uid, th, n_shingles, component_id (smallest id) and component (smallest uid)."""
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sketched = materialize(_sketch(docs, width, bands, rows), "sketches")
    some = sketched.where("n > 0")
    sets = materialize(some.groupBy("digest").agg(F.min(F.struct("uid", "th", "sig", "keys")).alias("s"), F.min("doc_id").alias("least_id")).select("s.*", "digest", "least_id"), "sets")
    by_key = sets.select(F.explode("keys").alias("key"), "uid")
    buckets = materialize(by_key.groupBy("key").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "rep"), "buckets")
    shared = maybe_in(by_key, "key", hash_filter(buckets.select(F.col("key").alias("h"))), "shared").where("shared")
    members = materialize(shared.join(buckets.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("key", "uid", "rep"), "members")

    pairs = materialize(members.where("uid <> rep").select(F.col("rep").alias("u"), F.col("uid").alias("v")).distinct(), "pairs")
    hits = materialize(_similar_signatures(pairs, sets, part[0] / part[1]), "similar")
    labels = materialize(connected_components(materialize(_linked(hits, sets, docs, width, part), "links")), "labels")
    # The representative was compared with its whole bucket; buckets within one component are done.
    pool = members.where("uid <> rep").select("key", "uid")
    marked = materialize(pool.join(labels, pool.uid == labels.node, "left").select("key", "uid", F.coalesce("component", "uid").alias("comp")), "marked")
    open_ = marked.groupBy(F.col("key").alias("k")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("k", "c")
    left = materialize(marked.join(materialize(open_, "open"), F.col("key") == F.col("k")).select("key", "uid", "comp", "c"), "left")
    if not left.isEmpty():
        more = connected_components(materialize(_cell_links(left, sets, docs, width, part), "cell-links"))
        more = materialize(more.select(F.col("node").alias("from"), F.col("component").alias("to")), "joined")
        # Links of the second kind join components; a component or a lone set may be named by them.
        old = labels.join(more, labels.component == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component"))
        alone = more.join(labels, F.col("from") == labels.node, "left_anti").select(F.col("from").alias("node"), F.col("to").alias("component"))
        labels = materialize(old.unionByName(alone), "labels")

    grouped = sets.join(labels, sets.uid == labels.node, "left").select("digest", "least_id", F.coalesce("component", "uid").alias("component"))
    grouped = materialize(grouped, "set-components")
    least_ids = grouped.groupBy(F.col("component").alias("c")).agg(F.min("least_id").alias("component_id"))
    named = materialize(grouped.join(least_ids, grouped.component == F.col("c")).select(F.col("digest").alias("d"), "component", "component_id"), "named-sets")
    out = sketched.join(named, F.col("digest") == F.col("d"), "left")
    return out.select(
        "doc_id", "uid", "th", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("n") == 0, F.col("uid")).otherwise(F.col("component")).alias("component"),
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: tuple[int, int] = (80, 100), **how) -> DataFrame:
    """The rows that stay, all columns kept: of each component the row of the smallest id.

    Only rows of components of two or more are shuffled; the others pass straight through.
    """
    judged = near_duplicates(df, id_col, text_col, part, **how)
    groups = judged.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("best")).where("c > 1")
    groups = materialize(groups.select(F.col("component").alias("g"), F.col("best.uid").alias("best")), "near-groups")
    inside = materialize(judged.join(groups, F.col("component") == F.col("g")).select("doc_id", "th", (F.col("uid") == F.col("best")).alias("stays")), "near-members")
    h, flag = free_name(df, "text_hash"), free_name(df, "in_group")
    tagged = maybe_in(df.withColumn(h, _text_hash(text_col)), h, hash_filter(inside.select(F.col("th").alias("h"))), flag)
    columns = [F.col(f"`{c}`") for c in df.columns]
    alone = tagged.where(~F.col(flag)).select(*columns)
    # Equal (id, text) rows are one component, so one verdict holds for all of them.
    i, t, v = (free_name(tagged, f"near_{x}") for x in ("id", "text", "stays"))
    verdict = inside.groupBy(F.col("doc_id").alias(i), F.col("th").alias(t)).agg(F.max("stays").alias(v))
    verdict = materialize(verdict, "near-verdicts")
    suspects = tagged.where(F.col(flag)).join(verdict, F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.col(h) == F.col(t)), "left")
    rest = suspects.where(F.col(v).isNull()).select(*columns)
    stay = suspects.where(F.col(v)).dropDuplicates([id_col, h]).select(*columns)
    return alone.unionByName(rest).unionByName(stay)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


ORACLE_OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n + b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m ON m.doc_id = s.doc_id
"""
