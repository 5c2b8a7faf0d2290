"""Removal of long repeated byte strings, by matching statistics from run-length indexes.

A byte goes if a ``length``-byte string over it also starts earlier (smaller id, or same
row and earlier start); overlaps count, matches never cross rows, and all is judged on the
input. Exact, and in these steps:

1. Each string of ``length`` bytes has an anchor, the leftmost least-hashed ``gram`` in it.
   Equal strings have equal anchors at equal places, so strings only have to be compared
   where anchors repeat. Consecutive strings of one anchor form a segment, about 30 strings
   on average. A first pass counts anchors; those seen twice form a filter of bounded size.
2. A second pass emits the segments of repeated anchors, as places and hashes. Equal segments
   are one from here on, known by the first: of the others every byte goes, at once.
3. What is left are different segments of one anchor - the ends of matches. A third pass
   reads their bytes and they are dealt out by anchor, a few hundred kilobytes at a time.
   Hashes of the strings tell which may be repeated; the first of each make the text of a
   run-compressed Burrows-Wheeler index with sampled run ends, the later ones are streamed
   through it, and what has a match of ``length`` bytes or more by its matching statistics
   goes (run_index). Segments of an anchor that has more of them than ``crowd`` go by
   128-bit hashes of their strings, pre-aggregated, so that no anchor fills a task.
4. The spans meet the texts; only rows that lose bytes are shuffled.

Defined results: a null text is an empty one; texts shorter than ``length`` lose nothing;
null ids order first, and rows of one id by their place in the input; of rows that repeat,
all but the first go whole; an empty table gives an empty result. Passes are joined on the
number of a row, so it must not depend on how a read is dealt to tasks: it is made of file
and row index where a table is read (number_rows), else written once with the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import BLOCK_BITS, Scratch, hash_filter, map_arrow, materialize, maybe_in, number_rows, table, text_or_empty
from quern.llm.run_index import RunIndex

LENGTH, GRAM = 100, 40
#: Bytes that are looked at together; longer texts are looked at in overlapping parts.
CHUNK = 1_000_000
#: Bytes of segments that are looked at together in the end.
INDEX_BYTES = 600_000
#: Different segments of one anchor beyond which their strings are hashed.
CROWD = 2000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_OTHER = np.random.default_rng(98).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class Segments:
    """Segments of the texts of a chunk, as arrays: row, start, strings, anchor."""

    _bytes = np.random.default_rng(99).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    _power = np.cumprod(np.full(CHUNK + 4096, _BASE)) * _BACK
    _inverse = np.cumprod(np.full(CHUNK + 4096, _BACK)) * _BASE

    def __init__(self, parts: list[tuple[int, int, bytes]], length: int, gram: int):
        """``parts``: row, place of the first byte in its text, bytes; each of ``length`` bytes or more."""
        self.length = length
        data = b"".join(p[2] for p in parts)
        x = np.frombuffer(data, np.uint8)
        n = len(x)
        self.data = data
        if n > len(self._power):
            power, inverse = np.cumprod(np.full(n, _BASE)) * _BACK, np.cumprod(np.full(n, _BACK)) * _BASE
        else:
            power, inverse = self._power[:n], self._inverse[:n]
        self.inverse = inverse
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self._bytes[x] * power, out=self.prefix[1:])
        grams = _mix((self.prefix[gram:] - self.prefix[:-gram]) * inverse[: n - gram + 1])
        # Leftmost least gram of each window, by doubling.
        width, least, at, have = length - gram + 1, grams, np.arange(len(grams), dtype=np.int32), 1
        while have < width:
            step = min(have, width - have)
            left = least[:-step] <= least[step:]
            least, at = np.where(left, least[:-step], least[step:]), np.where(left, at[:-step], at[step:])
            have += step
        sizes = np.array([len(p[2]) for p in parts], np.int64)
        first = np.cumsum(sizes) - sizes
        starts = np.ones(len(at), bool)
        for f, s in zip(first[:-1], sizes[:-1]):
            starts[f + s - length + 1 : f + s] = False
        s = np.flatnonzero(starts)
        a = at[s]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
        self.at = s[new]
        self.strings = np.diff(np.append(new, len(s)))
        self.anchor = grams[a[new]].view(np.int64)
        part = np.searchsorted(first, self.at, "right") - 1
        self.row = np.array([p[0] for p in parts], np.int64)[part]
        self.start = self.at - first[part] + np.array([p[1] for p in parts], np.int64)[part]

    def digests(self, keep: np.ndarray) -> np.ndarray:
        b = self.at[keep]
        e = b + self.strings[keep] + self.length - 1
        return _mix((self.prefix[e] - self.prefix[b]) * self.inverse[b] + (e - b).astype(np.uint64)).view(np.int64)

    def bytes_of(self, keep: np.ndarray) -> list[bytes]:
        return [self.data[b : b + n + self.length - 1] for b, n in zip(self.at[keep].tolist(), self.strings[keep].tolist())]


def strings_of(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every ``length``-byte string of the bodies the body, the place in it, and two hashes."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    x = np.frombuffer(b"".join(bodies), np.uint8)
    counts = np.maximum(sizes - length + 1, 0)
    body = np.repeat(np.arange(len(bodies)), counts)
    place = np.arange(len(body)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(sizes) - sizes)[body] + place
    power, inverse = np.cumprod(np.full(len(x), _BASE)) * _BACK, (np.cumprod(np.full(len(x), _BACK)) * _BASE)[at] if len(at) else None
    hashes = []
    for of_byte in (Segments._bytes, _OTHER):
        prefix = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(of_byte[x] * power, out=prefix[1:])
        hashes.append(_mix((prefix[at + length] - prefix[at]) * inverse).view(np.int64) if len(at) else np.zeros(0, np.int64))
    return body, place, *hashes


def _runs(flags: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of ``flags`` that lie in one body."""
    new = np.concatenate([[True], body[1:] != body[:-1]])
    before, after = np.concatenate([[False], flags[:-1]]) & ~new, np.concatenate([flags[1:], [False]]) & ~np.concatenate([new[1:], [True]])
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1


def later_strings(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, begin, end) of stretches of the bodies' strings that are in an earlier body (or earlier in the same one)."""
    body, place, h, _ = strings_of(bodies, length)
    _, first, of, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    known = np.zeros(len(h), bool)
    known[first] = True
    again = times[of] > 1
    b, e = _runs(again & known, body)
    texts = [bodies[i][p : p + n + length - 1] for i, p, n in zip(body[b].tolist(), place[b].tolist(), (e - b).tolist())]
    b, e = _runs(again & ~known, body)
    queries = [bodies[i][p : p + n + length - 1] for i, p, n in zip(body[b].tolist(), place[b].tolist(), (e - b).tolist())]
    hit = np.zeros(len(h), bool)
    if queries:
        for x, y, lengths in zip(b.tolist(), e.tolist(), RunIndex(texts).matching_statistics(queries)[0]):
            hit[x:y] = lengths[: y - x] >= length
    b, e = _runs(hit, body)
    return body[b], place[b], place[b] + (e - b)


def _chunks(texts: list[bytes | None], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Parts of at most about CHUNK bytes; the strings of a long text are dealt out, each to one part."""
    parts, size = [], 0
    for row, t in enumerate(texts):
        if t is None or len(t) < length:
            continue
        for a in range(0, len(t) - length + 1, CHUNK):
            part = t[a : a + CHUNK + length - 1]
            if parts and size + len(part) > CHUNK:
                yield parts
                parts, size = [], 0
            parts.append((row, a, part))
            size += len(part)
    if parts:
        yield parts


def _raw(df: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """doc_id, uid, body: the same at each read."""
    uid = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    raw = df.select(F.col(f"`{id_col}`").alias("doc_id"), uid.alias("uid"), text_or_empty(F.col(f"`{text_col}`")).cast("binary").alias("body"))
    return raw if row_col else materialize(raw, "texts")


def _repeated_anchors(raw: DataFrame, length: int, gram: int) -> DataFrame:
    """h: anchors of two or more segments."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for parts in _chunks(b.column(0).to_pylist(), length):
                h, n = np.unique(Segments(parts, length, gram).anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    return map_arrow(raw.select("body"), count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def _bitmap(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """The filter of common.hash_filter() as one array: 32 MiB at most."""
    bits, blocks = hash_filter(hashes)
    bitmap = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
    for r in bits.collect():  # bounded: 8192 blocks of 4 KiB at most
        at = r["block"] * BLOCK_BITS // 8
        bitmap[at : at + BLOCK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return bitmap, blocks


def _known(bitmap: np.ndarray, blocks: int, h: np.ndarray) -> np.ndarray:
    pos = (h.view(np.uint64) >> _U(24)).astype(np.int64) & (BLOCK_BITS - 1)
    place = (h % blocks) * BLOCK_BITS + pos
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _occurrences(raw: DataFrame, anchors: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, uid, start, strings, anchor, digest of the segments whose anchor may repeat."""
    bitmap, blocks = _bitmap(anchors)
    shared = raw.sparkSession.sparkContext.broadcast(bitmap)
    kind = raw.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for parts in _chunks(b.column(2).to_pylist(), length):
                s = Segments(parts, length, gram)
                keep = np.flatnonzero(_known(shared.value, blocks, s.anchor))
                if len(keep):
                    rows = pa.array(s.row[keep])
                    columns = [b.column(0).take(rows), b.column(1).take(rows), pa.array(s.start[keep]), pa.array(s.strings[keep]), pa.array(s.anchor[keep]), pa.array(s.digests(keep))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "start", "strings", "anchor", "digest"])

    return map_arrow(raw, emit, f"doc_id {kind}, uid long, start long, strings long, anchor long, digest long")


def _bodies(raw: DataFrame, mixed: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, first, kinds, body of the segments ``mixed`` (anchor, digest, first, kinds), read from the texts anew."""
    # Segments are known by place and hash; the same in numpy below.
    name = F.shiftleft("first.uid", 20).bitwiseXOR(F.col("first.start")).bitwiseXOR(F.col("digest"))
    bitmap, blocks = _bitmap(mixed.select(name.alias("h")))
    shared = raw.sparkSession.sparkContext.broadcast(bitmap)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uids = b.column(0).to_numpy()
            for parts in _chunks(b.column(1).to_pylist(), length):
                s = Segments(parts, length, gram)
                h = (uids[s.row] << 20) ^ s.start ^ s.digests(np.arange(len(s.at)))
                keep = np.flatnonzero(_known(shared.value, blocks, h))
                if len(keep):
                    yield pa.RecordBatch.from_arrays([pa.array(uids[s.row[keep]]), pa.array(s.start[keep]), pa.array(s.bytes_of(keep), pa.binary())], ["u", "s", "body"])

    read = map_arrow(raw.select("uid", "body"), emit, "u long, s long, body binary")
    return mixed.join(read, (F.col("first.uid") == F.col("u")) & (F.col("first.start") == F.col("s"))).select("anchor", "first", "kinds", "body")


def _indexed(segments: DataFrame, length: int) -> DataFrame:
    """uid, b, e of the strings of segments (anchor, doc_id, uid, start, body) that an earlier segment has, by run-length indexes."""
    # Rows of an anchor meet in one task, in order; there are at most ``crowd`` of them.
    dealt = segments.repartition("anchor").sortWithinPartitions("anchor", F.col("first.null_id").desc(), "first.doc_id", "first.uid", "first.start")
    dealt = dealt.select("anchor", F.col("first.uid").alias("uid"), F.col("first.start").alias("start"), "body")

    def spans(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        body, b, e = later_strings([r[2] for r in rows], length)
        uids, starts = (np.array([r[k] for r in rows], np.int64)[body] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(uids), pa.array(starts + b), pa.array(starts + e + length - 1)], ["uid", "b", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for anchor, uid, start, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if anchor != last and size >= INDEX_BYTES:
                    yield spans(rows)
                    rows, size = [], 0
                rows.append((uid, start, body))
                size += len(body)
                last = anchor
        if rows:
            yield spans(rows)

    return map_arrow(dealt, run, "uid long, b long, e long")


def _hashed(segments: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """As _indexed(), for anchors of very many segments: strings are known by 128-bit hashes."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                b = batch.slice(i, 2000)
                body, at, g, h = strings_of(b.column(1).to_pylist(), length)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(body)), pa.array(at), pa.array(g), pa.array(h)], ["first", "k", "g", "h"])

    kind = segments.schema["first"].dataType.simpleString()
    each = scratch.keep(materialize(map_arrow(segments.select("first", "body"), strings, f"first {kind}, k long, g long, h long"), "strings"))
    place = F.struct(~F.col("first.null_id"), F.col("first.doc_id"), F.col("first.uid"), (F.col("first.start") + F.col("k")).alias("at"))
    firsts = scratch.keep(materialize(each.groupBy(F.col("g").alias("fg"), F.col("h").alias("fh")).agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1").select("fg", "fh", F.col("p.uid").alias("fu"), F.col("p.at").alias("fa")), "first-strings"))
    at = F.col("first.start") + F.col("k")
    later = each.join(firsts, (F.col("g") == F.col("fg")) & (F.col("h") == F.col("fh"))).where((F.col("first.uid") != F.col("fu")) | (at != F.col("fa")))
    return later.select(F.col("first.uid").alias("uid"), at.alias("b"), (at + length).alias("e"))


def repeated_spans(raw: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """uid, spans: for each row of ``raw`` (doc_id, uid, body) that loses bytes an array of (b, e), neither merged nor in order."""
    scratch = Scratch(raw.sparkSession)
    keep = scratch.keep
    occ = keep(materialize(_occurrences(raw, keep(materialize(_repeated_anchors(raw, length, gram), "anchors")), length, gram), "segments"))
    first = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "uid", "start")
    order = F.struct(~F.col("doc_id").isNull(), "doc_id", "uid", "start")
    kinds = occ.groupBy("anchor", "digest").agg(F.min_by(first, order).alias("first"), F.count(F.lit(1)).alias("n"))
    kinds = keep(materialize(kinds, "kinds"))
    copied = keep(materialize(kinds.where("n > 1").select(F.col("anchor").alias("a"), F.col("digest").alias("g"), "first.uid", "first.start").withColumnsRenamed({"uid": "fu", "start": "fs"}), "copied"))
    copies = occ.select("anchor", "digest", "uid", "start", "strings").join(copied, (F.col("anchor") == F.col("a")) & (F.col("digest") == F.col("g")))
    copies = copies.where("uid <> fu or start <> fs").select("uid", F.col("start").alias("b"), (F.col("start") + F.col("strings") + length - 1).alias("e"))
    many = keep(materialize(kinds.groupBy(F.col("anchor").alias("a")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "mixed"))
    mixed = keep(materialize(kinds.join(many, F.col("anchor") == F.col("a")).select("anchor", "digest", "first", "kinds"), "mixed-kinds"))
    bodies = keep(materialize(_bodies(raw, mixed, length, gram), "bodies"))
    ends = _indexed(bodies.where(F.col("kinds") <= crowd).select("anchor", "first", "body"), length).unionByName(_hashed(bodies.where(F.col("kinds") > crowd).select("anchor", "first", "body"), length, scratch))
    spans = copies.unionByName(ends)
    out = materialize(spans.groupBy("uid").agg(F.collect_list(F.struct("b", "e")).alias("spans")), "spans")  # a row's own spans
    scratch.clear()
    return out


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted((s["b"], s["e"]) for s in spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [tuple(x) for x in out]


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, **how) -> DataFrame:
    """doc_id, body (the bytes that stay), n_bytes, n_removed, n_spans of each row.

    ``row_col``: a long that no two rows share and that each read gives alike; without it the texts are written once.
    """
    raw = _raw(df, id_col, text_col, row_col)
    spans = repeated_spans(raw, **how)
    flagged = maybe_in(raw.withColumn("h", F.xxhash64("uid")), "h", hash_filter(spans.select(F.xxhash64("uid").alias("h"))), "loses")
    whole = flagged.where("not loses").select("doc_id", "body", F.octet_length("body").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"))
    met = flagged.where("loses").select("doc_id", "uid", "body").join(spans.withColumnRenamed("uid", "u"), F.col("uid") == F.col("u"), "left").select("doc_id", "body", "spans")
    kind = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, sizes, gone, count = [], [], [], []
            for body, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                runs = _merged(spans or [])
                at, out = 0, []
                for s, e in runs:
                    out.append(body[at:s])
                    at = e
                out.append(body[at:])
                kept.append(b"".join(out))
                sizes.append(len(body))
                gone.append(len(body) - len(kept[-1]))
                count.append(len(runs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, count))], ["doc_id", "body", "n_bytes", "n_removed", "n_spans"])

    return whole.unionByName(map_arrow(met, cut, f"doc_id {kind}, body binary, n_bytes long, n_removed long, n_spans long"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(number_rows(table(spark, sf_dir, "documents"), "row"), row_col="row")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("body", 256).alias("kept_sha256"))
