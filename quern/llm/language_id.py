"""Language identification of whole texts, with spans for mixed-language ones.

Each word gets a score per learned language: the sum of centred log frequencies of its
letter 2-, 3- and 4-grams, word boundaries included, from hashed tables. The script of a
word (by code point ranges) narrows its candidates to the languages that were seen to use
that script. Viterbi over the words, with a penalty for changing the language, labels
spans; the language of most letters is the document's.

The tables are fitted on at most about ``per_language`` documents of each language, chosen
by a hash of the id; their size is bounded by the number of buckets and languages. Every
document is labelled, whole. Predictions use the text alone.

Defined results: a null text and one without a letter are ``und`` with score 0; so are
all texts where no language could be learned. A null id is never learned from and not
held out. Words in a script that no learned language uses are judged by all. Repeated
rows are labelled alike; equal sums of letters go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import free_name, map_arrow, table

#: Script, first and last code point; other letters are script 0.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
BUCKETS = 1 << 17
ORDERS = (2, 3, 4)
#: Documents of each language that the tables are fitted on, at most (in expectation).
PER_LANGUAGE = 3000
#: Cost of changing the language between two words, in nats.
SWITCH = 12.0
#: A language uses a script when it has this share of the language's letters.
SCRIPT_SHARE = 0.01
#: Characters that are cut into words at a time, and words that are labelled together; both bound a worker's memory.
CHARS, WORDS = 700_000, 1_500_000
_SPACE = 32


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, its lower case, its script."""
    letter = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in range(0xE0000):  # nothing beyond is a letter
        c = chr(i)
        letter[i] = c.isalpha()
        if letter[i]:
            d = c.lower()
            if len(d) == 1:
                lower[i] = ord(d)
    script = np.zeros(0x110000, np.uint8)
    names = list(dict.fromkeys(n for n, _, _ in SCRIPTS))
    for n, a, b in SCRIPTS:
        script[a : b + 1] = names.index(n) + 1
    return letter, lower, script


class Words:
    """The words of a few texts and their n-gram buckets."""

    def __init__(self, texts: list[str]):
        letter, lower, script = _tables()
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        sizes = np.array([len(c) + 1 for c in codes], np.int64)
        gap = np.array([_SPACE], np.uint32)
        cp = np.concatenate([gap, gap, gap, *(x for c in codes for x in (c, gap))])
        is_letter = letter[cp]
        x = np.where(is_letter, lower[cp], np.uint32(_SPACE)).astype(np.uint64)
        starts = np.flatnonzero(is_letter[1:] & ~is_letter[:-1]) + 1
        ends = np.flatnonzero(~is_letter[1:] & is_letter[:-1]) + 1
        self.letters = ends - starts
        first = 3 + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        self.doc = np.searchsorted(first, starts, "right") - 1
        self.start, self.end = starts - first[self.doc], ends - first[self.doc]
        self.script = script[cp[starts]]
        # Positions that end an n-gram: every letter and the place after each word.
        at = np.flatnonzero(is_letter | np.concatenate([[False], is_letter[:-1]]))
        self.word_at = np.searchsorted(at, starts)
        inside = np.cumsum(~is_letter)  # an n-gram is used if what lies between its ends is letters
        mul = np.uint64(0x9E3779B97F4A7C15)
        h = (x + np.uint64(1)) * mul
        self.grams = []
        for n in range(2, max(ORDERS) + 1):
            h[n - 1 :] = (h[n - 1 :] ^ (x[: -(n - 1)] << np.uint64(7)) ^ np.uint64(n)) * mul  # noqa: PLR6104
            h ^= h >> np.uint64(29)
            if n in ORDERS:
                bucket = (h[at] >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)
                whole = inside[at - 1] == inside[at - n + 1] if n > 2 else np.ones(len(at), bool)
                self.grams.append((bucket, whole))


class LanguageModel:
    def __init__(self, languages: list[str], weights: np.ndarray, uses: np.ndarray, switch: float = SWITCH):
        self.languages, self.weights, self.switch = languages, weights, switch
        some = uses.any(axis=0)
        self.narrow = np.where(uses | ~some, 0.0, -1e4).astype(np.float32)  # languages x scripts

    def word_scores(self, w: Words) -> np.ndarray:
        """languages x words"""
        if not len(w.word_at):
            return np.zeros((len(self.languages), 0), np.float32)
        out = []
        for i in range(len(self.languages)):
            row = self.weights[i]
            total = sum(row[b] * whole for b, whole in w.grams)
            out.append(np.add.reduceat(total, w.word_at))
        return np.stack(out).astype(np.float32) / len(ORDERS) + self.narrow[:, w.script]

    def viterbi(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Best state of every word; ``counts``: words of each text, in order. All texts advance together."""
        words = scores.shape[1]
        order = np.argsort(-counts, kind="stable")
        begin = (np.cumsum(counts) - counts)[order]
        many = counts[order]
        best, stay = np.zeros(words, np.int32), np.zeros(scores.shape, bool)
        alive = len(many) - np.searchsorted(many[::-1], np.arange(int(many[0]) if len(many) else 0), "right")
        v = np.zeros((len(self.languages), len(many)), np.float32)
        last = np.zeros(len(many), np.int32)
        for t, n in enumerate(alive):
            at = begin[:n] + t
            if t:
                v = v[:, :n]
                top = v.max(axis=0)
                best[at] = v.argmax(axis=0)
                stay[:, at] = keep = v >= top - self.switch
                v = np.where(keep, v, top - self.switch) - top
            else:
                v = v[:, :n]
            v = v + scores[:, at]
            ended = many[:n] == t + 1
            if ended.any():
                last[:n][ended] = v.argmax(axis=0)[ended]
        states = np.zeros(words, np.int32)
        now = last
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            at = begin[:n] + t
            states[at] = now[:n]
            if t:
                now[:n] = np.where(stay[now[:n], at], now[:n], best[at])
        return states

    def label(self, texts: list[str | None], spans: bool = False) -> tuple[list[str], list[float], list | None]:
        """Language, share of letters in it and, on request, spans (start, end, language) of each text."""
        langs, scores, runs = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts] if spans else None
        at = 0
        while at < len(texts):
            parts, begin, words = [], at, 0
            while at < len(texts) and words < WORDS:
                upto, chars = at, 0
                while upto < len(texts) and (upto == at or chars + len(texts[upto] or "") <= CHARS):
                    chars += len(texts[upto] or "")
                    upto += 1
                w = Words([t or "" for t in texts[at:upto]])
                parts.append((self.word_scores(w), w.doc + (at - begin), w.letters, w.start, w.end))
                words += len(w.doc)
                at = upto
            self._finish(begin, at - begin, [np.concatenate(x, axis=-1) for x in zip(*parts)], langs, scores, runs)
        return langs, scores, runs

    def _finish(self, begin: int, n: int, parts, langs, scores, runs) -> None:
        s, doc, letters, start, end = parts
        if not len(doc) or not self.languages:
            return
        states = self.viterbi(s, np.bincount(doc, minlength=n))
        k = len(self.languages)
        sums = np.bincount(doc * k + states, weights=letters, minlength=n * k).reshape(n, k)
        total, top = sums.sum(axis=1), sums.argmax(axis=1)
        for i in np.flatnonzero(total):
            langs[begin + i] = self.languages[top[i]]
            scores[begin + i] = float(sums[i, top[i]] / total[i])
        if runs is not None:
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (states[1:] != states[:-1])]))
            for a, b in zip(new, [*new[1:], len(doc)]):
                runs[begin + doc[a]].append((int(start[a]), int(end[b - 1]), self.languages[states[a]]))


def fit_language_model(examples: DataFrame, per_language: int = PER_LANGUAGE, switch: float = SWITCH) -> LanguageModel:
    """``examples``: key (for the sample), text and lang, none of them null."""
    sizes = {r["lang"]: r["count"] for r in examples.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    scripts = len(dict.fromkeys(n for n, _, _ in SCRIPTS)) + 1
    if not languages:
        return LanguageModel([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, scripts), bool), switch)
    index = {lang: i for i, lang in enumerate(languages)}
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, per_language / sizes[lang])))])
    picked = examples.where(F.pmod(F.xxhash64(F.col("key"), F.lit(11)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(languages), len(ORDERS) * BUCKETS))
        used = np.zeros((len(languages), scripts))
        for b in batches:
            d = b.to_pydict()
            by: dict[str, list[str]] = {}
            for text, lang in zip(d["text"], d["lang"]):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                i = index[lang]
                for a in range(0, len(texts), 200):
                    w = Words(texts[a : a + 200])
                    for n, (bucket, whole) in enumerate(w.grams):
                        grams[i] += np.bincount(bucket + n * BUCKETS, weights=whole, minlength=len(ORDERS) * BUCKETS)
                    used[i] += np.bincount(w.script, weights=w.letters, minlength=scripts)
        for what, table_ in ((0, grams), (1, used)):
            i, j = np.nonzero(table_)
            for a in range(0, len(i), 50_000):
                x, y = i[a : a + 50_000], j[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), what)), pa.array(x), pa.array(y), pa.array(table_[x, y])], ["what", "lang", "bucket", "n"])

    # At most languages x buckets rows, whatever the corpus.
    rows = map_arrow(picked, count, "what long, lang long, bucket long, n double").groupBy("what", "lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    grams, uses = np.zeros((len(languages), len(ORDERS) * BUCKETS)), np.zeros((len(languages), scripts))
    for what, target in ((0, grams), (1, uses)):
        r = rows[rows["what"] == what]
        target[r["lang"].to_numpy(), r["bucket"].to_numpy()] = r["n"].to_numpy()
    weights = np.zeros((len(languages), BUCKETS), np.float32)
    orders = grams.reshape(len(languages), len(ORDERS), BUCKETS)
    # One table for all orders: buckets of different orders share no hash, so their counts add.
    merged = orders.sum(axis=1)
    share_of = merged / np.maximum(merged.sum(axis=1, keepdims=True), 1)
    log = np.log(share_of + 1e-7)
    weights[:] = np.where(merged.sum(axis=0) > 0, log - log.mean(axis=0), 0)
    return LanguageModel(languages, weights, uses >= SCRIPT_SHARE * np.maximum(uses.sum(axis=1, keepdims=True), 1), switch)


def label_languages(df: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", spans_col: str | None = None) -> DataFrame:
    """``df`` with the language, its share and, if ``spans_col`` is given, the spans. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # size bounded by buckets x languages
    schema = ", ".join([f"{lang_col} string", f"{score_col} double"] + ([f"{spans_col} array<struct<start:int,end:int,lang:string>>"] if spans_col else []))
    types = [pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))]
    at = df.columns.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, runs = shared.value.label(b.column(at).to_pylist(), spans=bool(spans_col))
            more = [langs, scores] + ([[[dict(zip(("start", "end", "lang"), r)) for r in x] for x in runs]] if spans_col else [])
            names = [lang_col, score_col] + ([spans_col] if spans_col else [])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, t) for x, t in zip(more, types))], [*b.schema.names, *names])

    from pyspark.sql.types import StructType, _parse_datatype_string

    return map_arrow(df, label, StructType([*df.schema.fields, *_parse_datatype_string(schema).fields]))


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from; a null id counts as not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_from(docs: DataFrame, **how) -> LanguageModel:
    """A model of the documents that are not held out and have id, text and language."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    return fit_language_model(known.select(F.col("doc_id").alias("key"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), **how)


def identify_languages(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    model = learn_from(docs, **how)
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return label_languages(slim, model).drop("text")


def keep_identified(docs: DataFrame, **how) -> DataFrame:
    """The rows with a language, all columns kept, ``lang`` set to it; the undetermined ones go."""
    model = learn_from(docs, **how)
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    out = label_languages(docs, model, "text", lang, score)
    return out.where(F.col(lang) != "und").withColumn("lang", F.col(lang)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
