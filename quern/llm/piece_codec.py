"""SentencePiece encoding and decoding of whole texts.

The pieces of a vocabulary file stand in an Aho-Corasick automaton. One pass over a text
follows it, and at every place its output links give all pieces that end there; each
relaxes the best score of the place (Viterbi), and the way back gives the pieces of the
highest total score. Characters that no piece holds become byte pieces. Equal scores go
to the longer last piece.

Spaces are written as U+2581, with one in front of the text; a U+2581 of the text itself is
written in bytes, so that decoding gives back the very text. No piece crosses from a word
into a following space, so words are encoded apart and remembered in a bounded cache; a
vocabulary with such pieces is encoded in one go.

Defined results: a null text is an empty one, of which no pieces come; repeated rows are
encoded alike; an empty table gives an empty result; other columns are carried untouched.

The model file is one of byte-pair merges: its scores are ranks of merges, not log
probabilities. Viterbi maximises their sum, as dealt; the file's own library applies merges
in turn, so the ids differ from that library's in nearly every text, and pieces are about a
seventh more. Decoding gives the text back either way.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quern.llm.common import table

SPACE = "▁"
CACHE_WORDS = 500_000
#: What a byte piece costs beyond the least score of a piece.
BYTE_COST = 10.0


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.is_byte = [model.is_byte(i) for i in range(len(self.pieces))]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or b for i, b in enumerate(self.is_byte)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.is_byte[i]}
        self.automaton = ahocorasick.Automaton()
        least = 0.0
        for i, p in enumerate(self.pieces):
            if not special[i]:
                score = model.get_score(i)
                least = min(least, score)
                self.automaton.add_word(p, (i, len(p), score))
        self.automaton.make_automaton()
        self.byte_score = least - BYTE_COST
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for i, p in enumerate(self.pieces) if not special[i])
        self.word = re.compile(".+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
        #: What each piece stands for, in bytes.
        self.body = [bytes([int(p[3:5], 16)]) if self.is_byte[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.cache: dict[str, bytes] = {}

    def best(self, word: str, literal: frozenset[int] = frozenset()) -> list[int]:
        """Ids of the best pieces of a word; places in ``literal`` are only written in bytes."""
        n = len(word)
        score, piece = [0.0] * (n + 1), [(-1, 1)] * (n + 1)
        ends: dict[int, list[tuple[int, int, float]]] = {}
        for end, value in self.automaton.iter(word):
            ends.setdefault(end, []).append(value)
        for end in range(n):
            c = word[end]
            top = score[end] + (self.byte_score if c < "\x80" else len(c.encode("utf-8", "surrogatepass")) * self.byte_score)
            how = (-1, 1)
            # The output links lead from the longest piece to the shortest.
            for i, length, s in ends.get(end, ()):
                start = end + 1 - length
                if literal and any(start <= x <= end for x in literal):
                    continue
                total = score[start] + s
                if total > top:
                    top, how = total, (i, length)
            score[end + 1], piece[end + 1] = top, how
        out: list[int] = []
        at = n
        while at:
            i, length = piece[at]
            if i < 0:
                out += [self.bytes[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass"))]
            else:
                out.append(i)
            at -= length
        out.reverse()
        return out

    def _word(self, word: str) -> bytes:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            got = array("I", self.best(word)).tobytes()
            if len(word) <= 64:
                self.cache[word] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """Ids as packed native uint32."""
        if not text:
            return b""
        if SPACE in text:
            marked = SPACE + text.replace(" ", SPACE)
            literal = {i + 1 for i, c in enumerate(text) if c == SPACE}
            out = []
            for m in self.word.finditer(marked):
                here = frozenset(i - m.start() for i in range(m.start(), m.end()) if i in literal)
                out.append(array("I", self.best(m.group(), here)).tobytes() if here else self._word(m.group()))
            return b"".join(out)
        return b"".join(map(self._word, self.word.findall(SPACE + text.replace(" ", SPACE))))

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.body.__getitem__, array("I", ids))).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers as public

    return public.path("piece_bpe_32k.model")


def _map(df: DataFrame, out: str, kind, convert, path: str) -> DataFrame:
    """``df`` with the column ``out``, in the place of one that has its name already."""
    rest = [i for i, c in enumerate(df.columns) if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), convert(c, b)], [*(b.schema.names[i] for i in rest), out])

    return df.mapInArrow(run, StructType([*(df.schema.fields[i] for i in rest), StructField(out, kind)]))


def encode_pieces(df: DataFrame, text_col: str = "text", ids_col: str = "piece_ids", path: str | None = None) -> DataFrame:
    """``df`` with the array of piece ids of each text."""
    at = df.columns.index(text_col)
    to_ids = lambda c, b: pa.array([array("I", c.encode(t)).tolist() for t in b.column(at).to_pylist()], pa.list_(pa.int32()))
    return _map(df, ids_col, ArrayType(IntegerType()), to_ids, _path(path))


def decode_pieces(df: DataFrame, ids_col: str = "piece_ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of each array of piece ids; null gives null."""
    from pyspark.sql.types import StringType

    at = df.columns.index(ids_col)
    to_text = lambda c, b: pa.array([None if x is None else c.decode(array("I", x).tobytes()) for x in b.column(at).to_pylist()], pa.string())
    return _map(df, text_col, StringType(), to_text, _path(path))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian uint32 ids) and whether decoding gave the text back."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, kind = _path(None), df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, crc, same = [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t)
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                same.append(c.decode(ids) == (t or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return df.mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_crc32 long, round_trip boolean")
