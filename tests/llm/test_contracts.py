"""The registered queries as they are registered, on the smallest tables: columns, types and rows against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import queries
from tests.llm.test_operators import base_spans, brute_repeats


def run(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    return dict(df.dtypes), df.collect()


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()


def test_op1(spark, sf, documents):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    types, got = run(spark, sf, "op1_best_fit_packing")
    want = {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    assert want.items() <= types.items()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in documents:
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        mine, at = sorted(pieces[d["doc_id"]], key=lambda r: r["piece"]), 0
        assert [r["piece"] for r in mine] == list(range(len(mine))) and (len(mine) == 1 or len(ids) > 1024)
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 1024 for r in mine[1:])
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) <= 1.02 * -(-sum(r["length"] for r in got) // 1024) + 1


def test_op2(spark, sf):
    types, got = run(spark, sf, "op2_vector_search")
    assert {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}.items() <= types.items()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ok = [r for r in rows if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]
    ids, x = np.array([r["vec_id"] for r in ok]), np.array([r["embedding"] for r in ok], float)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got}
    n, hits, total = np.sqrt((x * x).sum(1)), 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q] / (n * n[q])
        s[q] = -9
        best = np.lexsort((ids, -s))[:5]
        for k, i in enumerate(best, 1):
            total += 1
            hits += found[ids[q], k][0] == ids[i]
            assert abs(found[ids[q], k][1] - s[i]) < 1e-12 or found[ids[q], k][0] != ids[i]
    assert total == len(got) and hits >= 0.9 * total


def test_op3(spark, sf, documents):
    types, got = run(spark, sf, "op3_secret_scan")
    assert {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}.items() <= types.items()
    by = {r["doc_id"]: r for r in got}
    assert len(by) == len(got) == len(documents)
    for d in documents:
        spans, r = base_spans(d["text"] or ""), by[d["doc_id"]]
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert [x for x in r["spans"].split(",") if x and not x.startswith("random:")] == [x for x in line.split(",") if x]


def test_op4(spark, sf, documents):
    types, got = run(spark, sf, "op4_language_id")
    assert types == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    by, langs = {r["doc_id"]: r for r in got}, {d["lang"] for d in documents} - {None}
    assert len(by) == len(got) == len(documents)
    right = of = 0
    for d in documents:
        r, letters = by[d["doc_id"]], any(c.isalpha() for c in d["text"] or "")
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in langs if letters else r["lang_pred"] == "und"
        if r["held_out"] and letters and d["lang"]:
            of += 1
            right += r["lang_pred"] == d["lang"]
    assert of and right >= 0.9 * of


def test_op6(spark, sf, documents):
    types, got = run(spark, sf, "op6_suffix_dedup")
    assert types == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    want = {i: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in brute_repeats([(d["doc_id"], d["text"]) for d in documents], 100)}
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


def test_op7_types(spark, sf):
    assert dict(queries.QUERIES["op7_minhash_dedup"](spark, sf).dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}


def test_op8(spark, sf):
    types, got = run(spark, sf, "op8_url_filter")
    assert {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}.items() <= types.items()
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {r["page_id"]: r for r in got}
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    assert len(pages) == len(got)
    for p in pages:
        _, sep, rest = (p["url"] or "").partition("://")
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest)) if sep else 0
        host, path = (rest[:cut].translate(fold), rest[cut:].split("?")[0].split("#")[0]) if sep else ("", "")
        fits = [(len(h + q), kind, h + q) for kind, h, q in rules if (host == h or host.endswith("." + h)) and path.startswith(q)]
        r = by[p["page_id"]]
        assert (r["host"], r["path"]) == (host, path) and r["verdict"] in ("allow", "block")
        assert (r["rule"], r["verdict"]) == (max(fits)[2], max(fits)[1]) if fits else r["rule"] is None


def test_op9(spark, sf, documents):
    types, got = run(spark, sf, "op9_sentencepiece")
    assert types == {"doc_id": "bigint", "n_pieces": "bigint", "ids_crc32": "bigint", "round_trip": "boolean"}
    assert len(got) == len(documents) and all(r["round_trip"] for r in got)
    from quern.llm.piece_codec import encode_pieces

    twice = encode_pieces(encode_pieces(spark.createDataFrame([("a b", 1)], "text string, Piece_Ids int")))
    assert twice.columns == ["text", "piece_ids"] and twice.where(F.size("piece_ids") > 0).count() == 1
