"""Operators must do the whole job on tables that sampling or moved rows would upset."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import line_dedup, suffix_dedup
from quern.llm.secret_scan import thresholds
from quern.llm.url_filter import UrlRatio, fit_ratio, judge_urls, model_text


def test_url_examples_are_different_urls(spark):
    """Two thousand rows of forty urls, a third of them one url: each url is an example, weighted by its rows."""
    n = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20)
    kind = F.when(F.col("id") % 2 == 0, "allow").otherwise("block")
    url = F.when(kind == "allow", F.format_string("http://s%d.com/fine/%d", n, n)).otherwise(F.format_string("http://s%d.net/es/bad/%d", n, n))
    rows = spark.range(2000).select(F.col("id").alias("page_id"), url.alias("url"), kind.alias("decided"))
    whole, few = fit_ratio(rows, 5000), fit_ratio(rows, 20)
    assert whole.known and few.known
    assert few.accepted.probability == whole.accepted.probability and few.rejected.probability == whole.rejected.probability and few.cut == whole.cut
    odd = rows.select("page_id", "url").unionByName(spark.createDataFrame([(-1, "http://s7.org/es/bad/7"), (-2, "http://s8.org/fine/8")], "page_id long, url string"))
    verdicts = [{r["page_id"]: r["verdict"] for r in judge_urls(odd.repartition(k), examples=20).where("page_id < 0").collect()} for k in (2, 7)]
    assert verdicts == [{-1: "block", -2: "allow"}] * 2


def test_url_examples_are_bounded_and_alike_however_dealt(spark):
    rows = spark.range(900).select(F.format_string("http://s%d.x/%d", F.col("id") % 300, F.col("id") % 300).alias("url"), F.when(F.col("id") % 2 == 0, "allow").otherwise("block").alias("decided"))
    a, b = (fit_ratio(rows.repartition(k), 50) for k in (1, 6))
    assert a.accepted.probability == b.accepted.probability and a.rejected.probability == b.rejected.probability and a.cut == b.cut


def test_url_models_are_of_all_ruled_urls(spark):
    """More ruled urls than any sample held: scores, cut and verdicts are those of the models of all of them, in memory."""
    rows = [(i, f"http://h{i % 97}.com/{hashlib.sha256(str(i).encode()).hexdigest()[: i % 9]}/fine") for i in range(5500)]
    rows += [(10_000 + i, f"http://é{i % 89}.net/fr/{hashlib.md5(str(i).encode()).hexdigest()[: i % 11]}bad") for i in range(5200)]
    rows += [(20_000 + i, f"https://x{i}.org/" + ("fr/bad" if i % 2 else "fine") * (i % 4)) for i in range(60)]
    rows += [(30_000, None), (30_001, ""), (30_002, "http://X7.org/" + "\U0001f600q" * 30), (0, "http://h0.com//fine"), (30_003, "http://long.org/" + "ab" * 5000)]
    accepted, rejected = (Counter(model_text(u) for _, u in rows if u and v in u) for v in (".com/", ".net/fr/"))
    assert min(len(accepted), len(rejected)) > 4000
    want = UrlRatio(accepted, rejected)
    df = spark.createDataFrame(rows, "page_id long, url string")
    for k in (3, 8):
        got = {r["page_id"]: r for r in judge_urls(df.repartition(k)).where("page_id >= 20000").collect()}
        assert len(got) == 64
        for i, u in rows:
            if i >= 20_000:
                assert got[i]["score"] == pytest.approx(want.score(model_text(u)), abs=1e-9)
                assert got[i]["verdict"] == want.verdict(model_text(u))


@pytest.mark.parametrize("numbered", [True, False])
def test_suffix_dedup_when_reads_are_dealt_anew(spark, tmp_path, monkeypatch, numbered):
    """Each pass splits the files otherwise, as when executors come and go."""
    passage = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(12))
    texts = [hashlib.sha256(f"doc {i}".encode()).hexdigest() * 2 + passage[i % 7 : 500 + i % 11] + hashlib.sha256(f"end {i}".encode()).hexdigest() for i in range(160)]
    d = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8, "doc_id").write.option("parquet.block.size", 4096).parquet(f"{d}/documents.parquet")
    seen, want = set(), {}
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(t[s : s + 100])
        want[i] = hashlib.sha256("".join(c for c, g in zip(t, gone) if not g).encode()).hexdigest()
    sizes, real = iter([1 << 30, 2000, 9000, 1 << 30] * 9), suffix_dedup.materialize

    def dealt_anew(df, tag):
        out = real(df, tag)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(next(sizes)))
        return out

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(suffix_dedup, "materialize", dealt_anew)
    try:
        if numbered:
            got = suffix_dedup.op6_suffix_dedup(spark, d)
        else:
            got = suffix_dedup.cut_repeats(spark.read.parquet(f"{d}/documents.parquet")).withColumn("kept_sha256", F.sha2("body", 256))
        assert {r["doc_id"]: r["kept_sha256"] for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_secret_thresholds_of_few_tokens(spark):
    """One token proves nothing, however large its p; few of a band are judged with the others of their encoding."""
    kind = "id int, tokens array<struct<s:int,e:int,encoding:string,n:int,p:double>>"
    token = lambda n, p: (0, n, "base62", n, p)
    assert thresholds(spark.createDataFrame([(1, [token(30, 0.9)])], kind)) == {}
    bands = [20, 30, 40, 60, 80, 120, 160, 240, 330, 460]
    rows = [(n, [token(n, (i + 0.5) / 12) for i in range(12)]) for n in bands] + [(0, [token(900, 0.45)])]
    got = thresholds(spark.createDataFrame(rows, kind))
    assert len(got) == 11 and got["base62", 10] <= 0.45
    junk = [(i, [token(900, 0.001)] * 40) for i in range(25)]
    assert 0 < thresholds(spark.createDataFrame(rows + junk, kind))["base62", 10] <= 0.45


def test_line_families_of_rare_words_meet_their_first_line_only(spark, monkeypatch):
    """Sixty alike lines, no word of which is common: pairs grow with the family, not with its square."""
    made = {}

    def counted(self, df, tag):
        out = real(self, df, tag)
        made.setdefault(tag, []).append(out.count())
        return out

    real = line_dedup.Scratch.materialize
    monkeypatch.setattr(line_dedup.Scratch, "materialize", counted)
    family = [f"only{i} " + " ".join(f"word{k}" for k in range(24)) for i in range(60)]
    other = [" ".join(hashlib.sha256(f"{i}-{k}".encode()).hexdigest() for k in range(9)) for i in range(60)]
    rows = [(i, f"{a}\n{b}") for i, (a, b) in enumerate(zip(family, other))]
    raw = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("doc_id", "doc_id uid", "text")
    gone = {(r["uid"], r["line"]) for r in line_dedup.judge_lines(raw).collect()}
    assert gone == {(i, 0) for i in range(1, 60)}
    assert made["tried-pairs"][0] <= 2 * 60 and made["line-pairs"] == [0]


def test_long_unlike_lines_make_no_pairs(spark, monkeypatch):
    """Lines of 150 words that share rare ones: the parities must tell what differs in more words than a long has bits."""
    made = {}

    def counted(self, df, tag):
        out = real(self, df, tag)
        made[tag] = out.count()
        return out

    real = line_dedup.Scratch.materialize
    monkeypatch.setattr(line_dedup.Scratch, "materialize", counted)
    words = [sorted(range(600), key=lambda k, i=i: hashlib.md5(f"{i}-{k}".encode()).digest())[:150] for i in range(40)]
    rows = [(i, " ".join([f"pair{i // 2}", *[f"word{k}" for k in w]])) for i, w in enumerate(words)]
    raw = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "doc_id uid", "text")
    assert line_dedup.judge_lines(raw).count() == 0 and made["all-pairs"] == 0


def test_line_word_levels_do_not_fill_the_plan(spark):
    """The driver keeps the text of a plan for every step of a query; the table of levels is in it."""
    raw = spark.createDataFrame([(1, 1, "a b c\nd")], "doc_id long, uid long, text string")
    plan = line_dedup.sets_of_lines(raw, [40] * line_dedup.SLOTS, (4, 5))
    assert len(plan._jdf.queryExecution().executedPlan().toString()) < 3 << 19


def test_line_pairs_by_parity_lose_no_link(spark):
    """Long lines about the threshold: brute force over their words."""
    words = [f"w{k}" for k in range(130)]
    lines = [" ".join(words[: 130 - i] + [f"x{i}-{k}" for k in range(i)]) for i in range(0, 40, 3)]
    sets = [set(x.split()) for x in lines]
    want = {j for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4}
    raw = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").selectExpr("doc_id", "doc_id uid", "text")
    assert 0 < len(want) < len(sets) and {r["uid"] for r in line_dedup.judge_lines(raw).collect()} == want


def test_line_families_of_shifted_prefixes_meet_their_first_line_only(spark, monkeypatch):
    """Lines of a family lack a word each and have none to three rare ones of their own, which moves the rest of the prefix."""
    made = {}

    def counted(self, df, tag):
        out = real(self, df, tag)
        made.setdefault(tag, []).append(out.count())
        return out

    real = line_dedup.Scratch.materialize
    monkeypatch.setattr(line_dedup.Scratch, "materialize", counted)
    lines = [" ".join([f"word{k}" for k in range(30) if k != i * 7 % 30] + [f"only{i}-{k}" for k in range(i % 4)]) for i in range(150)]
    raw = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").selectExpr("doc_id", "doc_id uid", "text")
    assert {r["uid"] for r in line_dedup.judge_lines(raw).collect()} == set(range(1, 150))
    assert made["line-pairs"][0] <= 15


@pytest.mark.parametrize("common", [1, 1 << 20])
def test_line_files(spark, common):
    """Under a rare token alone, else with each token after it; nothing else before the last of a key is shared where two sets first meet."""
    pre, own = [5, 7, 11, 13, 17], 4
    heads = spark.createDataFrame([(1, 15, pre)], "s long, n int, pre array<long>")
    got = {(r["key"], r["pos"]) for r in line_dedup._filed(heads, (4, 5), common).collect()}
    if common == 1:  # each is above it
        pairs = [(pre[i], pre[j], j - 1) for i in range(own) for j in range(i + 1, own + 1)]
        want = {(r["k"], r["p"]) for r in spark.createDataFrame(pairs, "t long, u long, p int").selectExpr("xxhash64(t, u) k", "p").collect()}
    else:
        want = {(t, i) for i, t in enumerate(pre[:own])}
    assert got == want


def test_line_order_from_a_sample_of_rows(spark, monkeypatch):
    """Words are counted over some rows only; nothing of the result depends on them."""
    lines = [" ".join(f"v{(i * 7 + k * k) % 50}" for k in range(4 + i % 9)) for i in range(300)]
    raw = spark.createDataFrame([(i, "\n".join(lines[i * 3 : i * 3 + 3])) for i in range(100)], "doc_id long, text string").selectExpr("doc_id", "doc_id uid", "text")
    seen, want = [], set()
    for i, x in enumerate(lines):
        s = set(x.split())
        if any(len(s & o) * 5 >= len(s | o) * 4 for o in seen):
            want.add((i // 3, i % 3))
        seen.append(s)
    monkeypatch.setattr(line_dedup, "COUNTED", 10)
    drawn = raw.where("pmod(xxhash64(uid), 10) = 0").count()
    assert 0 < drawn < 100 and 0 < len(want) < 300
    assert {(r["uid"], r["line"]) for r in line_dedup.judge_lines(raw, common=4).collect()} == want
