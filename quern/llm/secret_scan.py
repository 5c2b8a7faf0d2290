"""Secret scan with a randomness test battery (DataFrame functions only).

Base kinds are pattern matches: ``assign``, ``access`` and ``hex``. The method adds
``random``: long tokens that look uniformly random in their inferred encoding.

Battery. A token of n characters takes the smallest alphabet that holds it (decimal,
hex, base32, lower-case and upper-case base36, base62, base64). Against the hypothesis
that its characters are independent and uniform, three tests are made: chi-squared
uniformity over the alphabet, runs above and below the alphabet's middle, and lag-one
serial correlation. Fisher's method joins the three p-values into one.

Length-aware false-discovery control. Random tokens have uniform p-values, others pile
up near 0, and how well they separate depends on the length. So in each (encoding,
length band) the corpus-wide p-values are binned; the bins above 1/2 estimate how many
tokens are random (Storey), and the lowest threshold is taken at which the estimated
share of non-random tokens among those reported, one more than estimated, stays within
``fdr``: so at any threshold few tokens prove nothing. Bands that reach no threshold alone are
judged together with the others of their encoding, and what is left then with that of
the other encodings. The table of bins has a fixed size whatever the corpus.

Defined results: a null text counts as empty and has no spans; positions count code
points, ends are exclusive; equal starts order as assign, access, hex, random; repeated
rows and ids are judged row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import free_name, materialize, table, text_or_empty

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_VALUE = 12
#: Same spans as the maximal runs with the shorter ones dropped.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "random"]
#: Shortest token that the battery judges; below it the tests have hardly any power.
TOKEN_LENGTH = 20
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}"

#: Encodings from the smallest alphabet up, with pattern and characters in order.
ENCODINGS = [
    ("decimal", "^[0-9]+$", "0123456789"),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]
BINS = 64


def _spans(gaps: Column, hits: Column) -> Column:
    """array<struct<s,e>> of each hit, from the stretches between hits and the hits themselves."""
    start = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("out"))

    def step(acc, x):
        s = acc["pos"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _with_spans(df: DataFrame, text: str, hits: str, pattern: str, out: str) -> DataFrame:
    found = F.size(hits) > 0
    gaps = F.split(F.col(text), pattern, -1)
    empty = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    return df.withColumn(out, F.when(found, _spans(gaps, F.col(hits))).otherwise(empty))


def _alphabet(token: Column) -> tuple[Column, Column]:
    name, chars = None, None
    for kind, pattern, alphabet in reversed(ENCODINGS):
        fits = token.rlike(pattern)
        name = F.lit(kind) if name is None else F.when(fits, F.lit(kind)).otherwise(name)
        chars = F.lit(alphabet) if chars is None else F.when(fits, F.lit(alphabet)).otherwise(chars)
    return name, chars


def _phi(z: Column) -> Column:
    """Standard normal distribution function, to 2e-4, by a logistic curve."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070566 * z * z * z)))


def battery(token: Column) -> Column:
    """struct<encoding, n, p>: the inferred encoding, the length and the p-value of uniform randomness.

    Computed for tokens of two or more characters; url-safe and standard base64 are one encoding, padding is ignored.
    """
    encoding, alphabet = _alphabet(token)
    body = F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")
    folded = F.when(encoding.isin("hex", "base36"), F.lower(body)).otherwise(body)
    base = F.struct(encoding.alias("encoding"), alphabet.alias("alphabet"), folded.alias("body"))

    def measure(b: Column) -> Column:
        k = F.length(b["alphabet"]).cast("double")
        chars = F.filter(F.split(b["body"], ""), lambda c: c != "")
        index = F.transform(chars, lambda c: F.call_function("instr", b["alphabet"], c) - 1)
        squares = F.aggregate(
            F.array_distinct(chars),
            F.lit(0.0),
            lambda acc, c: acc + F.pow((F.length(b["body"]) - F.length(F.replace(b["body"], c, F.lit("")))).cast("double"), F.lit(2)),
        )
        return F.struct(
            b["encoding"].alias("encoding"), k.alias("k"), F.length(b["body"]).cast("double").alias("n"), index.alias("x"), squares.alias("squares")
        )

    def tests(m: Column) -> Column:
        n, k = m["n"], m["k"]
        chi = (m["squares"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        pairs = F.zip_with(F.slice(m["x"], F.lit(1), F.size(m["x"]) - 1), F.slice(m["x"], F.lit(2), F.size(m["x"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = F.aggregate(pairs, F.lit(1.0), lambda acc, p: acc + F.when((p["a"] * 2 < k) != (p["b"] * 2 < k), 1.0).otherwise(0.0))
        mean = (k - 1) / 2
        serial = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["a"] - mean) * (p["b"] - mean)) / ((k * k - 1) / 12)
        return F.struct(
            m["encoding"].alias("encoding"),
            n.alias("n"),
            (1 - _phi(chi)).alias("p1"),
            (2 * (1 - _phi(F.abs(runs - (n + 1) / 2) / F.sqrt((n - 1) / 4)))).alias("p2"),
            (2 * (1 - _phi(F.abs(serial) / F.sqrt(n - 1)))).alias("p3"),
        )

    def fisher(t: Column) -> Column:
        half = -sum((F.log(F.greatest(t[p], F.lit(1e-12))) for p in ("p1", "p2", "p3")), F.lit(0.0))
        p = F.exp(-half) * (1 + half + half * half / 2)
        return F.struct(t["encoding"].alias("encoding"), t["n"].cast("int").alias("n"), F.when(t["n"] >= 2, p).otherwise(F.lit(0.0)).alias("p"))

    # Each step binds its input once, so that nothing is computed twice.
    out = F.transform(F.array(base), measure)
    out = F.transform(out, tests)
    return F.transform(out, fisher)[0]


def band(n: Column) -> Column:
    """Length band: each spans a factor of about 1.4; all above 640 are one."""
    return F.least(F.floor(F.log2(n / float(TOKEN_LENGTH)) * 2), F.lit(10)).cast("int")


def scan_texts(df: DataFrame, text_col: str = "text", token_length: int = TOKEN_LENGTH) -> DataFrame:
    """``df`` with two more columns: spans array<struct<s,k,e>> of the base kinds in order, and
    tokens array<struct<s,e,encoding,n,p>>. No shuffle."""
    text, a0, a2, c0, x0, t0 = (free_name(df, f"scan_{x}") for x in ("text", "assign", "value", "access", "hex", "token"))
    token = TOKEN % token_length
    columns = [F.col(f"`{c}`") for c in df.columns]
    out = df.withColumn(text, text_or_empty(F.col(f"`{text_col}`")))
    out = out.withColumns({n: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for n, p in ((a0, ASSIGN), (c0, ACCESS), (x0, HEX), (t0, token))})
    out = out.withColumn(a2, F.when(F.size(a0) > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).otherwise(F.expr("cast(array() as array<string>)")))
    for hits, pattern in ((a0, ASSIGN), (c0, ACCESS), (x0, HEX), (t0, token)):
        out = _with_spans(out, text, hits, pattern, f"{hits}_at")

    def kind(spans, order):
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e")))

    valued = F.filter(F.zip_with(f"{a0}_at", a2, lambda x, v: F.struct(x["s"].alias("s"), x["e"].alias("e"), v.alias("v"))), lambda x: F.length(x["v"]) >= ASSIGN_VALUE)
    base = F.array_sort(F.concat(kind(valued, 0), kind(F.col(f"{c0}_at"), 1), kind(F.col(f"{x0}_at"), 2)))
    judged = F.zip_with(
        f"{t0}_at", t0, lambda x, t: F.struct(x["s"].alias("s"), x["e"].alias("e"), battery(t).alias("b"))
    )
    tokens = F.transform(judged, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["b"]["encoding"].alias("encoding"), x["b"]["n"].alias("n"), x["b"]["p"].alias("p")))
    nothing = F.expr("cast(array() as array<struct<s:int,e:int,encoding:string,n:int,p:double>>)")
    spans_name, tokens_name = free_name(df, "spans"), free_name(df, "tokens")
    return out.select(*columns, base.alias(spans_name), F.when(F.size(t0) > 0, tokens).otherwise(nothing).alias(tokens_name))


def _lowest(bins: list[int], fdr: float) -> float | None:
    """The lowest threshold at which the non-random tokens reported, and one more, stay within ``fdr``."""
    random = 2 * sum(bins[BINS // 2 :])
    for i in range(BINS):
        reported = sum(bins[i:])
        false = max(0.0, reported - random * (BINS - i) / BINS) + 1
        if false <= fdr * reported:
            return i / BINS
    return None


def thresholds(scanned: DataFrame, tokens_col: str = "tokens", fdr: float = 0.05) -> dict[tuple[str, int], float]:
    """Lowest accepted p-value for each (encoding, length band) of all tokens; bounded, one row per bin."""
    t = scanned.select(F.explode(F.col(tokens_col)).alias("t")).select("t.encoding", band(F.col("t.n")).alias("band"), F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts: dict[tuple[str, int], list[int]] = {}
    for r in t.groupBy("encoding", "band", "bin").count().collect():
        counts.setdefault((r["encoding"], r["band"]), [0] * BINS)[r["bin"]] = r["count"]
    out: dict[tuple[str, int], float] = {}
    for pool in (lambda key: key, lambda key: key[0], lambda key: None):
        groups: dict = {}
        for key in counts:
            if key not in out:
                groups.setdefault(pool(key), []).append(key)
        for keys in groups.values():
            limit = _lowest([sum(n) for n in zip(*(counts[key] for key in keys))], fdr)
            if limit is not None:
                out |= dict.fromkeys(keys, limit)
    return out


def add_random_spans(scanned: DataFrame, limits: dict[tuple[str, int], float], spans_col: str = "spans", tokens_col: str = "tokens") -> DataFrame:
    """``scanned`` with the tokens above their threshold joined to the spans as kind ``random``; tokens go."""
    keys = [F.lit(f"{e}:{b}") for e, b in limits]
    bounds = F.map_from_arrays(F.array(*keys), F.array(*[F.lit(float(v)) for v in limits.values()])) if limits else None

    def reported(x):
        # An absent bound is null, which filter() takes as false.
        return x["p"] >= bounds[F.concat_ws(":", x["encoding"], band(x["n"]).cast("string"))]

    found = F.filter(F.col(tokens_col), reported) if limits else F.slice(F.col(tokens_col), 1, 0)
    random = F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e")))
    every = F.when(F.size(tokens_col) > 0, F.array_sort(F.concat(F.col(spans_col), random))).otherwise(F.col(spans_col))
    return scanned.withColumn(spans_col, every).drop(tokens_col)


def span_string(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span replaced by ``mark``; overlapping spans are one."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc, x):
        before = F.substring(text, acc["pos"] + 1, x["s"] - acc["pos"])
        return F.when(
            x["s"] >= acc["pos"], F.struct(x["e"].alias("pos"), F.concat(acc["out"], before, F.lit(mark)).alias("out"))
        ).otherwise(F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), acc["out"].alias("out")))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_documents(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", fdr: float = 0.05) -> DataFrame:
    """Every row, its secrets replaced in the text and its character count, if any, renewed for changed texts."""
    slim = scan_texts(df.select(F.col(f"`{text_col}`").alias("text")))
    limits = thresholds(slim, "tokens", fdr)
    spans, tokens = free_name(df, "spans"), free_name(df, "tokens")
    out = add_random_spans(scan_texts(df, text_col), limits, spans, tokens)
    out = out.withColumn(text_col, redact(F.col(f"`{text_col}`"), F.col(spans)))
    if chars_col and chars_col in df.columns:
        count = F.length(F.col(f"`{text_col}`")).cast(df.schema[chars_col].dataType)
        out = out.withColumn(chars_col, F.when(F.size(spans) > 0, count).otherwise(F.col(f"`{chars_col}`")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05) -> DataFrame:
    """doc_id and all spans of each row, as array<struct<s,k,e>>."""
    slim = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    scanned = materialize(scan_texts(slim).drop("text"), "secrets")
    return add_random_spans(scanned, thresholds(scanned, "tokens", fdr))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["k"] < 3)
    kinds = F.transform("spans", lambda x: x["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint") for k in range(3)]
    counts = [c.alias(f"n_{KINDS[k]}") for k, c in enumerate(counts)]
    return found.select("doc_id", *counts, F.sha2(span_string(base).cast("binary"), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"))
