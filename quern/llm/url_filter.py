"""URL filter: host and path rules first, then a ratio of character language models.

Urls that a rule decides are the examples: one smoothed variable-order Markov model is
fitted to the accepted and one to the rejected. Each interpolates orders 0 to ``order``
by Witten-Bell: the weight of a context's own counts grows with how often it was seen
against how many characters followed it, so rare contexts lean on shorter ones. The score
of a url is the difference of its two log-likelihoods, the end of the url included,
divided by its number of characters. The cut between the verdicts is calibrated on a
fifth of the examples, held out of the models: it is the one of least balanced error.

The models are fitted on every url that a rule decides, each counted as often as it
occurs, and the cut on all that are held out. Their grams are a table: counted by
aggregates, smoothed order by order by joins on the next shorter gram, and joined to the
grams of the urls to be judged, so nothing of the corpus is held in one place. ``examples``
bounds the urls of each class for a caller who wants less; the query does not. Every url
is judged.

Defined results: a null url or one without ``://`` has empty host and path and no rule;
it is judged as its own text (null: empty). Where either class has no examples the
verdict is ``allow``. Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import LOWER, UPPER, Scratch, materialize, table

#: Verdict, host, path prefix; the longest fitting rule wins.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_FOLD = str.maketrans(UPPER, LOWER)
END = "\n"
ALPHABET = 256


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as ``host/path``, and its verdict; null where none fits."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    return rule, verdict


class MarkovModel:
    """Witten-Bell interpolated character model of orders 0 to ``order``."""

    def __init__(self, order: int = 5):
        self.order = order
        self.counts: list[dict[str, dict[str, int]]] = [defaultdict(dict) for _ in range(order + 1)]
        self.probability: dict[str, float] = {}  # seen context + character, the context of full order where it can be
        self.escape: dict[str, float] = {}  # weight that a seen context leaves to the shorter one

    def fit(self, urls) -> MarkovModel:
        """``urls``: a list, or a dict of urls and how often they occur."""
        for url, times in Counter(urls).items():
            s = url + END
            for i, c in enumerate(s):
                for k in range(min(i, self.order) + 1):
                    follows = self.counts[k][s[i - k : i]]
                    follows[c] = follows.get(c, 0) + times
        for k, contexts in enumerate(self.counts):
            for context, follows in contexts.items():
                total, kinds = sum(follows.values()), len(follows)
                self.escape[context] = kinds / (total + kinds)
                for c, n in follows.items():
                    shorter = self.probability[context[1:] + c] if k else 1 / ALPHABET
                    self.probability[context + c] = (n + kinds * shorter) / (total + kinds)
        self.counts = []
        return self

    def log_likelihood(self, url: str) -> float:
        s, out = url + END, 0.0
        probability, escape, order = self.probability, self.escape, self.order
        for i in range(len(s)):
            gram, weight = s[max(0, i - order) : i + 1], 1.0
            while gram not in probability:
                weight *= escape.get(gram[:-1], 1.0)
                gram = gram[1:]
                if not gram:
                    break
            out += math.log(weight * (probability[gram] if gram else 1 / ALPHABET))
        return out


class UrlRatio:
    """Both models and the calibrated cut."""

    def __init__(self, accepted: list[str] | dict[str, int], rejected: list[str] | dict[str, int], order: int = 5):
        self.known = bool(accepted and rejected)
        self.cut = 0.0
        if not self.known:
            return
        held = lambda u: zlib.crc32(b"fold:" + u.encode()) % 5 == 0
        fit = lambda urls: MarkovModel(order).fit({u: n for u, n in urls.items() if not held(u)} or urls)
        accepted, rejected = Counter(accepted), Counter(rejected)
        self.accepted, self.rejected = fit(accepted), fit(rejected)
        good = sorted((self.score(u), n) for u, n in accepted.items() if held(u))
        bad = sorted((self.score(u), n) for u, n in rejected.items() if held(u))
        if good and bad:
            self.cut = self._least_error(good, bad)

    @staticmethod
    def _least_error(good: list[tuple[float, int]], bad: list[tuple[float, int]]) -> float:
        """Midpoint cut with the least sum of both classes' error rates; ties go to the one nearest 0.

        Of each class scores and how often they occur. A cut lies between different scores.
        """
        steps: dict[float, list[int]] = {}
        for which, scores in enumerate((good, bad)):
            for s, n in scores:
                steps.setdefault(s, [0, 0])[which] += n
        points, (goods, bads) = sorted(steps), (sum(n for _, n in x) for x in (good, bad))
        best, missed, wrong = None, 0, bads
        for i in range(len(points) + 1):
            at = points[0] - 1e-9 if i == 0 else points[-1] + 1e-9 if i == len(points) else (points[i - 1] + points[i]) / 2
            key = (missed / goods + wrong / bads, abs(at))
            best = min(best, (key, at)) if best else (key, at)
            if i < len(points):
                missed += steps[points[i]][0]
                wrong -= steps[points[i]][1]
        return best[1]

    def score(self, url: str) -> float:
        return (self.accepted.log_likelihood(url) - self.rejected.log_likelihood(url)) / (len(url) + 1)

    def verdict(self, url: str) -> str:
        return "allow" if not self.known or self.score(url) >= self.cut else "block"


def model_text(url: str | None) -> str:
    """What the models read: the url without its scheme, A-Z lower-cased."""
    url = url or ""
    return (url.partition("://")[2] if "://" in url else url).translate(_FOLD)


def _drawn(ruled: DataFrame, examples: int) -> dict[str, Counter]:
    """By class, the model texts of the ``examples`` different urls of least hash, and how often they occur."""
    h = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(1 << 40))
    urls = ruled.select("url", "decided", h.alias("h"), F.shiftright(h, 24).cast("int").alias("bucket"))
    sizes = defaultdict(dict)
    for r in urls.where("decided is not null").distinct().groupBy("decided", "bucket").count().collect():  # bounded: 65536 buckets of each class
        sizes[r["decided"]][r["bucket"]] = r["count"]
    # The first buckets that hold enough urls; they are read, put in order and cut to the bound.
    last = {kind: next((b for b, n in zip(sorted(of), accumulate(of[b] for b in sorted(of))) if n >= examples), max(of)) for kind, of in sizes.items()}
    picked = {"allow": Counter(), "block": Counter()}
    if not last:
        return picked
    bound = F.create_map(*[F.lit(x) for of in last.items() for x in of])
    drawn = defaultdict(list)
    for r in urls.where(F.col("bucket") <= bound[F.col("decided")]).groupBy("decided", "h", "url").count().collect():
        drawn[r["decided"]].append((r["h"], r["url"], r["count"]))
    for kind, some in drawn.items():
        for _, url, n in sorted(some)[:examples]:
            picked[kind][model_text(url)] += n
    return picked


def fit_ratio(ruled: DataFrame, examples: int, order: int = 5) -> UrlRatio:
    """The ratio in memory, of a bounded number of urls. ``ruled``: url and decided ("allow", "block" or null)."""
    picked = _drawn(ruled, examples)
    return UrlRatio(picked["allow"], picked["block"], order)


def model_text_of(url: Column) -> Column:
    """model_text() as an expression."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    return F.translate(F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(u), UPPER, LOWER)


def _grams(texts: DataFrame, order: int, *keep: str) -> DataFrame:
    """``keep``, i, gram: each character of the texts and of their end, with up to ``order`` before it."""
    chars = F.split(F.concat("text", F.lit(END)), "")
    # The characters beside those one, two, ... places before them, so that no text is walked once a place.
    beside = F.arrays_zip(*[F.concat(F.array_repeat(F.lit(""), k), chars).alias(f"c{k}") for k in range(order + 1)])
    placed = texts.select(*keep, F.posexplode(beside).alias("i", "g")).where("g.c0 is not null")
    return placed.select(*keep, "i", F.concat(*[F.col(f"g.c{k}") for k in range(order, -1, -1)]).alias("gram"))


def _smoothed(texts: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """gram, pa, pb: the probabilities in either model of the last character of each gram of ``wanted`` texts.

    ``texts``: text, wanted, a and b (how often it counts as accepted and as rejected).
    """
    sums = F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("wanted").alias("wanted")
    longest = _grams(texts, order, "a", "b", "wanted").groupBy("gram").agg(*sums)
    ends = F.transform(F.sequence(F.lit(1), F.length("gram")), lambda k: F.right("gram", k))
    counts = longest.select(F.explode(ends).alias("gram"), "a", "b", "wanted").groupBy("gram").agg(*sums)
    n = F.length("gram")
    # Of a context: its occurrences and the kinds of characters after it. A group has a row for each of them.
    context = Window.partitionBy(F.substring("gram", F.lit(1), n - 1))
    seen = {f"{t}{x}": F.sum(F.col(x) if t == "t" else (F.col(x) > 0).cast("long")).over(context) for x in ("a", "b") for t in ("t", "k")}
    counts = scratch.materialize(counts.withColumns(seen).where("wanted").withColumn("n", n).drop("wanted"), "url-grams")

    def smooth(x: str, shorter: Column) -> Column:
        total, kinds = F.col(f"t{x}"), F.col(f"k{x}")
        return F.when(kinds > 0, (F.col(x) + kinds * shorter) / (total + kinds)).otherwise(shorter).alias(f"p{x}")

    none = F.lit(1 / ALPHABET)
    levels = [scratch.materialize(counts.where("n = 1").select("gram", smooth("a", none), smooth("b", none)), "url-model")]
    for k in range(2, order + 2):
        shorter = levels[-1].select(F.col("gram").alias("s"), F.col("pa").alias("sa"), F.col("pb").alias("sb"))
        met = counts.where(F.col("n") == k).join(shorter, F.substring("gram", F.lit(2), n) == F.col("s"))
        levels.append(scratch.materialize(met.select("gram", smooth("a", F.col("sa")), smooth("b", F.col("sb"))), "url-model"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def _scores(texts: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """u, score: of the ``wanted`` texts, summed in the order of their characters."""
    placed = _grams(texts.where("wanted"), order, "uid")
    model = model.select(F.col("gram").alias("m"), (F.ln("pa") - F.ln("pb")).alias("d"))
    met = placed.join(model, F.col("gram") == F.col("m")).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("i", "d"))).alias("ds"))  # a url's own characters
    return met.select(F.col("uid").alias("u"), (F.aggregate("ds", F.lit(0.0), lambda acc, x: acc + x["d"]) / F.size("ds")).alias("score"))


def _cut_of(held: DataFrame, scratch: Scratch) -> float:
    """UrlRatio._least_error() over a table of scores: score, a and b (how often it is accepted and rejected). 0 where a class has none."""
    points = held.groupBy("score").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).repartitionByRange("score")
    points = scratch.materialize(points.withColumn("part", F.spark_partition_id()), "url-cuts")
    parts = points.groupBy("part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("score").alias("least"), F.max("score").alias("most")).orderBy("part").collect()  # one a partition
    goods, bads = sum(r["a"] for r in parts), sum(r["b"] for r in parts)
    if not goods or not bads:
        return 0.0
    before, rows = [0, 0], []
    for r, after in zip(parts, [*parts[1:], None]):
        rows.append((r["part"], *before, after["least"] if after else None))
        before = [before[0] + r["a"], before[1] + r["b"]]
    known = held.sparkSession.createDataFrame(rows, "p int, a0 long, b0 long, following double")
    within = Window.partitionBy("part").orderBy("score")
    steps = points.join(F.broadcast(known), F.col("part") == F.col("p")).select(
        "score", (F.sum("a").over(within) + F.col("a0")).alias("missed"), (F.lit(bads) - F.sum("b").over(within) - F.col("b0")).alias("wrong"),
        F.coalesce(F.lead("score").over(within), "following").alias("above"),
    )
    at = F.when(F.col("above").isNull(), F.col("score") + 1e-9).otherwise((F.col("score") + F.col("above")) / 2)
    best = steps.withColumn("at", at).agg(F.min(F.struct((F.col("missed") / goods + F.col("wrong") / bads).alias("error"), F.abs("at").alias("far"), "at")).alias("x")).first()["x"]
    least = parts[0]["least"] - 1e-9
    return min(((best["error"], best["far"]), best["at"]), ((1.0, abs(least)), least))[1]


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, examples: int | None = None, order: int = 5) -> DataFrame:
    """One row per row of ``df``: id, host, path, rule, verdict, score (null where a rule decided).

    ``examples``: of each class the models are fitted on so many different urls at most; unset on all.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    slim = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    parsed = slim.withColumns({"host": host, "path": path})
    rule, decided = match_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "decided": decided})

    rows = ruled.select(model_text_of(F.col("url")).alias("text"), *[F.coalesce(F.col("decided") == k, F.lit(False)).cast("long").alias(x) for x, k in (("a", "allow"), ("b", "block"))], F.col("decided").isNull().alias("unruled"))
    if examples is not None:
        some = _drawn(ruled, examples)
        few = [(t, some["allow"][t], some["block"][t], False) for t in {**some["allow"], **some["block"]}]  # bounded by ``examples``
        rows = rows.where("unruled").unionByName(spark.createDataFrame(few, "text string, a long, b long, unruled boolean"))
    held = F.crc32(F.concat(F.lit("fold:"), "text").cast("binary")) % 5 == 0
    texts = rows.groupBy("text").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("unruled").alias("unruled"))
    texts = scratch.materialize(texts.select("*", held.alias("held"), F.monotonically_increasing_id().alias("uid")), "urls")
    has = texts.agg(*[F.max(F.col(x) > 0).alias(x) for x in ("a", "b")], *[F.max((F.col(x) > 0) & ~F.col("held")).alias(f"fit_{x}") for x in ("a", "b")]).first()
    if not has["a"] or not has["b"]:
        scratch.clear()
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("decided", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    # A class of which all is held out is fitted on all.
    fit = {x: F.when(F.col("held"), F.lit(0)).otherwise(F.col(x)).cast("long") if has[f"fit_{x}"] else F.col(x) for x in ("a", "b")}
    wanted = F.col("unruled") | (F.col("held") & (F.col("a") + F.col("b") > 0))
    used = texts.withColumn("wanted", wanted)
    scored = scratch.materialize(_scores(used, _smoothed(used.withColumns(fit), order, scratch), order), "url-scores")
    cut = _cut_of(texts.where("held and a + b > 0").join(scored, F.col("uid") == F.col("u")).select("score", "a", "b"), scratch)
    judged = texts.where("unruled").join(scored, F.col("uid") == F.col("u")).select(F.col("text").alias("t"), "score", (F.col("score") >= cut).alias("good"))
    judged = materialize(judged, "url-verdicts")
    scratch.clear()
    met = ruled.where("decided is null").withColumn("text", model_text_of(F.col("url"))).join(judged, F.col("text") == F.col("t"))
    out = met.select("page_id", "host", "path", "rule", F.when(F.col("good"), "allow").otherwise("block").alias("verdict"), "score")
    return ruled.where("decided is not null").select("page_id", "host", "path", "rule", F.col("decided").alias("verdict"), F.lit(None).cast("double").alias("score")).unionByName(out)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
