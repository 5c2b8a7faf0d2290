"""Queries for one exact step, loss or prediction of each learning algorithm, and short end-to-end trainings."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import vector as X
from quern.plans.registry import V, WSQL, query, r6, read, sql_weights, vectors, weight, weight_vector, written
from quern.plans.vectors import dense, dot_sql

K = 5
#: The first K vectors are the centres. K is fixed, so they are broadcast.
CENTERS = f"c AS (SELECT vec_id AS cid, x AS c FROM v WHERE vec_id < {K})"
DIST = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
ASSIGN = f"d AS (SELECT vec_id, x, cid, {DIST} AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY round({DIST}, 9), cid) AS k FROM v, c), a AS (SELECT vec_id, x, cid, dist FROM d WHERE k = 1)"


def assigned(spark, d):
    """Each vector with its nearest centre: every point meets the K broadcast centres, in one pass and without a shuffle."""
    v = vectors(spark, d, "embedding")
    c = v.where(F.col("vec_id") < K).agg(F.array_sort(F.collect_list(F.struct(F.col("vec_id").alias("cid"), F.col("x").alias("c")))).alias("cs"))
    # Both are doubles already, so a component costs one difference a centre.
    dist = lambda c: X.fsum(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)))
    scored = F.transform("cs", lambda s: F.struct(dist(s["c"]).alias("dist"), s["cid"].alias("cid")))
    # Ties are judged to nine digits, as the order of summation shows in the last ones.
    scored = F.transform(scored, lambda s: F.struct(F.round(s["dist"], 9).alias("near"), s["cid"].alias("cid"), s["dist"].alias("dist")))
    a = v.crossJoin(F.broadcast(c.where(F.size("cs") > 0))).select("vec_id", "x", "embedding", F.array_min(scored).alias("m"))
    # Never null, and said so: else a join on cid tests for nulls below, which takes every distance twice.
    return a.select("vec_id", "x", "embedding", F.coalesce("m.cid", F.lit(-1).cast("bigint")).alias("cid"), "m.dist")


@query(f"WITH {V}, {CENTERS}, {ASSIGN} SELECT vec_id, cid, round(dist, 6) + 0 AS dist FROM a")
def kmeans_assign(spark, d):
    return assigned(spark, d).select("vec_id", "cid", r6(F.col("dist")).alias("dist"))


@query(f"WITH {V}, {CENTERS}, {ASSIGN} SELECT round(sum(dist), 4) AS objective, count(*) AS n FROM a")
def kmeans_objective(spark, d):
    return assigned(spark, d).agg(r6(F.sum("dist"), 4).alias("objective"), F.count(F.lit(1)).alias("n"))


LAM = 10.0
MB = f"""{V}, {CENTERS}, {ASSIGN}, o AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY vec_id) AS j, count(*) OVER (PARTITION BY cid) AS n FROM a),
w AS (SELECT *, {LAM} / (j + {LAM}) * exp(coalesce(sum(ln(j / (j + {LAM}))) OVER (PARTITION BY cid ORDER BY j ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS w,
 exp(sum(ln(j / (j + {LAM}))) OVER (PARTITION BY cid)) AS old FROM o),
e AS (SELECT cid, j, w, old, unnest(range(64)) AS pos, unnest(x) AS y FROM w),
s AS (SELECT cid, pos, sum(w * y) AS moved, any_value(old) AS old, count(*) AS n FROM e GROUP BY ALL)"""


#: Ranges of ids in which the points of a cluster are numbered: tasks of a bounded share, however few the clusters.
RANGES = 128


def ranged(spark, d):
    """The assigned vectors and the range that holds their id; written once, as they are counted before they are weighed."""
    cuts = F.percentile_approx("vec_id", [i / RANGES for i in range(1, RANGES)], 100 * RANGES)
    bounds = sorted(set(read(spark, d, "embeddings").agg(cuts).first()[0] or []))
    part = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b < F.col("vec_id")))
    return written(assigned(spark, d).select("vec_id", "cid", "embedding", part.alias("part")), "clusters")


def moved_centers(spark, d):
    """The sequential update c <- (1 - eta) c + eta x in closed form: point j of n weighs eta_j prod_{i>j} i / (i + lambda).

    j is the number in the range and the cluster's count in the ranges before. As lambda is whole, the product over the later points leaves lambda factors.
    """
    a = ranged(spark, d)
    of = Window.partitionBy("cid")
    before = a.groupBy("part", "cid").agg(F.count(F.lit(1)).alias("m"))
    before = before.select("part", "cid", (F.sum("m").over(of.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(of).alias("n"))  # a row a range and cluster
    o = a.withColumn("r", F.row_number().over(Window.partitionBy("part", "cid").orderBy("vec_id")))
    o = o.join(F.broadcast(before), ["part", "cid"]).withColumn("j", F.col("before") + F.col("r"))
    shrink = lambda j: reduce(mul, [(j + k) / (F.col("n") + k) for k in range(1, int(LAM) + 1)])
    e = o.select("cid", "n", (LAM / (F.col("j") + LAM) * shrink(F.col("j"))).alias("w"), F.posexplode("embedding").alias("pos", "y"))
    s = e.groupBy("cid", "n", "pos").agg(F.sum(F.col("w") * F.col("y").cast("double")).alias("moved"))
    c = vectors(spark, d).where(F.col("vec_id") < K).select(F.col("vec_id").alias("cid"), F.posexplode("x").alias("pos", "old_center"))
    return s.join(c, ["cid", "pos"]).select("cid", F.col("pos").cast("bigint").alias("pos"), "n", (shrink(F.lit(0)) * F.col("old_center") + F.col("moved")).alias("center"))


@query(f"WITH {MB} SELECT s.cid, s.pos, round(s.old * c.c[s.pos + 1] + s.moved, 6) + 0 AS center FROM s JOIN c USING (cid)")
def kmeans_minibatch(spark, d):
    return moved_centers(spark, d).select("cid", "pos", r6(F.col("center")).alias("center"))


MERGE = f"""WITH {V}, {CENTERS}, {ASSIGN}, p AS (SELECT cid, vec_id % 4 AS worker, x FROM a), e AS (SELECT cid, worker, unnest(range(64)) AS pos, unnest(x) AS y FROM p),
l AS (SELECT cid, worker, pos, avg(y) - any_value(c.c[pos + 1]) AS delta, count(*) AS n FROM e JOIN c USING (cid) GROUP BY ALL)
SELECT cid, pos, round(any_value(c.c[pos + 1]) + sum(delta * n) / sum(n), 6) + 0 AS center FROM l JOIN c USING (cid) GROUP BY ALL"""


@query(MERGE)
def kmeans_merge(spark, d):
    """Moves of four workers (here to the mean of their points), joined by their shares of points."""
    p = assigned(spark, d).select("cid", (F.col("vec_id") % 4).alias("worker"), F.posexplode("x").alias("pos", "y"))
    local = p.groupBy("cid", "worker", "pos").agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n"))
    c = vectors(spark, d).where(F.col("vec_id") < K).select(F.col("vec_id").alias("cid"), F.posexplode("x").alias("pos", "c"))
    merged = local.join(c, ["cid", "pos"]).groupBy("cid", "pos", "c").agg((F.sum((F.col("mean") - F.col("c")) * F.col("n")) / F.sum("n")).alias("move"))
    return merged.select("cid", F.col("pos").cast("bigint").alias("pos"), r6(F.col("c") + F.col("move")).alias("center"))


@query()
def kmeans_e2e(spark, d):
    """Three clocks from the K nearest-by-hash points; the centres. No SQL: compared with numpy in the tests."""
    from quern.ml.models import KMeans

    p = read(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("features"))
    m = KMeans(K, learning_rate=LAM, seed=1).fit(p, 3)
    return spark.createDataFrame([(c, i, float(v)) for c, r in enumerate(m.centers) for i, v in enumerate(r)], "cid int, pos int, center double")


# -- logistic regression: label 1 against the others, from weights of row 1
W1 = sql_weights(1)
LR = f"""{V}, p AS (SELECT vec_id, x, CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END AS y, 1 / (1 + exp(-{dot_sql("x", W1)})) AS p FROM v)"""


def lr_rows(spark, d):
    v = vectors(spark, d)
    return v.select("vec_id", "x", F.when(F.col("label") == 1, 1.0).otherwise(0.0).alias("y"), X.sigmoid(X.dot("x", weight_vector(1))).alias("p"))


def gradient(rows, coefficient):
    """Sum over the rows of coefficient * x, by component: partial sums before the shuffle of 64 rows a task."""
    return rows.select(coefficient.alias("g"), F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.sum(F.col("g") * F.col("v")).alias("g")).select(F.col("pos").cast("bigint").alias("pos"), "g")


GRAD = f"WITH {LR}, e AS (SELECT p - y AS g, unnest(range(64)) AS pos, unnest(x) AS v FROM p), s AS (SELECT pos, sum(g * v) AS g FROM e GROUP BY pos)"


@query(f"{GRAD} SELECT pos, round(g, 6) + 0 AS grad FROM s")
def lr_batch_grad(spark, d):
    return gradient(lr_rows(spark, d), F.col("p") - F.col("y")).select("pos", r6(F.col("g")).alias("grad"))


@query(f"{GRAD} SELECT pos, round({WSQL.format(i=1, k='pos')} * (1 - 0.01 * 0.1) - 0.01 * g, 6) + 0 AS w FROM s")
def lr_l2_step(spark, d):
    w = weight(F.lit(1), F.col("pos"))
    return gradient(lr_rows(spark, d), F.col("p") - F.col("y")).select("pos", r6(w * (1 - 0.01 * 0.1) - 0.01 * F.col("g")).alias("w"))


@query(f"""WITH {LR} SELECT round(avg(CASE WHEN (CASE WHEN y = 1 THEN p ELSE 1 - p END) <= 0.5 THEN 1 ELSE 0 END), 6) AS zero_one,
round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) AS entropy, round(0.5 * 0.1 * {dot_sql(W1, W1)}, 6) AS l2, count(*) AS n FROM p""")
def lr_loss(spark, d):
    right = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    l2 = 0.5 * 0.1 * sum(weight(1, k) ** 2 for k in range(64))
    return lr_rows(spark, d).agg(
        r6(F.avg((right <= 0.5).cast("int"))).alias("zero_one"), r6(F.avg(-X.safe_log(right))).alias("entropy"), F.round(F.lit(l2), 6).alias("l2"), F.count(F.lit(1)).alias("n")
    )


# -- softmax regression on 10 labels
Z = f"list_transform(range(10), lambda i: {dot_sql('x', sql_weights('i'))})"
MLR = f"{V}, z AS (SELECT vec_id, label, x, {Z} AS z FROM v), q AS (SELECT vec_id, label, x, list_transform(z, lambda a: exp(a - list_max(z)) / list_sum(list_transform(z, lambda b: exp(b - list_max(z))))) AS q FROM z)"


def mlr_rows(spark, d):
    v = vectors(spark, d)
    scores = v.select("vec_id", "label", "x", F.array(*[X.dot("x", weight_vector(i)) for i in range(10)]).alias("z"))
    return scores.select("vec_id", "label", "x", X.softmax("z").alias("q"))


@query(f"""WITH {MLR}, e AS (SELECT label, q, unnest(range(64)) AS pos, unnest(x) AS v FROM q), f AS (SELECT label, pos, v, unnest(range(10)) AS lab, unnest(q) AS p FROM e)
SELECT lab, pos, round({WSQL.format(i='lab', k='pos')} - 0.01 * sum((p - CASE WHEN lab = label THEN 1 ELSE 0 END) * v), 6) + 0 AS w FROM f GROUP BY lab, pos""")
def mlr_batch_step(spark, d):
    """The outer product is summed by numpy in each task: 640 numbers a task are shuffled, and not 640 rows a sample."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    w = np.array([[weight(i, k) for k in range(64)] for i in range(10)])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros_like(w)
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy())
                z = x @ w.T
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(b)), b["label"].to_numpy(int)] -= 1
                g += p.T @ x
        lab, pos = np.indices(g.shape)
        yield pd.DataFrame({"lab": lab.ravel(), "pos": pos.ravel(), "g": g.ravel()})

    g = vectors(spark, d).select("label", "x").mapInPandas(part, "lab long, pos long, g double").groupBy("lab", "pos").agg(F.sum("g").alias("g"))
    return g.select("lab", "pos", r6(weight(F.col("lab"), F.col("pos")) - 0.01 * F.col("g")).alias("w"))


@query(f"""WITH {MLR}, r AS (SELECT label, q, list_position(q, list_max(q)) - 1 AS pred FROM q)
SELECT round(avg(CASE WHEN pred <> label THEN 1 ELSE 0 END), 6) AS zero_one, round(avg(-ln(q[label + 1])), 6) AS entropy, count(*) AS n FROM r""")
def mlr_eval(spark, d):
    q = mlr_rows(spark, d).select("label", "q", (F.array_position("q", F.array_max("q")) - 1).alias("pred"))
    return q.agg(r6(F.avg((F.col("pred") != F.col("label")).cast("int"))).alias("zero_one"), r6(F.avg(-X.safe_log(F.get("q", F.col("label"))))).alias("entropy"), F.count(F.lit(1)).alias("n"))


@query()
def softmax_fit_e2e(spark, d):
    """Three epochs of two mini-batches; the losses."""
    from quern.ml.models import SoftmaxRegression, train

    data = read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "label", F.col("embedding").alias("features"))
    return spark.createDataFrame(train(SoftmaxRegression(10, 64), data, 3, 2, 0.01).drop(columns=["time", "test_zero_one"]))


# -- random forest
@query("""WITH t AS (SELECT CASE WHEN l_quantity <= 25 THEN 1 ELSE 0 END AS side, l_returnflag AS lab, l_linestatus AS grp FROM lineitem),
n AS (SELECT grp, side, lab, count(*) AS n FROM t GROUP BY ALL),
h AS (SELECT grp, -sum(p * log2(p)) AS h FROM (SELECT grp, lab, sum(n) / sum(sum(n)) OVER (PARTITION BY grp) AS p FROM n GROUP BY grp, lab) GROUP BY grp),
s AS (SELECT grp, side, sum(n) AS m, -sum(p * log2(p)) AS hs FROM (SELECT grp, side, n, n / sum(n) OVER (PARTITION BY grp, side) AS p FROM n) GROUP BY grp, side),
w AS (SELECT grp, sum(m / tot * hs) AS after, -sum(m / tot * log2(m / tot)) AS split FROM (SELECT *, sum(m) OVER (PARTITION BY grp) AS tot FROM s) GROUP BY grp)
SELECT grp, round(CASE WHEN split = 0 THEN 0 ELSE (h - after) / split END, 6) + 0 AS gain_ratio FROM h JOIN w USING (grp)""")
def gain_ratio(spark, d):
    t = read(spark, d, "lineitem").select((F.col("l_quantity") <= 25).cast("int").alias("side"), F.col("l_returnflag").alias("lab"), F.col("l_linestatus").alias("grp"))
    n = t.groupBy("grp", "side", "lab").count()  # all that follows is on a few counts
    side = n.groupBy("grp", "side").agg(F.array_sort(F.collect_list("count")).alias("c"), F.sum("count").alias("m"))
    whole = n.groupBy("grp", "lab").agg(F.sum("count").alias("n")).groupBy("grp").agg(F.array_sort(F.collect_list("n")).alias("c"))
    split = side.groupBy("grp").agg((F.sum(F.col("m") * X.entropy("c")) / F.sum("m")).alias("after"), F.array_sort(F.collect_list("m")).alias("ms"))
    gain = whole.join(split, "grp").select("grp", (X.entropy("c") - F.col("after")).alias("gain"), X.entropy("ms").alias("split"))
    return gain.select("grp", r6(F.when(F.col("split") == 0, 0.0).otherwise(F.col("gain") / F.col("split"))).alias("gain_ratio"))


@query("SELECT l_quantity AS value, l_returnflag AS label, CAST(sum(l_linenumber) AS BIGINT) AS weight FROM lineitem GROUP BY ALL")
def split_entries_dedup(spark, d):
    t = read(spark, d, "lineitem")
    return t.groupBy(F.col("l_quantity").alias("value"), F.col("l_returnflag").alias("label")).agg(F.sum("l_linenumber").cast("bigint").alias("weight"))


@query("""SELECT grp, lab FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, lab) AS k FROM (SELECT l_linenumber AS grp, l_returnflag AS lab, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE k = 1""")
def majority_leaf(spark, d):
    n = read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("grp"), F.col("l_returnflag").alias("lab")).count()
    return n.groupBy("grp").agg(F.min(F.struct((-F.col("count")).alias("c"), "lab")).alias("m")).select("grp", "m.lab")


#: Three small trees over (quantity, discount, tax): pre-order lines.
TREES = ["0:25 1:0.05 -1:0 -1:1 2:0.04 -1:1 -1:2", "1:0.03 -1:2 0:10 -1:0 -1:1", "2:0.02 -1:1 1:0.07 -1:0 -1:2"]
TREE_SQL = """CASE WHEN l_quantity <= 25 THEN CASE WHEN l_discount <= 0.05 THEN 0 ELSE 1 END ELSE CASE WHEN l_tax <= 0.04 THEN 1 ELSE 2 END END AS t0,
CASE WHEN l_discount <= 0.03 THEN 2 ELSE CASE WHEN l_quantity <= 10 THEN 0 ELSE 1 END END AS t1,
CASE WHEN l_tax <= 0.02 THEN 1 ELSE CASE WHEN l_discount <= 0.07 THEN 0 ELSE 2 END END AS t2"""


def tree_column(line, features, at=1, nodes=None):
    """A saved tree as one conditional expression, inside whole-stage code."""
    from quern.sources.text import parse_tree

    nodes = nodes or {n[1]: n for n in parse_tree(line)}
    _, _, feature, split, leaf = nodes[at]
    if feature < 0:
        return F.lit(leaf)
    return F.when(features[feature] <= split, tree_column(line, features, 2 * at, nodes)).otherwise(tree_column(line, features, 2 * at + 1, nodes))


def predicted(spark, d):
    features = [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")]
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[tree_column(t, features).alias(f"t{i}") for i, t in enumerate(TREES)])


@query(f"SELECT t0 AS label, count(*) AS n FROM (SELECT {TREE_SQL} FROM lineitem) GROUP BY t0")
def forest_predict(spark, d):
    return predicted(spark, d).groupBy(F.col("t0").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, {TREE_SQL} FROM lineitem), v AS (SELECT l_orderkey, l_linenumber, list_transform(range(3), lambda l: CAST(t0 = l AS INT) + CAST(t1 = l AS INT) + CAST(t2 = l AS INT)) AS v FROM p)
SELECT l_orderkey, l_linenumber, list_position(v, list_max(v)) - 1 AS label FROM v""")
def forest_vote(spark, d):
    """Votes of all trees; ties go to the lowest label."""
    votes = F.array(*[sum((F.col(f"t{i}") == label).cast("int") for i in range(3)) for label in range(3)])
    v = predicted(spark, d).select("l_orderkey", "l_linenumber", votes.alias("v"))
    return v.select("l_orderkey", "l_linenumber", (F.array_position("v", F.array_max("v")) - 1).cast("int").alias("label"))


@query()
def forest_e2e(spark, d):
    """Ten trees of depth 4; predictions on all rows."""
    from quern.ml.models import predict_forest, train_forest

    data = read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "label", F.col("embedding").alias("features"))
    return predict_forest(data, train_forest(data, 10, 10, 60, 8, max_depth=4, seed=3), 10)


# -- factorisation of a 12-row matrix: columns are order dates' months, rows line numbers and flags
XM = "m AS (SELECT (l_linenumber - 1) AS i, month(l_shipdate) - 1 AS j, avg(l_quantity) / 10 AS x FROM lineitem GROUP BY ALL)"
RANK = 3


def cells(spark, d):
    t = read(spark, d, "lineitem")
    return t.groupBy((F.col("l_linenumber") - 1).alias("i"), (F.month("l_shipdate") - 1).alias("j")).agg((F.avg("l_quantity") / 10).alias("x"))


def factor(a, b, k=RANK):
    """Fixed positive start values of a factor."""
    return ((a * 5 + b * 3) % 7 + 1) / 10.0


FSQL = "((({a}) * 5 + ({b}) * 3) % 7 + 1) / 10.0"
RS, LS = FSQL.format(a="i", b="k"), FSQL.format(a="k", b="j")
NMF = f"""{XM}, k AS (SELECT unnest(range({RANK})) AS k), e AS (SELECT i, j, x - (SELECT sum({RS} * {LS}) FROM k) AS e FROM m),
l AS (SELECT k, j, least(greatest(any_value({LS}) + 2 * 0.01 * sum({RS} * e), 0), 1e5) AS l FROM e, k GROUP BY k, j),
f AS (SELECT m.i, m.j, any_value(x) - sum({FSQL.format(a='m.i', b='l.k')} * l.l) AS f FROM m JOIN l USING (j) GROUP BY m.i, m.j)"""


def start_error(c):
    return c.select("i", "j", "x", (F.col("x") - sum(factor(F.col("i"), F.lit(k)) * factor(F.lit(k), F.col("j")) for k in range(RANK))).alias("e"))


def nmf_left(c):
    """L after one clamped step: L_j += 2 eta R'(X_j - R L_j); grouped by column, k as parallel aggregates."""
    sums = [F.sum(factor(F.col("i"), F.lit(k)) * F.col("e")).alias(f"s{k}") for k in range(RANK)]
    g = start_error(c).groupBy("j").agg(*sums)
    return g.select("j", F.array(*[X.clamp(factor(F.lit(k), F.col("j")) + 2 * 0.01 * F.col(f"s{k}")) for k in range(RANK)]).alias("l"))


@query(f"""WITH {NMF}, n AS (SELECT count(DISTINCT j) AS n FROM m)
SELECT f.i, l.k, round(least(greatest(any_value({FSQL.format(a='f.i', b='l.k')}) + 2 * 0.01 * sum(f.f * l.l) / any_value(n.n), 0), 1e5), 6) AS r FROM f JOIN l USING (j), n GROUP BY f.i, l.k""")
def nmf_step(spark, d):
    """R after one clock."""
    c = cells(spark, d)
    left = nmf_left(c)
    f = c.join(left, "j").withColumn("f", F.col("x") - sum(factor(F.col("i"), F.lit(k)) * F.get("l", F.lit(k)) for k in range(RANK)))
    n = F.broadcast(c.agg(F.countDistinct("j").alias("n")))  # one row
    g = f.groupBy("i").agg(*[F.sum(F.col("f") * F.get("l", F.lit(k))).alias(f"g{k}") for k in range(RANK)]).crossJoin(n)
    r = g.select("i", F.array(*[X.clamp(factor(F.col("i"), F.lit(k)) + 2 * 0.01 * F.col(f"g{k}") / F.col("n")) for k in range(RANK)]).alias("r"))
    return r.select("i", F.posexplode("r").alias("k", "v")).select("i", F.col("k").cast("bigint").alias("k"), F.round("v", 6).alias("r"))


@query(f"WITH {NMF} SELECT round(sum(f * f) / count(DISTINCT j), 6) AS objective FROM f")
def nmf_objective(spark, d):
    c = cells(spark, d)
    f = c.join(nmf_left(c), "j").withColumn("f", F.col("x") - sum(factor(F.col("i"), F.lit(k)) * F.get("l", F.lit(k)) for k in range(RANK)))
    return f.agg(F.round(F.sum(F.col("f") * F.col("f")) / F.countDistinct("j"), 6).alias("objective"))


SC = f"""{XM}, k AS (SELECT unnest(range({RANK})) AS k), e AS (SELECT i, j, x - (SELECT sum({RS} * {LS}) FROM k) AS e FROM m),
g AS (SELECT k, j, any_value({LS}) + 2 * 0.01 * sum({RS} * e) AS s FROM e, k GROUP BY k, j), s AS (SELECT k, j, sign(s) * greatest(abs(s) - 0.01 * 0.5, 0) AS s FROM g),
f AS (SELECT m.i, m.j, any_value(x) - sum({FSQL.format(a='m.i', b='s.k')} * s.s) AS f FROM m JOIN s USING (j) GROUP BY m.i, m.j)"""


def sc_codes(c):
    sums = [F.sum(factor(F.col("i"), F.lit(k)) * F.col("e")).alias(f"s{k}") for k in range(RANK)]
    g = start_error(c).groupBy("j").agg(*sums)
    return g.select("j", F.array(*[X.soft_threshold(factor(F.lit(k), F.col("j")) + 2 * 0.01 * F.col(f"s{k}"), 0.01 * 0.5) for k in range(RANK)]).alias("l"))


@query(f"""WITH {SC}, n AS (SELECT count(DISTINCT j) AS n FROM m), b AS (SELECT f.i, s.k, any_value({FSQL.format(a='f.i', b='s.k')}) + 2 * 0.01 * sum(f.f * s.s) / any_value(n.n) AS b FROM f JOIN s USING (j), n GROUP BY f.i, s.k)
SELECT i, k, round(b * CASE WHEN sum(b * b) OVER (PARTITION BY k) > 0.5 THEN sqrt(0.5 / sum(b * b) OVER (PARTITION BY k)) ELSE 1 END, 6) + 0 AS b FROM b""")
def sc_step(spark, d):
    """The dictionary after one clock, each atom projected to squared norm 1/2 at most."""
    c = cells(spark, d)
    f = c.join(sc_codes(c), "j").withColumn("f", F.col("x") - sum(factor(F.col("i"), F.lit(k)) * F.get("l", F.lit(k)) for k in range(RANK)))
    n = F.broadcast(c.agg(F.countDistinct("j").alias("n")))  # one row
    g = f.groupBy("i").agg(*[F.sum(F.col("f") * F.get("l", F.lit(k))).alias(f"g{k}") for k in range(RANK)]).crossJoin(n)
    b = g.select("i", F.array(*[factor(F.col("i"), F.lit(k)) + 2 * 0.01 * F.col(f"g{k}") / F.col("n") for k in range(RANK)]).alias("b"))
    b = b.select("i", F.posexplode("b").alias("k", "b"))
    norm = F.sum(F.col("b") * F.col("b")).over(Window.partitionBy("k"))
    return b.select("i", F.col("k").cast("bigint").alias("k"), r6(F.col("b") * F.when(norm > 0.5, F.sqrt(0.5 / norm)).otherwise(1.0)).alias("b"))


@query(f"WITH {SC} SELECT round((SELECT sum(f * f) FROM f) + 0.5 * (SELECT sum(abs(s)) FROM s), 6) AS objective")
def sc_objective(spark, d):
    c = cells(spark, d)
    codes = sc_codes(c)
    f = c.join(codes, "j").withColumn("f", F.col("x") - sum(factor(F.col("i"), F.lit(k)) * F.get("l", F.lit(k)) for k in range(RANK)))
    fit = f.agg(F.sum(F.col("f") * F.col("f")).alias("a"))
    size = codes.agg(F.sum(X.fsum(F.transform("l", lambda v: F.abs(v)))).alias("b"))
    return fit.crossJoin(size).select(F.round(F.col("a") + 0.5 * F.col("b"), 6).alias("objective"))  # one row each


# -- metric learning: pairs (id, id + 1) and (id, id + 7), similar where the labels agree; L has 2 rows
PAIRS = f"""{V}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, list_transform(list_zip(a.x, b.x), lambda q: q[1] - q[2]) AS dx FROM v a JOIN v b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 7)),
q AS (SELECT *, list_transform(range(2), lambda i: {dot_sql('dx', sql_weights('i'))}) AS ld FROM p), z AS (SELECT *, ld[1] * ld[1] + ld[2] * ld[2] AS dist FROM q)"""


def pair_rows(spark, d):
    v = vectors(spark, d)
    a = v.select(F.col("vec_id").alias("a"), F.col("x").alias("xa"), F.col("label").alias("la"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 7)).alias("b"))
    p = a.join(v.select(F.col("vec_id").alias("b"), F.col("x").alias("xb"), F.col("label").alias("lb")), "b")
    p = p.select("a", "b", (F.col("la") == F.col("lb")).alias("alike"), X.subtract("xa", "xb").alias("x"))
    p = p.select("*", F.array(*[X.dot("x", weight_vector(i)) for i in range(2)]).alias("ld"))
    return p.select("*", X.sq_norm("ld").alias("dist"))


@query(f"WITH {PAIRS} SELECT a, b, alike, round(dist, 6) + 0 AS dist FROM z")
def dml_pair_distance(spark, d):
    return pair_rows(spark, d).select("a", "b", "alike", r6(F.col("dist")).alias("dist"))


@query(f"""WITH {PAIRS}, e AS (SELECT ld, CASE WHEN alike THEN 1 WHEN dist <= 0.02 THEN -1 ELSE 0 END AS w, unnest(range(64)) AS pos, unnest(dx) AS v FROM z),
f AS (SELECT pos, w, v, unnest(range(2)) AS i, unnest(ld) AS l FROM e) SELECT i, pos, round(sum(w * l * v), 6) + 0 AS grad FROM f GROUP BY i, pos""")
def dml_grad(spark, d):
    w = F.when(F.col("alike"), 1.0).when(F.col("dist") <= 0.02, -1.0).otherwise(0.0)
    p = pair_rows(spark, d).select(w.alias("w"), F.get("ld", F.lit(0)).alias("l0"), F.get("ld", F.lit(1)).alias("l1"), "x").where("w <> 0")
    g = p.select("w", "l0", "l1", F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.sum(F.col("w") * F.col("l0") * F.col("v")).alias("g0"), F.sum(F.col("w") * F.col("l1") * F.col("v")).alias("g1"))
    return g.select(F.col("pos").cast("bigint").alias("pos"), F.posexplode(F.array("g0", "g1")).alias("i", "g")).select(F.col("i").cast("bigint").alias("i"), "pos", r6(F.col("g")).alias("grad"))


@query(f"WITH {PAIRS} SELECT round(avg(dist) FILTER (alike) + 0.5 * avg(greatest(0.02 - dist, 0)) FILTER (NOT alike), 6) AS loss FROM z")
def dml_loss(spark, d):
    near, far = F.when(F.col("alike"), F.col("dist")), F.when(~F.col("alike"), F.greatest(0.02 - F.col("dist"), F.lit(0.0)))
    return pair_rows(spark, d).agg(r6(F.avg(near) + 0.5 * F.avg(far)).alias("loss"))


# -- perceptron 64-3-10
H = f"list_transform(range(3), lambda i: 1 / (1 + exp(-({dot_sql('x', sql_weights('i'))} + i / 10.0))))"
OUT = "list_transform(range(10), lambda o: list_sum(list_transform(range(3), lambda i: h[i + 1] * " + WSQL.format(i="o", k="i") + ")) + o / 20.0)"
MLP = f"{V}, h AS (SELECT vec_id, label, {H} AS h FROM v), z AS (SELECT *, {OUT} AS z FROM h), o AS (SELECT *, list_transform(z, lambda a: exp(a - list_max(z)) / list_sum(list_transform(z, lambda b: exp(b - list_max(z))))) AS o FROM z)"


def mlp_rows(spark, d):
    v = vectors(spark, d)
    hidden = F.array(*[X.sigmoid(X.dot("x", weight_vector(i)) + i / 10) for i in range(3)])
    out = lambda h: F.array(*[sum(F.get(h, F.lit(i)) * weight(o, i) for i in range(3)) + o / 20 for o in range(10)])
    # Bound once by the lambda: inlined, the hidden layer would be computed anew for each of its 30 uses.
    layers = F.transform(F.array(hidden), lambda h: F.struct(h.alias("h"), out(h).alias("z")))
    return v.select("vec_id", "label", F.explode(layers).alias("n")).select("vec_id", "label", "n.h", X.softmax("n.z").alias("o"))


@query(f"WITH {MLP}, e AS (SELECT vec_id, unnest(range(10)) AS pos, unnest(o) AS y FROM o) SELECT vec_id, pos, round(y, 6) AS value FROM e")
def mlp_forward(spark, d):
    return dense(mlp_rows(spark, d).select("vec_id", F.col("o").alias("x")))


@query(f"WITH {MLP}, e AS (SELECT label, h, unnest(range(10)) AS o, unnest(o) AS y FROM o), f AS (SELECT label, o, y, unnest(range(3)) AS i, unnest(h) AS h FROM e) SELECT o, i, round(sum((y - CASE WHEN o = label THEN 1 ELSE 0 END) * h), 5) + 0 AS grad FROM f GROUP BY o, i")
def mlp_backprop_last(spark, d):
    """Gradient of the last layer: its 30 sums are parallel aggregates of one pass."""
    m = mlp_rows(spark, d)
    delta = lambda o: F.get("o", F.lit(o)) - (F.col("label") == o).cast("double")
    sums = m.agg(*[F.sum(delta(o) * F.get("h", F.lit(i))).alias(f"g{o}_{i}") for o in range(10) for i in range(3)])
    rows = F.array(*[F.struct(F.lit(o).cast("bigint").alias("o"), F.lit(i).cast("bigint").alias("i"), r6(F.col(f"g{o}_{i}"), 5).alias("grad")) for o in range(10) for i in range(3)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


@query(f"WITH {MLP} SELECT vec_id, list_position(o, list_max(o)) - 1 AS prediction FROM o")
def mlp_predict(spark, d):
    return mlp_rows(spark, d).select("vec_id", (F.array_position("o", F.array_max("o")) - 1).cast("int").alias("prediction"))


@query()
def mlp_e2e(spark, d):
    """Two epochs of a 64-16-10 perceptron; the losses."""
    from quern.ml.models import Perceptron, train

    data = read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "label", F.col("embedding").alias("features"))
    return spark.createDataFrame(train(Perceptron([64, 16, 10], seed=2), data, 2, 2, 0.5).drop(columns=["time", "test_zero_one"]))


@query("SELECT o_orderkey, ntile(5) OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS label FROM orders")
def quantile_labels(spark, d):
    """Labels by equal-count quantiles of a score, without gathering the rows: range partitions, their counts, and a rank in each."""
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice").repartitionByRange("o_totalprice", "o_orderkey").select("*", F.spark_partition_id().alias("p"))
    o = written(o, "quantiles")  # the numbers of the partitions are met twice
    sizes = o.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"), F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))  # a row a partition
    r = o.join(F.broadcast(before), "p").withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("o_totalprice", "o_orderkey")) + F.col("before") - 1)
    q, m = F.floor(F.col("total") / 5), F.col("total") % 5
    label = F.when(F.col("r") < m * (q + 1), F.floor(F.col("r") / (q + 1))).otherwise(m + F.floor((F.col("r") - m * (q + 1)) / F.greatest(q, F.lit(1))))
    return r.select("o_orderkey", label.cast("bigint").alias("label"))


@query("SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS prior FROM embeddings GROUP BY label")
def class_prior(spark, d):
    from quern.ml.models import class_prior as prior

    return prior(read(spark, d, "embeddings")).select("label", "n", F.round("prior", 8).alias("prior"))
