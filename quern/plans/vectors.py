"""Queries over vectors: scalar functions, products, distances, projections and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import vector as X
from quern.plans.registry import V, query, r6, read, sql_weights, updates, vectors, weight_vector

#: list_sum of products, in DuckDB
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def dot_sql(a: str, b: str) -> str:
    return DOT.format(a=a, b=b)


def dense(df, name="x", key="vec_id"):
    """One row a component."""
    return df.select(key, F.posexplode(name).alias("pos", "y")).select(key, F.col("pos").cast("bigint").alias("pos"), r6(F.col("y")).alias("value"))


def unnest_sql(body: str, expr: str) -> str:
    return f"WITH {V}, t AS ({body}), e AS (SELECT vec_id, unnest(range(len(y))) AS pos, unnest(y) AS y FROM t) SELECT vec_id, pos, round({expr}, 6) + 0 AS value FROM e"


@query("SELECT event_id, round(ln(CASE WHEN abs(value - 10) < 1e-15 THEN 1e-15 ELSE abs(value - 10) END), 6) + 0 AS value FROM events")
def safe_log(spark, d):
    return read(spark, d, "events").select("event_id", r6(X.safe_log(F.abs(F.col("value") - 10))).alias("value"))


@query("SELECT event_id, round(1 / (1 + exp(-(value - 20) / 10)), 6) + 0 AS value FROM events")
def sigmoid(spark, d):
    return read(spark, d, "events").select("event_id", r6(X.sigmoid((F.col("value") - 20) / 10)).alias("value"))


@query("SELECT event_id, round(greatest(value, 30.0) + ln(1 + exp(-abs(value - 30.0))), 6) + 0 AS value FROM events")
def log_sum(spark, d):
    return read(spark, d, "events").select("event_id", r6(X.log_sum("value", F.lit(30.0))).alias("value"))


@query(f"WITH {V} SELECT vec_id, round(list_max(x) + ln(list_sum(list_transform(x, lambda a: exp(a - list_max(x))))), 6) + 0 AS value FROM v")
def logsumexp(spark, d):
    return vectors(spark, d).select("vec_id", r6(X.logsumexp("x")).alias("value"))


@query(unnest_sql("SELECT vec_id, list_transform(x, lambda a: exp(a - list_max(x)) / list_sum(list_transform(x, lambda b: exp(b - list_max(x))))) AS y FROM v", "y"))
def softmax(spark, d):
    return dense(vectors(spark, d).select("vec_id", X.softmax("x").alias("x")))


@query(f"WITH {V} SELECT vec_id, round({dot_sql('x', sql_weights(1))}, 6) + 0 AS value FROM v")
def dot_dense(spark, d):
    return vectors(spark, d).select("vec_id", r6(X.dot("x", weight_vector(1))).alias("value"))


@query(f"WITH {V} SELECT vec_id, round(x[1] * 1 + x[11] * 2 + x[41] * -3, 6) + 0 AS value FROM v")
def dot_sparse_dense(spark, d):
    ids, vals = F.array(*map(F.lit, (0, 10, 40))), F.array(*map(F.lit, (1.0, 2.0, -3.0)))
    return vectors(spark, d).select("vec_id", r6(X.sparse_dot_dense(ids, vals, "x")).alias("value"))


SPARSE = "s AS (SELECT vec_id, i, x[i + 1] AS a FROM v, (SELECT unnest(range(64)) AS i) WHERE (vec_id + i) % 5 = 0)"


@query(f"WITH {V}, {SPARSE} SELECT p.vec_id AS a, q.vec_id AS b, round(sum(p.a * q.a), 6) + 0 AS value FROM s p JOIN s q ON p.i = q.i AND q.vec_id = p.vec_id + 5 GROUP BY ALL")
def dot_sparse_sparse(spark, d):
    s = vectors(spark, d).select("vec_id", F.posexplode("x").alias("i", "v")).where("(vec_id + i) % 5 = 0")
    a, b = s.select(F.col("vec_id").alias("a"), "i", F.col("v").alias("x")), s.select(F.col("vec_id").alias("b"), "i", F.col("v").alias("y"))
    # Both ids are join keys: every pair of vectors meets in one task, and no id is hot.
    both = a.withColumn("b", F.col("a") + 5).join(b, ["b", "i"])
    return both.groupBy("a", "b").agg(r6(F.sum(F.col("x") * F.col("y"))).alias("value"))


@query(unnest_sql(f"SELECT vec_id, list_transform(list_zip(x, {sql_weights(2)}), lambda p: p[2] + 0.5 * p[1]) AS y FROM v", "y"))
def axpy(spark, d):
    return dense(vectors(spark, d).select("vec_id", X.axpy(0.5, "x", weight_vector(2)).alias("x")))


@query(f"WITH {V}, w AS (SELECT *, {sql_weights(3)} AS c FROM v) SELECT vec_id, round(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) + 0 AS value FROM w")
def sq_distance(spark, d):
    return vectors(spark, d).select("vec_id", r6(X.sq_distance("x", weight_vector(3))).alias("value"))


@query(f"WITH {V}, w AS (SELECT *, {sql_weights(3)} AS c FROM v) SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) + 0 AS value FROM w")
def l2_distance(spark, d):
    return vectors(spark, d).select("vec_id", r6(X.l2_distance("x", weight_vector(3))).alias("value"))


@query(f"WITH {V} SELECT vec_id, CAST(i AS BIGINT) AS pos, round({dot_sql('x', sql_weights('i'))}, 6) + 0 AS value FROM v, (SELECT unnest(range(4)) AS i)")
def matvec(spark, d):
    return dense(vectors(spark, d).select("vec_id", F.array(*[X.dot("x", weight_vector(i)) for i in range(4)]).alias("x")))


@query(f"WITH {V} SELECT vec_id, CAST(i AS BIGINT) AS pos, round({dot_sql('x', sql_weights('i'))} + i / 10.0, 6) + 0 AS value FROM v, (SELECT unnest(range(4)) AS i)")
def affine_transform(spark, d):
    return dense(vectors(spark, d).select("vec_id", F.array(*[X.dot("x", weight_vector(i)) + i / 10 for i in range(4)]).alias("x")))


@query(unnest_sql("SELECT vec_id, list_transform(x, lambda a: sign(a) * greatest(abs(a) - 0.05, 0)) AS y FROM v", "y"))
def soft_threshold(spark, d):
    return dense(vectors(spark, d).select("vec_id", F.transform("x", lambda v: X.soft_threshold(v, 0.05)).alias("x")))


@query(unnest_sql(f"SELECT vec_id, list_transform(x, lambda a: a * CASE WHEN {dot_sql('x', 'x')} > 0.5 THEN sqrt(0.5 / {dot_sql('x', 'x')}) ELSE 1 END) AS y FROM v", "y"))
def l2_project(spark, d):
    return dense(vectors(spark, d).select("vec_id", X.l2_project("x", 0.5).alias("x")))


@query(unnest_sql("SELECT vec_id, list_transform(x, lambda a: least(greatest(a, 0), 0.1)) AS y FROM v", "y"))
def clamp_nonneg(spark, d):
    return dense(vectors(spark, d).select("vec_id", F.transform("x", lambda v: X.clamp(v, 0.0, 0.1)).alias("x")))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda a: CAST(CAST(round(a * 1000) AS BIGINT) AS VARCHAR)), ' ') AS line FROM embeddings")
def vector_to_string(spark, d):
    # Scaled in the table's own floats, as the SQL does: in doubles 0.0125f times 1000 falls short of 12.5.
    whole = F.transform("embedding", lambda a: F.round(a * F.lit(1000).cast("float")).cast("bigint"))
    return read(spark, d, "embeddings").select("vec_id", X.vector_to_string(whole).alias("line"))


@query(f"WITH {V}, t AS (SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN (vec_id + i) % 5 = 0 THEN x[i + 1] ELSE 0 END) AS y FROM v), e AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(y) AS y FROM t) SELECT vec_id, pos, round(y, 6) + 0 AS value FROM e")
def densify(spark, d):
    v = vectors(spark, d)
    ids = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.col("vec_id") + i) % 5 == 0)
    s = v.select("vec_id", ids.alias("ids"), F.transform(ids, lambda i: F.get("x", i)).alias("vals"))
    return dense(s.select("vec_id", X.densify("ids", "vals", 64).alias("x")))


def libsvm_round_trip(v):
    """vec_id, label, pos, value: the components of ``x`` as lines of libsvm and parsed back."""
    from quern.sources.text import parse_libsvm

    body = F.array_join(F.transform("x", lambda v, i: F.concat(F.format_string("%d", i + 1), F.lit(":"), F.format_string("%.4f", F.round(v, 4)))), " ")
    lines = v.select("vec_id", F.concat_ws(" ", F.col("label").cast("string"), body).alias("line"))
    label, ids, vals = parse_libsvm(F.col("line"), one_based_ids=True)
    e = lines.select("vec_id", label.alias("label"), F.explode(F.arrays_zip(ids.alias("i"), vals.alias("v"))).alias("e"))
    return e.select("vec_id", "label", F.col("e.i").cast("bigint").alias("pos"), F.round(F.col("e.v"), 4).alias("value"))


@query(f"WITH {V}, e AS (SELECT vec_id, label, unnest(range(len(x))) AS pos, unnest(x) AS y FROM v) SELECT vec_id, CAST(label AS DOUBLE) AS label, pos, round(CAST(round(y, 4) AS FLOAT), 4) + 0 AS value FROM e")
def libsvm_parse(spark, d):
    """Lines of ``label id:val``, one-based, written from the vectors and parsed back."""
    return libsvm_round_trip(vectors(spark, d))


@query("SELECT l_returnflag AS grp, round(-sum(p * log2(p)), 6) + 0 AS value FROM (SELECT l_returnflag, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS p FROM lineitem GROUP BY l_returnflag, l_linenumber) GROUP BY 1")
def label_entropy(spark, d):
    n = read(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").count()
    return n.groupBy(F.col("l_returnflag").alias("grp")).agg(F.array_sort(F.collect_list("count")).alias("c")).select("grp", r6(X.entropy("c")).alias("value"))


@query("SELECT l_linenumber AS label, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM lineitem GROUP BY l_linenumber")
def normalized_shares(spark, d):
    from quern.ml.models import class_prior

    return class_prior(read(spark, d, "lineitem").select(F.col("l_linenumber").alias("label"))).select("label", r6(F.col("prior"), 8).alias("share"))


@query()
def digamma_approx(spark, d):
    return read(spark, d, "events").select("event_id", X.digamma(F.col("value") + 0.5).alias("value"), X.lgamma(F.col("value") + 0.5).alias("lgamma"))


@query("SELECT event_id, round(exp(value / 100), 6) AS e, round(ln(value + 1), 6) AS l, round(log2(value + 1), 6) AS l2, round(pow(value + 1, 0.3), 6) AS p, round((exp(value / 100) - exp(-value / 100)) / 2, 6) AS sh, round((exp(value / 100) + exp(-value / 100)) / 2, 6) AS ch, round((exp(value / 50) - 1) / (exp(value / 50) + 1), 6) AS th FROM events")
def math_functions(spark, d):
    v = F.col("value")
    e = read(spark, d, "events")
    return e.select("event_id", r6(F.exp(v / 100)).alias("e"), r6(F.log(v + 1)).alias("l"), r6(F.log2(v + 1)).alias("l2"), r6(F.pow(v + 1, F.lit(0.3))).alias("p"), r6(F.sinh(v / 100)).alias("sh"), r6(F.cosh(v / 100)).alias("ch"), r6(F.tanh(v / 100)).alias("th"))


@query("WITH u AS (SELECT user_id % 8 AS row_id, event_id % 16 AS col_id, count(*) AS n FROM events GROUP BY ALL) SELECT row_id, string_agg(CASE WHEN col_id <> 3 THEN col_id || ':' || CASE col_id WHEN 5 THEN 7 ELSE n END END, ' ' ORDER BY col_id) AS line FROM u GROUP BY row_id")
def sparse_feature_edit(spark, d):
    """Place 5 set to 7, place 3 set to 0 and so gone; written as text."""
    n = updates(spark, d).groupBy("row_id", "col_id").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("col_id", "n"))).alias("m"))
    k = lambda i: F.lit(i).cast("bigint")
    m = m.select("row_id", X.sparse_set(X.sparse_set("m", k(5), k(7)), k(3), k(0)).alias("m"))
    return m.select("row_id", X.sparse_to_string("m").alias("line"))
