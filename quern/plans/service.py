"""Queries over write buffers, consistency modes, server rows and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import consistency as C
from quern.operators import partition as P
from quern.operators.table import DenseUpdateBatch, TableConfig, TableGroup, ThreadBuffer, UpdateBatch, combine_thread_updates, overwrite_column
from quern.plans.registry import U, query, r6, read, updates

#: Updates with exact sums, so that orders and ratios are the same everywhere.
E = """e AS (SELECT event_id % 4 AS worker, CAST(day(ts) - 1 AS BIGINT) AS clk, user_id % 100 AS row_id, event_id % 16 AS col_id, round(value, 2)::DECIMAL(18,2) AS delta, event_id FROM events)"""


def exact_updates(spark, d):
    return read(spark, d, "events").select(
        (F.col("event_id") % 4).alias("worker"), (F.dayofmonth("ts") - 1).cast("bigint").alias("clk"), (F.col("user_id") % 100).alias("row_id"),
        (F.col("event_id") % 16).alias("col_id"), F.round("value", 2).cast("decimal(18,2)").alias("delta"), "event_id",
    )


@query(f"WITH {U} SELECT worker, clk, row_id, col_id, round(sum(delta), 6) AS delta FROM u GROUP BY ALL")
def thread_flush(spark, d):
    """The thread-private buffers of every worker and clock, flushed: one update a cell."""
    u = combine_thread_updates(updates(spark, d))
    return u.select("worker", "clk", "row_id", "col_id", r6(F.col("delta")).alias("delta"))


@query("SELECT r.row_id, c.col_id, CAST(CASE WHEN c.col_id = 1 THEN 2.5 ELSE 0 END + CASE WHEN c.col_id IN (1, 2) THEN 1 ELSE 0 END + CASE WHEN c.col_id >= 2 THEN c.col_id - 1 ELSE 0 END AS DOUBLE) AS value FROM (SELECT unnest(range(2)) AS row_id) r, (SELECT unnest(range(1, 4)) AS col_id) c")
def thread_buffer_e2e(spark, d):
    """Single, sparse and dense updates through a thread's buffer into a table."""
    group = TableGroup(spark, workers=1)
    t = group.create_table("w", TableConfig())
    b = ThreadBuffer(t, 0)
    for row in range(2):
        b.inc(row, 1, 2.5)
        b.batch_inc(row, UpdateBatch([1, 2], [1.0, 1.0]))
        b.dense_batch_inc(row, DenseUpdateBatch(2, [1.0, 2.0]))
    b.flush()
    return t.snapshot().select(F.col("row_id").cast("bigint").alias("row_id"), F.col("col_id").cast("bigint").alias("col_id"), "value")


@query(f"""WITH {E}, x AS (SELECT row_id, col_id, sum(delta) AS value FROM e WHERE clk < 10 GROUP BY ALL),
w AS (SELECT e.row_id, e.delta, coalesce(x.value, 0) + coalesce(sum(e.delta) OVER (PARTITION BY e.row_id, e.col_id ORDER BY clk, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x
  FROM e LEFT JOIN x ON x.row_id = e.row_id AND x.col_id = e.col_id WHERE e.clk >= 10)
SELECT row_id, round(sum(CASE WHEN x = 0 THEN abs(delta::DOUBLE) ELSE abs(delta::DOUBLE / x::DOUBLE) END), 5) AS importance FROM w GROUP BY row_id""")
def importance_while_applying(spark, d):
    e = exact_updates(spark, d)
    base = e.where("clk < 10").groupBy("row_id", "col_id").agg(F.sum("delta").alias("value"))
    out = C.importance_while_applying(base, e.where("clk >= 10"), ["clk", "event_id"])
    return out.select("row_id", r6(F.col("importance"), 5).alias("importance"))


@query("SELECT min(v) AS min_version FROM (SELECT user_id % 3 AS server, max(day(ts) - 1) AS v FROM events GROUP BY 1)")
def server_version_min(spark, d):
    acks = read(spark, d, "events").select((F.col("user_id") % 3).alias("server"), (F.dayofmonth("ts") - 1).cast("bigint").alias("clk"))
    return C.server_version_min(acks)


M = "m AS (SELECT row_id, min(clk) AS clk, sum(abs(delta)) AS importance, count(DISTINCT col_id) AS n_cols FROM e GROUP BY row_id)"


@query(f"WITH {E}, {M}, c AS (SELECT * FROM m ORDER BY row_id LIMIT 40) SELECT row_id, importance::DOUBLE AS importance FROM c ORDER BY c.importance DESC, row_id LIMIT 8")
def partial_push_magnitude(spark, d):
    return C.partial_push(C.row_log_meta(exact_updates(spark, d)), 8).select("row_id", F.col("importance").cast("double").alias("importance"))


@query(f"WITH {E}, {M}, c AS (SELECT * FROM m ORDER BY row_id LIMIT 40) SELECT row_id FROM c ORDER BY md5('5:' || row_id), row_id LIMIT 8")
def partial_push_random(spark, d):
    return C.partial_push(C.row_log_meta(exact_updates(spark, d)), 8, policy="random", seed=5).select("row_id")


@query(f"""WITH {E}, b AS (SELECT DISTINCT row_id FROM e WHERE clk < 3), {M.replace('FROM e', 'FROM e WHERE clk = 20')}
SELECT coalesce(b.row_id, m.row_id) AS row_id, m.row_id IS NOT NULL AS dirty, coalesce(m.importance::DOUBLE, 0) AS importance FROM b FULL JOIN m ON b.row_id = m.row_id""")
def server_rows(spark, d):
    e = exact_updates(spark, d)
    rows = C.server_rows(e.where("clk < 3"), e.where("clk = 20").withColumn("delta", F.col("delta").cast("double")))
    return rows.select("row_id", "dirty", r6(F.col("importance")).alias("importance"))


@query(f"WITH {E}, p AS (SELECT *, (row_number() OVER (PARTITION BY worker, clk ORDER BY event_id) - 1) // 50 AS flush FROM e) SELECT worker, clk, flush, count(*) AS n, sum(delta)::DOUBLE AS total FROM p GROUP BY ALL")
def aggregate_early_flush(spark, d):
    """Every fifty updates of a worker's clock leave together."""
    p = C.flush_batches(exact_updates(spark, d), 50, ["event_id"])
    return p.groupBy("worker", "clk", "flush").agg(F.count(F.lit(1)).alias("n"), F.sum("delta").cast("double").alias("total"))


@query(f"WITH {E}, {M}, b AS (SELECT row_id, coalesce(sum(8 * n_cols) OVER (ORDER BY importance DESC, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m) SELECT row_id FROM b WHERE before < 2000")
def aggregate_sent(spark, d):
    """What a budget of 2000 bytes sends, by the sum of |u|."""
    return C.AggregateController(order="magnitude", budget_bytes=2000).sent(exact_updates(spark, d))


@query(f"""WITH {E}, x AS (SELECT row_id, col_id, sum(delta) AS value FROM e WHERE clk < 10 AND row_id < 60 GROUP BY ALL),
v AS (SELECT e.row_id, sum(CASE WHEN coalesce(x.value, 0) = 0 THEN abs(delta)::DOUBLE ELSE abs(delta)::DOUBLE / abs(x.value::DOUBLE) END) AS importance FROM e LEFT JOIN x ON x.row_id = e.row_id AND x.col_id = e.col_id WHERE clk >= 10 GROUP BY e.row_id)
SELECT row_id, round(importance, 5) AS importance FROM v""")
def aggregate_by_value_importance(spark, d):
    e = exact_updates(spark, d)
    cached = e.where("clk < 10 and row_id < 60").groupBy("row_id", "col_id").agg(F.sum("delta").alias("value"))
    m = C.AggregateByValueController().importance(e.where("clk >= 10"), cached)
    return m.select("row_id", r6(F.col("importance"), 5).alias("importance"))


@query(f"""WITH {E}, n AS (SELECT row_id, sum(delta) AS v FROM e GROUP BY row_id), o AS (SELECT row_id, sum(delta) AS v FROM e WHERE clk < 20 GROUP BY row_id), k AS (SELECT DISTINCT row_id FROM e WHERE clk = 25 AND col_id < 2)
SELECT o.row_id, (CASE WHEN k.row_id IS NULL THEN o.v ELSE n.v END)::DOUBLE AS value FROM o LEFT JOIN k ON k.row_id = o.row_id LEFT JOIN n ON n.row_id = o.row_id UNION ALL SELECT n.row_id, n.v::DOUBLE FROM n JOIN k ON k.row_id = n.row_id WHERE n.row_id NOT IN (SELECT row_id FROM o)""")
def push_refresh(spark, d):
    """A copy of clock 20, with the rows that were pushed since as they are now."""
    e = exact_updates(spark, d)
    now = e.groupBy("row_id").agg(F.sum("delta").cast("double").alias("value"))
    copy = e.where("clk < 20").groupBy("row_id").agg(F.sum("delta").cast("double").alias("value"))
    return C.PushController().refresh(copy, now, e.where("clk = 25 and col_id < 2"))


@query(f"WITH {E} SELECT row_id % 16 AS slot, row_id, sum(delta)::DOUBLE AS total, count(*) AS n FROM e GROUP BY ALL")
def dense_oplog(spark, d):
    """The log as a dense table of 16 slots, a row in the slot of its id."""
    e = exact_updates(spark, d)
    return e.groupBy((F.col("row_id") % 16).alias("slot"), "row_id").agg(F.sum("delta").cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {E} SELECT row_id, col_id, CASE WHEN col_id = 3 THEN least(greatest(row_id / 10.0 - 2, 0), 5)::DOUBLE ELSE sum(delta)::DOUBLE END AS value FROM e GROUP BY row_id, col_id")
def overwrite_with_clamp(spark, d):
    """A column set, not added to, within [0, 5]."""
    cells = exact_updates(spark, d).groupBy("row_id", "col_id").agg(F.sum("delta").cast("double").alias("value"))
    return overwrite_column(cells, 3, F.col("row_id") / 10.0 - 2, 0.0, 5.0)


DRAW = "SELECT i AS draw, ('0x' || substr(md5('{seed}:' || i), 1, 8))::BIGINT % (SELECT count(*) FROM {table}) AS idx FROM (SELECT unnest(range({k})) AS i)"


@query(f"SELECT draw, vec_id, label FROM ({DRAW.format(seed=9, table='embeddings', k=300)}) JOIN embeddings ON vec_id = idx")
def sample_ids_with_replacement(spark, d):
    """300 examples of a mini-batch; one may be drawn again."""
    v = read(spark, d, "embeddings").select("vec_id", "label")
    return P.sample_with_replacement(v, v.count(), 300, 9, "vec_id")


@query(f"SELECT draw, idx AS col_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 6) AS total FROM ({DRAW.format(seed=2, table='embeddings', k=64)}) JOIN embeddings ON vec_id = idx")
def random_columns(spark, d):
    """64 columns of the matrix, with replacement, and their sums."""
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    x = P.sample_with_replacement(v, v.count(), 64, 2, "vec_id")
    return x.select("draw", F.col("vec_id").alias("col_id"), r6(F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b.cast("double"))).alias("total"))


@query("WITH r AS (SELECT n_nationkey AS k, n_nationkey * 900.0 - 1000 AS b, n_nationkey * 900.0 + 350 AS e FROM nation) SELECT k, count(*) AS n, min(c_custkey) AS first FROM customer JOIN r ON c_acctbal >= b AND c_acctbal < e GROUP BY k")
def range_join(spark, d):
    """Customers by overlapping ranges of their balance."""
    r = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 900.0 - 1000).alias("b"), (F.col("n_nationkey") * 900.0 + 350).alias("e"))
    met = P.range_join(read(spark, d, "customer").select("c_custkey", "c_acctbal"), r, "c_acctbal", "b", "e", 1350.0)
    return met.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))


@query(f"WITH {U} SELECT row_id, col_id FROM u WHERE clk = 7 INTERSECT SELECT row_id, col_id FROM u WHERE clk = 8")
def cells_of_both_clocks(spark, d):
    u = updates(spark, d)
    return u.where("clk = 7").select("row_id", "col_id").intersect(u.where("clk = 8").select("row_id", "col_id"))


@query(f"WITH {U} SELECT row_id, col_id FROM u EXCEPT SELECT row_id, col_id FROM u WHERE clk = 7")
def cells_not_of_clock(spark, d):
    u = updates(spark, d)
    return u.select("row_id", "col_id").subtract(u.where("clk = 7").select("row_id", "col_id"))


@query(f"WITH {E}, x AS (SELECT row_id, col_id, sum(delta)::DOUBLE AS value FROM e WHERE clk <= 20 GROUP BY ALL HAVING sum(delta) <> 0) SELECT row_id, col_id, round(value, 6) AS value FROM x")
def resume_clock_e2e(spark, d):
    """A snapshot of clock 20 is resumed by a new group, which is then at that clock."""
    import uuid

    from quern.operators.table import shared_folder

    where = f"{shared_folder(spark)}/resume-{uuid.uuid4().hex}"
    e = exact_updates(spark, d)
    group = TableGroup(spark, workers=2)
    group.create_table("w", TableConfig()).inc_frame(e.where("clk <= 20"))
    group.get_table("w").write_snapshot(where, 21)
    again = TableGroup(spark, workers=2)
    t = again.create_table("w", TableConfig())
    again.resume(where, 21)
    if again.min_clock != 21:
        raise AssertionError("the clock was not resumed")
    return t.snapshot().select(F.col("row_id").cast("bigint").alias("row_id"), F.col("col_id").cast("bigint").alias("col_id"), r6(F.col("value")).alias("value"))
