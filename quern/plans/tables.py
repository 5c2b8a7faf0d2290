"""Queries over parameter tables, update logs and work placement."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import consistency as C
from quern.operators import partition as P
from quern.operators import rows as R
from quern.operators.table import explode_batch, explode_dense_batch
from quern.plans.registry import U, query, r6, read, updates

SUMS = "SELECT row_id, col_id, round(sum(delta), 6) AS value FROM u"


@query(f"WITH {U} {SUMS} WHERE row_id = 3 GROUP BY ALL")
def ps_get(spark, d):
    # The row filter stands before the aggregate and reaches the scan.
    u = updates(spark, d).where("row_id = 3")
    return R.SparseRow().cells(u).select("row_id", "col_id", r6(F.col("value")).alias("value"))


@query(f"WITH {U} {SUMS} GROUP BY ALL")
def ps_inc_sum(spark, d):
    return updates(spark, d).groupBy("row_id", "col_id").agg(r6(F.sum("delta")).alias("value"))


@query(f"WITH {U} SELECT row_id, col_id, round(sum(delta), 6) AS value, count(*) AS n FROM u GROUP BY ALL")
def ps_batch_inc(spark, d):
    u = updates(spark, d)
    batches = u.groupBy("row_id", "worker", "clk").agg(F.collect_list(F.struct("col_id", "delta")).alias("b"))
    batches = batches.select("row_id", F.col("b.col_id").alias("cols"), F.col("b.delta").alias("deltas"))
    return explode_batch(batches).groupBy("row_id", "col_id").agg(r6(F.sum("delta")).alias("value"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {U}, b AS (SELECT row_id, clk AS start, [delta, 2 * delta, 3 * delta] AS deltas FROM u),
x AS (SELECT row_id, start + unnest(range(3)) AS col_id, unnest(deltas) AS delta FROM b)
SELECT row_id, CAST(col_id AS BIGINT) AS col_id, round(sum(delta), 5) AS value FROM x GROUP BY ALL""")
def ps_dense_batch_inc(spark, d):
    b = updates(spark, d).select("row_id", F.col("clk").alias("start"), F.array(F.col("delta"), 2 * F.col("delta"), 3 * F.col("delta")).alias("deltas"))
    return explode_dense_batch(b).groupBy("row_id", "col_id").agg(r6(F.sum("delta"), 5).alias("value"))


@query(f"""WITH {U}, base AS (SELECT row_id, col_id, sum(delta) AS value FROM u WHERE clk < 10 AND row_id < 6 GROUP BY ALL),
d AS (SELECT row_id, col_id, sum(delta) AS delta FROM u WHERE clk >= 10 GROUP BY ALL)
SELECT coalesce(base.row_id, d.row_id) AS row_id, coalesce(base.col_id, d.col_id) AS col_id, round(coalesce(value, 0) + coalesce(delta, 0), 6) AS value
FROM base FULL JOIN d ON base.row_id = d.row_id AND base.col_id = d.col_id""")
def ps_apply_upsert(spark, d):
    u = updates(spark, d)
    base = R.DenseRow(16).cells(u.where("clk < 10 and row_id < 6"))
    return R.DenseRow(16).apply(base, u.where("clk >= 10")).select("row_id", "col_id", r6(F.col("value")).alias("value"))


@query(f"WITH {U} SELECT DISTINCT row_id FROM u WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.clk < 10 AND b.row_id < 6 AND b.row_id = u.row_id)")
def ps_missing_rows(spark, d):
    u = updates(spark, d)
    return C.missing_rows(u, u.where("clk < 10 and row_id < 6"))


@query(f"""WITH {U}, c AS (SELECT row_id, col_id, sum(delta) AS value FROM u WHERE col_id <> 5 GROUP BY ALL), r AS (SELECT DISTINCT row_id FROM c)
SELECT r.row_id, p.pos AS pos, round(coalesce(c.value, 0), 6) AS value FROM r CROSS JOIN (SELECT unnest(range(16)) AS pos) p LEFT JOIN c ON c.row_id = r.row_id AND c.col_id = p.pos""")
def dense_row_merge(spark, d):
    rows = R.DenseRow(16).rows(updates(spark, d).where("col_id <> 5"))
    return rows.select("row_id", F.posexplode("row").alias("pos", "value")).select("row_id", F.col("pos").cast("bigint").alias("pos"), r6(F.col("value")).alias("value"))


SIGNED = "CASE event_type WHEN 'purchase' THEN -1 WHEN 'click' THEN 1 ELSE 0 END"


@query(f"WITH {U} SELECT row_id, col_id, CAST(sum({SIGNED}) AS DOUBLE) AS value FROM u GROUP BY ALL HAVING sum({SIGNED}) <> 0")
def sparse_row_merge(spark, d):
    u = updates(spark, d).withColumn("delta", F.expr(SIGNED).cast("double"))
    return R.SparseRow().cells(u)


@query(f"""WITH {U}, c AS (SELECT row_id, col_id, sum(round(delta, 2)::DECIMAL(18,2)) AS value FROM u GROUP BY ALL HAVING sum(round(delta, 2)::DECIMAL(18,2)) <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY value DESC, col_id) AS rank FROM c)
SELECT row_id, col_id, CAST(value AS DOUBLE) AS value, rank FROM k WHERE rank <= 5""")
def sorted_row_topk(spark, d):
    # Exact decimals, so that near ties rank alike whatever the order of summation.
    u = updates(spark, d).withColumn("delta", F.round("delta", 2).cast("decimal(18,2)"))
    return R.SortedRow().top(u, 5).select("row_id", "col_id", F.col("value").cast("double").alias("value"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {U}, c AS (SELECT row_id, col_id, sum(delta) AS value FROM u WHERE col_id < 10 GROUP BY ALL HAVING sum(delta) <> 0)
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY col_id) - 1 AS BIGINT) AS pos, col_id, round(value, 6) AS value FROM c""")
def sparse_feature_row(spark, d):
    rows = R.SparseFeatureRow(10).rows(updates(spark, d))
    return rows.select("row_id", F.posexplode("entries").alias("pos", "e")).select("row_id", F.col("pos").cast("bigint").alias("pos"), "e.col_id", r6(F.col("e.value")).alias("value"))


@query(f"WITH {U} SELECT row_id, col_id, round(ln(product(1 + delta / 100000)), 8) AS log_value FROM u GROUP BY ALL")
def mult_row_merge(spark, d):
    u = updates(spark, d).withColumn("delta", 1 + F.col("delta") / 100000)
    return R.MultiplicativeRow().cells(u).select("row_id", "col_id", r6(F.log("value"), 8).alias("log_value"))


@query(f"""WITH {U}, x AS (SELECT row_id, col_id, sum(delta) AS x FROM u WHERE clk < 15 AND col_id < 12 GROUP BY ALL), d AS (SELECT row_id, col_id, sum(delta) AS u FROM u WHERE clk >= 15 GROUP BY ALL)
SELECT d.row_id, d.col_id, round(CASE WHEN coalesce(x, 0) = 0 THEN abs(u) ELSE abs(u / x) END, 6) AS importance FROM d LEFT JOIN x ON d.row_id = x.row_id AND d.col_id = x.col_id""")
def update_importance(spark, d):
    u = updates(spark, d)
    x = u.where("clk < 15 and col_id < 12").groupBy("row_id", "col_id").agg(F.sum("delta").alias("x"))
    new = u.where("clk >= 15").groupBy("row_id", "col_id").agg(F.sum("delta").alias("u"))
    return new.join(x, ["row_id", "col_id"], "left").select("row_id", "col_id", r6(R.RowCodec.importance(F.coalesce("x", F.lit(0.0)), F.col("u"))).alias("importance"))


@query(f"WITH {U} SELECT row_id, round(sum(abs(delta)), 5) AS importance FROM u GROUP BY row_id")
def accumulated_importance(spark, d):
    return C.row_log_meta(updates(spark, d)).select("row_id", r6(F.col("importance"), 5).alias("importance"))


@query(f"WITH {U} SELECT row_id, col_id, CAST(sum({SIGNED}) AS BIGINT) AS delta FROM u GROUP BY ALL HAVING sum({SIGNED}) <> 0")
def oplog_squeeze_zeros(spark, d):
    return C.squeeze_zeros(updates(spark, d).withColumn("delta", F.expr(SIGNED))).select("row_id", "col_id", F.col("delta").cast("bigint").alias("delta"))


@query(f"WITH {U} SELECT DISTINCT row_id FROM u WHERE clk = 7")
def dirty_rows(spark, d):
    return C.dirty_rows(updates(spark, d).where("clk = 7"))


META = "m AS (SELECT user_id % 100 AS row_id, min(CAST(day(ts) - 1 AS BIGINT)) AS clk, sum(round(value, 2)::DECIMAL(18,2)) AS importance, 8 * count(DISTINCT event_id % 16) AS bytes FROM events GROUP BY ALL)"


def meta(spark, d):
    """Pending updates of 100 rows; exact sums, so that orders are the same everywhere."""
    e = read(spark, d, "events").select((F.col("user_id") % 100).alias("row_id"), (F.dayofmonth("ts") - 1).cast("bigint").alias("clk"), (F.col("event_id") % 16).alias("col_id"), F.round("value", 2).cast("decimal(18,2)").alias("delta"))
    return e.groupBy("row_id").agg(F.min("clk").alias("clk"), F.sum("delta").alias("importance"), (8 * F.countDistinct("col_id")).alias("bytes"))


@query(f"WITH {META} SELECT row_id, clk, row_number() OVER (ORDER BY clk, row_id) AS place FROM m")
def update_order_fifo(spark, d):
    return C.ranked_updates(meta(spark, d), "fifo").select("row_id", "clk", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {META} SELECT row_id, CAST(importance AS DOUBLE) AS importance, row_number() OVER (ORDER BY importance DESC, row_id) AS place FROM m")
def update_order_magnitude(spark, d):
    return C.ranked_updates(meta(spark, d), "magnitude").select("row_id", F.col("importance").cast("double").alias("importance"), F.col("place").cast("bigint").alias("place"))


@query()
def update_order_random(spark, d):
    return C.ranked_updates(meta(spark, d), "random", seed=5).select("row_id", "place")


@query(f"""WITH {META}, b AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY importance DESC, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes_before FROM m)
SELECT row_id, CAST(bytes AS BIGINT) AS bytes, CAST(bytes_before AS BIGINT) AS bytes_before FROM b WHERE bytes_before < 1000""")
def update_budget_cut(spark, d):
    return C.budget_cut(meta(spark, d), 1000).select("row_id", F.col("bytes").cast("bigint").alias("bytes"), F.col("bytes_before").cast("bigint").alias("bytes_before"))


@query(f"WITH {U} SELECT row_id, count(*) AS n FROM u WHERE clk <= 12 GROUP BY row_id")
def updates_up_to_clock(spark, d):
    return updates(spark, d).where("clk <= 12").groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {U}, m AS (SELECT worker, max(clk) AS clk FROM u GROUP BY worker) SELECT worker, clk, least(clk, clk - 3 + 2) AS push_clock FROM m")
def push_clock(spark, d):
    m = updates(spark, d).groupBy("worker").agg(F.max("clk").alias("clk"))
    return m.select("worker", "clk", C.push_clock(F.col("clk"), 3, 2).alias("push_clock"))


@query(f"WITH {META} SELECT row_id, round(bytes * 8 / 40.0 / 1000, 6) AS millis FROM m")
def send_time_estimate(spark, d):
    return meta(spark, d).select("row_id", r6(C.send_millis(F.col("bytes"), 40.0)).alias("millis"))


@query(f"WITH {U} {SUMS} WHERE clk < 20 OR worker = 1 GROUP BY ALL")
def read_my_writes(spark, d):
    u = updates(spark, d)
    snapshot = R.DenseRow(16).cells(u.where("clk < 20"))
    return C.read_my_writes(snapshot, u, 20, 1).select("row_id", "col_id", r6(F.col("value")).alias("value"))


@query(f"WITH {U} {SUMS} WHERE clk < 20 - 3 OR worker = 2 GROUP BY ALL")
def ssp_view(spark, d):
    return R.DenseRow(16).cells(C.ssp_view(updates(spark, d), 20, 3, 2)).select("row_id", "col_id", r6(F.col("value")).alias("value"))


@query("""WITH s AS (SELECT user_id, CAST(day(ts) - 1 AS BIGINT) AS clk, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, arg_max(clk, clk) AS clk, arg_max(n, clk) AS n FROM s WHERE clk <= 16 GROUP BY user_id""")
def asof_version(spark, d):
    """The latest version of each user up to day 16: a version is a day with events, and the gaps are those of the data."""
    e = read(spark, d, "events").select("user_id", (F.dayofmonth("ts") - 1).cast("bigint").alias("clk"))
    return C.asof_version(e.groupBy("user_id", "clk").agg(F.count(F.lit(1)).alias("n")), 16, "user_id")


@query(f"WITH {U} SELECT min(clk) AS min_clk FROM (SELECT worker, max(clk) AS clk FROM u WHERE clk < 10 + worker GROUP BY worker)")
def vector_clock_min(spark, d):
    return C.vector_clock_min(updates(spark, d).where("clk < 10 + worker"))


@query("SELECT o_orderkey AS row_id, o_orderkey % 4 AS channel, (o_orderkey // 4) % 3 AS client FROM orders")
def row_placement(spark, d):
    channel, client = P.row_placement(F.col("row_id"), 4, 3)
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id")).select("row_id", channel.alias("channel"), client.cast("bigint").alias("client"))


@query(f"WITH {U} {SUMS} WHERE row_id IN (SELECT row_id FROM u WHERE clk = 7 AND col_id = 3 AND worker = 3) GROUP BY ALL")
def push_dirty_rows(spark, d):
    u = updates(spark, d)
    # The semi-join stands before the aggregate: rows that are not pushed are never summed.
    pushed = C.push_dirty_rows(u, u.where("clk = 7 and col_id = 3 and worker = 3"))
    return R.DenseRow(16).cells(pushed).select("row_id", "col_id", r6(F.col("value")).alias("value"))


@query(f"WITH {META} SELECT row_id, CAST(importance AS DOUBLE) AS importance FROM m ORDER BY m.importance DESC, row_id LIMIT 10")
def topk_important_rows(spark, d):
    return C.top_important_rows(meta(spark, d), 10).select("row_id", F.col("importance").cast("double").alias("importance"))


@query("""SELECT w AS worker, w * (1003 // 4) AS "begin", CASE WHEN w = 3 THEN 1003 ELSE (w + 1) * (1003 // 4) END AS "end",
CAST(ceil((CASE WHEN w = 3 THEN 1003 ELSE (w + 1) * (1003 // 4) END - w * (1003 // 4)) / 7.0) AS BIGINT) AS batch FROM (SELECT unnest(range(4)) AS w)""")
def workload_ranges(spark, d):
    return P.workload_ranges(spark, 1003, 4, 7)


@query("""WITH r AS (SELECT w AS worker, w * 25 AS b, CASE WHEN w = 3 THEN 103 ELSE (w + 1) * 25 END AS e FROM (SELECT unnest(range(4)) AS w)),
q AS (SELECT *, CAST(ceil((e - b) / 7.0) AS BIGINT) AS batch FROM r), s AS (SELECT *, unnest(range(10)) AS step FROM q), k AS (SELECT *, unnest(range(batch)) AS k FROM s)
SELECT worker, step, k, b + (step * batch + k) % (e - b) AS idx FROM k""")
def minibatch_schedule(spark, d):
    return P.minibatch_schedule(P.workload_ranges(spark, 103, 4, 7), 10)


@query("SELECT e AS epoch, round(0.5 * pow(e + 1, -0.75), 8) AS power_rate, round(0.01 * pow(0.99, e), 8) AS decay_rate FROM (SELECT unnest(range(50)) AS e)")
def lr_schedule(spark, d):
    from quern.functions.vector import lr_decay, lr_power

    e = spark.range(50).withColumnRenamed("id", "epoch")
    return e.select("epoch", r6(lr_power("epoch", 0.5, 1.0, 0.75), 8).alias("power_rate"), r6(lr_decay("epoch", 0.01, 0.99), 8).alias("decay_rate"))


@query(f"WITH {U} SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, round(sum(delta), 5) AS total, count(*) AS n FROM u GROUP BY 1")
def clock_tumbling_sum(spark, d):
    from quern.streaming.updates import tumbling

    t = tumbling(updates(spark, d), "ts", "1 day")
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), r6(F.col("total"), 5).alias("total"), "n")


@query(f"""WITH {U}, c AS (SELECT row_id, clk, sum(delta) AS s FROM u GROUP BY ALL)
SELECT row_id, clk, round(sum(s) OVER (PARTITION BY row_id ORDER BY clk RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), 5) AS total FROM c""")
def staleness_sliding(spark, d):
    c = updates(spark, d).groupBy("row_id", "clk").agg(F.sum("delta").alias("s"))
    w = Window.partitionBy("row_id").orderBy("clk").rangeBetween(-3, 0)
    return c.select("row_id", "clk", r6(F.sum("s").over(w), 5).alias("total"))


@query(f"WITH {U} SELECT clk % 5 AS stripe, count(*) AS n FROM u GROUP BY 1")
def column_striping(spark, d):
    return updates(spark, d).groupBy(P.stripe(F.col("clk"), 5).alias("stripe")).agg(F.count(F.lit(1)).alias("n"))


@query()
def hash_sample_k(spark, d):
    return P.sample_k(read(spark, d, "orders").select("o_orderkey"), 100, 3, "o_orderkey")


@query()
def bernoulli_sample(spark, d):
    return P.bernoulli(read(spark, d, "orders").select("o_orderkey"), 0.1, 3, "o_orderkey")


@query()
def table_clock_e2e(spark, d):
    """Four workers, every clock of the events through the table API; what worker 0 is guaranteed at staleness 1."""
    from quern.operators.table import TableConfig, TableGroup

    group = TableGroup(spark, workers=4, fold_every=2)
    t = group.create_table("w", TableConfig(staleness=1))
    for c in range(updates(spark, d).agg(F.max("clk")).first()[0] + 1):
        t.inc_frame(updates(spark, d).where(F.col("clk") == c))
        for w in range(4):
            group.clock(w)
    return t.snapshot(worker=0).select("row_id", "col_id", r6(F.col("value")).alias("value"))


@query()
def stream_table_e2e(spark, d):
    """The update log as a file stream, folded batch by batch into versioned snapshots."""
    import uuid

    from quern.operators.table import shared_folder
    from quern.schema import UPDATE
    from quern.streaming.updates import SnapshotSink, read_updates

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    updates(spark, d).select(*[f.name for f in UPDATE]).repartition(3, "clk").write.parquet(base + "/in")
    sink = SnapshotSink(spark, base + "/table")
    q = read_updates(spark, base + "/in", 1).writeStream.foreachBatch(sink).option("checkpointLocation", base + "/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return sink.version(q.lastProgress["batchId"]).select("row_id", "col_id", r6(F.col("value")).alias("value"))


from quern.plans.registry import ORACLES  # noqa: E402

ORACLES["stream_table_e2e"] = f"WITH {U} {SUMS} GROUP BY ALL"
ORACLES["table_clock_e2e"] = f"WITH {U} SELECT row_id, col_id, round(sum(delta), 6) + 0 AS value FROM u WHERE clk < (SELECT max(clk) FROM u) OR worker = 0 GROUP BY ALL HAVING sum(delta) <> 0"
