"""Queries that must meet every row and component of their tables."""

import duckdb
from pyspark.sql import functions as F

from quern import catalog
from quern.plans.registry import read


def test_vectors_whole(spark, sf):
    size = read(spark, sf, "embeddings").agg(F.sum(F.size("embedding"))).first()[0]
    assert catalog.QUERIES["libsvm_parse"](spark, sf).count() == size
    lines = catalog.QUERIES["vector_to_string"](spark, sf)
    assert lines.agg(F.sum(F.size(F.split("line", " ")))).first()[0] == size


def test_vector_to_string_rounds_in_floats(spark, tmp_path):
    """Halves that only show in the table's own precision, on both sides of zero, and vectors and components that are missing."""
    halves = [i / 1000 + 0.0005 for i in range(-1000, 1000)]
    rows = [(0, halves, 0), (1, [0.0125, None, -0.0125], 1), (2, [], 1), (3, None, 1), (4, [-0.0001, 0.0, 1e6], 2)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.line for r in catalog.QUERIES["vector_to_string"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == dict(duck.execute(catalog.ORACLES["vector_to_string"]).fetchall())


def test_minibatch_of_one_crowded_cluster(spark, tmp_path):
    """Nearly all points nearest to one centre and stored against the order of their ids: numbered by ranges, not in one window, with the weights of the SQL."""
    point = lambda i: [float(i % 5 if i < 5 else 0.1) + ((i * 37 + k * 11) % 101) / 1000 for k in range(64)]
    rows = [(i * i, point(i), 0) for i in reversed(range(3000)) if i not in (2, 3)] + [(2, point(2), 0), (3, point(3), 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = catalog.QUERIES["kmeans_minibatch"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {(c, p): v for c, p, v in duck.execute(catalog.ORACLES["kmeans_minibatch"]).fetchall()}
    got = {(r.cid, r.pos): r.center for r in df.collect()}
    assert got.keys() == want.keys() and all(abs(v - want[k]) < 1e-9 for k, v in got.items())
    windows = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
    # Over points only a running number, within a range; a frame that ends at the last row is summed anew for each row before it.
    assert windows and not any("RowFrame, 1, unboundedfollowing" in x for x in windows)
    assert all("windowspecdefinition(part#" in x for x in windows if "row_number" in x)


def test_clocks_whole(spark, sf):
    events = read(spark, sf, "events")
    last, days = catalog.QUERIES["asof_version"](spark, sf), events.groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    assert last.count() == days.where("day <= 17").select("user_id").distinct().count()
    total = catalog.QUERIES["table_clock_e2e"](spark, sf).agg(F.sum("value")).first()[0]
    top = events.agg(F.max(F.dayofmonth("ts"))).first()[0]
    assert abs(total - events.where((F.dayofmonth("ts") < top) | (F.col("event_id") % 4 == 0)).agg(F.sum("value")).first()[0]) < 1e-3
