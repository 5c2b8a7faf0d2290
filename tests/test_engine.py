"""Tables, clocks, trainers and streams."""

import numpy as np
from pyspark.sql import functions as F

from quern.ml import generate as G
from quern.ml import models as M
from quern.operators import partition as P
from quern.operators.table import DenseUpdateBatch, TableConfig, TableGroup, UpdateBatch


def cells(df):
    return {(r["row_id"], r["col_id"]): r["value"] for r in df.collect()}


def test_staleness_contract(spark):
    g = TableGroup(spark, workers=2, fold_every=1)
    t = g.create_table("t", TableConfig(staleness=1))
    t.inc(0, 0, 1.0, worker=0)
    t.batch_inc(0, UpdateBatch().update(1, 2.0), worker=1)
    assert cells(t.snapshot(worker=0)) == {(0, 0): 1.0}  # own update only
    assert g.clock(0) is None and g.clock(1) == 1
    t.dense_batch_inc(0, DenseUpdateBatch(0, [1.0, -2.0]), worker=1)
    assert cells(t.snapshot(worker=0)) == {(0, 0): 1.0}
    g.barrier()
    assert cells(t.snapshot(worker=0)) == {(0, 0): 2.0}  # the sum of column 1 is 0 and gone


def test_snapshot_and_resume(spark, tmp_path):
    g = TableGroup(spark)
    t = g.create_table("t", TableConfig(snapshot_clock=1, snapshot_dir=f"file://{tmp_path}"))
    t.inc(3, 4, 5.0)
    g.clock(0)
    u = TableGroup(spark).create_table("t")
    u.resume(f"file://{tmp_path}", 1)
    assert cells(u.snapshot()) == {(3, 4): 5.0}


def test_kmeans_step_is_the_sequential_update(spark):
    p = G.blobs(spark, 3, 4, 60, seed=2).repartition(1)
    m = M.KMeans(3, learning_rate=5.0, seed=1)
    m.init(p)
    c = m.centers.copy()
    at = {r["point_id"]: r["cid"] for r in m.assign(p).collect()}
    n = np.zeros(3)
    for r in p.orderBy("point_id").collect():
        k = at[r["point_id"]]
        n[k] += 1
        eta = 5.0 / (n[k] + 5.0)
        c[k] = (1 - eta) * c[k] + eta * np.array(r["features"])
    m.step(p)
    assert np.allclose(m.centers, c)


def test_trainers_improve(spark):
    d = G.sparse_classification(spark, 300, 20, 6, 3, seed=1)
    from quern.functions.vector import densify

    data = d.select("key", "label", densify("ids", "vals", 20).alias("features")).cache()
    losses = M.train(M.SoftmaxRegression(3, 20), data, 4, 2, 0.05)
    assert losses["entropy"].iloc[-1] < losses["entropy"].iloc[0]
    two = data.withColumn("label", (F.col("label") > 0).cast("int"))
    log = M.train(M.make_solver(2, 20), two, 3, 1, 0.02)
    assert log["entropy"].iloc[-1] < log["entropy"].iloc[0]
    mlp = M.train(M.Perceptron([20, 8, 3], seed=1), data, 4, 2, 1.0)
    assert mlp["entropy"].iloc[-1] < mlp["entropy"].iloc[0]
    forest = M.train_forest(data, 5, 3, 100, 5, max_depth=4, seed=2)
    right = M.predict_forest(data, forest, 3).agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]
    assert right > 0.4


def test_factorisations_and_metric(spark):
    x = G.block_diagonal(spark, 3, 3).withColumn("left", F.array(*[F.lit(0.5)] * 3))
    m = M.MatrixFactorization(9, 3, seed=1)
    first = m.objective(x)
    for _ in range(4):
        x = m.step(x, 0.02, 0.05, iter_l=3)
    assert m.objective(x) < first
    y = G.dictionary_mix(spark, 5, 40, 6, 2, seed=3).withColumn("code", F.array(*[F.lit(0.0)] * 6))
    s = M.SparseCoding(5, 6, seed=2)
    first = s.objective(y)
    for _ in range(3):
        y = s.step(y, 0.05, 0.1, iter_s=5)
    assert s.objective(y) < first and (s.b**2).sum(0).max() <= 1 + 1e-9
    a = G.blobs(spark, 2, 4, 40, seed=5)
    b = a.select((F.col("point_id") - 1).alias("point_id"), F.col("cluster").alias("c2"), F.col("features").alias("y"))
    c = a.select((F.col("point_id") - 2).alias("point_id"), F.col("cluster").alias("c2"), F.col("features").alias("y"))
    pairs = a.join(b.unionByName(c), "point_id").select(F.col("features").alias("x"), "y", (F.col("cluster") == F.col("c2")).alias("similar"))
    ml = M.MetricLearning(2, 4, seed=1)
    first = ml.loss(pairs)
    for _ in range(5):
        ml.step(pairs, 0.01)
    assert ml.loss(pairs) < first


def test_partitioning(spark):
    r = P.workload_ranges(spark, 10, 3, 2).orderBy("worker").collect()
    assert [(x["begin"], x["end"], x["batch"]) for x in r] == [(0, 3, 2), (3, 6, 2), (6, 10, 2)]
    assert P.split_trees(10, 4) == [3, 3, 2, 2]
    s = P.sample_k(spark.range(100), 7, 1, "id")
    assert sorted(x["id"] for x in s.collect()) == sorted(x["id"] for x in P.sample_k(spark.range(100).repartition(7), 7, 1, "id").collect())
