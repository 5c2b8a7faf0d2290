"""Trainers and table services against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.ml.models import KMeans
from quern.operators.consistency import AggregateByValueController, AggregateController, PushController
from quern.operators.table import Consistency, DenseUpdateBatch, TableConfig, TableGroup, ThreadBuffer, UpdateBatch
from quern.sources.sinks import kaldi_text, read_layers, write_layers, write_stats
from quern.sources.text import read_client_files


@pytest.mark.parametrize("batch", [7, 10000])
def test_kmeans_step_is_sequential_whatever_the_batches(spark, batch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((100, 3))
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "point_id long, features array<double>").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        m = KMeans(4, 1.5)
        m.centers = x[:4].copy()
        m.step(points)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, n = x[:4].copy(), np.zeros(4)
    for p in x:
        c = ((p - x[:4]) ** 2).sum(1).argmin()
        n[c] += 1
        eta = 1.5 / (n[c] + 1.5)
        want[c] = (1 - eta) * want[c] + eta * p
    assert np.allclose(m.centers, want) and (m.counts == n).all()


def test_initial_centers_from_file(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1 2\n3 4\n5 6\n")
    m = KMeans(2)
    m.load(spark, f"file://{tmp_path}/c.txt", 2)
    assert m.centers.tolist() == [[1, 2], [3, 4]]
    with pytest.raises(ValueError):
        KMeans(9).load(spark, f"file://{tmp_path}/c.txt", 2)


def test_buffer_and_flush(spark):
    group = TableGroup(spark, workers=2)
    t = group.create_table("w", TableConfig(staleness=1))
    b = ThreadBuffer(t, 0)
    b.inc(1, 2, 0.5)
    b.inc(1, 2, 0.25)
    b.batch_inc(1, UpdateBatch([4], [1.0]))
    b.dense_batch_inc(1, DenseUpdateBatch(4, [1.0, 2.0]))
    assert b.get(1) == {2: 0.75, 4: 2.0, 5: 2.0} and t.snapshot().count() == 0
    b.flush()
    assert {r["col_id"]: r["value"] for r in t.get(1).collect()} == {2: 0.75, 4: 2.0, 5: 2.0} and not b.cells
    for i in range(50):
        t.inc(3, i, 1.0, worker=1)
    assert len(t.waiting) == 50 and t.get(3).count() == 50 and not t.waiting
    assert t.row_type == "SparseRow"


def test_controllers_follow_the_configuration(spark):
    kinds = [(TableConfig(consistency=Consistency.SSP_PUSH), PushController), (TableConfig(consistency=Consistency.SSP_AGGR), AggregateController), (TableConfig(consistency=Consistency.SSP_AGGR, by_value=True), AggregateByValueController)]
    group = TableGroup(spark, workers=1)
    for i, (config, kind) in enumerate(kinds):
        assert type(group.create_table(str(i), config).controller) is kind
    t = group.create_table("small", TableConfig(consistency=Consistency.SSP_AGGR, order="magnitude", push_budget_kb=0.009))
    for row, delta in ((1, 1.0), (2, 5.0), (3, 3.0)):
        t.inc(row, 0, delta)
    assert {r["row_id"] for r in t.to_send(1).collect()} == {2, 3}
    late = group.create_table("late", TableConfig(own_writes="deferred"))
    late.inc(1, 1, 1.0)
    assert late.snapshot(worker=0).count() == 0 and late.snapshot().count() == 1


def test_layers_round_trip_and_text(spark, tmp_path):
    w, b = [np.array([[1.5, -2.0], [0.1, 3.0]]), np.array([[0.25, 4.0]])], [np.array([1.0, 2.0]), np.array([-1.0])]
    write_layers(spark, w, b, f"file://{tmp_path}/m")
    got = read_layers(spark, f"file://{tmp_path}/m", 2)
    assert all((x == y).all() for a, c in zip(got, (w, b)) for x, y in zip(a, c))
    text = kaldi_text(w, b)
    assert text.count("<AffineTransform>") == 2 and "<Sigmoid> 2 2" in text and "<Softmax> 1 1" in text
    write_stats({"b": 2, "a": 1}, f"file://{tmp_path}/stats", spark)
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/stats").collect()] == ["a: 1", "b: 2"]
    for c in range(2):
        (tmp_path / f"train.{c}").write_text(f"x{c}\n")
    lines = read_client_files(spark, f"file://{tmp_path}/train", 2).orderBy("client").collect()
    assert [tuple(r) for r in lines] == [(0, "x0"), (1, "x1")]


def test_range_join_against_brute_force(spark):
    from quern.operators.partition import draws, range_join

    points = spark.range(200).select((F.col("id") * 0.37 - 20).alias("p"))
    ranges = [(i, i * 3.0 - 25, i * 3.0 - 25 + (i % 5) * 2.5) for i in range(25)]
    got = range_join(points, spark.createDataFrame(ranges, "k int, b double, e double"), "p", "b", "e", 4.0)
    want = {(k, round(i * 0.37 - 20, 6)) for k, b, e in ranges for i in range(200) if b <= i * 0.37 - 20 < e}
    assert {(r["k"], round(r["p"], 6)) for r in got.collect()} == want and got.count() == len(want)
    d = [r["idx"] for r in draws(spark, 10, 500, 3).collect()]
    assert set(d) == set(range(10)) and len(d) == 500
