"""Readers and writers: small files and round trips."""

import numpy as np
import pyarrow as pa
import pytest

from quern.sources import sinks
from quern.sources import text as T


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return f"file://{path}"


def test_libsvm_zero_and_one_based(spark, tmp_path):
    p = write(tmp_path / "a", ["1 0:1.5 3:2 ", "0 1:-1"])
    r = [tuple(x) for x in T.read_libsvm(spark, p, 4).collect()]
    assert r == [(1.0, [0, 3], [1.5, 2.0], 4), (0.0, [1], [-1.0], 4)]
    one = T.read_libsvm(spark, write(tmp_path / "b", ["2 1:1 4:2"]), 4, True, True).first()
    assert (one["label"], one["ids"]) == (1.0, [0, 3])
    with pytest.raises(ValueError):
        T.read_libsvm(spark, p, 4, num_data=3)


def test_meta_and_snappy(spark, tmp_path):
    body = b"1 1:1\n2 2:2\n"
    (tmp_path / "d").write_bytes(pa.Codec("snappy").compress(body, asbytes=True))
    write(tmp_path / "d.meta", ["num_train_this_partition: 2", "feature_dim: 3", "feature_one_based: 1", "label_one_based: 1", "snappy_compressed: 1"])
    assert [r["label"] for r in T.read_libsvm_meta(spark, f"file://{tmp_path}/d").collect()] == [0.0, 1.0]


def test_dense_binary(spark, tmp_path):
    a = np.zeros(3, np.dtype([("label", "<i4"), ("x", "<f4", (2,))]))
    a["label"], a["x"] = [1, 2, 3], [[1, 2], [3, 4], [5, 6]]
    (tmp_path / "b").write_bytes(a.tobytes())
    r = T.read_dense_binary(spark, f"file://{tmp_path}/b", 2).orderBy("idx").collect()
    assert [(x["label"], x["features"]) for x in r] == [(1, [1, 2]), (2, [3, 4]), (3, [5, 6])]


def test_other_texts(spark, tmp_path):
    m = T.read_matrix_text(spark, write(tmp_path / "m", ["1 2", "3 4"]), 2).orderBy("col_id").collect()
    assert [r["values"] for r in m] == [[1, 2], [3, 4]]
    p = T.read_points(spark, write(tmp_path / "p", ["+1 1:5 2:6 ", "7 8"]), 2).orderBy("point_id").collect()
    assert [r["features"] for r in p] == [[5, 6], [7, 8]]
    d = T.read_metric_points(spark, write(tmp_path / "q", ["3 2 0:1 2:4"]), 3).first()
    assert (d["label"], d["features"]) == (3, [1, 0, 4])
    assert [tuple(r) for r in T.read_pairs(spark, write(tmp_path / "x", ["0 1", "2 3"])).collect()] == [(0, 1), (2, 3)]
    assert T.read_mlp_rows(spark, write(tmp_path / "r", ["4 0.5 1"])).first()["features"] == [0.5, 1]
    write(tmp_path / "s.fea", ["1 2", "3 4"]), write(tmp_path / "s.label", ["0", "1"])
    assert [r["label"] for r in T.read_speech(spark, f"file://{tmp_path}/s", 2).orderBy("idx").collect()] == [0, 1]
    assert T.read_manifest(spark, write(tmp_path / "l", ["a.txt 5"])) == [("a.txt", 5)]
    assert T.read_hosts(spark, write(tmp_path / "h", ["0 10.0.0.1 80"])).first()["port"] == 80


def test_round_trips(spark, tmp_path):
    w = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.5])], "label int, weights array<double>")
    sinks.write_weights(w, f"file://{tmp_path}/w", 2, 2)
    assert [r["weights"] for r in sinks.read_weights(spark, f"file://{tmp_path}/w").orderBy("label").collect()] == [[1, 2], [3, 4.5]]
    f = spark.createDataFrame([(0, [1e-9, 2.0])], "row_id int, values array<double>")
    sinks.write_factor(f, f"file://{tmp_path}/f")
    assert sinks.read_factor(spark, f"file://{tmp_path}/f").first()["values"] == [0, 2]
    forest = T.read_forest(spark, write(tmp_path / "t", ["0:1.5 -1:2 1:0.5 -1:0 -1:1", "-1:3"]))
    sinks.write_forest(forest, f"file://{tmp_path}/g")
    assert sorted(r["value"] for r in spark.read.text(f"file://{tmp_path}/g").collect()) == ["-1:3", "0:1.5 -1:2 1:0.5 -1:0 -1:1"]
