"""Readers of the text and binary layouts, as DataFrames of declared types."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def parse_libsvm(line: Column, one_based_ids: bool = False, one_based_labels: bool = False) -> tuple[Column, Column, Column]:
    """label (double), ids (array<int>) and vals (array<float>) of ``label id:val ...``."""
    tokens = F.split(F.trim(line), r"\s+")
    pairs = F.transform(F.slice(tokens, F.lit(2), F.size(tokens) - 1), lambda t: F.split(t, ":"))
    label = tokens[0].cast("double") - (1 if one_based_labels else 0)
    ids = F.transform(pairs, lambda p: p[0].cast("int") - (1 if one_based_ids else 0))
    return label, ids, F.transform(pairs, lambda p: p[1].cast("float"))


def read_libsvm(spark: SparkSession, path: str, dim: int, one_based_ids: bool = False, one_based_labels: bool = False, num_data: int | None = None, snappy: bool = False) -> DataFrame:
    """label double, ids, vals, dim. Fewer than ``num_data`` records is an error; more are cut off (the file's contract)."""
    lines = read_snappy_lines(spark, path) if snappy else _lines(spark, path)
    label, ids, vals = parse_libsvm(F.col("value"), one_based_ids, one_based_labels)
    out = lines.select(label.alias("label"), ids.alias("ids"), vals.alias("vals"), F.lit(dim).alias("dim"))
    return take_exactly(out, num_data) if num_data else out


def take_exactly(df: DataFrame, n: int) -> DataFrame:
    if df.limit(n).count() < n:
        raise ValueError(f"fewer than {n} records")
    return df.limit(n)


def read_libsvm_meta(spark: SparkSession, path: str, train: bool = True) -> DataFrame:
    """A libsvm file by its ``.meta`` sidecar."""
    m = read_meta(spark, path + ".meta")
    n = int(m["num_train_this_partition"] if train and "num_train_this_partition" in m else m.get("num_test", m.get("num_data", 0)))
    return read_libsvm(spark, path, int(m["feature_dim"]), m.get("feature_one_based") == "1", m.get("label_one_based") == "1", n or None, m.get("snappy_compressed") == "1")


def read_meta(spark: SparkSession, path: str) -> dict[str, str]:
    """``key: value`` lines; a parameter file, not data."""
    return {k.strip(): v.strip() for k, _, v in (r["value"].partition(":") for r in _lines(spark, path).collect())}


def read_params(spark: SparkSession, path: str) -> dict[str, str]:
    """Ordered ``name: value`` hyper-parameters."""
    return read_meta(spark, path)


def read_snappy_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of whole-file raw snappy blocks; a block is one file and is held by one task."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame({"value": [x for x in _unsnappy(bytes(content)).decode().split("\n") if x.strip()]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "value string")


def _unsnappy(data: bytes) -> bytes:
    """Raw snappy needs its length, which stands in front as a varint."""
    import pyarrow as pa

    size, shift = 0, 0
    for byte in data:
        size |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            break
    return pa.Codec("snappy").decompress(data, decompressed_size=size, asbytes=True)


def read_dense_binary(spark: SparkSession, path: str, dim: int, one_based_labels: bool = False) -> DataFrame:
    """Records of an int32 label and ``dim`` float32 values: idx, label, features."""
    record = np.dtype([("label", "<i4"), ("x", "<f4", (dim,))])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                rows = np.frombuffer(bytes(content), record)
                for a in range(0, len(rows), 10_000):
                    part = rows[a : a + 10_000]
                    yield pd.DataFrame({"path": p, "idx": np.arange(a, a + len(part)), "label": part["label"] - int(one_based_labels), "features": list(part["x"])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, idx long, label int, features array<float>")


def read_matrix_text(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """Column-major tokens, one line a column: (col_id, values). Lines keep their order in a file by position."""
    numbered = _numbered(spark, path)
    out = numbered.select(F.col("idx").alias("col_id"), F.transform(F.split("value", r"\s+"), lambda t: t.cast("double")).alias("values"))
    return out.where(F.size("values") == rows)


def random_matrix(spark: SparkSession, rows: int, cols: int, low: float, high: float, seed: int = 0) -> DataFrame:
    """(col_id, values) uniform in [low, high), by hash."""
    from quern.operators.partition import uniform

    places = F.sequence(F.lit(0), F.lit(rows - 1))
    return spark.range(cols).select(F.col("id").alias("col_id"), F.transform(places, lambda i: uniform(seed, F.col("id"), i) * (high - low) + low).alias("values"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number. Line numbers need the lines before: counts by partition, then an offset each."""
    lines = _lines(spark, path).select("value", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    sizes = lines.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    from pyspark.sql.window import Window

    before = sizes.select("p", "first", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # a row a partition
    return lines.join(before, "p").select((F.col("before") + F.col("m") - F.col("first")).alias("idx"), "value")


def read_client_files(spark: SparkSession, path: str, clients: int, shared: bool = False) -> DataFrame:
    """Lines of every client's own file ``path.<client>``, or of the one file that all share: client, value."""
    if shared:
        return _lines(spark, path).select(F.lit(-1).alias("client"), "value")
    parts = [_lines(spark, f"{path}.{c}").select(F.lit(c).alias("client"), "value") for c in range(clients)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_points(spark: SparkSession, path: str, dim: int, one_based: bool = True) -> DataFrame:
    """K-means points: dense values, or ``label id:val ...``: point_id, features."""
    from quern.functions.vector import densify

    sparse = F.instr("value", ":") > 0
    _, ids, vals = parse_libsvm(F.col("value"), one_based)
    dense = F.transform(F.split("value", r"\s+"), lambda t: t.cast("double"))
    return _numbered(spark, path).select(F.col("idx").alias("point_id"), F.when(sparse, densify(ids, vals, dim)).otherwise(dense).alias("features"))


def read_metric_points(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``label count idx:val ...``: point_id, label, features."""
    from quern.functions.vector import densify

    tokens = F.split("value", r"\s+")
    pairs = F.transform(F.slice(tokens, F.lit(3), F.size(tokens) - 2), lambda t: F.split(t, ":"))
    ids, vals = F.transform(pairs, lambda p: p[0].cast("int")), F.transform(pairs, lambda p: p[1].cast("double"))
    return _numbered(spark, path).select(F.col("idx").alias("point_id"), tokens[0].cast("int").alias("label"), densify(ids, vals, dim).alias("features"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``x y`` zero-based row numbers."""
    t = F.split("value", r"\s+")
    return _lines(spark, path).select(t[0].cast("long").alias("x"), t[1].cast("long").alias("y"))


def read_mlp_rows(spark: SparkSession, path: str) -> DataFrame:
    """``label f1 f2 ...``: label, features."""
    t = F.split("value", r"\s+")
    return _lines(spark, path).select(t[0].cast("int").alias("label"), F.transform(F.slice(t, F.lit(2), F.size(t) - 1), lambda v: v.cast("double")).alias("features"))


def read_manifest(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """``path count`` lines; a list of files, not data."""
    return [(p, int(n)) for p, n in (r["value"].split() for r in _lines(spark, path).collect())]


def read_speech(spark: SparkSession, base: str, dim: int) -> DataFrame:
    """``base``.fea and ``base``.label, joined on the line number: idx, label, features."""
    f = _numbered(spark, base + ".fea").select("idx", F.transform(F.split("value", r"\s+"), lambda v: v.cast("double")).alias("features")).where(F.size("features") == dim)
    return f.join(_numbered(spark, base + ".label").select("idx", F.col("value").cast("int").alias("label")), "idx").select("idx", "label", "features")


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    t = F.split("value", r"\s+")
    return _lines(spark, path).select(t[0].cast("int").alias("id"), t[1].alias("ip"), t[2].cast("int").alias("port"))


def parse_tree(line: str, tree_id: int = 0) -> list[tuple[int, int, int, float, int]]:
    """A pre-order line of ``feature:split`` and ``-1:label`` tokens as heap-numbered nodes."""
    nodes, todo = [], [1]
    for token in line.split():
        a, b = token.split(":")
        at = todo.pop()
        if int(a) < 0:
            nodes.append((tree_id, at, -1, 0.0, int(float(b))))
        else:
            nodes.append((tree_id, at, int(a), float(b), -1))
            todo += [2 * at + 1, 2 * at]
    return nodes


def read_forest(spark: SparkSession, path: str) -> DataFrame:
    """One tree a line: tree_id, node_id, feature_id, split_val, leaf_val."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [n for i, v in zip(b["idx"], b["value"]) for n in parse_tree(v, int(i))]
            yield pd.DataFrame(rows, columns=["tree_id", "node_id", "feature_id", "split_val", "leaf_val"])

    return _numbered(spark, path).mapInPandas(parse, "tree_id int, node_id long, feature_id int, split_val double, leaf_val int")
