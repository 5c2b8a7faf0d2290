"""Writers of models, predictions, factors and losses. Each writes a folder of part files in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def write_weights(df: DataFrame, path: str, labels: int, dim: int) -> None:
    """``df``: label, weights. Two header lines, then ``id:val`` of each label; read_weights() reads it back."""
    spark = df.sparkSession
    body = F.array_join(F.transform("weights", lambda v, i: F.concat_ws(":", i.cast("string"), v.cast("string"))), " ")
    head = spark.createDataFrame([(-2, f"num_labels: {labels}"), (-1, f"feature_dim: {dim}")], "label long, value string")
    _write(head.unionByName(df.select(F.col("label").cast("long").alias("label"), body.alias("value"))).repartitionByRange(1, "label").sortWithinPartitions("label").select("value"), path)


def read_weights(spark, path: str) -> DataFrame:
    """label, weights; labels are numbered in order."""
    from quern.sources.text import _numbered

    lines = _numbered(spark, path).where(~F.col("value").startswith("num_labels") & ~F.col("value").startswith("feature_dim"))
    values = F.transform(F.split("value", r"\s+"), lambda t: F.split(t, ":")[1].cast("double"))
    return lines.select((F.col("idx") - 2).alias("label"), values.alias("weights"))


def write_losses(df: DataFrame, path: str) -> None:
    df.orderBy("eval").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_predictions(df: DataFrame, path: str, key: str, label: str = "prediction") -> None:
    """One label a line, in the order of ``key``."""
    _write(df.orderBy(key).select(F.col(label).cast("string").alias("value")), path)


def write_factor(df: DataFrame, path: str, key: str = "row_id", values: str = "values") -> None:
    """Tab-separated rows in order; magnitudes below 1e-5 are written as 0."""
    shown = F.array_join(F.transform(values, lambda v: F.when(F.abs(v) < 1e-5, F.lit("0")).otherwise(v.cast("string"))), "\t")
    _write(df.orderBy(key).select(shown.alias("value")), path)


def read_factor(spark, path: str) -> DataFrame:
    from quern.sources.text import _numbered

    return _numbered(spark, path).select(F.col("idx").alias("row_id"), F.transform(F.split("value", "\t"), lambda t: t.cast("double")).alias("values"))


def write_centers(centers: DataFrame, assignments: DataFrame, prefix: str) -> None:
    """``prefix``.centers with ``id:val`` lines and ``prefix``.assignment with ``point center`` lines."""
    body = F.array_join(F.transform("center", lambda v, i: F.concat_ws(":", i.cast("string"), v.cast("string"))), " ")
    _write(centers.orderBy("cid").select(body.alias("value")), prefix + ".centers")
    _write(assignments.orderBy("point_id").select(F.concat_ws(" ", F.col("point_id").cast("string"), F.col("cid").cast("string")).alias("value")), prefix + ".assignment")


def tree_line(nodes: dict[int, tuple[int, float, int]], at: int = 1) -> str:
    """Heap-numbered nodes (feature, split, leaf) as a pre-order line."""
    feature, split, leaf = nodes[at]
    return f"-1:{leaf}" if feature < 0 else f"{feature}:{split!r} {tree_line(nodes, 2 * at)} {tree_line(nodes, 2 * at + 1)}"


def write_forest(df: DataFrame, path: str) -> None:
    """One pre-order line a tree; a tree is one group."""
    import pandas as pd

    def line(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = {int(r.node_id): (int(r.feature_id), float(r.split_val), int(r.leaf_val)) for r in pdf.itertuples()}
        return pd.DataFrame({"tree_id": [int(pdf["tree_id"].iloc[0])], "value": [tree_line(nodes)]})

    _write(df.groupBy("tree_id").applyInPandas(line, "tree_id int, value string").orderBy("tree_id").select("value"), path)


def write_layers(spark, weights: list, biases: list, prefix: str) -> None:
    """Weights and biases of a perceptron: ``prefix``.weight<i> with a line a unit, ``prefix``.bias<i> with one a value."""
    for i, (w, b) in enumerate(zip(weights, biases)):
        rows = [(k, " ".join(repr(float(v)) for v in unit)) for k, unit in enumerate(w)]
        _write(spark.createDataFrame(rows, "k int, value string").orderBy("k").select("value"), f"{prefix}.weight{i}")
        _write(spark.createDataFrame([(k, repr(float(v))) for k, v in enumerate(b)], "k int, value string").orderBy("k").select("value"), f"{prefix}.bias{i}")


def read_layers(spark, prefix: str, layers: int) -> tuple[list, list]:
    """What write_layers() wrote, as arrays."""
    import numpy as np

    from quern.sources.text import _numbered

    def lines(path: str) -> list[str]:
        return [r["value"] for r in _numbered(spark, path).orderBy("idx").collect()]  # a model is small

    weights = [np.array([[float(v) for v in x.split()] for x in lines(f"{prefix}.weight{i}")]) for i in range(layers)]
    return weights, [np.array([float(x) for x in lines(f"{prefix}.bias{i}")]) for i in range(layers)]


def kaldi_text(weights: list, biases: list) -> str:
    """Layers as a text network: affine transforms, sigmoids between and a softmax at the end."""
    out = ["<Nnet>"]
    for i, (w, b) in enumerate(zip(weights, biases)):
        n, m = len(w), len(w[0])
        rows = "\n".join("  " + " ".join(repr(float(v)) for v in unit) for unit in w)
        out += [f"<AffineTransform> {n} {m}", " [", rows + " ]", " [ " + " ".join(repr(float(v)) for v in b) + " ]"]
        out.append(f"<Softmax> {n} {n}" if i == len(weights) - 1 else f"<Sigmoid> {n} {n}")
    return "\n".join([*out, "</Nnet>"]) + "\n"


def write_stats(stats: dict, path: str, spark) -> None:
    """Counters and timers of a job as ``name: value`` lines, in order of the names."""
    rows = [(f"{k}: {v}",) for k, v in sorted(stats.items())]
    _write(spark.createDataFrame(rows, "value string").orderBy("value").coalesce(1), path)
