"""What the trainers share."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Solver(ABC):
    """init, step, predict and loss over a DataFrame of examples. The model is a few arrays on the driver."""

    @abstractmethod
    def step(self, batch: DataFrame, eta: float) -> None: ...

    @abstractmethod
    def predict(self, data: DataFrame) -> DataFrame: ...

    @abstractmethod
    def loss(self, data: DataFrame) -> dict[str, float]: ...


def sum_arrays(df: DataFrame, columns: list[str], part) -> dict[str, np.ndarray]:
    """``part`` maps each pandas batch to named arrays; their sums over all batches."""

    def each(batches: Iterator[pd.DataFrame]) -> dict[str, np.ndarray]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if len(b):
                for k, v in part(b).items():
                    total[k] = total[k] + v if k in total else np.asarray(v, float)
        return total

    return sum_partitions(df, columns, each)


def sum_partitions(df: DataFrame, columns: list[str], part) -> dict[str, np.ndarray]:
    """``part`` maps the pandas batches of a whole partition to named arrays; their sums over all partitions.

    Each task sends one row an array, of the model's size, and Spark adds them up before the driver sees any.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = part(batches)
        rows = [(k, i, float(x)) for k, v in total.items() for i, x in enumerate(np.ravel(v))]
        shapes = [(k + "#shape", i, float(s)) for k, v in total.items() for i, s in enumerate(np.shape(v))]
        yield pd.DataFrame(rows + shapes, columns=["name", "i", "x"])

    from pyspark.sql import functions as F

    out = df.select(*columns).mapInPandas(run, "name string, i long, x double")
    shape = F.col("name").endswith("#shape")
    r = out.groupBy("name", "i").agg(F.when(F.first(shape), F.max("x")).otherwise(F.sum("x")).alias("x")).toPandas()
    got = {n: g.sort_values("i")["x"].to_numpy() for n, g in r.groupby("name")}
    return {n: x.reshape([int(s) for s in got.get(n + "#shape", [])]) for n, x in got.items() if not n.endswith("#shape")}


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 0))
