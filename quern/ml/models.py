"""Trainers: each clock is one distributed pass; models are small arrays, broadcast by closure."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.ml.base import Solver, matrix, sum_arrays, sum_partitions
from quern.operators.partition import uniform


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class KMeans:
    """Mini-batch k-means: in each cluster the points of a batch move the centre in order with rate lambda / (n + lambda);
    the workers' moves are merged by their share of assigned points."""

    def __init__(self, k: int, learning_rate: float = 1.0, seed: int = 0):
        self.k, self.rate, self.seed = k, learning_rate, seed
        self.centers: np.ndarray | None = None
        self.counts = np.zeros(k)

    def init(self, points: DataFrame) -> None:
        """``k`` points by hash."""
        rows = points.orderBy(F.xxhash64(F.lit(self.seed), "point_id")).limit(self.k).select("features").collect()
        self.centers = np.array([r["features"] for r in rows], float)

    def load(self, spark, path: str, dim: int) -> None:
        """Centres from a file of points, a line each."""
        from quern.sources.text import read_points

        rows = read_points(spark, path, dim).orderBy("point_id").limit(self.k).collect()
        if len(rows) < self.k:
            raise ValueError(f"{path} has {len(rows)} centres, {self.k} are needed")
        self.centers = np.array([r["features"] for r in rows], float)

    @staticmethod
    def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)
        at = d.argmin(axis=1)  # the first of equal minima
        return at, d[np.arange(len(x)), at]

    def assign(self, points: DataFrame) -> DataFrame:
        centers = self.centers

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    at, d = KMeans.nearest(matrix(b["features"]), centers)
                    yield pd.DataFrame({"point_id": b["point_id"], "cid": at.astype("int32"), "dist": d})

        return points.select("point_id", "features").mapInPandas(run, "point_id long, cid int, dist double")

    def objective(self, points: DataFrame) -> float:
        return self.assign(points).agg(F.sum("dist")).first()[0]

    def step(self, batch: DataFrame) -> None:
        """One clock: each partition is a worker, in order of point_id. Centres and counts are carried through its Arrow batches."""
        centers, counts, rate, k = self.centers, self.counts, self.rate, self.k

        def part(batches: Iterator[pd.DataFrame]) -> dict[str, np.ndarray]:
            moving, n = centers.astype(float), np.zeros(k)
            for b in batches:
                if not len(b):
                    continue
                x = matrix(b["features"])
                at, _ = KMeans.nearest(x, centers)
                for c in np.unique(at):
                    p = x[at == c]
                    eta = rate / (counts[c] + n[c] + np.arange(1, len(p) + 1) + rate)
                    keep = np.concatenate([np.cumprod((1 - eta)[::-1])[::-1][1:], [1.0]])
                    moving[c] = np.prod(1 - eta) * moving[c] + ((eta * keep)[:, None] * p).sum(0)
                    n[c] += len(p)
            return {"moved": (moving - centers) * n[:, None], "n": n}

        got = sum_partitions(batch.sortWithinPartitions("point_id"), ["point_id", "features"], part)
        if got:
            self.centers = centers + got["moved"] / np.maximum(got["n"], 1)[:, None]
            self.counts = counts + got["n"]

    def fit(self, points: DataFrame, clocks: int, share: float = 1.0) -> KMeans:
        if self.centers is None:
            self.init(points)
        for t in range(clocks):
            self.step(points if share >= 1 else points.where(uniform(self.seed + t + 1, F.col("point_id")) < share))
        return self


class LogisticRegression(Solver):
    """Binary labels 0 and 1. ``lam`` 0: plain gradient step of the batch; else weights also shrink by 1 - eta * lam."""

    def __init__(self, dim: int, lam: float = 0.0):
        self.w, self.lam = np.zeros(dim), lam

    def step(self, batch: DataFrame, eta: float) -> None:
        w = self.w

        def part(b: pd.DataFrame) -> dict[str, np.ndarray]:
            x = matrix(b["features"])
            return {"g": x.T @ (_sigmoid(x @ w) - b["label"].to_numpy(float))}

        got = sum_arrays(batch, ["label", "features"], part)
        self.w = w * (1 - eta * self.lam) - eta * got.get("g", np.zeros_like(w))

    def sequential(self, data: DataFrame, key: str, eta: float) -> None:
        """One pass in order, sample by sample, by one worker; for small data."""
        w0 = self.w

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            w = w0.copy()
            for x, y in zip(matrix(pdf.sort_values(key)["features"]), pdf.sort_values(key)["label"]):
                w -= eta * (_sigmoid(x @ w) - y) * x
            return pd.DataFrame({"i": np.arange(len(w)), "w": w})

        r = data.select(key, "label", "features").groupBy(F.lit(0).alias("worker")).applyInPandas(run, "i long, w double").orderBy("i").collect()
        self.w = np.array([x["w"] for x in r])

    def predict(self, data: DataFrame) -> DataFrame:
        """probability of 1, and prediction; 1/2 counts as 1."""
        w = self.w

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    p = _sigmoid(matrix(b["features"]) @ w)
                    yield pd.DataFrame({"label": b["label"].astype(float), "probability": p, "prediction": (p >= 0.5).astype("int32")})

        return data.select("label", "features").mapInPandas(run, "label double, probability double, prediction int")

    def loss(self, data: DataFrame) -> dict[str, float]:
        """zero_one (a probability of just 1/2 is an error either way), entropy, n, l2."""
        right = F.when(F.col("label") == 1, F.col("probability")).otherwise(1 - F.col("probability"))
        r = self.predict(data).select(right.alias("p")).agg(F.avg((F.col("p") <= 0.5).cast("int")).alias("e"), F.avg(-F.log(F.greatest("p", F.lit(1e-15)))).alias("h"), F.count("p").alias("n")).first()
        return {"zero_one": r["e"], "entropy": r["h"], "n": r["n"], "l2": 0.5 * self.lam * float(self.w @ self.w)}


class SoftmaxRegression(Solver):
    def __init__(self, labels: int, dim: int):
        self.w = np.zeros((labels, dim))

    def step(self, batch: DataFrame, eta: float) -> None:
        w = self.w

        def part(b: pd.DataFrame) -> dict[str, np.ndarray]:
            x, y = matrix(b["features"]), b["label"].to_numpy(int)
            p = _softmax(x @ w.T)
            p[np.arange(len(y)), y] -= 1
            return {"g": p.T @ x}

        self.w = w - eta * sum_arrays(batch, ["label", "features"], part).get("g", np.zeros_like(w))

    def predict(self, data: DataFrame) -> DataFrame:
        w = self.w

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    p, y = _softmax(matrix(b["features"]) @ w.T), b["label"].to_numpy(int)
                    yield pd.DataFrame({"label": y.astype("int32"), "probability": p[np.arange(len(y)), y], "prediction": p.argmax(1).astype("int32")})

        return data.select("label", "features").mapInPandas(run, "label int, probability double, prediction int")

    def loss(self, data: DataFrame) -> dict[str, float]:
        r = self.predict(data).agg(F.avg((F.col("label") != F.col("prediction")).cast("int")).alias("e"), F.avg(-F.log(F.greatest("probability", F.lit(1e-15)))).alias("h"), F.count("label").alias("n")).first()
        return {"zero_one": r["e"], "entropy": r["h"], "n": r["n"]}


def train(solver: Solver, data: DataFrame, epochs: int, batches: int, eta: float, decay: float = 1.0, test: DataFrame | None = None, seed: int = 0) -> pd.DataFrame:
    """Epochs of mini-batches by hash; one row of losses an epoch."""
    import time

    rows, began = [], time.time()
    numbered = data.withColumn("_batch", F.floor(uniform(seed, F.col("key")) * batches))
    for e in range(epochs):
        for b in range(batches):
            solver.step(numbered.where(F.col("_batch") == b), eta * decay**e)
        a, t = solver.loss(data), solver.loss(test) if test is not None else {}
        rows.append((e, float(e + 1), float((e + 1) * batches), a["zero_one"], a["entropy"], float(a["n"]), t.get("zero_one"), float(t.get("n", 0)), time.time() - began))
    return pd.DataFrame(rows, columns=["eval", "epoch", "batch", "zero_one", "entropy", "n_train", "test_zero_one", "n_test", "time"])


def make_solver(labels: int, dim: int, lam: float = 0.0) -> Solver:
    return LogisticRegression(dim, lam) if labels == 2 else SoftmaxRegression(labels, dim)


class MatrixFactorization:
    """X (m x n, one column a row of ``columns``) as R (m x k) times L (k x n), both in [0, 1e5]; L stays with its columns."""

    def __init__(self, m: int, rank: int, seed: int = 0):
        self.r = np.random.default_rng(seed).random((m, rank))
        self.rank = rank

    def _columns(self, columns: DataFrame, steps: int, eta: float):
        r, k = self.r, self.rank

        def solve(x: np.ndarray, left: np.ndarray) -> np.ndarray:
            for _ in range(steps):
                left = np.clip(left + 2 * eta * (x - left @ r.T) @ r, 0, 1e5)
            return left

        return solve, k

    def step(self, columns: DataFrame, eta_l: float, eta_r: float, iter_l: int = 1) -> DataFrame:
        """One clock over columns (col_id, values, left); their new ``left`` is returned, R is moved."""
        r = self.r
        solve, _ = self._columns(columns, iter_l, eta_l)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    b["left"] = list(solve(matrix(b["values"]), matrix(b["left"])))
                    yield b

        def part(b: pd.DataFrame) -> dict[str, np.ndarray]:
            x, left = matrix(b["values"]), matrix(b["left"])
            return {"g": 2 * eta_r * (x - left @ r.T).T @ left, "n": np.ones(1) * len(b)}

        out = columns.select("col_id", "values", "left").mapInPandas(run, "col_id long, values array<double>, left array<double>")
        from quern.operators.table import TableGroup

        out = TableGroup(columns.sparkSession).cut(out)
        got = sum_arrays(out, ["values", "left"], part)
        self.r = np.clip(r + got["g"] / got["n"][0], 0, 1e5)
        return out

    def objective(self, columns: DataFrame) -> float:
        r = np.clip(self.r, 0, None)
        got = sum_arrays(columns, ["values", "left"], lambda b: {"e": np.array([((matrix(b["values"]) - matrix(b["left"]) @ r.T) ** 2).sum(), len(b)])})
        return got["e"][0] / got["e"][1]


class SparseCoding:
    """min |X - B S|^2 + lam |S|_1 with |B_k|^2 at most c."""

    def __init__(self, m: int, atoms: int, lam: float = 0.1, c: float = 1.0, seed: int = 0):
        self.b = np.random.default_rng(seed).standard_normal((m, atoms))
        self.lam, self.c = lam, c
        self._project()

    def _project(self) -> None:
        n = (self.b**2).sum(0)
        self.b = self.b * np.where(n > self.c, np.sqrt(self.c / np.maximum(n, 1e-300)), 1.0)

    def step(self, columns: DataFrame, eta_s: float, eta_b: float, iter_s: int = 1) -> DataFrame:
        """One clock over columns (col_id, values, code)."""
        basis, lam = self.b, self.lam

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x, s = matrix(b["values"]), matrix(b["code"])
                    for _ in range(iter_s):
                        s = s + 2 * eta_s * (x - s @ basis.T) @ basis
                        s = np.sign(s) * np.maximum(np.abs(s) - eta_s * lam, 0)
                    b["code"] = list(s)
                    yield b

        from quern.operators.table import TableGroup

        out = TableGroup(columns.sparkSession).cut(columns.select("col_id", "values", "code").mapInPandas(run, "col_id long, values array<double>, code array<double>"))

        def part(b: pd.DataFrame) -> dict[str, np.ndarray]:
            x, s = matrix(b["values"]), matrix(b["code"])
            return {"g": 2 * eta_b * (x - s @ basis.T).T @ s, "n": np.ones(1) * len(b)}

        got = sum_arrays(out, ["values", "code"], part)
        self.b = basis + got["g"] / got["n"][0]
        self._project()
        return out

    def objective(self, columns: DataFrame) -> float:
        basis, lam = self.b, self.lam
        got = sum_arrays(columns, ["values", "code"], lambda b: {"e": np.array([((matrix(b["values"]) - matrix(b["code"]) @ basis.T) ** 2).sum() + lam * np.abs(matrix(b["code"])).sum(), len(b)])})
        return got["e"][0] / got["e"][1]


class MetricLearning:
    """L (p x d): similar pairs are drawn together, dissimilar ones pushed past ``threshold``. ``lam`` weighs the latter in
    gradient and loss; ``plain_gradient`` leaves it out of the gradient."""

    def __init__(self, p: int, d: int, lam: float = 1.0, threshold: float = 1.0, plain_gradient: bool = False, seed: int = 0):
        self.l = np.random.default_rng(seed).integers(0, 1000, (p, d)) / 1000 / 2000
        self.lam, self.threshold, self.plain = lam, threshold, plain_gradient

    def step(self, pairs: DataFrame, eta: float) -> None:
        """``pairs``: x, y (vectors) and similar (boolean)."""
        lm, thr, lam = self.l, self.threshold, 1.0 if self.plain else self.lam

        def part(b: pd.DataFrame) -> dict[str, np.ndarray]:
            d = matrix(b["x"]) - matrix(b["y"])
            ld = d @ lm.T
            same = b["similar"].to_numpy(bool)
            w = np.where(same, 1.0, np.where((ld**2).sum(1) <= thr, -lam, 0.0))
            return {"g": (ld * w[:, None]).T @ d, "n": np.ones(1) * len(b)}

        got = sum_arrays(pairs, ["x", "y", "similar"], part)
        self.l = lm - 2 * eta / got["n"][0] * got["g"]

    def loss(self, pairs: DataFrame) -> float:
        lm, thr, lam = self.l, self.threshold, self.lam

        def part(b: pd.DataFrame) -> dict[str, np.ndarray]:
            dist = (((matrix(b["x"]) - matrix(b["y"])) @ lm.T) ** 2).sum(1)
            s = b["similar"].to_numpy(bool)
            return {"e": np.array([dist[s].sum(), s.sum(), np.maximum(thr - dist[~s], 0).sum(), (~s).sum()])}

        e = sum_arrays(pairs, ["x", "y", "similar"], part)["e"]
        return e[0] / max(e[1], 1) + lam * e[2] / max(e[3], 1)


class Perceptron(Solver):
    """Sigmoid hidden layers, softmax output; ``sizes``: units of every layer."""

    def __init__(self, sizes: list[int], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w = [rng.uniform(-0.1, 0.1, (b, a)) for a, b in zip(sizes, sizes[1:])]
        self.b = [rng.uniform(-0.1, 0.1, b) for b in sizes[1:]]

    @staticmethod
    def forward(w, b, x: np.ndarray) -> list[np.ndarray]:
        z = [x]
        for i, (wi, bi) in enumerate(zip(w, b)):
            a = z[-1] @ wi.T + bi
            z.append(_softmax(a) if i == len(w) - 1 else _sigmoid(a))
        return z

    def step(self, batch: DataFrame, eta: float) -> None:
        w, bias = self.w, self.b

        def part(f: pd.DataFrame) -> dict[str, np.ndarray]:
            z, y = Perceptron.forward(w, bias, matrix(f["features"])), f["label"].to_numpy(int)
            delta = z[-1].copy()
            delta[np.arange(len(y)), y] -= 1
            out = {"n": np.ones(1) * len(y)}
            for i in range(len(w) - 1, -1, -1):
                out[f"w{i}"], out[f"b{i}"] = delta.T @ z[i], delta.sum(0)
                delta = (delta @ w[i]) * z[i] * (1 - z[i])
            return out

        got = sum_arrays(batch, ["label", "features"], part)
        if got:
            self.w = [x - eta / got["n"][0] * got[f"w{i}"] for i, x in enumerate(w)]
            self.b = [x - eta / got["n"][0] * got[f"b{i}"] for i, x in enumerate(bias)]

    def predict(self, data: DataFrame) -> DataFrame:
        w, bias = self.w, self.b

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in batches:
                if len(f):
                    p, y = Perceptron.forward(w, bias, matrix(f["features"]))[-1], f["label"].to_numpy(int)
                    yield pd.DataFrame({"label": y.astype("int32"), "probability": p[np.arange(len(y)), y], "prediction": p.argmax(1).astype("int32")})

        return data.select("label", "features").mapInPandas(run, "label int, probability double, prediction int")

    def loss(self, data: DataFrame) -> dict[str, float]:
        r = self.predict(data).agg(F.avg((F.col("label") != F.col("prediction")).cast("int")).alias("e"), F.avg(-F.log(F.greatest("probability", F.lit(1e-10)))).alias("h"), F.count("label").alias("n")).first()
        return {"zero_one": r["e"], "entropy": r["h"], "n": r["n"]}


def affine_frames(frames: DataFrame, transform: np.ndarray) -> DataFrame:
    """Frames (idx, features) times a matrix whose last column is the shift."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["features"] = list(matrix(b["features"]) @ transform[:, :-1].T + transform[:, -1])
                yield b

    return frames.select("idx", "features").mapInPandas(run, "idx long, features array<double>")


def class_prior(data: DataFrame) -> DataFrame:
    n = data.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("label", "n", (F.col("n") / F.col("total")).alias("prior"))  # one row


# -- random forest: each tree is one group, as rows are sub-sampled for it once
def _entropy(counts: np.ndarray) -> float:
    p = counts / counts.sum()
    p = p[p >= 1e-5]
    return float(-(p * np.log2(p)).sum())


def gain_ratio(values: np.ndarray, labels: np.ndarray, threshold: float, classes: int) -> float:
    left = values <= threshold
    n, a = len(values), left.sum()
    if a in (0, n):
        return 0.0
    split = _entropy(np.array([a, n - a]))
    count = partial(np.bincount, minlength=classes)
    gain = _entropy(count(labels)) - a / n * _entropy(count(labels[left])) - (n - a) / n * _entropy(count(labels[~left]))
    return gain / split if split > 0 else 0.0


def grow_tree(x: np.ndarray, y: np.ndarray, classes: int, rng: np.random.Generator, max_depth: int, features_per_split: int) -> dict[int, tuple[int, float, int]]:
    """Heap-numbered nodes (feature, split, leaf). Depth 0 is unlimited; a feature is used once on a path."""
    nodes: dict[int, tuple[int, float, int]] = {}

    def grow(at: int, rows: np.ndarray, features: list[int], depth: int) -> None:
        counts = np.bincount(y[rows], minlength=classes)
        leaf = int(counts.argmax())
        if (max_depth and depth >= max_depth - 1) or not features or counts.max() == len(rows):
            nodes[at] = (-1, 0.0, leaf)
            return
        some = sorted(rng.choice(features, min(features_per_split, len(features)), replace=False).tolist())
        best = (0.0, some[0], 0.0)
        for f in some:
            v = x[rows, f]
            for t in rng.uniform(v.min(), v.max(), len(np.unique(v))):
                g = gain_ratio(v, y[rows], t, classes)
                if g > best[0]:
                    best = (g, f, float(t))
        _, f, t = best
        left = x[rows, f] <= t
        nodes[at] = (f, t, -1)
        rest = [g for g in features if g != f]
        for child, part in ((2 * at, rows[left]), (2 * at + 1, rows[~left])):
            if len(part):
                grow(child, part, rest, depth + 1)
            else:
                nodes[child] = (-1, 0.0, leaf)

    grow(1, np.arange(len(y)), list(range(x.shape[1])), 0)
    return nodes


def train_forest(data: DataFrame, trees: int, classes: int, rows_per_tree: int, features_per_split: int, max_depth: int = 0, seed: int = 0) -> DataFrame:
    """tree_id, node_id, feature_id, split_val, leaf_val. ``data``: key, label, features.

    Rows go to a tree with probability rows_per_tree / n and a margin, by hash; the tree takes the first rows_per_tree of them.
    """
    n = data.count()
    share = min(1.0, 1.5 * rows_per_tree / max(n, 1) + 20 / max(n, 1))
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree_id")
    picked = data.select(tree, "key", "label", "features").withColumn("u", uniform(seed, F.col("tree_id"), F.col("key"))).where(F.col("u") < share)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree_id"].iloc[0])
        pdf = pdf.sort_values(["u", "key"]).head(rows_per_tree)
        nodes = grow_tree(matrix(pdf["features"]), pdf["label"].to_numpy(int), classes, np.random.default_rng([seed, t]), max_depth, features_per_split)
        return pd.DataFrame([(t, i, *v) for i, v in nodes.items()], columns=["tree_id", "node_id", "feature_id", "split_val", "leaf_val"])

    return picked.groupBy("tree_id").applyInPandas(run, "tree_id int, node_id long, feature_id int, split_val double, leaf_val int")


def predict_forest(data: DataFrame, forest: DataFrame, classes: int) -> DataFrame:
    """key, label, prediction by votes; ties go to the lowest label. The forest's size does not depend on the data."""
    trees: dict[int, dict[int, tuple[int, float, int]]] = {}
    for r in forest.collect():
        trees.setdefault(r["tree_id"], {})[r["node_id"]] = (r["feature_id"], r["split_val"], r["leaf_val"])

    def vote(nodes: dict[int, tuple[int, float, int]], x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), int)
        todo = [(1, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            f, t, leaf = nodes[at]
            if f < 0:
                out[rows] = leaf
            else:
                left = x[rows, f] <= t
                todo += [(c, r) for c, r in ((2 * at, rows[left]), (2 * at + 1, rows[~left])) if len(r)]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = matrix(b["features"])
                votes = np.zeros((len(b), classes), int)
                for nodes in trees.values():
                    votes[np.arange(len(b)), vote(nodes, x)] += 1
                yield pd.DataFrame({"key": b["key"], "label": b["label"].astype("int32"), "prediction": votes.argmax(1).astype("int32")})

    return data.select("key", "label", "features").mapInPandas(run, "key long, label int, prediction int")
