"""PCA and UMAP.

PCA is MLlib's on centred vectors, with the sign of every component fixed.  UMAP
follows McInnes, Healy and Melville (2018): neighbours, their calibration and
the symmetric graph are DataFrames; the layout, which updates points one after
the other, is one numpy kernel over at most ``UmapSpec.max_points`` points.  Of
more rows so many are landmarks; the others are placed among them, each by an
optimisation of its own against the landmarks, in as many tasks as there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.vectors import l2_normalize
from corpusloom.operators.descent import descent_knn
from corpusloom.operators.neighbors import knn
from corpusloom.operators.rows import materialise


@dataclass(frozen=True)
class PcaState:
    """Components in rows; a projection is (x - mean) times their transpose."""

    components: np.ndarray
    mean: np.ndarray
    explained: np.ndarray

    def save(self, spark, path: str) -> None:
        rows = [(i, [float(v) for v in c], float(e)) for i, (c, e) in enumerate(zip(self.components, self.explained, strict=True))] + [(-1, [float(v) for v in self.mean], 0.0)]
        spark.createDataFrame(rows, "component int, weights array<double>, explained double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> PcaState:
        rows = spark.read.parquet(path).orderBy("component").collect()  # as many rows as components
        return cls(np.array([r["weights"] for r in rows[1:]]), np.array(rows[0]["weights"]), np.array([r["explained"] for r in rows[1:]]))


def fit_pca(df: DataFrame, vector_col: str, n_components: int) -> PcaState:
    """Centred PCA without whitening; the largest loading of every component is positive."""
    vectors = df.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("v"))
    mean = vectors.select(Summarizer.mean(F.col("v")).alias("m"), F.count("*").alias("n")).first()
    centre = np.array(mean["m"].toArray())
    k = min(n_components, len(centre), mean["n"])
    centred = df.select(array_to_vector(F.zip_with(F.col(vector_col).cast("array<double>"), F.array(*[F.lit(float(c)) for c in centre]), lambda x, m: x - m)).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(centred)
    components = model.pc.toArray().T
    sign = np.sign(components[np.arange(k), np.abs(components).argmax(axis=1)])
    return PcaState(components * sign[:, None], centre, np.array(model.explainedVariance.toArray()))


def apply_pca(df: DataFrame, state: PcaState, vector_col: str, out_col: str) -> DataFrame:
    """``df`` with the projected vectors; the state is small (dimensions by components) and goes with the tasks."""

    @F.pandas_udf("array<double>")
    def project(values: pd.Series) -> pd.Series:
        if values.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list((np.stack(values.to_numpy()).astype(float) - state.mean) @ state.components.T))

    return df.withColumn(out_col, project(F.col(vector_col)))


@dataclass(frozen=True)
class UmapSpec:
    neighbors: int = 40
    min_dist: float = 0.05
    epochs: int = 500
    dims: int = 3
    negatives: int = 5
    seed: int = 0
    #: Points that the layout kernel, one task, takes at most; of more, so many are its landmarks.
    max_points: int = 10_000


def _curve(min_dist: float) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^2b), fitted to the membership that falls from min_dist on (Gauss-Newton)."""
    x = np.linspace(1e-3, 3, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist)))
    a, b = 1.5, 0.9
    for _ in range(200):
        p = x ** (2 * b)
        f = 1 / (1 + a * p)
        j = np.stack([-p * f * f, -a * p * 2 * np.log(x) * f * f], axis=1)
        step = np.linalg.lstsq(j, y - f, rcond=None)[0]
        a, b = max(a + 0.5 * step[0], 1e-3), max(b + 0.5 * step[1], 1e-3)
    return float(a), float(b)


def _memberships(d: np.ndarray) -> np.ndarray:
    """Of the neighbours at these distances: 1 for the nearest, falling so that all sum up to the logarithm of their number."""
    rho = d[d > 0].min() if (d > 0).any() else 0.0
    low, high, sigma, goal = 0.0, np.inf, 1.0, np.log2(max(len(d), 2))
    for _ in range(64):
        total = np.exp(-np.maximum(d - rho, 0) / sigma).sum()
        if abs(total - goal) < 1e-5:
            break
        if total > goal:
            high = sigma
            sigma = (low + high) / 2
        else:
            low = sigma
            sigma = sigma * 2 if high == np.inf else (low + high) / 2
    sigma = max(sigma, 1e-3 * (d.mean() or 1.0))
    return np.exp(-np.maximum(d - rho, 0) / sigma)


def fuzzy_graph(near: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b: the symmetric membership graph of a neighbour table with distances as scores."""

    @F.pandas_udf("array<double>")
    def memberships(distances: pd.Series) -> pd.Series:
        return pd.Series([_memberships(np.asarray(d, float)) for d in distances])

    lists = near.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor_id", "score"))).alias("n"))
    weighted = lists.select("row_id", "n", memberships(F.transform("n", lambda s: s["score"])).alias("w"))
    edges = weighted.select("row_id", F.explode(F.arrays_zip(F.transform("n", lambda s: s["neighbor_id"]).alias("neighbor_id"), "w")).alias("e")).select("row_id", "e.neighbor_id", "e.w")
    both = edges.select(F.least("row_id", "neighbor_id").alias("a"), F.greatest("row_id", "neighbor_id").alias("b"), "w")
    return both.groupBy("a", "b").agg((F.sum("w") - F.when(F.count("*") > 1, F.product("w")).otherwise(0.0)).alias("weight"))


def _layout(start: np.ndarray, a_: np.ndarray, b_: np.ndarray, weight: np.ndarray, spec: UmapSpec) -> np.ndarray:
    """Stochastic gradient descent with negative samples; an edge is due in the epochs that its weight gives it."""
    rng = np.random.default_rng(spec.seed)
    y, (a, b) = start.copy(), _curve(spec.min_dist)
    heads, tails = np.r_[a_, b_], np.r_[b_, a_]
    share = np.r_[weight, weight] / weight.max()
    owed = np.zeros(len(heads))
    for epoch in range(spec.epochs):
        rate = 1.0 - epoch / spec.epochs
        owed += share
        due = np.flatnonzero(owed >= 1)
        owed[due] -= 1
        i, j = heads[due], tails[due]
        gap = y[i] - y[j]
        d2 = (gap * gap).sum(1)
        pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0)
        step = np.clip(pull[:, None] * gap, -4, 4)
        move = np.zeros_like(y)
        np.add.at(move, i, step)
        for _ in range(spec.negatives):
            k = rng.integers(0, len(y), len(i))
            gap = y[i] - y[k]
            d2 = (gap * gap).sum(1)
            push = np.where(i != k, 2 * b / ((0.001 + d2) * (1 + a * d2**b)), 0)
            np.add.at(move, i, np.clip(push[:, None] * gap, -4, 4))
        # edges of one epoch act together; points with many of them take their mean force
        y += rate * move / np.maximum(np.sqrt(np.bincount(i, minlength=len(y)))[:, None], 1)
    return y


def _drawn(row: np.ndarray, turn: int, n: int, seed: int) -> np.ndarray:
    """A number below n for each row and turn, the same in whatever task."""
    h = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((turn * 0xD6E8FEB86659FD93 + seed * 0xBF58476D1CE4E5B9) % 2**64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


def _settle(row: np.ndarray, near: np.ndarray, weight: np.ndarray, landmarks: np.ndarray, spec: UmapSpec) -> np.ndarray:
    """Positions of points among fixed landmarks: from the mean of their neighbours, by the layout's own forces."""
    a, b = _curve(spec.min_dist)
    y = (weight[:, :, None] * landmarks[near]).sum(1) / weight.sum(1)[:, None]
    share, owed = weight / weight.max(1, keepdims=True), np.zeros_like(weight)
    epochs = max(30, spec.epochs // 3)
    for epoch in range(epochs):
        owed += share
        due = owed >= 1
        owed[due] -= 1
        gap = y[:, None, :] - landmarks[near]
        d2 = (gap * gap).sum(2)
        pull = np.where(due & (d2 > 0), -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0)
        move = np.clip(pull[:, :, None] * gap, -4, 4).sum(1)
        times = due.sum(1)
        for turn in range(spec.negatives):
            gap = y - landmarks[_drawn(row, epoch * spec.negatives + turn, len(landmarks), spec.seed)]
            d2 = (gap * gap).sum(1)
            push = 2 * b / ((0.001 + d2) * (1 + a * d2**b))
            move += times[:, None] * np.clip(push[:, None] * gap, -4, 4)
        # as in the kernel; a landmark's forces come from both ends of its edges
        y += (1.0 - epoch / epochs) * move / np.maximum(np.sqrt(2 * times)[:, None], 1)
    return y


def _among(rest: DataFrame, landmarks: DataFrame, laid: DataFrame, spec: UmapSpec) -> DataFrame:
    """(row_id, x, y, z) of rows that are no landmarks; the landmarks' positions go with the tasks."""
    known = laid.orderBy("row_id").collect()  # max_points rows
    ids, at = np.array([r["row_id"] for r in known]), np.array([[r["x"], r["y"], r["z"]] for r in known])
    near = knn(landmarks, min(spec.neighbors, len(ids)), "row_id", "v", metric="euclidean", queries=rest)
    lists = near.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor_id", "score"))).alias("n")).select("row_id", F.transform("n", lambda s: s["neighbor_id"]).alias("near"), F.transform("n", lambda s: s["score"]).alias("apart"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column("row_id").to_numpy()
            near, apart = (batch.column(c).flatten().to_numpy().reshape(len(row), -1) for c in ("near", "apart"))
            weight = np.array([_memberships(d) for d in apart])
            y = _settle(row, np.searchsorted(ids, near), weight, at, spec)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), *[pa.array(y[:, k]) for k in range(3)]], names=["row_id", "x", "y", "z"])

    return lists.mapInArrow(settle, "row_id long, x double, y double, z double")


def umap(df: DataFrame, id_col: str, vector_col: str, spec: UmapSpec = UmapSpec(), near: DataFrame | None = None) -> DataFrame:
    """(id, x, y, z) of a three-dimensional UMAP layout of the vectors, started from their leading components.

    ``near`` are neighbours of all rows with distances, where a caller has them.
    Of more than ``spec.max_points`` rows the first so many in the order of a hash
    are landmarks: they are laid out together, the others one by one among them.
    """
    rows = materialise(df.select(F.col(id_col).cast("long").alias("row_id"), F.col(vector_col).alias("v")), "umap-rows")
    n = rows.count()
    if n <= spec.max_points:
        return _kernel(rows, n, spec, near).withColumnRenamed("row_id", id_col)
    chosen = rows.select("row_id").orderBy(F.xxhash64("row_id", F.lit(spec.seed)), "row_id").limit(spec.max_points)
    landmarks = materialise(rows.join(chosen, "row_id"), "landmarks")
    rest = rows.join(landmarks.select("row_id"), "row_id", "left_anti")
    laid = materialise(_kernel(landmarks, spec.max_points, spec), "landmark-layout")
    return laid.unionByName(_among(rest, landmarks, laid, spec)).withColumnRenamed("row_id", id_col)


def _kernel(rows: DataFrame, n: int, spec: UmapSpec, near: DataFrame | None = None) -> DataFrame:
    """(row_id, x, y, z) of at most max_points rows, in one task."""
    start = apply_pca(rows, fit_pca(rows, "v", spec.dims), "v", "p").select("row_id", "p")
    edges = fuzzy_graph(near.where(F.col("rank") <= spec.neighbors) if near is not None else knn(rows, min(spec.neighbors, n - 1), "row_id", "v", metric="euclidean"))

    def lay(_: tuple, points: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("row_id", ignore_index=True)
        p = np.stack(points["p"].to_numpy())
        p = np.pad(p, ((0, 0), (0, spec.dims - p.shape[1])))
        p = p / max(np.abs(p).max(), 1e-12) * 10 + np.random.default_rng(spec.seed).normal(scale=1e-4, size=p.shape)
        place = pd.Series(points.index, index=points["row_id"])
        links = links.sort_values(["a", "b"])
        y = _layout(p, place[links["a"]].to_numpy(), place[links["b"]].to_numpy(), links["weight"].to_numpy(), spec)
        return pd.DataFrame({"row_id": points["row_id"], "x": y[:, 0], "y": y[:, 1], "z": y[:, 2]})

    one = start.withColumn("all", F.lit(0)).groupBy("all").cogroup(edges.withColumn("all", F.lit(0)).groupBy("all"))
    return one.applyInPandas(lay, "row_id long, x double, y double, z double")


#: Rows up to which the shared graph is exact.
EXACT = 250_000


def neighbor_graph(df: DataFrame, k: int, id_col: str, vector_col: str, exact: int = EXACT) -> DataFrame:
    """A written table of k nearest rows by distance: exactly up to ``exact`` rows, by descent beyond."""
    n = df.count()
    k = min(k, n - 1)
    return materialise(knn(df, k, id_col, vector_col, metric="euclidean"), "graph") if n <= exact else descent_knn(df, k, id_col, vector_col, metric="euclidean")


def project(df: DataFrame, id_col: str, vector_col: str, components: int = 50, spec: UmapSpec = UmapSpec()) -> tuple[DataFrame, PcaState]:
    """L2 norm, PCA, UMAP, in this order; also returns the PCA for later vectors."""
    layout, state, _ = project_with_graph(df, id_col, vector_col, components, spec, None)
    return layout, state


def project_with_graph(df: DataFrame, id_col: str, vector_col: str, components: int, spec: UmapSpec, k: int | None) -> tuple[DataFrame, PcaState, DataFrame | None]:
    """As ``project``, with one neighbour graph in the reduced space (k rows or those of the layout, if more) for the layout and all that comes after."""
    unit = df.select(id_col, l2_normalize(F.col(vector_col)).alias("unit"))
    state = fit_pca(unit, "unit", components)
    reduced = apply_pca(unit, state, "unit", "reduced")
    graph = None
    if k is not None:
        reduced = materialise(reduced.select(id_col, "reduced"), "reduced")
        graph = neighbor_graph(reduced, max(k, spec.neighbors), id_col, "reduced")
    return umap(reduced, id_col, "reduced", spec, graph), state, graph
