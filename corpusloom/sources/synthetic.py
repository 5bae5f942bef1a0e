"""Synthetic embeddings and coordinates with known clusters, and the stub encoder."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.vectors import l2_normalize


def centres(n_clusters: int, dim: int, seed: int) -> np.ndarray:
    c = np.random.default_rng(seed).normal(size=(n_clusters, dim))
    return c / np.linalg.norm(c, axis=1, keepdims=True)


def make_embeddings(spark: SparkSession, n: int, dim: int = 768, n_clusters: int = 8, *, seed: int = 0, spread: float = 0.35, normalize: bool = True) -> DataFrame:
    """(row_id, label, embedding): unit centres plus noise of ``spread`` over all dimensions together.

    The noise of a row depends on seed and row only, so partitions do not matter.
    """
    centre = centres(n_clusters, dim, seed)
    sigma = spread / math.sqrt(dim)

    @F.pandas_udf("array<double>")
    def draw(ids: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([centre[c] + np.random.default_rng((seed, i)).normal(scale=sigma, size=dim) for i, c in zip(ids, labels, strict=True)], dtype=object)

    rows = spark.range(n).select(F.col("id").alias("row_id"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_clusters)).cast("int").alias("label"))
    vector = draw("row_id", "label")
    return rows.select("row_id", "label", (l2_normalize(vector) if normalize else vector).alias("embedding"))


def make_coords(spark: SparkSession, n: int, n_clusters: int = 8, *, seed: int = 0, spread: float = 0.35) -> DataFrame:
    """(row_id, label, x, y, z): blobs around points of the unit sphere."""
    rows = make_embeddings(spark, n, 3, n_clusters, seed=seed, spread=spread, normalize=False)
    return rows.select("row_id", "label", *[F.col("embedding")[k].alias(a) for k, a in enumerate("xyz")])


def cluster_name(label: Column) -> Column:
    return F.format_string("cluster-%02d", label)


def make_title(name: Column, row_id: Column) -> Column:
    return F.format_string("%s #%06d", name, row_id)


def stub_vector(text: str, dim: int) -> np.ndarray:
    """A vector that depends on the text only; equal texts, up to case and outer blanks, have equal vectors."""
    start = hashlib.sha256(text.strip().lower().encode()).digest()[:8]
    return np.random.default_rng(int.from_bytes(start, "big")).normal(size=dim).astype(np.float32)


def stub_encoder(dim: int):
    """The stub as an Arrow UDF of a text column."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else stub_vector(t, dim) for t in texts], dtype=object)

    return encode
