"""Principal components from moments of shards, which are kept and added to.

A shard's state is its count, mean and scatter.  Two states merge into that of
both together (Chan, Golub and LeVeque 1983), so new shards cost only themselves,
and the vectors are never read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.reduce import PcaState
from corpusloom.operators.rows import materialise

STATE = "n long, mean array<double>, scatter array<double>"
#: States that one task merges.
MERGED = 16


def _of(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    return len(x), mean, (x - mean).T @ (x - mean)


def merged(one: tuple[int, np.ndarray, np.ndarray], two: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    (n, a, s), (m, b, t) = one, two
    gap = b - a
    return n + m, a + gap * (m / (n + m)), s + t + np.outer(gap, gap) * (n * m / (n + m))


def _together(states: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Merged in pairs, so that sums of like sizes meet."""
    level = list(states)
    while len(level) > 1:
        level = [merged(*p) if len(p) == 2 else p[0] for p in (level[i : i + 2] for i in range(0, len(level), 2))]
    return level[0]


def _states(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for n, mean, scatter in zip(frame["n"], frame["mean"], frame["scatter"], strict=True):
        yield int(n), np.asarray(mean, float), np.asarray(scatter, float).reshape(len(mean), len(mean))


def _row(state: tuple[int, np.ndarray, np.ndarray]) -> dict:
    return {"n": state[0], "mean": state[1].tolist(), "scatter": state[2].ravel().tolist()}


def shard_moments(df: DataFrame, vector_col: str, shard_col: str) -> DataFrame:
    """(shard, n, mean, scatter): one row for each value of ``shard_col``; null vectors are left out.

    A task adds up what it reads of each shard, so that a shard of any size
    leaves it as one row.
    """
    rows = df.select(F.col(shard_col).alias("shard"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    kind = rows.schema["shard"].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = pa.schema([batch.schema.field("shard"), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("scatter", pa.list_(pa.float64()))])
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            names = batch.column("shard").dictionary_encode(null_encoding="encode")
            for code, name in enumerate(names.dictionary.to_pylist()):
                found = _of(x[names.indices.to_numpy() == code])
                held[name] = merged(held[name], found) if name in held else found
        if held:
            yield pa.RecordBatch.from_pylist([{"shard": k, **_row(v)} for k, v in held.items()], schema)

    parts = rows.mapInArrow(partial, f"shard {kind}, {STATE}")

    def join(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"shard": key[0], **_row(_together(_states(frame)))}])

    return parts.groupBy("shard").applyInPandas(join, f"shard {kind}, {STATE}")


def merge(moments: DataFrame) -> DataFrame:
    """One row (n, mean, scatter) of all shards; MERGED of them meet in a task, round after round."""
    level = materialise(moments.select("n", "mean", "scatter", F.monotonically_increasing_id().alias("id")), "moments")
    while (count := level.count()) > 1:

        def join(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([_row(_together(_states(frame.sort_values("id"))))])

        group = F.pmod(F.xxhash64("id"), F.lit(-(-count // MERGED)))
        level = level.groupBy(group.alias("g")).applyInPandas(join, STATE)
        level = materialise(level.withColumn("id", F.monotonically_increasing_id()), "moments")
    return level.drop("id")


def pca_of(moments: DataFrame, n_components: int) -> PcaState:
    """The components that ``fit_pca`` finds in all vectors of the shards; the driver sees one row of the dimensions' square."""
    row = merge(moments).first()
    if row is None:
        raise ValueError("no vectors")
    mean = np.array(row["mean"])
    values, vectors = np.linalg.eigh(np.array(row["scatter"]).reshape(len(mean), -1) / max(row["n"] - 1, 1))
    k = min(n_components, len(mean), row["n"])
    components = vectors[:, ::-1][:, :k].T
    sign = np.sign(components[np.arange(k), np.abs(components).argmax(axis=1)])
    return PcaState(components * sign[:, None], mean, values[::-1][:k] / values.sum())
