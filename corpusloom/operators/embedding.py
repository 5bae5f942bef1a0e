"""Vectors from a pluggable model, on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Takes a list of texts, or of image bytes, and gives a matrix.
Model = Callable[[list], np.ndarray]


def embed(df: DataFrame, factory: Callable[[], Model], id_col: str, input_col: str, *, batch_size: int = 256, half: bool = False) -> DataFrame:
    """(id, embedding) of every row with an input; null inputs have null vectors.

    ``factory`` loads the model once in each worker task; devices are its
    business.  ``half`` rounds vectors to half precision.  Rows stay where they
    are, batches are cut to ``batch_size``.
    """
    kind = np.float16 if half else np.float32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            for k in range(0, len(batch), batch_size):
                part = batch.iloc[k : k + batch_size]
                out = pd.Series([None] * len(part), index=part.index, dtype=object)
                given = part[input_col].notna()
                if given.any():
                    model = model or factory()
                    out[given] = pd.Series(list(np.asarray(model(part[input_col][given].tolist()), kind).astype(np.float32)), index=part.index[given], dtype=object)
                yield pd.DataFrame({id_col: part[id_col], "embedding": out})

    return df.select(id_col, input_col).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, embedding array<float>")


def embed_in_shards(rows: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str, *, id_col: str = "row_id", shard_rows: int = 8192, shards_per_job: int = 64) -> int:
    """Encodes the rows whose id is not in the table at ``path`` yet; returns how many jobs that took.

    A shard is a folder of ``shard_rows`` consecutive ids (a long column), and a
    job appends ``shards_per_job`` of them at once or not at all: a run that was
    killed goes on with the job that it was in.  ``encode`` gives (id, ...).
    """
    try:
        rows = rows.join(rows.sparkSession.read.parquet(path).select(id_col).distinct(), id_col, "left_anti")
    except AnalysisException:
        pass  # nothing is there yet
    shard = F.floor(F.col(id_col) / shard_rows).cast("long")
    numbers = sorted(r[0] for r in rows.select(shard.alias("shard")).distinct().collect())  # a number for each shard
    for k in range(0, len(numbers), shards_per_job):
        low, high = numbers[k] * shard_rows, (numbers[min(k + shards_per_job, len(numbers)) - 1] + 1) * shard_rows
        part = rows.where((F.col(id_col) >= low) & (F.col(id_col) < high))
        encode(part).withColumn("shard", shard).repartition("shard").write.mode("append").partitionBy("shard").parquet(path)
    return -(-len(numbers) // shards_per_job)
