"""Helpers for jobs that have to survive lost executors."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.rows import run_dir

FILES_PER_CORE = 8
#: Whether Spark deletes a query's shuffle files when the query has ended, not when the driver collects its garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, *, compact: bool = False) -> DataFrame:
    """Writes ``df`` once as a table in the shared folder and reads it back.

    This cuts the lineage as ``checkpoint()`` does, but computes the plan only
    once, and the result is column-pruned when it is read.  ``compact`` is for
    what comes out of a shuffle: FILES_PER_CORE files for each core, or a quarter
    of the shuffle partitions if that is more, so that many partitions do not
    become as many small files and no task has to read more than a few of them.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    files = max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, partitions(spark) // 4)
    (df.coalesce(files) if compact else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rewritten(df: DataFrame, label: str, spent: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """``df`` as a written table, and its path; then the files of its shuffles and the tables at ``spent``, which only ``df`` may read, are deleted.

    So a job in many steps holds the tables and shuffles of one step at a time.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    for old in spent:
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.read.schema(df.schema).parquet(path), path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with underscores added until no column of ``df`` has them in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; no other column is read."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def portions(batch: pa.RecordBatch, column: str, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with about ``size`` bytes of text, so that no task holds the Python objects of a whole batch."""
    held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(held, (held[at - 1] if at else 0) + size)) + 1
        yield batch.slice(at, stop - at)
        at = stop


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives memory back at the end of a task: Python workers are reused, and what they keep adds up on an executor."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return tidied
