"""Key words in texts by an index of character trigrams.

The index has a posting list of row ids for every trigram and block of rows, cut
by a hash of the trigram into folders, so that a search reads the lists of its own
trigrams alone.  The lists are intersected block by block, the shortest first;
what is left is verified in the texts, which are kept in folders by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block, and folders of the index.
BLOCK, FOLDERS = 32_768, 64
#: Trigrams of texts that a task holds before it makes their lists.
HELD = 4_000_000


def _codes(text: str) -> np.ndarray:
    """The different runs of three characters, each as one number of three times 21 bits."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:]) if len(points) > 2 else np.zeros(0, np.int64)


def _lists(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """(gram, block, ids): a part of a posting list for each trigram of some texts in one block of ``rows`` rows."""
    codes, ids, held = [], [], 0

    def cut() -> pa.RecordBatch:
        code, row = np.concatenate(codes), np.concatenate(ids)
        order = np.lexsort((row, code))
        code, row = code[order], row[order]
        block = row // rows
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
        points = np.stack([code[first] >> 42, (code[first] >> 21) & 0x1FFFFF, code[first] & 0x1FFFFF], 1).astype("<u4").tobytes()
        grams = [points[k : k + 12].decode("utf-32-le", "surrogatepass") for k in range(0, len(points), 12)]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(row))
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(block[first]), lists], names=["gram", "block", "ids"])

    for batch in batches:
        for row, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            own = _codes(text.as_py())
            if len(own):
                codes.append(own)
                ids.append(np.full(len(own), row, np.int64))
                held += len(own)
            if held >= HELD:
                yield cut()
                codes, ids, held = [], [], 0
    if held:
        yield cut()


def _folder(gram: Column) -> Column:
    return F.pmod(F.crc32(gram), F.lit(FOLDERS)).cast("int")


def build(df: DataFrame, text: Column, path: str, order: str = "row_id") -> None:
    """Writes the postings of the lower-cased texts, and the rows themselves by block.

    A posting list has at most BLOCK ids.  Null texts have no trigram.
    """
    block = F.floor(F.col(order) / BLOCK).cast("long")
    each = df.select(F.col(order).cast("long").alias("id"), F.lower(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    # what is shuffled are parts of lists, not a row for each trigram of each text
    parts = each.mapInArrow(partial(_lists, rows=BLOCK), "gram string, block long, ids array<long>")
    ids = F.array_sort(F.flatten(F.collect_list("ids")))
    lists = parts.groupBy("gram", "block").agg(F.sum(F.size("ids")).cast("long").alias("n"), ids.alias("ids"))
    lists = lists.withColumn("folder", _folder(F.col("gram")))
    lists.repartition("folder", "block").sortWithinPartitions("folder", "gram").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    df.withColumn("__block", block).repartition("__block").sortWithinPartitions("__block", order).write.mode("overwrite").partitionBy("__block").parquet(f"{path}/rows")


def candidates(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """(block, id) of the rows that have every trigram of the needle, which has three characters at least."""
    wanted = needle.strip().lower()
    grams = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
    folders = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder(F.col("gram"))).distinct().collect()]  # at most a folder for each trigram
    lists = spark.read.parquet(f"{path}/postings").where(F.col("folder").isin(folders) & F.col("gram").isin(grams))
    shortest_first = F.array_sort(F.collect_list(F.struct("n", "ids")))
    together = lists.groupBy("block").agg(F.count("*").alias("lists"), shortest_first.alias("l")).where(F.col("lists") == len(grams))
    both = F.aggregate(F.slice("l", 2, len(grams)), F.get("l", F.lit(0))["ids"], lambda have, other: F.array_intersect(have, other["ids"]))
    return together.select("block", F.explode(both).alias("id"))


def search(spark: SparkSession, path: str, needle: str, text: Column, limit: int = 5000, order: str = "row_id") -> DataFrame:
    """The rows that ``search.keyword_search`` finds; needles under three characters read all texts."""
    rows = spark.read.parquet(f"{path}/rows")
    columns = [c for c in rows.columns if c != "__block"]
    wanted = needle.strip().lower()
    if not wanted:
        return rows.select(*columns).limit(0)
    if len(wanted) >= 3:
        found = candidates(spark, path, needle)
        rows = rows.join(found, (rows["__block"] == found["block"]) & (rows[order] == found["id"]), "left_semi")
    return rows.where(F.contains(F.lower(text), F.lit(wanted))).select(*columns).orderBy(order).limit(limit)
