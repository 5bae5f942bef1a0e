"""Contiguous shards of nearly equal bytes, by global prefix sums.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.runtime import materialise, partitions


def shard_by_bytes(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows are laid end to end in order of id (null ids first, ties by checksum
    and size).  A row goes to the shard in whose equal part of all bytes its
    first byte lies, so shards are contiguous and differ by less than the
    largest row; ``slot`` counts from 0 within a shard.

    Rows with equal texts are groups that may be larger than a shard, so this law
    does not keep them together: each copy goes where its id belongs, and a group
    of any size is dealt over the shards that its ids span.

    Texts are read once, for ids, sizes and checksums; only these are shuffled:
    they are range-partitioned and written once, so that the bounds, which Spark
    samples, hold for both of the following passes.  Totals per partition (one small row each) give every
    partition its offset; positions within a partition are a running sum.

    A null text has no bytes (size 1, checksum 0) and is not told from an empty
    one.  Repeated rows are placed one by one; which of two identical rows comes
    first does not show.  Further columns are ignored.  An empty table gives an
    empty one.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    rows = df.select(df[id_col].cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = materialise(rows, "shard-rows")
    n = partitions(df.sparkSession)
    dealt = rows.repartitionByRange(n, F.asc_nulls_first("doc_id"), "text_crc32", "size").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "shard-sizes")
    # as many rows as there are partitions
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_0"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.withColumns({"byte_n": F.sum("size").over(inside), "row_n": F.count("*").over(inside)})
        .join(F.broadcast(offsets), "part")
        .withColumn("start", F.col("byte_0") + F.col("byte_n") - F.col("size"))
        .withColumn("row", F.col("row_0") + F.col("row_n") - 1)
        .withColumn("shard", F.expr(f"cast(floor(cast(start as decimal(38, 0)) * {n_shards} / all_bytes) as int)"))
    )
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "shard-rows")
    first = placed.groupBy("shard").agg(F.min("row").alias("row_0"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("row_0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
