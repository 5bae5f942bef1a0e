"""Resumable ingest with Structured Streaming.

A file source with a checkpoint does what an append-only journal does: a run
takes up what is new since the last one, and a killed run loses at most the
batch it was in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, source: str, schema: StructType | str, sink: str, checkpoint: str, *, transform: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_batch: int = 1000) -> None:
    """Appends what is new in ``source`` (Parquet files) to the Parquet table ``sink``, then stops."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    transform(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def embed_shards(spark: SparkSession, source: str, schema: StructType | str, sink: str, checkpoint: str, encoder, text_col: str = "text", id_col: str = "row_id") -> None:
    """Encodes new rows in batches; a batch is one shard folder, rewritten whole if it is run again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(id_col, encoder(F.col(text_col)).alias("embedding")).write.mode("overwrite").parquet(f"{sink}/shard={number:05d}")

    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Event counts and sums per window and type, for streams and tables alike."""
    at = F.col("ts").cast("timestamp")
    return events.withColumn("ts", at).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def place_prompts(spark: SparkSession, source: str, rows: DataFrame, encoder, sink: str, checkpoint: str, **options) -> None:
    """Places new prompts (query_id, text) in the layout ``rows``, a batch at a time; a batch is one folder."""
    from corpusloom.operators.placement import place

    def write(batch: DataFrame, number: int) -> None:
        place(batch.select("query_id", encoder(F.col("text")).alias("embedding")), rows, **options).write.mode("overwrite").parquet(f"{sink}/batch={number:05d}")

    spark.readStream.schema("query_id long, text string").parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
