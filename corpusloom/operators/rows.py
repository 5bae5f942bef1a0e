"""Dense row numbers over a global order without one task for all rows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Only used by sessions in one process, where the cluster names no shared folder.
LOCAL_DIR = "/tmp/corpusloom-checkpoints"


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables, in what driver and executors share (``spark.checkpoint.dir``)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = LOCAL_DIR
    return f"{named.rstrip('/')}/corpusloom-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Deletes the tables that this application has materialised; results that read them must have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dense_ids(df: DataFrame, *order: str, id_col: str = "row_id") -> DataFrame:
    """``df`` with 0, 1, 2, ... in the given order, which should decide every tie.

    Rows are range-partitioned and written once, as the sampled bounds have to
    hold for both passes; only a count per partition is then needed to turn a
    number within the partition into a global one.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "dealt")
    # one row per partition
    before = dealt.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__at", inside).join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + F.col("__at") - 1).cast("long").alias(id_col))


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, by an aggregate with partial sums instead of a sort of each group."""
    rest = [c for c in df.columns if c not in key and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("__first")
    return df.groupBy(*key).agg(best).select(*[F.col(c) if c in key else F.col("__first")[c].alias(c) for c in df.columns])
