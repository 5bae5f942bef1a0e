"""Tables in buckets of a key, which later joins read as they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Writes a table of the warehouse in sorted buckets of ``key`` and reads it; an existing one is replaced.

    Tables with equally many buckets of the joined columns are joined without a
    shuffle of either.
    """
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def purity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, as ``neighbors.label_purity``: of edges kept by row_id and labels kept by row_id, only the edges move, once, to the neighbours."""
    own = edges.join(labels.select("row_id", F.col("label").alias("own")), "row_id").select("neighbor_id", "own")
    both = own.join(labels.select("row_id", "label"), F.col("neighbor_id") == F.col("row_id"))
    return both.agg(F.avg((F.col("own") == F.col("label")).cast("double")).alias("purity"))


def farthest(edges: DataFrame, coords: DataFrame) -> DataFrame:
    """(row_id, farthest): the distance of each row's farthest neighbour, by tables kept by row_id."""
    own = edges.select("row_id", "neighbor_id").join(coords.select("row_id", "x", "y", "z"), "row_id")
    other = coords.select(F.col("row_id").alias("other"), *[F.col(a).alias(f"o{a}") for a in "xyz"])
    apart = F.sqrt(sum((F.col(a) - F.col(f"o{a}")) * (F.col(a) - F.col(f"o{a}")) for a in "xyz"))
    return own.join(other, F.col("neighbor_id") == F.col("other")).groupBy("row_id").agg(F.max(apart).alias("farthest"))
