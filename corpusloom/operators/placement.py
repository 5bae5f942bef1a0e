"""Placing query vectors in a layout by their nearest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.vectors import softmax_weights
from corpusloom.operators.neighbors import knn

NOTE = "the neighbours lie far apart; the position is not reliable"


def place(queries: DataFrame, rows: DataFrame, *, k: int = 12, radius: float | None = None, spread_limit: float = 0.55, temperature: float = 0.05) -> DataFrame:
    """One row per query: position, neighbours with similarities and weights, spread, verdict.

    ``queries`` has (query_id, embedding), ``rows`` (row_id, embedding, x, y, z).
    All queries go through one plan.  ``spread`` is the neighbours' mean distance
    from the position in units of the radius (default: of the farthest row).
    """
    if radius is None:
        radius = rows.agg(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))).first()[0] or 1.0
    near = knn(rows, k, "row_id", "embedding", queries=queries.select(((-F.col("query_id")) - 1).alias("row_id"), "embedding"))
    near = near.select((-F.col("row_id") - 1).alias("query_id"), "rank", "neighbor_id", F.col("score").alias("similarity"))
    near = near.join(rows.select(F.col("row_id").alias("neighbor_id"), "x", "y", "z"), "neighbor_id")
    own = Window.partitionBy("query_id")
    near = near.withColumn("weight", softmax_weights(F.col("similarity"), own, temperature))
    near = near.withColumns({f"p{a}": F.sum(F.col("weight") * F.col(a)).over(own) for a in "xyz"})
    apart = F.sqrt(sum((F.col(a) - F.col(f"p{a}")) * (F.col(a) - F.col(f"p{a}")) for a in "xyz"))
    listed = F.sort_array(F.collect_list(F.struct("rank", "neighbor_id", "similarity", "weight")))
    out = near.groupBy("query_id").agg(*[F.first(f"p{a}").alias(a) for a in "xyz"], (F.avg(apart) / radius).alias("spread"), listed.alias("n"))

    def part(field: str, name: str):
        return F.transform("n", lambda s: s[field]).alias(name)

    sure = F.col("spread") <= spread_limit
    return out.select("query_id", "x", "y", "z", part("neighbor_id", "neighbors"), part("similarity", "similarities"), part("weight", "weights"), "spread", sure.alias("confident"), F.when(sure, "").otherwise(NOTE).alias("note"))
