"""The gate: does a layout carry meaning, or would noise look the same?"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import neighbors as N
from corpusloom.operators import ranks
from corpusloom.operators.rows import materialise


@dataclass(frozen=True)
class GateSpec:
    k: int = 15
    min_overlap: float = 0.05
    margin: float = 0.05


def run_gate(df: DataFrame, shuffled: DataFrame | None = None, spec: GateSpec = GateSpec(), high: DataFrame | None = None, high_shuffled: DataFrame | None = None, trust: bool = True) -> DataFrame:
    """One row of measures, reasons and verdict.

    ``df`` and ``shuffled`` have (row_id, embedding, coords, label); ``shuffled``
    holds the same rows with structureless embeddings and their layout.  The same
    neighbour operator, without self, serves every measure; ``high`` and
    ``high_shuffled`` are neighbours in the space of the embeddings that a caller
    has already.  Without ``trust`` there is no trustworthiness, which no reason
    depends on and which compares all pairs once more.
    """
    n = df.count()
    k = min(spec.k, n - 1)
    if k < 1:
        raise ValueError("the gate needs two rows")
    labels = df.select("row_id", "label")

    def low_of(rows: DataFrame) -> DataFrame:
        return materialise(N.knn(rows, k, "row_id", "coords", metric="euclidean"), "gate-low")

    def measures(rows: DataFrame, high: DataFrame | None, low: DataFrame, suffix: str) -> DataFrame:
        high = materialise(N.knn(rows, k, "row_id", "embedding"), "gate-high") if high is None else high
        one = N.overlap(high, low, k).withColumnRenamed("overlap", f"overlap{suffix}")
        return one.crossJoin(N.label_purity(low, labels).withColumnRenamed("purity", f"purity_3d{suffix}")).crossJoin(N.label_purity(high, labels).withColumnRenamed("purity", f"purity_high{suffix}"))

    low = low_of(df)
    row = measures(df, high, low, "").crossJoin(N.chance_level(labels))
    if trust:
        row = row.crossJoin(ranks.trustworthiness(df, k, "row_id", "embedding", "coords", low=low).drop("compared"))
    if shuffled is not None:
        row = row.crossJoin(measures(shuffled, high_shuffled, low_of(shuffled), "_shuffled").drop("purity_high_shuffled"))
    else:
        row = row.withColumns({"overlap_shuffled": F.lit(None).cast("double"), "purity_3d_shuffled": F.lit(None).cast("double")})
    reasons = [
        (F.col("overlap") < spec.min_overlap, "neighbourhoods are not kept"),
        (F.col("purity_3d") <= F.col("chance") + spec.margin, "labels are mixed in the layout"),
        (F.col("purity_high") <= F.col("chance") + spec.margin, "labels are mixed in the embedding"),
        (F.col("purity_3d") <= F.col("purity_3d_shuffled") + spec.margin, "noise would look the same"),
    ]
    row = row.withColumn("reasons", F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in reasons]), lambda x: x.isNotNull()))
    return row.select(F.lit(k).alias("k"), F.lit(n).alias("n"), "*", (F.size("reasons") == 0).alias("passed"))
