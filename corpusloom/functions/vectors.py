"""Vector expressions on array columns, and weights of neighbours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit vectors in double precision; zero vectors stay zero."""
    length = F.transform(F.array(norm(a)), lambda n: F.when(n == 0, 1.0).otherwise(n))
    return F.transform(F.arrays_zip(a.cast("array<double>").alias("x"), F.array_repeat(length[0], F.size(a)).alias("n")), lambda z: z["x"] / z["n"])


def softmax_weights(similarity: Column, query: WindowSpec, temperature: float = 0.05) -> Column:
    """Weights of a query's neighbours: softmax on the scale of their own range."""
    top, low = F.max(similarity).over(query), F.min(similarity).over(query)
    spread = top - low
    scale = F.when(spread > 0, F.greatest(spread, F.lit(1e-6)) * (max(temperature, 1e-6) / 0.05)).otherwise(1.0)
    weight = F.exp((similarity - top) / F.greatest(scale, F.lit(1e-6)))
    return weight / F.sum(weight).over(query)
