"""Normalising and quantising 3-D coordinates (columns x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
BOX = 50.0
I16 = 32767.0

# The colours of label classes.
PALETTE = (
    (230, 159, 0),
    (86, 180, 233),
    (0, 158, 115),
    (240, 228, 66),
    (0, 114, 178),
    (213, 94, 0),
    (204, 121, 167),
    (148, 103, 189),
)


def normalize(df: DataFrame, box: float = BOX) -> DataFrame:
    """Centres the coordinates and scales all axes alike, so that the largest magnitude is ``box``.

    Two aggregates of one row each; identical points stay at the origin.
    """
    centre = df.agg(*[F.avg(a).alias(f"c{a}") for a in AXES])
    centred = df.crossJoin(F.broadcast(centre)).select(*[c for c in df.columns if c not in AXES], *[(F.col(a) - F.col(f"c{a}")).alias(a) for a in AXES])
    most = centred.agg(F.max(F.greatest(*[F.abs(a) for a in AXES])).alias("most"))
    scale = F.when(F.col("most") > 0, box / F.col("most")).otherwise(1.0)
    return centred.crossJoin(F.broadcast(most)).select(*[c for c in df.columns if c not in AXES], *[(F.col(a) * scale).alias(a) for a in AXES])


def spec(df: DataFrame) -> DataFrame:
    """One row: per axis minimum, maximum, offset and half extent; radius of the farthest point."""
    ends = df.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))], F.max(F.sqrt(sum(F.col(a) * F.col(a) for a in AXES))).alias("radius"))
    half = {a: (F.col(f"max_{a}") - F.col(f"min_{a}")) / 2 for a in AXES}
    return ends.withColumns({**{f"offset_{a}": (F.col(f"max_{a}") + F.col(f"min_{a}")) / 2 for a in AXES}, **{f"half_{a}": F.when(half[a] == 0, 1.0).otherwise(half[a]) for a in AXES}})


def quantize(df: DataFrame) -> DataFrame:
    """``df`` with qx, qy, qz as 16-bit integers over each axis' extent."""
    one = F.broadcast(spec(df).select(*[f"{n}_{a}" for a in AXES for n in ("offset", "half")]))
    value = {a: F.rint((F.col(a) - F.col(f"offset_{a}")) / F.col(f"half_{a}") * I16) for a in AXES}
    return df.crossJoin(one).withColumns({f"q{a}": F.greatest(F.lit(-I16), F.least(F.lit(I16), value[a])).cast("short") for a in AXES})


def dequantize(q: Column, offset: Column, half: Column) -> Column:
    return q.cast("double") / I16 * half + offset


def palette(label: Column) -> list[Column]:
    """Red, green, blue and an opaque fourth component of a label."""
    place = F.pmod(label, F.lit(len(PALETTE))).cast("int")
    return [F.element_at(F.array(*[F.lit(c[k]) for c in PALETTE]), place + 1).alias("rgb"[k]) for k in range(3)] + [F.lit(255).alias("a")]


def mean_spacing(radius: Column, n: Column) -> Column:
    """Spacing of n points in a ball's volume; 1 if that is undefined."""
    value = 2 * radius / F.cbrt(n)
    return F.when((n > 0) & (value > 0) & (value < float("inf")), value).otherwise(1.0)
