"""Points on a screen: projection by a camera's matrix, and what is hit where."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.coords import AXES

Matrix = list[list[float]]


def look_at(eye: list[float], target: list[float], up: list[float] | None = None) -> Matrix:
    """World to camera: the camera looks along -z, x is to the right and y up."""
    up = up or [0.0, 1.0, 0.0]

    def unit(v: list[float]) -> list[float]:
        size = math.sqrt(sum(c * c for c in v)) or 1.0
        return [c / size for c in v]

    def cross(a: list[float], b: list[float]) -> list[float]:
        return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    back = unit([e - t for e, t in zip(eye, target, strict=True)])
    right = unit(cross(up, back))
    axes = [right, cross(back, right), back]
    return [[*a, -sum(c * e for c, e in zip(a, eye, strict=True))] for a in axes] + [[0.0, 0.0, 0.0, 1.0]]


def perspective(degrees: float, aspect: float, near: float, far: float) -> Matrix:
    """Camera to clip space, by the vertical angle of view."""
    f = 1 / math.tan(math.radians(degrees) / 2)
    return [[f / aspect, 0, 0, 0], [0, f, 0, 0], [0, 0, (far + near) / (near - far), 2 * far * near / (near - far)], [0, 0, -1, 0]]


def times(a: Matrix, b: Matrix) -> Matrix:
    return [[sum(a[i][k] * b[k][j] for k in range(4)) for j in range(4)] for i in range(4)]


def project(df: DataFrame, matrix: Matrix, width: int, height: int) -> DataFrame:
    """``df`` with screen_x, screen_y (pixels from the top left) and depth (-1 near to 1 far) of the points in view.

    Points behind the camera, nearer or farther than the matrix allows, and
    beside the screen are left out.
    """

    def row(i: int) -> Column:
        m = matrix[i]
        return F.col(AXES[0]) * float(m[0]) + F.col(AXES[1]) * float(m[1]) + F.col(AXES[2]) * float(m[2]) + F.lit(float(m[3]))

    clip = df.withColumn("__w", row(3)).where(F.col("__w") > 0).withColumns({c: row(i) / F.col("__w") for i, c in enumerate(("__x", "__y", "depth"))})
    seen = clip.where(F.greatest(F.abs("__x"), F.abs("__y"), F.abs("depth")) <= 1)
    return seen.withColumns({"screen_x": (F.col("__x") + 1) / 2 * width, "screen_y": (1 - F.col("__y")) / 2 * height}).drop("__w", "__x", "__y")


def grid_hits(seen: DataFrame, cell: int, id_col: str = "row_id") -> DataFrame:
    """(cell_x, cell_y, id, n): the nearest point of each screen cell of ``cell`` pixels, on ties the smallest id, and how many lie there."""
    at = {f"cell_{a}": F.floor(F.col(f"screen_{a}") / cell).cast("int") for a in "xy"}
    return seen.withColumns(at).groupBy(*at).agg(F.min(F.struct("depth", F.col(id_col).alias("id"))).alias("m"), F.count("*").alias("n")).select(*at, F.col("m.id").alias("id"), "n")


def nearest_to(seen: DataFrame, x: float, y: float, reach: float, id_col: str = "row_id") -> DataFrame:
    """One row: the id of the point within ``reach`` pixels whose place on the screen is nearest to (x, y), then nearest to the camera; else null."""
    apart = (F.col("screen_x") - x) * (F.col("screen_x") - x) + (F.col("screen_y") - y) * (F.col("screen_y") - y)
    return seen.where(apart <= reach * reach).agg(F.min(F.struct(apart.alias("d"), "depth", F.col(id_col).alias("id"))).alias("m")).select(F.col("m.id").alias("id"))
