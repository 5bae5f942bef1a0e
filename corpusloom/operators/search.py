"""Queries on a finished corpus: facets, key words, details, verdict on a selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import UNKNOWN

VISIBLE, MATCH, SELECTED, NEIGHBOR = 1, 2, 4, 8
LOST = 0.6


def facet_filter(df: DataFrame, chosen: dict[str, str | None]) -> DataFrame:
    """Rows that have all chosen values; a facet with null is open."""
    for facet, value in chosen.items():
        if value is not None:
            df = df.where(F.col(facet) == value)
    return df


def keyword_search(df: DataFrame, needle: str, text: Column, limit: int = 5000, order: str = "row_id") -> DataFrame:
    """The first ``limit`` rows in order whose text holds the trimmed, lower-cased needle; none for an empty one."""
    wanted = needle.strip().lower()
    if not wanted:
        return df.limit(0)
    return df.where(F.contains(F.lower(text), F.lit(wanted))).orderBy(order).limit(limit)


def flags(df: DataFrame, visible: Column, match: Column, selected: Column, neighbor: Column) -> DataFrame:
    """``df`` with the bit field of a point's state."""
    bit = lambda c, b: F.when(c, F.lit(b)).otherwise(F.lit(0))
    return df.withColumn("flags", bit(visible, VISIBLE) + bit(match, MATCH) + bit(selected, SELECTED) + bit(neighbor, NEIGHBOR))


def details(df: DataFrame, label: str, facets: list[str], fields: list[str]) -> DataFrame:
    """(row_id, position, name, value): label first, then facets, then fields; unknown, empty, repeated names and the id are left out."""
    names = list(dict.fromkeys([label, *facets, *fields]))
    rows = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for i, n in enumerate(names) if n not in ("object_id", "title")]
    out = df.select("row_id", F.explode(F.array(*rows)).alias("d")).select("row_id", "d.*").where("value <> ''")
    return out.where((F.col("value") != UNKNOWN) | ~F.col("name").isin(facets) | (F.col("name") == label))


def neighbor_verdict(neighbors: DataFrame, coords: DataFrame) -> DataFrame:
    """(row_id, farthest, share, lost): distance of the farthest neighbour, also as a share of the layout's radius."""
    radius = F.broadcast(coords.agg(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("radius")))
    own = coords.select("row_id", "x", "y", "z")
    other = coords.select(F.col("row_id").alias("neighbor_id"), *[F.col(a).alias(f"o{a}") for a in "xyz"])
    distance = F.sqrt(sum((F.col(a) - F.col(f"o{a}")) * (F.col(a) - F.col(f"o{a}")) for a in "xyz"))
    far = neighbors.join(own, "row_id").join(other, "neighbor_id").groupBy("row_id").agg(F.max(distance).alias("farthest"))
    return far.crossJoin(radius).select("row_id", "farthest", (F.col("farthest") / F.col("radius")).alias("share"), (F.col("farthest") / F.col("radius") > LOST).alias("lost"))


def line_intensity(neighbors: DataFrame) -> DataFrame:
    """``neighbors`` with the intensity of the line to each: falls with the rank from 0.85 to 0.25."""
    count = F.count("*").over(Window.partitionBy("row_id"))
    return neighbors.withColumn("intensity", 0.25 + 0.6 * (1 - (F.col("rank") - 1) / F.greatest(count - 1, F.lit(1))))


def nearest_hit(pixels: DataFrame, center_x: float, center_y: float, n: int) -> DataFrame:
    """One row: the id nearest to a screen position, among pixels (x, y, id) that show one of the n points.

    Equally near pixels give the smallest id; without a hit the id is null.
    """
    apart = (F.col("x") - center_x) * (F.col("x") - center_x) + (F.col("y") - center_y) * (F.col("y") - center_y)
    return pixels.where((F.col("id") >= 0) & (F.col("id") < n)).agg(F.min(F.struct(apart.alias("d"), "id")).alias("m")).select(F.col("m.id").alias("id"))
