"""Facets by bitmaps: which rows have a value, and how many would have it under a choice.

A bitmap is 32,768 rows of one facet's value, built with partial bitmaps in every
task.  Choices are joined by AND, block by block, so no step holds more than
bitmaps of one block, and counts never touch the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _block(id_: Column) -> Column:
    return F.bitmap_bucket_number(id_.cast("long"))


def build(df: DataFrame, facets: list[str], id_col: str = "row_id") -> DataFrame:
    """(facet, value, block, bits): the rows of each facet's value; nulls are a value."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]))
    rows = df.select(F.col(id_col).cast("long").alias("id"), each.alias("e"))
    return rows.groupBy("e.facet", "e.value", _block(F.col("id")).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def _chosen(chosen: dict[str, str | None]) -> dict[str, str]:
    return {f: v for f, v in chosen.items() if v is not None}


def selected(index: DataFrame, chosen: dict[str, str | None]) -> DataFrame:
    """(block, bits) of the rows that have all chosen values; a facet with null is open, without a choice all rows are meant."""
    some = _chosen(chosen)
    if not some:
        return index.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
    either = F.lit(False)
    for facet, value in some.items():
        either = either | ((F.col("facet") == facet) & (F.col("value") == value))
    together = index.where(either).groupBy("block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return together.where(F.col("n") == len(some)).drop("n")


def filter_rows(df: DataFrame, bitmaps: DataFrame, id_col: str = "row_id") -> DataFrame:
    """The rows of ``df`` whose bit is set."""
    bitmaps = bitmaps.select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))
    place = F.bitmap_bit_position(df[id_col].cast("long"))
    byte = F.conv(F.hex(F.substr(F.col("__bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.getbit(byte, (place % 8).cast("int")) == 1
    return df.join(bitmaps, _block(df[id_col]) == F.col("__block")).where(there).select(*[df[c] for c in df.columns])


def _both(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): the number of rows in both bitmaps of each key, ``two`` being (block, more)."""
    pairs = one.join(two, "block").select(*keys, "block", F.explode(F.array("bits", "more")).alias("bits"))
    return pairs.groupBy(*keys, "block").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n")).groupBy(*keys).agg(F.sum("n").alias("n"))


def counts(index: DataFrame, chosen: dict[str, str | None]) -> DataFrame:
    """(facet, value, n) for every value of the open facets that some row has under the choice."""
    here = selected(index, chosen).withColumnRenamed("bits", "more")
    open_ = index.where(~F.col("facet").isin(list(_chosen(chosen)))) if _chosen(chosen) else index
    return _both(open_, here, ["facet", "value"]).where("n > 0")


def pair_counts(index: DataFrame, one: str, two: str) -> DataFrame:
    """(<one>, <two>, n) for every pair of values of two facets that some row has."""
    left = index.where(F.col("facet") == one).select(F.col("value").alias(one), "block", "bits")
    right = index.where(F.col("facet") == two).select(F.col("value").alias(two), "block", F.col("bits").alias("more"))
    return _both(left, right, [one, two]).where("n > 0")
