"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.runtime import materialise

#: Rounds after which an edge list must have settled; each at least halves the depth of every tree, so this covers any input.
MAX_ROUNDS = 80


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: longs): label is the smallest node reachable.

    Alternates the two star contractions of Kiveris et al. (2014).  A node's
    least neighbour is an aggregate with partial sums, and comes back by a join
    whose other side has the node once, so a node with very many neighbours can
    be split.  Every round is written to the shared folder.
    """

    def contract(links: DataFrame, large: bool) -> DataFrame:
        both = links.union(links.select("b", "a")).toDF("a", "b") if large else links
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # with a second key, here a bit of the first, the minima are shuffled for the join as well, so that a hot node can be split
        of = least.select(F.col("a").alias("of"), "m")
        joined = both.join(of, (F.col("a") == F.col("of")) & (F.col("a") % 2 == F.col("of") % 2)).drop("of")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        return out.where("a <> b").distinct()

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38, 0)"))).first())

    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = materialise(links, "links", compact=True)
    before = state(links)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        links = materialise(contract(contract(links, True), False), "links", compact=True)
        after = state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components have not settled")
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(links.select("b", "b").distinct())
