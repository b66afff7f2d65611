"""Connected components of links between numbers, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) of all nodes with a link to another one.

    In each round a node moves to the neighbour with the smallest hash, if that is smaller than
    its own, and links between nodes that have met go. As hashes are random, the nodes left
    shrink by a constant factor, also along chains. Each round's tables are stored, so both sides
    of its joins are plain shuffles, which adaptive execution splits at a node with very many
    links; the moves themselves are found by partial aggregation.
    """
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct(), "edges")
    at = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        moves = both.groupBy("u").agg(F.least(F.first(key("u")), F.min(key("v")))["id"].alias("to"))
        moves = stored(moves.withColumnRenamed("u", "node"), "moves")
        if at is None:
            at = moves
        else:
            moved = at.join(moves.select(F.col("node").alias("_n"), F.col("to").alias("_t")), F.col("to") == F.col("_n"), "left")
            at = stored(moved.select("node", F.coalesce("_t", "to").alias("to")), "at")
        ends = {c: moves.select(F.col("node").alias(f"_{c}"), F.col("to").alias(f"{c}2")) for c in "uv"}
        edges = edges.join(ends["u"], F.col("u") == F.col("_u")).join(ends["v"], F.col("v") == F.col("_v"))
        edges = edges.select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).filter("u != v").distinct()
        edges = stored(edges, "edges")
    if at is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least = stored(at.groupBy("to").agg(F.min("node").alias("component")), "least")
    return at.join(least, "to").select("node", "component")
