"""Connected components of a graph in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Ties each node's neighbours (the larger ones, or the smaller ones and itself) to the least of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        tied = both.where(F.col("b") > F.col("a")).join(least, "a").select("b", "m")
        return tied.select(F.col("m").alias("a"), "b").where(F.col("a") < F.col("b")).distinct()
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b").select("a", "b", "m")
    return tied.select("m", F.explode(F.array("a", "b")).alias("x")).where(F.col("m") < F.col("x")).select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a < b. Returns node, component (its least node) for every node but the least ones.

    Alternates large and small stars, each a sum over the edges; the result of
    each round is a table of its own, so a lost executor costs a round at most.
    """
    edges = materialise(edges.where(F.col("a") < F.col("b")).select("a", "b").distinct(), "edges")
    before = None
    while True:
        edges = materialise(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.count_distinct("b")).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before = now
