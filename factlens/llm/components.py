"""Connected components by alternating large and small stars, each round one Spark job written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over (u, v) edges: every neighbour of u is linked to the least node seen around u."""
    if large:
        sided = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sided = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sided.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = sided.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component.

    Edges may repeat, run either way and link a node to itself. Rounds go on until the star forest stands still;
    their number grows with the logarithm of the longest path. Only a count and a checksum reach the driver.
    """
    loops = edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
    current = materialize(loops.where("u != v").distinct(), "edges")
    before = _state(current)
    while before[0]:
        after = materialize(_star(_star(current, large=True), large=False), "edges")
        state = _state(after)
        discard(current)
        current = after
        if state == before:
            break
        before = state
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
