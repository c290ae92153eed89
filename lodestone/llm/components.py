"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _checksum(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) for every node with an edge (a, b), root being its component's smallest node.

    Rounds end when none changes an edge; their number grows with the logarithm of the longest path.
    If `rounds` are not enough, that is an error, never an unfinished result.

    Each round is two key-wise minima and two joins on the same key; the edge list, never longer
    than at the start, is written to the shared folder after each.
    """
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct()
    e = materialise(e, "components")
    seen = _checksum(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).unionByName(low.where("m < x").select(F.col("x").alias("v"), F.col("m").alias("u"))).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        e = materialise(small, "components")
        now = _checksum(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)
