"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import durable


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Rows (node, component): every node of an edge with the smallest node it reaches.

    Alternates large-star and small-star steps (each node's neighbours are hung on the
    smallest of them) until nothing changes, in a number of rounds that grows with the
    logarithm of the longest chain. A step is one minimum per node, combined before the
    shuffle, and one join of the edges with these minima, so that a node with very many
    neighbours is one row on one side. Each round is written to the shared checkpoint
    folder. Edges with a null end, loops and repeated edges change nothing.
    """
    found = durable(
        edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .distinct()
    )
    state = _state(found)
    while state[0]:
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = star.groupBy("a").agg(F.min("b").alias("m"))
        hung = star.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        found = durable(hung.select("e.*").where("a <> b").distinct())
        before, state = state, _state(found)
        if before == state:
            break
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
