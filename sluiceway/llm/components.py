"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluiceway.session import materialize

# Graphs of fewer edges send what each round joins to every task.
SMALL = 1 << 20


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def connected_components(edges: DataFrame, a: str, b: str, *, most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Distributed union-find by alternating stars: each node links its larger
    neighbours, then itself and its smaller ones, to the smallest node it knows,
    until every tree is a star. The rounds grow as the logarithm of the path
    lengths. Minima are combined before the shuffle, and what is joined back to
    a node with many neighbours is a single row. Edges with a null end and
    loops are ignored. Each round is a written table, so lineage stays short.
    """
    ends = F.col(a).alias("a"), F.col(b).alias("b")
    edges = edges.select(*ends).where(F.col("a") != F.col("b"))
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    before, count = None, edges.count()
    for _ in range(most_rounds):
        sent = F.broadcast if count <= SMALL else lambda df: df
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _smallest(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(sent(least), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        # Small star: all edges now point from a node to a smaller one.
        least = _smallest(large)
        small = large.join(sent(least), "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == before or after[0] == 0:
            break
        before, count = after, after[0]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
