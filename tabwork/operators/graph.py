"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabwork.session import cut_lineage

MAX_ROUNDS = 100


def _sizes(edges: DataFrame) -> tuple:
    """Two order-free figures that change when the edge set does."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link each node's neighbours (all smaller ones, or the larger ones) to the least node among them.

    The least neighbour is a grouped minimum, combined before the shuffle, so a
    node with very many neighbours is never gathered in one place.
    """
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = edges.join(least, "a")
    if larger_only:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.inline(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
        )))
    return out.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, id1: str = "id1", id2: str = "id2") -> DataFrame:
    """(id, component) for every node of the edges; the component is its least id.

    Alternates the large-star and small-star steps: every round keeps the
    components and shortens the paths, until each node points at its least one.
    Each round is written to the checkpoint folder.
    """
    current = edges.select(
        F.greatest(id1, id2).alias("a"), F.least(id1, id2).alias("b")
    ).filter(F.col("a") != F.col("b")).distinct()
    current = cut_lineage(current)
    before = _sizes(current)
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        stars = _to_least(both, larger_only=True)
        current = cut_lineage(_to_least(stars, larger_only=False))
        after = _sizes(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    # every edge now runs from a node to the least node of its component
    roots = current.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
