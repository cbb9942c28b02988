"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest reachable id) of each node of ``edges(a long, b long)``.

    In each round every node moves to its smallest neighbour if that is smaller,
    all edges move along, and loops and repeats go. What an edge joins stays
    joined, so the rounds end with no edge and each node at its component's
    smallest id. Rounds are few (a star takes two); each is written to the
    shared folder. A hub's edges are summed up before they are shuffled, and
    joins to it are split by adaptive execution.
    """
    edges = common.written(_tidy(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        moves = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("id"), F.least("a", "to").alias("to"))
        moves = common.written(moves, "moves")
        if labels is None:
            labels = moves.select("id", F.col("to").alias("component"))
        else:
            labels = common.written(
                labels.join(moves.withColumnRenamed("id", "component"), "component", "left")
                .select("id", F.coalesce("to", "component").alias("component")), "labels")
        moved = moves.where("id != to")
        edges = (edges.join(moved.select(F.col("id").alias("a"), F.col("to").alias("a2")), "a", "left")
                 .join(moved.select(F.col("id").alias("b"), F.col("to").alias("b2")), "b", "left")
                 .select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")))
        edges = common.written(_tidy(edges), "edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
