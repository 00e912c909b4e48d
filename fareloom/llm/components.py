"""Connected components of a graph of edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node of each component, for every node on an edge.

    In each round every node moves to the smallest of its neighbours and itself, and the
    edges move along; a component's smallest node never moves, so the rounds end when no
    edge is left. Minima are folded before the shuffle, and a node with very many edges
    meets one row of the other side, which adaptive execution splits. Each round is written
    to the scratch folder.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    pairs = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    moves = []
    while not pairs.isEmpty():
        move = stored(pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "moves")
        moves.append(move)
        to_b = move.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        pairs = stored(pairs.join(move, "a").select(F.col("to").alias("to_a"), "b").join(to_b, "b")
                       .select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct(), "edges")
    if not moves:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = moves[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for move in moves[1:]:
        onward = move.select(F.col("a").alias("root"), "to")
        labels = labels.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stored(labels, "components")
