"""Connected components of an edge table, by contraction in a random order.

Each round gives every node a fresh random rank.  A node hooks to the lowest of
itself and its neighbours, and then to that node's own choice; edges are renamed
and loops and repeats dropped.  Only nodes that are lowest among their
neighbours, or are chosen through one that isn't, are left, so the nodes with
edges shrink by a constant factor in expectation whatever their numbers are:
rounds grow with the logarithm of the input, for chains and stars alike.

Minima are pre-aggregated and renaming joins spread hot keys, so a node with
very many edges is no hot key; nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.store import spread_join, stored


def components(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """node, label for every node of edges (a, b: long); label: one node of the component. rounds: is given the edges of each round."""
    e = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, turn = None, 0
    while left := e.count():
        if rounds is not None:
            rounds.append(left)
        turn += 1
        ranked = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("rank"), F.col(c).alias("p"))  # noqa: B023, E731
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min(ranked("b")).alias("near")).select("a", F.least(ranked("a"), "near").getField("p").alias("p")), "parents")
        up = stored(spread_join(up, up.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", "q"), "parents")
        to = lambda c: up.select(F.col("a").alias(c), F.col("q").alias(f"{c}_"))  # noqa: B023, E731
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("q").alias("label"))
        else:
            labels = stored(spread_join(labels, to("label"), "label", "left").select("node", F.coalesce("label_", "label").alias("label")), "labels")
        half = stored(spread_join(e, to("a"), "a").select("a_", "b"), "edges")
        e = stored(spread_join(half, to("b"), "b").where("a_ <> b_").select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels
