"""Connected components of an edge table by contraction, all on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that has an edge to another; one root a component.

    In each round a node takes the least of itself and its neighbours as its label, and the edges between
    different labels are the next round's graph, which has at most half the nodes. What a round reads shrinks
    with it; its tables are written to the shared folder.
    """
    pairs = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "cc-labels")
        up = near.select(F.col("node").alias("root"), F.col("root").alias("up"))
        labels, old = near if labels is None else cut(labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "cc-labels"), labels
        ends = pairs.join(near.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(near.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        rest = cut(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        for done in (pairs, old):
            if done is not None and done is not labels:
                discard(done)
        if rest.isEmpty():
            return labels
        pairs = rest
