"""Connected components by contraction: every node hooks to its least neighbour until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.operators.tables import dropped, kept


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long).  Returns node, label for each node of an edge: label is the least node reachable.

    A round maps each node to the least of itself and its neighbours (partial minima before the shuffle), renames
    the ends of all edges and drops loops; a hub is a key of sums and of joins that adaptive execution can split.  The number of edges
    falls by a constant factor each round; every round is kept in the shared folder.
    """
    edges = kept(edges.select("u", "v").where("u <> v").distinct())
    labels = None
    while True:
        before = [edges, labels] if labels is not None else [edges]
        to = edges.union(edges.select("v", "u")).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("to"))
        to = kept(to)
        if labels is None:
            labels = to.select("node", F.col("to").alias("label"))
        else:
            labels = labels.join(to.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = kept(labels)
        left = to.select(F.col("node").alias("u"), F.col("to").alias("u2"))
        right = to.select(F.col("node").alias("v"), F.col("to").alias("v2"))
        edges = kept(edges.join(left, "u").join(right, "v").where("u2 <> v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct())
        dropped(to, *before)
        if edges.isEmpty():
            dropped(edges)
            return labels
