"""Connected components of a graph of links, by repeated contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Edges that are joined by one task at last, 16 MB; only more of them are contracted by all tasks.
FEW = 1 << 20


def _joined(edges: pa.Table) -> pa.Table:
    """(a, b): the nodes of few edges, and the least node of the component of each."""
    ends = np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()])
    nodes, place = np.unique(ends, return_inverse=True)
    one, two, label = place[: edges.num_rows], place[edges.num_rows :], np.arange(len(nodes))
    while True:
        # Labels are nodes that are their own label; of two that an edge joins the larger one takes the least of its neighbours' labels.
        x, y = label[one], label[two]
        apart = x != y
        if not apart.any():
            return pa.table([pa.array(nodes), pa.array(nodes[label])], names=["a", "b"])
        one, two, x, y = one[apart], two[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, label): for each node of the undirected `edges` (a, b), both long, the least node of its component.

    While there are more than `few` edges, in each round a node points to its least neighbour or itself, pointers are doubled until they end
    at nodes that point to themselves, and all that ended at one place become one.  Of neighbours one at most is such an end, so that a
    round leaves half of the nodes at most; a chain of n pointers takes log2 n doublings.  Only minima are taken over
    neighbours, which combine before the shuffle; no neighbourhood is gathered.  The `few` edges that are left, however many there were,
    are joined by one task: rounds over so few rows are all jobs and no work, and each job stays in the driver's memory.  Rows with
    nulls and loops are ignored; repeated edges count once; no edges give an empty table.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        last = edges.count() <= few
        if last:
            point = cut(edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_joined, "a long, b long"))
        else:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            point = cut(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b")))
        moving = not last
        while moving:
            onward = point.select(F.col("a").alias("b"), F.col("b").alias("c"))
            further = cut(point.join(onward, "b").select("a", F.col("c").alias("b"), (F.col("b") != F.col("c")).alias("moved")))
            moving = not further.where("moved").isEmpty()
            point = further.select("a", "b")
        if labels is None:
            labels = point.select(F.col("a").alias("node"), F.col("b").alias("label"))
        else:
            labels = cut(labels.join(point, labels.label == point.a, "left").select("node", F.coalesce("b", "label").alias("label")))
        if last:
            return labels
        to = point.select("a", F.col("b").alias("to"))
        moved = edges.join(to, "a").select(F.col("to").alias("x"), "b")
        moved = moved.join(to, moved.b == to.a).select("x", F.col("to").alias("y")).where("x <> y")
        edges = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
