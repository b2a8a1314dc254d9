"""Connected components of links between documents.

Up to ONE_TASK links one task finds them in a few NumPy passes; more are contracted in
rounds of joins.  Links never go to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed

#: Links that one task may hold (16 bytes each).
ONE_TASK = 1 << 20


def _roots(parents: DataFrame) -> DataFrame:
    """parents (node, label), labels no larger than nodes: follow labels to their ends, doubling the way each time."""
    while True:
        above = parents.select(F.col("node").alias("at"), F.col("label").alias("above"))
        step = packed(parents.join(above, parents["label"] == above["at"]).select("node", F.col("above").alias("label"), (F.col("above") != F.col("label")).alias("moved")))
        parents = step.select("node", "label")
        if not step.filter("moved").limit(1).count():
            return parents


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches if x.num_rows]
        if not held:
            return
        a, b = (np.concatenate(c) for c in zip(*held))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = place[: len(a)], place[len(a) :]
        root = np.arange(len(nodes))
        while True:  # the larger root of each link goes under the smaller one, then ways are shortened
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "label"])

    return edges.repartition(1).mapInArrow(run, "node long, label long")


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of links (a, b): the smallest node reachable.

    Beyond ONE_TASK links each round points every node at its least neighbour, follows those pointers to their
    ends, and replaces the links by those between ends, which are at most half as many
    nodes.  Rounds are written to the shared folder; nothing is collected but whether any
    link is left.
    """
    edges = packed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= ONE_TASK:
        return packed(_in_one_task(edges))
    labels = None
    while True:
        ends = edges.union(edges.select("b", "a"))
        parents = _roots(packed(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))))
        if labels is None:
            labels = parents
        else:
            above = parents.select(F.col("node").alias("at"), F.col("label").alias("above"))
            labels = packed(labels.join(above, labels["label"] == above["at"], "left").select("node", F.coalesce("above", "label").alias("label")))
        high = parents.select(F.col("node").alias("a"), F.col("label").alias("ra"))
        low = parents.select(F.col("node").alias("b"), F.col("label").alias("rb"))
        ends = edges.join(high, "a").join(low, "b").filter("ra <> rb")
        edges = packed(ends.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
        if not edges.limit(1).count():
            return labels
