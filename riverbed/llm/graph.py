"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def contract(batches, most: int = 1_000_000):
    """Within blocks of a task's edges: each node with the smallest node it is joined to. Keeps components, leaves shallow stars."""

    def stars(a, b):
        nodes, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = np.arange(nodes.size)
        x, y = codes[: a.size], codes[a.size :]
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, root[x], low)
            np.minimum.at(new, root[y], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        off = np.flatnonzero(root != np.arange(nodes.size))
        return pa.RecordBatch.from_arrays([pa.array(nodes[root[off]]), pa.array(nodes[off])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= most:
            yield stars(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield stars(*map(np.concatenate, zip(*held, strict=True)))


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(id, label) for every node of edges (a long, b long): label is the smallest id reachable. Nodes without an edge are not listed.

    Labels spread along edges and jump through labels until nothing changes, so rounds grow with the logarithm of a component's width;
    each round is cut off by a table in the shared folder. A node with a great many edges only widens a partial minimum.
    """
    stars = edges.where("a is not null and b is not null and a <> b").select("a", "b").mapInArrow(contract, "a long, b long")
    both = materialize(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{tag}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), tag)
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("m"))
        spread = labels.join(near, labels.id == near.a, "left").select("id", F.col("label").alias("old"), F.least("label", "m").alias("low"))
        jump = labels.select(F.col("id").alias("of"), F.col("label").alias("next"))
        labels = materialize(spread.join(jump, spread.low == jump.of, "left").select("id", "old", F.least("low", "next").alias("label")), tag)
        if labels.where("old <> label").isEmpty():
            return labels.select("id", "label")
        labels = labels.select("id", "label")
