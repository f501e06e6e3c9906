"""Connected components of a graph given as rows of edges, by minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, far, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of every node but the smallest of each component."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = inv[: len(a)], inv[len(a) :]
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def contracted(edges: DataFrame) -> DataFrame:
    """A spanning forest of each batch in place of its edges: the same components, fewer rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for e in batches:
            held.append(e.to_numpy(np.int64).reshape(-1, 2))
            size += len(e)
            if size > 500_000:
                ab = np.concatenate(held)
                node, root = forest(ab[:, 0], ab[:, 1])
                ab = np.stack([node, root], axis=1)
                held, size = [ab], len(ab)
                if size > 250_000:
                    yield pd.DataFrame(ab, columns=["a", "b"])
                    held, size = [], 0
        if held:
            ab = np.concatenate(held)
            node, root = forest(ab[:, 0], ab[:, 1])
            yield pd.DataFrame({"a": node, "b": root})

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of every node of an edge (a, b), the smallest node that it reaches.

    Labels live in tables in the shared folder; each round lowers a label to the least among
    neighbours and then follows it once. The number of rounds is about the logarithm of the longest
    shortest path.
    """
    spark = edges.sparkSession
    slim = written(contracted(edges), spark)
    both = written(slim.where("a <> b").select("a", "b").unionAll(slim.where("a <> b").select(F.col("b"), F.col("a"))).distinct(), spark)
    dropped(slim)
    labels = held = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), spark)
    while True:
        told = both.withColumn("j", far(F.col("b"))).join(labels.select(far(F.col("node")).alias("j"), "root"), "j").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("r"))
        low = labels.join(told, "node").select("node", "root", F.least("root", "r").alias("r"))
        # root's own label, one step further
        jump = labels.select(far(F.col("node")).alias("j"), F.col("root").alias("rr"))
        nxt = written(low.withColumn("j", far(F.col("r"))).join(jump, "j").select("node", F.least("r", "rr").alias("root"), (F.least("r", "rr") < F.col("root")).alias("moved")), spark)
        dropped(held)
        labels, held = nxt.select("node", "root"), nxt
        if nxt.where("moved").limit(1).count() == 0:
            dropped(both)
            return labels
