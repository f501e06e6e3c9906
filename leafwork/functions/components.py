"""Connected components of graphs given as rows of edges, all graphs of a table at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Edges that a task holds at a time.
HELD = 200_000


def smallest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the least node that each one reaches."""
    label = np.arange(int(max(a.max(), b.max())) + 1)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def thinned(e: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Edges (keys, a, b) as stars: every node but the least of each of their components, and that one."""
    both = pd.concat([e[[*keys, "a"]].rename(columns={"a": "node"}), e[[*keys, "b"]].rename(columns={"b": "node"})], ignore_index=True)
    place = both.groupby([*keys, "node"], sort=True).ngroup().to_numpy()  # numbers rise with the node
    first = np.unique(place, return_index=True)[1]
    root = smallest(place[: len(e)], place[len(e) :])
    own = np.flatnonzero(root != np.arange(len(root)))
    out = both.iloc[first[own]].rename(columns={"node": "a"})
    return out.assign(b=both["node"].to_numpy()[first[root[own]]])


def contracted(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Fewer edges (keys, a, b) with the same components: each task keeps stars of what it has seen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for e in batches:
            held.append(e)
            if sum(map(len, held)) > HELD:
                held = [thinned(pd.concat(held, ignore_index=True), keys)]
                if len(held[0]) > HELD // 2:
                    yield held[0]
                    held = []
        if held and sum(map(len, held)):
            yield thinned(pd.concat(held, ignore_index=True), keys)

    return edges.mapInPandas(run, edges.schema)


def components(edges: DataFrame, keys: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """(keys, node, root): for every node of an edge, the least node that it reaches within its keys.

    Tasks first thin out the edges that they happen to hold, then those of a share of the keys (a key
    with very many edges is split). What is left is joined with labels in the shared folder: each round
    lowers a label to the least of the neighbours' and follows it once, until none moves. Loops and repeated
    edges are fine; edges with a null end or key are left out; no edges give no rows.
    """
    some = edges.select(*keys, F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").dropna()
    slim = written(contracted(contracted(some, keys).hint("rebalance", *keys), keys))
    both = slim.unionByName(slim.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        of = labels.withColumnsRenamed({"node": "b", "root": "_r"})
        near = both.join(of, [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("_r").alias("_r"))
        low = labels.join(near, [*keys, "node"]).select(*keys, "node", "root", F.least("root", "_r").alias("_low"))
        step = labels.withColumnsRenamed({"node": "_low", "root": "_next"})
        after = written(low.join(step, [*keys, "_low"]).select(*keys, "node", F.least("_low", "_next").alias("root"), (F.least("_low", "_next") < F.col("root")).alias("moved")))
        labels = after.drop("moved")
        if after.where("moved").isEmpty():
            return labels
