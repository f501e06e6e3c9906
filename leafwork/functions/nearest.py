"""Nearest points of a plane by a k-d tree for each page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a leaf; distances within this of the least count as equal here, so that the caller's rounding decides.
LEAF, EQUAL = 16, 2e-6


class Tree:
    """Points split at the middle of their wider side until LEAF are left. looked counts distances."""

    def __init__(self, xy: np.ndarray):
        self.xy, self.looked, self.nodes = xy, 0, []
        todo = [(np.arange(len(xy)), -1, 0)]
        while todo:
            own, above, side = todo.pop()
            at = len(self.nodes)
            low, high = xy[own].min(axis=0), xy[own].max(axis=0)
            self.nodes.append([low, high, own, -1, -1])
            if above >= 0:
                self.nodes[above][3 + side] = at
            if len(own) > LEAF and (high > low).any():
                axis = int((high - low).argmax())
                order = own[np.argpartition(xy[own, axis], len(own) // 2)]
                self.nodes[at][2] = None
                todo += [(order[: len(own) // 2], at, 0), (order[len(own) // 2 :], at, 1)]

    def nearest(self, p: np.ndarray, but: int) -> list[int]:
        """Points at the least distance from p, point `but` aside; nearer boxes first, those further away
        than the best so far not at all."""
        best, found = np.inf, []
        todo = [(0.0, 0)]
        while todo:
            far, at = todo.pop()
            if far > best + EQUAL:
                continue
            low, high, own, left, right = self.nodes[at]
            if own is None:
                kids = sorted(((float(np.hypot(*np.maximum(0, np.maximum(self.nodes[k][0] - p, p - self.nodes[k][1])))), k) for k in (left, right)), reverse=True)
                todo += kids
                continue
            own = own[own != but]
            d = np.hypot(*(self.xy[own] - p).T)
            self.looked += len(own)
            best = min(best, d.min(initial=np.inf))
            found += [(x, int(i)) for x, i in zip(d, own) if x <= best + EQUAL]
        return [i for x, i in found if x <= best + EQUAL]


def near(points: DataFrame, asks: DataFrame, keys: list[str], node: str, x: str, y: str) -> DataFrame:
    """(keys, node, other): for each of asks the nearest of points with equal keys that isn't the same node;
    all that are equally near to within EQUAL. Only pages that ask are looked at, each by one tree; a task
    holds one page's points at a time. Points without a place take no part."""
    cols = [*keys, node, x, y]
    pages = asks.select(*keys).distinct()
    # places come as doubles, ids as they are
    both = points.select(*[F.col(k) for k in cols], F.lit(False).alias("_ask")).join(pages, keys, "left_semi").unionByName(asks.select(*[F.col(k) for k in cols], F.lit(True).alias("_ask"))).dropna(subset=[x, y])
    sorted_ = both.repartition(*keys).sortWithinPartitions(*keys, "_ask", node)
    m = len(keys)

    def settle(rows: list[tuple]) -> list[tuple]:
        own, asking = [r for r in rows if not r[-1]], [r for r in rows if r[-1]]
        if not own or not asking:
            return []
        ids = [r[m] for r in own]
        at = {i: k for k, i in enumerate(ids)}
        tree = Tree(np.array([r[m + 1 : m + 3] for r in own], dtype=np.float64))
        return [(*r[: m + 1], ids[k]) for r in asking for k in tree.nearest(np.array(r[m + 1 : m + 3], dtype=np.float64), at.get(r[m], -1))]

    names = [*keys, node, "other"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for r in b.itertuples(index=False, name=None):
                if held and held[0][:m] != r[:m]:
                    out += settle(held)
                    held = []
                held.append(r)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held and (out := settle(held)):
            yield pd.DataFrame(out, columns=names)

    kind = {f.name: f.dataType.simpleString() for f in points.schema}
    return sorted_.mapInPandas(run, ", ".join([*[f"`{k}` {kind[k]}" for k in (*keys, node)], f"other {kind[node]}"]))
