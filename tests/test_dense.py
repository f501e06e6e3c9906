"""Pages with very many boxes: joins by cells, relations, components, point location, nearest nodes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafwork.functions import intervals
from leafwork.operators import graph

NODES = "doc_id long, page_number int, node int, x double, y double, width double, height double"


def boxes(n, seed, page=1, span=100.0):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        w, h = (float(v) for v in r.choice([0.0, 0.01, 3.0, 7.5, 20.0, 90.0], 2))
        out.append((1, page, i, float(r.integers(-20, span)) / 2, float(r.integers(0, span)) / 2, w, h))
    return out + [(*out[0][:2], n, *out[0][3:])]  # a box twice


def share(a, b, c, d):
    least = min(b - a, d - c)
    return max(0.0, min(b, d) - max(a, c)) / least if least > 0 else 0.0


def plain_edges(rows, near=30.0, inside=0.85):
    out = []
    for a in rows:
        for b in rows:
            if a[:2] != b[:2] or a[2] == b[2]:
                continue
            ax, ay, ax2, ay2 = a[3], a[4], a[3] + a[5], a[4] + a[6]
            bx, by, bx2, by2 = b[3], b[4], b[3] + b[5], b[4] + b[6]
            both = max(0, min(ax2, bx2) - max(ax, bx)) * max(0, min(ay2, by2) - max(ay, by))
            area_a, area_b = (ax2 - ax) * (ay2 - ay), (bx2 - bx) * (by2 - by)
            say = lambda name, w: out.append((a[0], a[1], a[2], b[2], name, round(w, 4)))
            if area_a > 0 and area_b > 0 and both / area_a >= inside:
                say("INSIDE", 0.1)
            elif area_a > 0 and area_b > 0 and both / area_b >= inside:
                say("CONTAINS", 0.1)
            else:
                ox, oy, v, h = share(ax, ax2, bx, bx2), share(ay, ay2, by, by2), by - ay2, bx - ax2
                if ox > 0.3 and 0 <= v <= near:
                    say("BELOW", v + 1), say("ADJACENT", v + 1)
                if oy > 0.3 and 0 <= h <= 2 * near:
                    say("RIGHT_OF", h + 1)
                if ox > 0.5:
                    say("SAME_COLUMN", abs((ay + ay2) / 2 - (by + by2) / 2))
                if oy > 0.5:
                    say("SAME_ROW", abs((ax + ax2) / 2 - (bx + bx2) / 2))
    return sorted(out)


def told(e):
    return sorted((r.doc_id, r.page_number, r.src, r.dst, r.relation, round(r.weight, 4)) for r in e.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_relations(spark, seed):
    rows = boxes(70, seed) + boxes(25, seed + 10, page=2, span=20.0) + [(2, 1, 0, 1.0, 1.0, 5.0, 5.0)]
    n = spark.createDataFrame(rows, NODES)
    want = plain_edges(rows)
    assert {w[4] for w in want} == set(graph.RELATIONS)
    assert told(graph.edges(n)) == want
    for only in (("SAME_ROW",), ("BELOW", "CONTAINS"), ("INSIDE",), ("RIGHT_OF", "ADJACENT")):
        assert told(graph.edges(n, only=only)) == [w for w in want if w[4] in only]


def test_relations_of_a_dense_page(spark):
    """10,000 boxes: what is looked at grows with what is found, not with all pairs of the page."""
    side = 100
    n = spark.range(side * side).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page_number"), F.col("id").cast("int").alias("node"), (F.col("id") % side * 8.0).alias("x"), (F.floor(F.col("id") / side) * 8.0).alias("y"), F.lit(6.0).alias("width"), F.lit(6.0).alias("height"))
    got = {r.relation: r["count"] for r in graph.edges(n).groupBy("relation").count().collect()}
    below = sum(min(4, side - 1 - i) for i in range(side)) * side  # rows 2, 10, 18 and 26 below
    assert got["SAME_COLUMN"] == got["SAME_ROW"] == side * side * (side - 1) and got["BELOW"] == got["ADJACENT"] == below
    slim = n.select("doc_id", "page_number", "node", F.col("x").alias("lo"), (F.col("x") + F.col("width")).alias("hi"))
    met = intervals.placed(slim, slim, ["doc_id", "page_number"], "lo", "hi", "lo").count()
    cells = slim.select(F.explode(F.sequence(F.floor(F.col("lo") / 8), F.floor(F.col("hi") / 8))).alias("cell")).groupBy("cell").count()
    assert met <= 2 * got["SAME_COLUMN"] + 2 * side * side and cells.agg(F.max("count")).first()[0] <= 2 * side


def test_places_in_intervals(spark):
    r = np.random.default_rng(5)
    wide = [(i % 3, i, float(a), float(a + w)) for i, (a, w) in enumerate(zip(r.integers(-50, 50, 200), r.choice([0, 0.001, 1, 5, 1000, 3e12], 200)))] + [(1, 900, 5.0, 4.0), (None, 901, 0.0, 9.0)]
    points = [(i % 4, i, float(x)) for i, x in enumerate(r.integers(-60, 90, 300))] + [(None, 902, 1.0)]
    got = intervals.placed(spark.createDataFrame(wide, "k int, i int, lo double, hi double"), spark.createDataFrame(points, "k int, j int, at double"), ["k"], "lo", "hi", "at").select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for k, i, lo, hi in wide for m, j, x in points if k is not None and k == m and lo <= x <= hi)
    assert intervals.placed(spark.createDataFrame([], "k int, i int, lo double, hi double"), spark.createDataFrame(points, "k int, j int, at double"), ["k"], "lo", "hi", "at").count() == 0


def test_components(spark, monkeypatch):
    from leafwork.functions import components as cc

    monkeypatch.setattr(cc, "HELD", 40)
    r = np.random.default_rng(3)
    rows = [(f"d{int(k)}", 1, int(a), int(b)) for k, a, b in zip(r.integers(0, 4, 300), r.integers(0, 150, 300), r.integers(0, 150, 300))]
    chain = [("chain", 1, i, i + 1) for i in range(400)]
    star = [("star", 2, 7, i) for i in range(300)] + [("star", 2, 7, 7)]
    data = [*rows, *chain[::-1], *star, ("d0", None, 1, 2), ("d0", 1, None, 2)]
    got = {(x.doc_id, x.page_number, x.node): x.root for x in cc.components(spark.createDataFrame(data, "doc_id string, page_number int, src int, dst int").repartition(6), ["doc_id", "page_number"]).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for d, p, a, b in data:
        if None not in (p, a) and a != b:
            s, t = sorted((find((d, p, a)), find((d, p, b))))
            root[t] = s
    assert got == {x: find(x)[2] for x in root}
    assert cc.components(spark.createDataFrame([], "doc_id string, page_number int, src int, dst int"), ["doc_id", "page_number"]).count() == 0


def test_a_page_of_a_million_edges(spark):
    from leafwork.functions import components as cc

    e = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page_number"), (F.col("id") % 2000).cast("int").alias("src"), ((F.col("id") * 7 + F.floor(F.col("id") / 2000) * 2) % 2000).cast("int").alias("dst"))
    e = e.where("src % 2 = dst % 2")
    got = cc.components(e, ["doc_id", "page_number"]).groupBy("root").count().collect()
    assert sorted((r.root, r["count"]) for r in got) == [(0, 1000), (1, 1000)]


def test_nearest_looks_at_few():
    from leafwork.functions import nearest

    r = np.random.default_rng(7)
    for xy in (r.random((20_000, 2)) * 1000, np.repeat(r.integers(0, 30, (500, 2)), 3, axis=0).astype(float), np.zeros((40, 2))):
        t = nearest.Tree(xy)
        asks = r.integers(0, len(xy), 60)
        for i in asks:
            d = np.hypot(*(xy - xy[i]).T)
            d[i] = np.inf
            assert sorted(t.nearest(xy[i], int(i))) == np.flatnonzero(d <= d.min() + nearest.EQUAL).tolist()
        assert len(xy) < 10_000 or t.looked < 60 * 100
    assert nearest.Tree(np.array([[1.0, 2.0]])).nearest(np.array([0.0, 0.0]), 0) == []


def test_orphans(spark):
    r = np.random.default_rng(8)
    rows = [(d, 1, i, float(x), float(y), 4.0, 4.0) for d in (1, 2) for i, (x, y) in enumerate(r.integers(0, 40, (60, 2)) * 50)] + [(3, 1, 0, 1.0, 1.0, 2.0, 2.0)]
    n = spark.createDataFrame(rows, NODES)
    e = graph.edges(n, only=("BELOW", "RIGHT_OF"))
    used = {(x.doc_id, k) for x in e.collect() for k in (x.src, x.dst)}
    want = []
    for d, _, i, x, y, *_ in rows:
        rest = [(round(float(np.hypot(x - v[3], y - v[4])), 6), v[2]) for v in rows if v[0] == d and v[2] != i]
        if (d, i) not in used and rest:
            want.append((d, i, min(rest)[1], min(rest)[0]))
    got = sorted((x.doc_id, x.src, x.dst, x.weight) for x in graph.orphan_links(n, e).collect())
    assert len(want) > 10 and got == sorted(want)
