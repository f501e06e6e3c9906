"""Kernels over whole pages."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafwork.functions import bypage
from leafwork.operators import layout


def test_pages_come_whole(spark, monkeypatch):
    monkeypatch.setattr(bypage, "ROWS", 7)
    df = spark.range(200).select((F.col("id") % 3).alias("doc_id"), (F.col("id") % 11).cast("int").alias("page_number"), F.col("id").alias("v"))

    def size(t: pa.Table, page: np.ndarray) -> pa.Table:
        return t.append_column("n", pa.array(np.bincount(page)[page]))

    got = {(r.doc_id, r.page_number): r.n for r in bypage.paged(df, ["doc_id", "page_number"], ["v"], size, "doc_id long, page_number int, v long, n long").collect()}
    assert got == {(r.doc_id, r.page_number): r["count"] for r in df.groupBy("doc_id", "page_number").count().collect()}


def test_sweep_makes_each_pair_once(monkeypatch):
    monkeypatch.setattr(bypage, "PAIRS", 5)
    r = np.random.default_rng(1)
    page, lo = np.sort(r.integers(0, 3, 60)), r.integers(-9, 30, 60).astype(float)
    hi = lo + r.integers(-1, 9, 60)
    got = sorted((min(i, j), max(i, j)) for a, b in bypage.swept(page, lo, hi) for i, j in zip(a.tolist(), b.tolist()))
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if page[i] == page[j] and lo[i] < hi[i] and lo[j] < hi[j] and lo[i] < hi[j] and lo[j] < hi[i]]
    assert got == want


@pytest.mark.parametrize("cell", [None, 32])
def test_collisions_against_all_pairs(spark, cell):
    r = np.random.default_rng(2)
    rows = [(1, int(r.integers(1, 3)), i, int(a), int(b), int(a + w), int(b + h), 0.9, "w", 200, 200) for i, (a, b, w, h) in enumerate(zip(r.integers(0, 180, 80), r.integers(0, 180, 80), r.integers(1, 30, 80), r.integers(1, 90, 80)))]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, word_idx int, x1 int, y1 int, x2 int, y2 int, confidence double, text string, page_width int, page_height int")
    want = {}
    for p in rows:
        over, near = 0, []
        for q in rows:
            w = min(200, p[5] + 4, q[5] + 4) - max(0, p[3] - 4, q[3] - 4)
            h = min(200, p[6] + 6, q[6] + 6) - max(0, p[4] - 6, q[4] - 6)
            if p[1] == q[1] and p[2] != q[2] and w > 0 and h > 0:
                over, near = over + w * h, [*near, q[2]]
        want[p[2]] = (pytest.approx(over / max(1, (p[5] - p[3]) * (p[6] - p[4])), abs=1e-5), near)
    assert {x.word_idx: (x.pressure, x.neighbours) for x in layout.collisions(df, cell=cell).collect()} == want
