"""Into how many parts tables are dealt out, and what their queries leave to the disk."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from leafwork.functions import tables
from leafwork.operators import images, layout
from leafwork.sources import compositors

SF = "/root/testdata/sf0.001"
driver_data = pytest.mark.skipif(not os.path.exists(SF), reason="driver data not present")


def docs_of(spark, n=12):
    return spark.createDataFrame([(i, "one two three four\nfive six " * 20) for i in range(n)], "doc_id long, text string")


def test_larger_texts_go_to_more_partitions(spark, monkeypatch):
    docs = docs_of(spark)
    few = layout.collisions(layout.confidence_gate(compositors.text_words(docs)), cell=32)
    assert few.rdd.getNumPartitions() == 4
    monkeypatch.setattr(tables, "PART", 700)  # one text has 560 bytes
    many = layout.collisions(layout.confidence_gate(compositors.text_words(docs)), cell=32)
    assert many.rdd.getNumPartitions() == 10
    assert sorted(many.collect()) == sorted(few.collect())
    held = tables.kept(compositors.text_words(docs))
    assert held.groupBy("doc_id").count().rdd.getNumPartitions() == 10  # buckets alike, nothing is dealt out again


def test_more_orders_go_to_more_partitions(spark, monkeypatch):
    orders = spark.createDataFrame([(i * 500, "O", 1.5 * i, "1-URGENT") for i in range(100)], "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    few = compositors.ledger_words(orders)
    assert few.rdd.getNumPartitions() == 4
    monkeypatch.setattr(tables, "PART", 500)
    many = compositors.ledger_words(orders)
    assert many.rdd.getNumPartitions() == compositors.ORDER * 100 // 500
    assert sorted(many.collect()) == sorted(few.collect())


def plan_of(spark, name, mode="executedPlan"):
    q = entry.queries()[name](spark, SF)._jdf.queryExecution()
    return getattr(q, mode)().toString()


@driver_data
@pytest.mark.parametrize("name", ["plugin_detected", "image_blocks", "plugin_recognised", "image_prepared"])
def test_pages_are_drawn_many_at_a_time(spark, name):
    plan = plan_of(spark, name)
    assert "FlatMapGroupsInPandas" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_drawn_pages(spark, monkeypatch):
    monkeypatch.setattr(images, "DRAWN", 2)
    r = np.random.default_rng(4)
    rows = [(d, p, *map(int, (x, y, x + w, y + h))) for d in (1, 2, 3) for p in (1, 2) for x, y, w, h in r.integers(0, 300, (9, 4))]
    got = {(x.doc_id, x.page_number): np.frombuffer(bytes(x.data), np.uint8).reshape(x.height, x.width) for x in images.drawn(spark.createDataFrame(rows, "doc_id long, page_number int, x1 int, y1 int, x2 int, y2 int")).collect()}
    assert len(got) == 6
    for key, img in got.items():
        want = np.full((275, 200), 242, np.uint8)
        for _, _, x1, y1, x2, y2 in (v for v in rows if v[:2] == key):
            want[y1 // 4 : max(y2 // 4, y1 // 4 + 1), x1 // 4 : x2 // 4] = 40
        assert (img == want).all()


def test_kept_turns_and_weights(monkeypatch):
    r = np.random.default_rng(3)
    for _ in range(4):
        img = np.where(r.random((60, 45)) < 0.2, 40, 242).astype(np.uint8)
        kept = images.skew(img)
        monkeypatch.setattr(images, "TURNED", 0)
        assert images.skew(img) == kept
        monkeypatch.undo()
        g = r.integers(0, 256, (9, 8)).astype(np.float64)
        p = np.pad(g, 1, mode="reflect")
        near = np.stack([p[y : y + 9, x : x + 8] for y in range(3) for x in range(3)])
        w = np.exp(-((near - g) ** 2) / 1250 - np.array([2, 1, 2, 1, 0, 1, 2, 1, 2])[:, None, None] / 1250)
        assert (images.bilateral(g.astype(np.uint8)) == np.rint((w * near).sum(axis=0) / w.sum(axis=0))).all()


@driver_data
@pytest.mark.parametrize("name", ["typography_solved", "export_rendered"])
def test_lengths_of_lines_are_told_once(spark, name):
    assert plan_of(spark, name, "optimizedPlan").count("lambdafunction(char_length(") == 1


@driver_data
def test_matches_and_orphans_stay_with_their_page(spark):
    assert plan_of(spark, "evaluate_best_one_to_one").count("Exchange") <= 1
    assert "explode" not in plan_of(spark, "graph_orphans", "optimizedPlan")
