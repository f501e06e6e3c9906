"""What kernels tell of whole pages, against joins and edges as rows; sinks that read their tokens once."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafwork.functions import bypage
from leafwork.operators import graph, structure
from leafwork.sources import compositors, sinks

SF = "/root/testdata/sf0.001"
driver_data = pytest.mark.skipif(not os.path.exists(SF), reason="driver data not present")
NODES = "doc_id long, page_number int, node int, node_id string, x double, y double, width double, height double, text string, confidence double, page_width int, page_height int"


def nodes_of(spark, seed):
    r = np.random.default_rng(seed)
    words = ["TITLE", "key: value", "- item", "3) item", "some words of a longer line here", "x"]
    rows = []
    for d, p, n in ((1, 1, 60), (1, 2, 1), (2, 1, 25), (-3, 1, 40), (4, 1, 3)):
        for i in range(n):
            x, y = (float(v) for v in (r.choice([40, 220, 400, 580, 417]) + r.integers(0, 3), 40 + 20 * r.integers(0, 40 if d != 2 else 8)))
            rows.append((d, p, 2 * i, f"p{p}-{i}", x, y, float(r.choice([0, 8, 150, 340, 720])), float(r.choice([16, 16, 30])), str(r.choice(words)), float(r.integers(50, 100)) / 100, 800, 1100))
    return spark.createDataFrame(rows, NODES).repartition(3, "doc_id")


def told(df, *cols):
    return sorted(map(str, df.select(*(cols or df.columns)).collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pages_are_told_as_by_joins(spark, seed):
    n = nodes_of(spark, seed)
    c = graph.assigned(n, graph.column_centres(n))
    assert told(graph.columned(n), *c.columns) == told(c) and c.select("num_columns").distinct().count() > 1
    want = told(graph.labels(c, graph.edges(c)))
    assert told(graph.labels(n)) == want and len({w.split("label=")[1] for w in want}) >= 4
    b = structure.build(c, graph.edges(c, only=("SAME_ROW",)))
    assert told(structure.build(structure.tabled(n)), *b.columns) == told(b) and b.where("block_type = 'table'").count() > 0
    assert structure.build(structure.tabled(n.where("doc_id = 99"))).count() == graph.labels(n.where("doc_id = 99")).count() == 0


def plan_of(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@driver_data
@pytest.mark.parametrize("name, scans, moves", [("graph_labels", 1, 1), ("graph_edges", 1, 1), ("graph_inverse_edges", 1, 1), ("structure_sections", 1, 0), ("export_docx_commands", 2, 3), ("export_legacy_json", 2, 2), ("export_txt", 2, 4)])
def test_tables_are_read_once(spark, name, scans, moves):
    plan = plan_of(spark, name)
    assert plan.count("FileScan parquet") <= scans and plan.count("Exchange hashpartitioning") <= moves
    assert ("Join" in plan) == (name == "export_legacy_json")


@driver_data
@pytest.mark.parametrize("name", ["graph_edges", "graph_inverse_edges", "graph_labels"])
def test_pages_that_come_in_order_stay(spark, name):
    plan = plan_of(spark, name)
    assert "Window" not in plan and "Sort" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("rows", [1, 7, 40, 20_000])
def test_pages_in_order(spark, monkeypatch, rows):
    monkeypatch.setattr(bypage, "ROWS", rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        n = nodes_of(spark, 4).repartition(2, "doc_id").sortWithinPartitions("doc_id", "page_number", "node")
        want = told(graph.labels(n))
        assert told(graph.labels(n, ready=True)) == want and told(graph.edges(n, ready=True)) == told(graph.edges(n))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ledger_pages_are_those_of_words(spark):
    rows = [(int(k), s, 1.25 * k, p) for k, s, p in zip(range(3, 9000, 7), ["O", "F", None] * 500, ["1-URGENT", "5-LOW" * 9, None, "x"] * 400)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    row = compositors.ledger_words(orders).withColumn("r", F.floor(F.col("word_idx") / 4)).groupBy("doc_id", "page_number", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda v: v["text"]).alias("c"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    want = row.groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c"))), lambda v: v["c"]).alias("rows"), F.min("x1").alias("x"), F.min("y1").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    got = compositors.ledger_pages(orders)
    assert told(got) == told(want) and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]


def test_stripped_ends(spark):
    from leafwork.functions import text as t

    texts = ["", " ", "a", " a", "a ", "a\n", "\u2003a b\u00a0", "\u0085", "a\r\n", "a\u2028", "\tx y", "漢 字", " 漢", None, "a \n", "\x1cfs", "zero\u200b"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    old = F.regexp_replace(F.regexp_replace("x", r"(?U)^\s+", ""), r"(?U)\s+$", "")
    got = df.select(old.alias("old"), t.strip(F.col("x")).alias("new"), t.strip("x").alias("named")).collect()
    assert [r.old for r in got] == [r.new for r in got] == [r.named for r in got] and sum(r.new != x for r, x in zip(got, texts)) >= 8


def test_numbers_of_lists(spark):
    texts = ["3) item", "12", " 7. x", "٣: y", "3)item x", "x 3", "", None, "4\u2003em", "5.\u00a0nbsp", "6\u0085nel", "1 2", "9]", "(1) a", "\n2.) b"]
    from leafwork.functions import text as t

    df = spark.createDataFrame([(x,) for x in texts], "x string")
    old = F.coalesce(F.try_element_at(t.words(F.col("x")), F.lit(1)), F.lit("")).rlike(r"^\p{Nd}+[.):]*$")
    got = df.select(old.alias("old"), t.is_numbered(F.col("x")).alias("new")).collect()
    assert [r.old for r in got] == [r.new for r in got] and 6 <= sum(r.new for r in got) < len(got)


def test_page_breaks(spark):
    cols = "doc_id long, page_number int, block_order int, block_type string, text string, x int, y int, width int, height int, column_id int, table_rows array<array<string>>"
    t = lambda d, p, o, kind, text, rows=None: (d, p, o, kind, text, 1, 2, 3, 4, 0, rows)
    rows = [t(1, 2, 0, "paragraph", "a"), t(1, 3, 4, "list", None), t(1, 5, 1, "list", "- p\n-\n- q"), t(1, 5, 0, "table", "a | b\nc"), t(2, 7, 0, "heading", "H"), t(1, 9, 0, "TABLE", "", [["x"], ["y", " z "]])]
    got = [(r.doc_id, r.page_number, r.block_order, r.part, r.op, r.text, r.row, r.col, r.bold) for r in sinks.docx_commands(spark.createDataFrame(rows, cols)).collect()]
    brk = lambda p: (1, p, -1, 0, "page_break", "", 0, 0, False)
    cell = lambda p, k, text, r, c: (1, p, 0, k, "cell", text, r, c, r == 0)
    assert sorted(got) == sorted([
        (1, 2, 0, 0, "paragraph", "a", 0, 0, False), brk(3), brk(5), brk(9), (2, 7, 0, 0, "heading_1", "H", 0, 0, False),
        cell(5, 0, "a", 0, 0), cell(5, 1, "b", 0, 1), cell(5, 2, "c", 1, 0), (1, 5, 0, 3, "paragraph", "", 0, 0, False), (1, 5, 1, 0, "bullet", "p", 0, 0, False), (1, 5, 1, 1, "bullet", "q", 0, 0, False),
        cell(9, 0, "x", 0, 0), cell(9, 1, "y", 1, 0), cell(9, 2, "z", 1, 1), (1, 9, 0, 3, "paragraph", "", 0, 0, False),
    ])
