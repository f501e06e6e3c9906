"""The driver's contract, and a few queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


@needs_data
@pytest.mark.parametrize("name", ["layout_textlines", "layout_column_boundaries", "layout_table_candidates_ledger", "telemetry_violations", "structure_table_grid", "layout_box_arithmetic", "layout_column_assignment", "structure_blocks", "graph_order", "ocr_batches", "typography_tables", "export_txt", "export_docx_commands", "export_draw_commands", "export_legacy_json", "image_overrides", "telemetry_recovery", "telemetry_context", "telemetry_rollup"])
def test_against_sql(spark, name):
    got = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "orders", "events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(got.columns)
    norm = lambda v: tuple(map(norm, v)) if isinstance(v, list) else round(v, 6) if isinstance(v, float) else v
    assert sorted((tuple(norm(x) for x in row) for row in got.select(*cols).collect()), key=str) == sorted((tuple(norm(x) for x in row) for row in r.fetchall()), key=str)


@needs_data
def test_pair_query_joins_on_the_page(spark):
    plan = entry.queries()["layout_collisions"](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@needs_data
def test_stream_gives_what_the_table_gives(spark, tmp_path):
    from leafwork.streaming import events

    table = spark.read.parquet(f"{SF}/events.parquet")
    table.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    q = events.windowed(events.arriving(spark, str(tmp_path / "in"), table)).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.table("w")) == key(events.windowed(table))


@needs_data
@pytest.mark.parametrize("name, most", [("layout_reading_order", 6), ("structure_blocks", 9), ("evaluate_one_to_one", 6)])
def test_scans(spark, name, most):
    """What several branches read is a table; the documents themselves are read once before."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("FileScan parquet") <= most and "documents.parquet" not in plan
