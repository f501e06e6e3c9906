"""How often rows move: queries over pages deal out documents once and stay there."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver data not present")
#: Shuffles of a query's last plan at most.
MOVES = {"layout_collisions": 1, "layout_collisions_by_cell": 1, "graph_neighbours": 1, "graph_edges": 1, "ocr_matched": 3, "ocr_confident": 3, "ocr_page_text": 3, "ocr_metrics": 3, "structure_blocks": 1, "structure_merged_tokens": 1, "export_json": 1, "layout_clusters": 3, "evaluate_one_to_one": 1}


@pytest.mark.parametrize("name", sorted(MOVES))
def test_shuffles(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") <= MOVES[name]


@pytest.mark.parametrize("name", ["layout_paragraph_clusters", "layout_greedy_merge", "layout_greedy_merge_looser", "evaluate_one_to_one"])
def test_pages_go_to_python_many_at_a_time(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
