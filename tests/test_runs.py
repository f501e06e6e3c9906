"""Runs as streaming state against the same events as a table."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwork.operators import telemetry
from leafwork.streaming import runs

EVENT = "doc_id long, event_id long, ts timestamp, state string"
BEGAN = datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def events(seed, n=260):
    r = np.random.default_rng(seed)
    minutes = np.sort(r.integers(0, 2000, n)) + r.integers(0, 3, n) * 0.25
    return [(int(d), i, BEGAN + timedelta(minutes=float(m)), [*telemetry.STAGE_OF.values(), None][int(s)]) for i, (d, m, s) in enumerate(zip(r.integers(0, 7, n), minutes, r.integers(0, 6, n)))]


def fed(spark, rows, files, path, tmp):
    """Writes the files in order, each read as one batch, and gives all rows that have come out."""
    for k, own in enumerate(files):
        spark.createDataFrame([rows[i] for i in own], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp}/in/{path}{k}")


def told(spark, tmp):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp}/in")
    q = runs.tracked(stream, "30 minutes", 60).writeStream.outputMode("append").format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/state").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.schema(runs.OUTPUT).parquet(f"{tmp}/out")


def test_stream_in_any_order_gives_the_tables_runs(store, tmp_path):
    spark, rows = store, events(1)
    r = np.random.default_rng(2)
    # any order within the half hour: sort by time with up to a quarter of an hour of shift
    order = sorted(range(len(rows)), key=lambda i: rows[i][2] + timedelta(minutes=float(r.uniform(-14, 14))))
    end = (99, 10_000, BEGAN + timedelta(days=30), "LOADED")  # time goes on, so that all runs end
    late = (3, 10_001, BEGAN + timedelta(minutes=1), "FAILED")
    after = (99, 10_002, BEGAN + timedelta(days=31), "LOADED")
    rows += [end, late, after]
    cuts = [order[:90], order[90:180]]
    fed(spark, rows, cuts, "a", str(tmp_path))
    told(spark, str(tmp_path))
    # a new query goes on from the checkpoint
    fed(spark, rows, [order[180:], [len(rows) - 3], [len(rows) - 2, len(rows) - 1]], "b", str(tmp_path))
    got = told(spark, str(tmp_path)).collect()

    table = spark.createDataFrame(rows[:-3], EVENT)
    want = {(x.doc_id, x.run): (x.last_state, x.final_state, x.n, x.illegal) for x in telemetry.runs(table, 60).collect()}
    ended = [x for x in got if x.kind == "ended" and x.doc_id != 99]
    assert len(ended) == len(want) > 20 and {(x.doc_id, x.run): (x.state, x.final_state, x.n, x.illegal) for x in ended} == want
    assert sorted(x.event_id for x in got if x.kind == "late") == [10_001]
    assert sum(x.kind == "violation" for x in got) == sum(w[3] for w in want.values()) > 10


def test_runs_of_one_silence_are_the_documents(spark):
    table = spark.createDataFrame(events(4), EVENT)
    got = {r.doc_id: (r.run, r.last_state, r.final_state, r.illegal) for r in telemetry.runs(table, 10**6).collect()}
    final = {r.doc_id: (0, r.last_state, r.final_state) for r in telemetry.final_states(table).collect()}
    bad = {r.doc_id: r["count"] for r in telemetry.violations(table).groupBy("doc_id").count().collect()}
    assert {k: v[:3] for k, v in got.items()} == final
    # a null state never counts, neither as what comes before nor after
    assert {k: v[3] for k, v in got.items()} == {k: bad.get(k, 0) for k in got}
