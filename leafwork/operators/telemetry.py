"""Stage timings, states and their allowed order, batch outcomes, from a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States by type of event, and which states may follow which.
STAGE_OF = {"view": "INITIALIZED", "click": "LOADED", "signup": "PREPROCESSED", "purchase": "LAYOUT_ANALYZED", "error": "FAILED"}
FOLLOWS = {
    "INITIALIZED": ("LOADED", "FAILED"),
    "LOADED": ("PREPROCESSED", "FAILED"),
    "PREPROCESSED": ("LAYOUT_ANALYZED", "FAILED"),
    "LAYOUT_ANALYZED": ("OCR_COMPLETED", "FAILED", "PARTIAL_FAILURE"),
    "OCR_COMPLETED": ("M5_SEMANTIC_RECONSTRUCTION", "COMPLETED", "PARTIAL_FAILURE", "FAILED", "M5_FAILURE"),
    "M5_SEMANTIC_RECONSTRUCTION": ("COMPLETED", "PARTIAL_FAILURE", "FAILED"),
    "PARTIAL_FAILURE": ("COMPLETED", "FAILED"),
    "M5_FAILURE": ("COMPLETED", "PARTIAL_FAILURE", "FAILED"),
    "COMPLETED": (),
    "FAILED": (),
}
ALLOWED = [(a, b) for a, own in FOLLOWS.items() for b in own]


def state_events(events: DataFrame) -> DataFrame:
    """(doc_id, event_id, ts, state, latency)"""
    names = F.create_map(*[F.lit(x) for kv in STAGE_OF.items() for x in kv])
    return events.select(F.col("user_id").alias("doc_id"), "event_id", "ts", names[F.col("event_type")].alias("state"), F.col("value").alias("latency"))


def stage_metrics(states: DataFrame) -> DataFrame:
    return states.groupBy("doc_id", "state").agg(F.count("*").alias("n"), F.round(F.sum("latency"), 6).alias("latency"), F.max("event_id").alias("last_event"))


def violations(states: DataFrame) -> DataFrame:
    """Events whose state may not follow the document's state before."""
    w = Window.partitionBy("doc_id").orderBy("ts", "event_id")
    spark = states.sparkSession
    ok = spark.createDataFrame(ALLOWED, "before string, state string")
    return states.withColumn("before", F.lag("state").over(w)).where("before is not null and before <> state").join(F.broadcast(ok), ["before", "state"], "left_anti").select("doc_id", "event_id", "before", "state")


def final_states(states: DataFrame) -> DataFrame:
    s = states.groupBy("doc_id").agg(F.max(F.struct("ts", "event_id", "state")).alias("m"), F.count_if(F.col("state") == "FAILED").alias("fatal"), F.count_if(F.col("state") == "LOADED").alias("loaded"))
    state = F.when(F.col("fatal") > 0, "FAILED").when(F.col("loaded") == 0, "PARTIAL_FAILURE").otherwise("COMPLETED")
    return s.select("doc_id", F.col("m.state").alias("last_state"), state.alias("final_state"))


def outcome(failed: bool, loaded: bool) -> str:
    """The final state of a run by what it has been through, as `final_states` has it."""
    return "FAILED" if failed else "COMPLETED" if loaded else "PARTIAL_FAILURE"


def runs(states: DataFrame, silence_minutes: int = 60) -> DataFrame:
    """(doc_id, run, last_state, final_state, n, illegal): a document's events fall into runs that a longer
    silence parts; illegal counts those whose state may not follow the one before in the run."""
    w = Window.partitionBy("doc_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = states.withColumn("_at", at).withColumns({"_gap": F.col("_at") - F.lag("_at").over(w), "_before": F.lag("state").over(w)})
    e = e.withColumn("_new", F.coalesce(F.col("_gap") > silence_minutes * 60_000_000, F.lit(True))).withColumn("run", (F.sum(F.col("_new").cast("int")).over(w) - 1).cast("int"))
    ok = F.array(*[F.lit(f"{a}>{b}") for a, b in ALLOWED])
    bad = ~F.col("_new") & (F.col("_before") != F.col("state")) & ~F.array_contains(ok, F.concat_ws(">", "_before", "state"))
    per = e.groupBy("doc_id", "run").agg(F.max(F.struct("ts", "event_id", "state")).alias("m"), F.count_if(F.col("state") == "FAILED").alias("fatal"), F.count_if(F.col("state") == "LOADED").alias("loaded"), F.count("*").alias("n"), F.count_if(bad).alias("illegal"))
    final = F.when(F.col("fatal") > 0, outcome(True, True)).when(F.col("loaded") == 0, outcome(False, False)).otherwise(outcome(False, True))
    return per.select("doc_id", "run", F.col("m.state").alias("last_state"), final.alias("final_state"), "n", "illegal")


def durations(states: DataFrame) -> DataFrame:
    """Seconds from the first to the last event of each document's state."""
    return states.groupBy("doc_id", "state").agg((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("micros"))


def batch_outcome(final: DataFrame, least: float = 0.85) -> DataFrame:
    rate = F.avg((F.col("final_state") == "COMPLETED").cast("double"))
    return final.agg(F.count("*").alias("documents"), F.count_if(F.col("final_state") == "COMPLETED").alias("succeeded"), F.round(rate, 6).alias("success_rate"), (rate >= least).alias("target_met"))


def recovery(failures: DataFrame, tries: int = 2) -> DataFrame:
    """What to do about each failure (doc_id, event_id, ts, kind): a recoverable one is skipped, a fatal one
    stops at once, any other is tried again until a document has had so many of them."""
    w = Window.partitionBy("doc_id", "kind").orderBy("ts", "event_id")
    action = F.when(F.col("kind") == "recoverable", "SKIP").when(F.col("kind") == "fatal", "FAIL_FAST").when(F.row_number().over(w) < tries, "RETRY").otherwise("FAIL_FAST")
    return failures.select("doc_id", "event_id", "kind", action.alias("action"))


def context_status(final: DataFrame, states: DataFrame) -> DataFrame:
    """(doc_id, status, error_stage, n_events): success, failed or partial; the state before the first
    failure is where it happened."""
    w = Window.partitionBy("doc_id").orderBy("ts", "event_id")
    s = states.withColumn("before", F.lag("state").over(w))
    bad = s.where("state = 'FAILED'").groupBy("doc_id").agg(F.min_by(F.coalesce("before", F.lit("")), F.struct("ts", "event_id")).alias("error_stage"))
    n = states.groupBy("doc_id").agg(F.count("*").alias("n_events"))
    status = F.when(F.col("final_state") == "COMPLETED", "success").when(F.col("final_state") == "FAILED", "failed").otherwise("partial")
    return final.join(n, "doc_id").join(bad, "doc_id", "left").select("doc_id", status.alias("status"), F.coalesce("error_stage", F.lit("")).alias("error_stage"), "n_events")


def rolled_up(states: DataFrame) -> DataFrame:
    """Events and their latency by day and state, with totals: of a day where state is null, of all where
    both are."""
    r = states.withColumn("day", F.to_date("ts")).rollup("day", "state").agg(F.count("*").alias("n"), F.round(F.sum("latency"), 4).alias("latency"))
    return r.select("day", "state", "n", "latency")
