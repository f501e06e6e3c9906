"""One run over a folder of files: stages in a fixed order, each held to what it must return, with a policy
for failures, allowed states, timings and a final state.

    python -m leafwork.plans.run --input FOLDER --output FOLDER [--profile FILE] [--debug]
"""

from __future__ import annotations

import argparse
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions.tables import written
from leafwork.operators import graph, images, layout, ocr, plugins, structure, telemetry, typography
from leafwork.sources import files, sinks


class ContractViolation(ValueError):
    """A stage gave something else than it must."""


class Fatal(RuntimeError):
    """Stops a run at once."""


class Recoverable(RuntimeError):
    """What failed is left out; the run ends as partly failed."""


class Cancelled(Fatal):
    """Someone asked for the run to end."""


@dataclass
class Token:
    """Asks a run to end: between stages by a look at it, within one by cancelling the run's Spark jobs."""

    tag: str = field(default_factory=lambda: f"leafwork-{uuid.uuid4().hex}")
    cancelled: bool = False

    def cancel(self, spark: SparkSession) -> None:
        self.cancelled = True
        spark.sparkContext.cancelJobsWithTag(self.tag)


@dataclass
class Stage:
    """run takes the results of earlier stages by name; returns what has these columns and types.
    fallback takes its place where it fails, tries is how often it may."""

    name: str
    state: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    returns: dict[str, str]
    tries: int = 1
    fallback: Callable[[dict[str, DataFrame]], DataFrame] | None = None


@dataclass
class Result:
    final_state: str
    tables: dict[str, DataFrame]
    states: list[tuple[str, float]]
    seconds: dict[str, float]
    failures: list[str]

    @property
    def status(self) -> str:
        return {"COMPLETED": "success", "FAILED": "failed"}.get(self.final_state, "partial")


def held(stage: str, out, returns: dict[str, str]) -> DataFrame:
    if not isinstance(out, DataFrame):
        raise ContractViolation(f"{stage}: Contract Violation: expected a table, got {type(out).__name__}")
    have = dict(out.dtypes)
    wrong = [f"{k} {have.get(k, 'missing')}" for k, v in returns.items() if have.get(k) != v]
    if wrong:
        raise ContractViolation(f"{stage}: Contract Violation: {', '.join(wrong)}")
    return out


def policy(error: Exception) -> str:
    return "SKIP" if isinstance(error, Recoverable) else "FAIL_FAST" if isinstance(error, Fatal | ContractViolation) else "RETRY"


def execute(stages: list[Stage], token: Token | None = None, spark: SparkSession | None = None) -> Result:
    """Runs the stages. Each result is written before the next stage begins, so that a failure shows where
    it happens. A failure that isn't fatal is tried again as often as the stage may, then the stage's
    fallback is taken; without one the run fails, or ends as partly failed if it was recoverable."""
    at, began = "INITIALIZED", time.time()
    states, tables, seconds, failures = [(at, began)], {}, {}, []

    def to(state: str) -> None:
        nonlocal at
        if state not in telemetry.FOLLOWS[at]:
            raise ValueError(f"illegal transition from {at} to {state}")
        at = state
        states.append((state, time.time()))

    def one(stage: Stage) -> DataFrame:
        for n in range(1, stage.tries + 1):
            if token and token.cancelled:
                raise Cancelled(f"cancelled before {stage.name}")
            try:
                return written(held(stage.name, stage.run(tables), stage.returns))
            except Exception as e:
                failures.append(f"{stage.name}: {str(e)[:300]}")
                if token and token.cancelled:
                    raise Cancelled(f"cancelled in {stage.name}") from e
                if policy(e) != "RETRY" or n == stage.tries:
                    if stage.fallback is None or policy(e) == "FAIL_FAST":
                        raise
                    return written(held(stage.name, stage.fallback(tables), stage.returns))
        raise AssertionError("unreachable")

    if token and spark:
        spark.sparkContext.addJobTag(token.tag)
    try:
        for stage in stages:
            t = time.time()
            tables[stage.name] = one(stage)
            seconds[stage.name] = time.time() - t
            to(stage.state)
        to("COMPLETED")
    except Recoverable:
        to("PARTIAL_FAILURE" if "PARTIAL_FAILURE" in telemetry.FOLLOWS[at] else "FAILED")
    except Exception:
        to("FAILED")
    finally:
        if token and spark:
            spark.sparkContext.removeJobTag(token.tag)
    return Result(at, tables, states, seconds, failures)


BOX = {"x1": "int", "y1": "int", "x2": "int", "y2": "int"}


def document_stages(spark: SparkSession, folder: str, profile: files.Profile, least: float = 0.5, rasteriser: str = "pixmap", detector: str = "shape", recogniser: str = "bars") -> list[Stage]:
    """From files to rendered tokens, with the named backends."""

    def ingest(_: dict) -> DataFrame:
        endings = (*files.ENDINGS, *plugins.capabilities("rasteriser", rasteriser)["endings"])
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        ok = files.checked(read.withColumn("head", F.substring("content", 1, 4)), endings=endings).where("rejected is null")
        pages = plugins.rasterised(ok, rasteriser).where("error is null")
        return pages.select(F.xxhash64("doc_key").alias("doc_id"), "doc_key", "page_number", "height", "width", "data")

    def boxes(t: dict) -> DataFrame:
        pages = t["M2_Preprocess"].where("height > 0")
        size = pages.select("doc_id", "page_number", F.col("width").alias("page_width"), F.col("height").alias("page_height"))
        found = plugins.detected(pages, detector).join(size, ["doc_id", "page_number"]).withColumn("text", F.lit(""))
        return layout.reading_order(layout.textlines(layout.confidence_gate(found, least)), F.lit(0))

    def read(t: dict) -> DataFrame:
        found = plugins.recognised(t["M2_Preprocess"].where("height > 0"), recogniser).where("not failed").drop("failed", "given_up")
        words = ocr.matched(t["M3_Layout"], ocr.cleaned(found))
        return t["M3_Layout"].drop("text").join(words.select("doc_id", "page_number", "line_idx", "ocr_text", "ocr_confidence"), ["doc_id", "page_number", "line_idx"]).withColumnRenamed("ocr_text", "text")

    def structured(t: dict) -> DataFrame:
        n0 = written(graph.nodes(t["M4_OCR"].withColumn("confidence", F.col("ocr_confidence"))))
        n = graph.assigned(n0, graph.column_centres(n0))
        return typography.solved(structure.tokens(structure.ordered(structure.build(n, written(graph.edges(n0))))))

    def plain(t: dict) -> DataFrame:
        one = F.lit(None).cast("array<array<string>>")
        lines = t["M4_OCR"].select("doc_id", "page_number", F.col("region_id").alias("token_id"), F.lit("unknown").alias("block_type"), F.col("reading_order").alias("block_order"), "text", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"), F.lit("left_column").alias("layout_role"), F.lit(0).alias("column_id"), F.lit(1).alias("n_nodes"), F.col("ocr_confidence").alias("confidence"), one.alias("table_rows"))
        return typography.solved(lines)

    page = {"doc_id": "bigint", "page_number": "int"}
    return [
        Stage("M1_Ingest", "LOADED", ingest, page | {"height": "int", "width": "int", "data": "binary"}),
        Stage("M2_Preprocess", "PREPROCESSED", lambda t: images.prepare(t["M1_Ingest"], profile), page | {"data": "binary", "operations": "array<string>"}),
        Stage("M3_Layout", "LAYOUT_ANALYZED", boxes, page | {"line_idx": "int", "reading_order": "int"} | BOX),
        Stage("M4_OCR", "OCR_COMPLETED", read, page | {"line_idx": "int", "text": "string", "ocr_confidence": "double"}, tries=2),
        Stage("M5_Semantic", "M5_SEMANTIC_RECONSTRUCTION", structured, page | {"token_id": "string", "block_type": "string", "text": "string"}, fallback=plain),
    ]


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Pages of a folder of files as structured text.")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--profile")
    p.add_argument("--debug", action="store_true", help="also write overlays")
    a = p.parse_args(args)
    s = files.settings(a.profile)
    spark = SparkSession.builder.getOrCreate()
    done = execute(document_stages(spark, a.input, files.profile(a.profile), s["layout"]["confidence_threshold"]))
    print(json.dumps({"final_state": done.final_state, "status": done.status, "seconds": {k: round(v, 2) for k, v in done.seconds.items()}, "failures": done.failures}))
    if done.final_state != "COMPLETED":
        return 1
    tokens = sinks.rendered(done.tables["M5_Semantic"])
    writers = {
        "json": lambda to: sinks.json_documents(tokens).select("json").write.text(to), "txt": lambda to: sinks.txt(tokens).write.parquet(to), "markdown": lambda to: sinks.markdown(tokens).write.parquet(to),
        "docx": lambda to: sinks.docx_commands(tokens).write.parquet(to), "pdf": lambda to: sinks.draw_commands(tokens).write.parquet(to),
    }
    formats = [f for f in s["export"]["formats"] if f in writers] or ["json"]
    if a.debug:
        writers["overlays"] = lambda to: sinks.overlays(done.tables["M3_Layout"]).write.parquet(to)
        formats.append("overlays")
    for name, status, error in sinks.export_all({f: writers[f] for f in formats}, a.output):
        print(json.dumps({"format": name, "status": status, "error": error}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
