"""Quality against ground truth: matches by IoU, precision and recall, word error rate."""

from __future__ import annotations

import resource
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.functions import edits
from leafwork.functions import geometry as g
from leafwork.functions.assignment import heaviest
from leafwork.functions.bypage import paged
from leafwork.functions.components import smallest
from leafwork.functions.intervals import placed
from leafwork.functions.text import words

PAGE = ["doc_id", "page_number"]


def pairs(found: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(page, line_idx, truth_idx, iou) of boxes that overlap by that much; least is over 0. From a half on
    the middle of a truth's rows lies in those of the box; below, one begins within the other, so that
    pairs come from two joins."""
    if least >= 0.5:
        p = placed(found, truth.withColumn("_mid", g.centre_y()), PAGE, "y1", "y2", "_mid").where(g.iou("a", "b") >= g.real(least))
        return p.select(*[F.col(f"a.{k}") for k in PAGE], "a.line_idx", "b.truth_idx", F.round(g.iou("a", "b"), 9).alias("iou"))
    sides = (placed(found, truth, PAGE, "y1", "y2", "y1"), "a", "b"), (placed(truth, found, PAGE, "y1", "y2", "y1").where("b.y1 > a.y1"), "b", "a")
    near = [p.where(g.iou(f, t) >= g.real(least)).select(*[F.col(f"{f}.{k}") for k in PAGE], F.col(f"{f}.line_idx"), F.col(f"{t}.truth_idx"), F.round(g.iou(f, t), 9).alias("iou")) for p, f, t in sides]
    return near[0].unionByName(near[1])


def any_match(found: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(page, tp, fp, fn): a box counts if any of the other side reaches the IoU."""
    p = pairs(found, truth, least)
    hit = p.groupBy(*PAGE).agg(F.countDistinct("line_idx").alias("tp"), F.countDistinct("truth_idx").alias("hit"))
    n, m = found.groupBy(*PAGE).agg(F.count("*").alias("n")), truth.groupBy(*PAGE).agg(F.count("*").alias("m"))
    z = lambda k: F.coalesce(F.col(k), F.lit(0))
    return n.join(m, PAGE, "full").join(hit, PAGE, "left").select(*PAGE, z("tp").alias("tp"), (z("n") - z("tp")).alias("fp"), (z("m") - z("hit")).alias("fn"))


def one_to_one(found: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Matches of a greedy choice by falling IoU, until no pair is left."""
    p = pairs(found, truth, least)

    def choose(t: pa.Table, page: np.ndarray) -> pa.Table:
        at, a, b, keep = -1, set(), set(), []
        for k, i, j in zip(page.tolist(), t.column("line_idx").to_pylist(), t.column("truth_idx").to_pylist()):
            if k != at:
                at, a, b = k, set(), set()
            keep.append(i not in a and j not in b)
            if keep[-1]:
                a.add(i)
                b.add(j)
        return t.filter(pa.array(keep))

    return paged(p.withColumn("_down", -F.col("iou")), PAGE, ["_down", "line_idx", "truth_idx"], lambda t, page: choose(t.drop_columns("_down"), page), p.schema)


def best_one_to_one(found: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Matches of the one-to-one choice of greatest total IoU (in billionths), which a greedy choice may
    miss. A page's pairs fall into components that share no box; each is settled by itself, so that a page with
    very many boxes is many small groups. Of equal choices one that hangs on the boxes' numbers alone. Pairs stay
    with their page."""

    def choose(t: pa.Table, page: np.ndarray) -> pa.Table:
        ends = [np.unique(t.column(k).to_numpy(), return_inverse=True)[1] for k in ("line_idx", "truth_idx")]
        # boxes of both sides by page, as numbers from 0
        (_, a), (_, b) = (np.unique(page * np.int64(e.max() + 1) + e, return_inverse=True) for e in ends)
        part = smallest(a, b + a.max() + 1)[a]
        size = np.bincount(part)[part]
        keep = size == 1
        rest = np.flatnonzero(~keep)
        rest = rest[np.argsort(part[rest], kind="stable")]  # rows come by line and truth
        weight = np.rint(t.column("iou").to_numpy() * 1e9).astype(np.int64)
        for own in np.split(rest, np.flatnonzero(np.diff(part[rest])) + 1) if len(rest) else ():
            left, right = (pd.factorize(e[own])[0].tolist() for e in (a, b))
            keep[own[heaviest(left, right, weight[own].tolist())]] = True
        return t.filter(pa.array(keep))

    p = pairs(found, truth, least)
    return paged(p, PAGE, ["line_idx", "truth_idx"], choose, p.schema)


def scores(counts: DataFrame) -> DataFrame:
    s = counts.groupBy("doc_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), g.real(0))
    s = s.withColumns({"precision": part("tp", "fp"), "recall": part("tp", "fn")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), g.real(0))
    return s.select("doc_id", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def word_edits(truth: Column, found: Column) -> Column:
    """(errors, substitutions, insertions, deletions) of a shortest way from the words of truth to those of
    found, texts of any length and number of distinct words; null if either is null."""

    @F.pandas_udf("errors int, substitutions int, insertions int, deletions int")
    def count(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        both = [edits.counted(x, y) if x is not None and y is not None else (None,) * 3 for x, y in zip(a, b)]
        out = pd.DataFrame(both, columns=["substitutions", "insertions", "deletions"], dtype="Int32")
        return out.assign(errors=out.sum(axis=1, skipna=False))[["errors", "substitutions", "insertions", "deletions"]]

    return count(words(truth), words(found))


def wer(pairs_: DataFrame) -> DataFrame:
    """pairs_ with errors, how many of these are substitutions, insertions and deletions, reference words and
    the quotient of errors and these."""
    n = F.size(words(F.col("truth")))
    out = pairs_.withColumn("_e", word_edits(F.col("truth"), F.col("found")))
    out = out.withColumns({k: F.col(f"_e.{k}") for k in ("errors", "substitutions", "insertions", "deletions")}).drop("_e")
    return out.withColumn("n_words", n).withColumn("wer", F.when(n > 0, F.round(F.col("errors") / n, 6)).otherwise(F.when(F.col("errors") > 0, g.real(1)).otherwise(g.real(0))))


def ground_truth(spark: SparkSession, path: str, kind: str = "custom") -> DataFrame:
    """(source, truth_idx, x1, y1, x2, y2, text) of a folder of ground truth. "funsd": JSON files with a
    form of boxes; "sroie": text lines of eight corner coordinates and a text, by commas; "custom": JSON
    lines or Parquet with these columns."""
    box = ["x1", "y1", "x2", "y2"]
    if kind == "funsd":
        entry = "struct<id:int,box:array<int>,text:string>"
        f = spark.read.option("multiLine", "true").schema(f"form array<{entry}>").json(path).select(F.col("_metadata.file_name").alias("source"), F.explode("form").alias("e"))
        return f.select("source", F.col("e.id").alias("truth_idx"), *[F.col("e.box")[i].alias(k) for i, k in enumerate(box)], "e.text")
    if kind == "sroie":
        f = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.posexplode(F.split("value", r"\r?\n")).alias("truth_idx", "line"))
        parts = F.split("line", ",", 9)
        n = f.where(F.size(parts) == 9).select("source", "truth_idx", F.transform(F.slice(parts, 1, 8), lambda x: F.trim(x).cast("int")).alias("c"), parts[8].alias("text"))
        xs, ys = F.array(*[F.col("c")[i] for i in (0, 2, 4, 6)]), F.array(*[F.col("c")[i] for i in (1, 3, 5, 7)])
        return n.select("source", "truth_idx", F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"), "text")
    if kind != "custom":
        raise ValueError(f"unknown kind of ground truth: {kind}")
    schema = "source string, truth_idx int, x1 int, y1 int, x2 int, y2 int, text string"
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(schema).json(path)


#: What a report is held against.
TARGETS = {"precision": 0.85, "recall": 0.80, "f1": 0.82, "wer": 0.15}


def report(scored: DataFrame, errors: DataFrame, latency: DataFrame, ram_mb: float | None = None) -> DataFrame:
    """One row per document with ground truth: scores, word error rate over all its pairs, mean latency of
    a page, peak memory of the driver (the argument, else measured), and which targets it meets."""
    if ram_mb is None:
        ram_mb = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    w = errors.groupBy("doc_id").agg(F.round(F.sum("errors") / F.greatest(F.lit(1), F.sum("n_words")), 6).alias("wer"))
    lat = latency.groupBy("doc_id").agg(F.round(F.sum("latency") / F.count("*"), 6).alias("latency_per_page"))
    r = scored.join(w, "doc_id", "left").join(lat, "doc_id", "left")
    met = F.array(*[F.when((F.col(k) <= g.real(v)) if k == "wer" else (F.col(k) >= g.real(v)), F.lit(k)) for k, v in TARGETS.items()])
    return r.select("doc_id", "precision", "recall", F.col("f1").alias("f1_score"), "wer", "latency_per_page", F.lit(float(ram_mb)).alias("ram_usage_mb"), F.filter(met, lambda x: x.isNotNull()).alias("targets_met"))
