"""Line dedup: windows of three consecutive lines, hashed and counted over the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import far, keyed, table


def windows(docs: DataFrame, width: int) -> DataFrame:
    """(_id, _th, pos, k1, k2): a row for each window with a line that isn't blank."""
    lines = docs.select("_id", F.xxhash64("_text").alias("_th"), F.split("_text", "\n", -1).alias("l")).where(F.size("l") >= width)
    hashed = lines.select("_id", "_th", F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(17)).alias("b"), (F.trim(x) != "").alias("t"))).alias("h"))
    at = lambda i: [F.col("h")[i + j] for j in range(width)]
    each = hashed.select("_id", "_th", F.explode(F.transform(F.sequence(F.lit(0), F.size("h") - width), lambda i: F.struct(
        i.alias("pos"),
        F.xxhash64(*[x["a"] for x in at(i)]).alias("k1"),
        F.xxhash64(F.lit(29), *[x["b"] for x in at(i)]).alias("k2"),
        F.array_contains(F.array(*[x["t"] for x in at(i)]), True).alias("t"),
    ))).alias("w"))
    return each.where("w.t").select("_id", "_th", "w.pos", "w.k1", "w.k2")


def later_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """(_id, _th, starts): of each document, the windows that also start earlier: in a document
    with a smaller id, or in the same one before."""
    every = windows(docs, width)
    repeated = (
        every.groupBy("k1", "k2").agg(F.min(F.struct("_id", "pos")).alias("first"), F.max(F.struct("_id", "pos")).alias("last"))
        .where("first < last").select(far(F.col("k1")).alias("j1"), far(F.col("k2")).alias("j2"), "first")
    )
    marked = every.withColumns({"j1": far(F.col("k1")), "j2": far(F.col("k2"))}).join(repeated, ["j1", "j2"]).where(F.struct("_id", "pos") > F.col("first"))
    return marked.groupBy("_id", "_th").agg(F.collect_set("pos").alias("starts"))


def cut_lines(text: str, starts, width: int) -> tuple[int, int, str]:
    """(lines, removed lines, what stays) of a text whose windows at these starts are later ones."""
    lines = text.split("\n")
    if starts is None or len(starts) == 0:
        return len(lines), 0, text
    edge = np.zeros(len(lines) + 1, dtype=np.int64)
    starts = np.asarray(starts)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    keep = np.cumsum(edge)[:-1] == 0
    return len(lines), int((~keep).sum()), "\n".join(x for x, k in zip(lines, keep) if k)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per document: id_col, n_lines, n_removed, kept_text.

    Lines are split at \\n, bytes as they are. A window is `width` consecutive lines, at least one
    of which isn't blank. A window that also starts in a document with a smaller id, or earlier in
    the same one, is a later occurrence; the lines that later occurrences cover go. Windows are
    judged on the input. Rows without an id take no part; a null text counts as empty (one empty
    line); documents of fewer lines keep all; equal rows with one id give equal rows; other columns
    are ignored; an empty table gives an empty one. Identity of windows is that of 128 hash bits.
    """
    base = keyed(docs, id_col, text_col)
    cuts = later_windows(base, width)
    both = base.withColumn("_th", F.xxhash64("_text")).join(cuts, ["_id", "_th"], "left").select("_id", "_text", "starts")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [cut_lines(t, s, width) for t, s in zip(b["_text"], b["starts"])]
            yield pd.DataFrame([(i, *g) for i, g in zip(b["_id"], got)], columns=[id_col, "n_lines", "n_removed", "kept_text"])

    kind = base.schema["_id"].dataType.simpleString()
    return both.mapInPandas(cut, f"`{id_col}` {kind}, n_lines long, n_removed long, kept_text string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, count_col: str = "n_chars") -> DataFrame:
    """docs, all columns, without the lines that line_dedup removes; count_col, where docs has it, is
    counted anew in changed rows. A document of which only blank lines would stay is left out; one
    that was blank from the start, or has no id, stays as it is."""
    names = docs.columns
    keyed_docs = docs.withColumns({"__t": F.coalesce(F.col(text_col), F.lit(""))}).withColumn("__h", F.xxhash64("__t"))
    cuts = later_windows(keyed(docs, id_col, text_col), width).select(F.col("_id").alias("__i"), F.col("_th").alias("__th"), F.col("starts").alias("__s"))
    both = keyed_docs.join(cuts, (F.col(id_col) == F.col("__i")) & (F.col("__h") == F.col("__th")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, starts = b.column("__t").to_pylist(), b.column("__s").to_pylist()
            new = [t if not s else cut_lines(t, s, width)[2] for t, s in zip(texts, starts)]
            live = [not s or bool(x.strip()) for x, s in zip(new, starts)]
            columns = {c: b.column(c) for c in names}
            changed = pa.array([bool(s) for s in starts])
            columns[text_col] = pc.if_else(changed, pa.array(new, pa.string()), columns[text_col].cast(pa.string()))
            if count_col in columns:
                columns[count_col] = pc.if_else(changed, pa.array([len(x) for x in new]).cast(columns[count_col].type), columns[count_col])
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(live))

    return both.select(*names, "__t", "__s").mapInArrow(run, docs.schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM l),
w AS (SELECT doc_id, pos, line, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3 FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS k FROM w
      WHERE l3 IS NOT NULL AND (trim(line, ' ') <> '' OR trim(l2, ' ') <> '' OR trim(l3, ' ') <> '')),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE k > 1)
SELECT e.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
       sha256(coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (WHERE c.pos IS NULL), '')) AS kept_sha256
FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.pos = c.pos GROUP BY e.doc_id
"""
