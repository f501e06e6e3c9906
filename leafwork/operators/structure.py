"""Nodes to blocks, each class taking what earlier ones left: headings, tables, key-values, lists, paragraphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions import geometry as g
from leafwork.functions import text as t
from leafwork.functions.bypage import numbers
from leafwork.functions.components import smallest
from leafwork.functions.islands import islands
from leafwork.operators.graph import NODE, PAGE, banded, boxes, in_columns, related, widened
from leafwork.operators.layout import page_components

BLOCK = ["block_type", "block_no", "text", "x", "y", "width", "height", "column_id", "layout_role", "children", "confidence", "table_rows"]


def role(column: Column) -> Column:
    return F.when(column == -1, "full_width").when(column == 0, "left_column").when(column == 1, "right_column").otherwise("multi_column")


def is_heading() -> Column:
    return (F.char_length("text") < 80) & ((F.col("width") > g.real(0.55) * F.col("page_width")) | (t.is_upper(F.col("text")) & (F.char_length("text") > 2)))


def is_key_value() -> Column:
    return (F.instr("text", ":") > 0) & (F.size(t.words(F.col("text"))) <= 8)


def is_list() -> Column:
    return t.is_bullet(F.col("text")) | t.is_numbered(F.col("text"))


def millionths(column: Column) -> Column:
    """column to six digits as SQL's round has it: times a million, to the nearest whole number, back. What
    F.round does to a double goes by its decimals and parts from that at halves."""
    return F.round(column * g.real(1e6)) / g.real(1e6)


def mean(values: Column) -> Column:
    """Mean of an array of numbers of six digits, itself of six, halves up: a sum of whole millionths, so
    that it doesn't hang on the order of rows. Null for an empty array."""
    n = F.size(values)
    whole = F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + F.round(v * g.real(1e6)).cast("long"))
    return F.when(n > 0, F.floor((2 * whole + n) / (2 * n)) / g.real(1e6))


def blocks_of(grouped: DataFrame, kind: str, order: list[str], sep: str, column: Column) -> DataFrame:
    """One block per (page, block_no): hull, texts joined in order, mean confidence."""
    pick = F.struct(*order, "node", "text", "confidence")
    b = grouped.groupBy(*PAGE, "block_no").agg(
        F.array_sort(F.collect_list(pick)).alias("s"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("r"), F.max(F.col("y") + F.col("height")).alias("d"),
        column.alias("column_id"),
    )
    known = F.filter(F.transform("s", lambda v: v["confidence"]), lambda v: v.isNotNull())
    return b.select(*PAGE, F.lit(kind).alias("block_type"), "block_no", F.array_join(F.transform("s", lambda v: v["text"]), sep).alias("text"), "x", "y", (F.col("r") - F.col("x")).alias("width"), (F.col("d") - F.col("y")).alias("height"),
                    "column_id", role(F.col("column_id")).alias("layout_role"), F.transform("s", lambda v: v["node"]).alias("children"), mean(known).alias("confidence"), F.lit(None).cast("array<array<string>>").alias("table_rows"))


def headings(n: DataFrame) -> DataFrame:
    h = n.where(is_heading()).withColumn("block_no", (F.row_number().over(Window.partitionBy(*PAGE).orderBy("node")) - 1).cast("int"))
    return blocks_of(h, "heading", ["y", "x"], " ", F.lit(-1))


def table_rows(n: DataFrame, e: DataFrame) -> DataFrame:
    """Nodes of SAME_ROW components of two or more, with the component's number."""
    c = page_components(n, e.where("relation = 'SAME_ROW'"), "node", "row_no", among=True)
    return n.join(c, NODE).withColumn("_n", F.count("*").over(Window.partitionBy(*PAGE, "row_no"))).where("_n >= 2").drop("_n")


def tables(n: DataFrame, e: DataFrame, gap: float = 40.0) -> DataFrame:
    """Blocks of at least two rows that follow each other within the gap; cells by x."""
    return tables_of(table_rows(n, e), gap)


def in_tables(t: pa.Table, page: np.ndarray, gap: float = 40.0) -> pa.Table:
    """Nodes of whole pages by node, with row_no: the row of those that are in tables(), null for others. Nodes
    with _heading are in none."""
    y, h, node = numbers(t, "y", "height", "node")
    free = ~t.column("_heading").fill_null(False).to_numpy()
    own = np.cumsum(np.append(False, (np.diff(page) != 0) | (np.diff(node) != 0)))
    ends = [np.zeros((2, 1), np.int64)]
    for src, dst, _, _ in related(boxes(t), page, 30.0, 0.85, ("SAME_ROW",)):
        k = free[src] & free[dst]
        ends.append(np.stack([own[src[k]], own[dst[k]]]))
    a, b = np.concatenate(ends, axis=1)
    root = smallest(a, b)
    root = np.append(root, np.arange(len(root), own[-1] + 1))[own]
    at = np.flatnonzero(free & (np.bincount(root[free], minlength=len(page))[root] >= 2))
    rows, row = np.unique(root[at], return_inverse=True)
    top, end, sheet = np.full(len(rows), np.inf), np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)
    np.minimum.at(top, row, y[at])
    np.maximum.at(end, row, (y + h)[at])
    sheet[row] = page[at]
    order = np.lexsort((rows, top, sheet))
    new = np.append(True, (np.diff(sheet[order]) != 0) | (top[order][1:] - end[order][:-1] >= gap))[: len(rows)]
    run = np.zeros(len(rows), np.int64)
    run[order] = np.cumsum(new) - 1
    at = at[(np.bincount(run)[run] >= 2)[row]] if len(rows) else at
    none, no = np.ones(len(page), bool), np.zeros(len(page), np.int32)
    none[at], no[at] = False, root[at] - np.searchsorted(page, page[at])
    return t.append_column("row_no", pa.array(no, mask=none))


def tabled(n: DataFrame, ready: bool = False) -> DataFrame:
    """Nodes without columns as build() takes them by themselves: with columns, whether they are headings, and
    with the rows of tables among the others."""
    return widened(n.withColumn("_heading", is_heading()), "column_id int, num_columns int, row_no int", in_columns, in_tables, ready=ready)


def tables_of(rows: DataFrame, gap: float = 40.0) -> DataFrame:
    """tables() of nodes with row_no."""
    r = rows.groupBy(*PAGE, "row_no").agg(
        F.min("y").alias("y"), F.max(F.col("y") + F.col("height")).alias("d"), F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("r"),
        F.array_sort(F.collect_list(F.struct("x", "node", "text", "confidence"))).alias("cells"), F.count("*").alias("k"),
    ).withColumn("conf", F.transform("cells", lambda c: F.coalesce(c["confidence"], g.real(0))))
    w = Window.partitionBy(*PAGE).orderBy("y", "row_no")
    grouped = islands(r, PAGE, ["y", "row_no"], F.col("y") - F.lag("d").over(w) >= g.real(gap), "run")
    whole = grouped.groupBy(*PAGE, "run").agg(F.array_sort(F.collect_list(F.struct("y", "row_no", "cells", "conf"))).alias("s"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("r").alias("r"), F.max("d").alias("d"), F.sum("k").alias("k")).where(F.size("s") >= 2)
    cells = F.transform("s", lambda v: F.transform(v["cells"], lambda c: c["text"]))
    no = (F.row_number().over(Window.partitionBy(*PAGE).orderBy("run")) - 1).cast("int")
    return whole.withColumn("table_rows", cells).select(
        *PAGE, F.lit("table").alias("block_type"), no.alias("block_no"), F.array_join(F.transform("table_rows", lambda v: F.array_join(v, " | ")), "\n").alias("text"), "x", "y", (F.col("r") - F.col("x")).alias("width"), (F.col("d") - F.col("y")).alias("height"),
        F.lit(-1).alias("column_id"), F.lit("full_width").alias("layout_role"), F.flatten(F.transform("s", lambda v: F.transform(v["cells"], lambda c: c["node"]))).alias("children"), mean(F.flatten(F.transform("s", lambda v: v["conf"]))).alias("confidence"), "table_rows",
    )


def key_values(n: DataFrame, gap: float = 30.0) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy("y", "x", "node")
    k = islands(n.where(is_key_value()), PAGE, ["y", "x", "node"], F.col("y") - F.lag(F.col("y") + F.col("height")).over(w) >= g.real(gap), "block_no")
    return blocks_of(k, "key_value", ["y", "x"], "\n", F.min_by("column_id", F.struct("y", "x", "node")))


def runs(n: DataFrame, kind: str, order: list[str], gap: float, sep: str) -> DataFrame:
    """Blocks of nodes of one column, each within gap of the one before."""
    w = Window.partitionBy(*PAGE).orderBy(*order, "node")
    new = (F.col("column_id") != F.lag("column_id").over(w)) | (F.col("y") - F.lag(F.col("y") + F.col("height")).over(w) >= g.real(gap))
    return blocks_of(islands(n, PAGE, [*order, "node"], new, "block_no"), kind, order, sep, F.first("column_id"))


def lists(n: DataFrame) -> DataFrame:
    return runs(n.where(is_list()), "list", ["column_id", "y"], 25.0, "\n")


def paragraphs(n: DataFrame) -> DataFrame:
    return runs(n, "paragraph", ["column_id", "y", "x"], 30.0, " ")


def build(n: DataFrame, e: DataFrame | None = None) -> DataFrame:
    """All blocks of nodes with column_id and edges e, or of tabled() nodes. What a class claims by its nodes alone
    is told by an expression; only tables of edges need a join. All other classes go through the same windows and groups at once, each in the
    order and with the breaks that it has by itself. A node that is a heading is never asked again."""
    if e is None:
        t_, m = tables_of(n.where("row_no is not null")), n.where("row_no is null")
    else:
        t_ = tables(n.where(~is_heading()), e)
        m = n.join(t_.select(*PAGE, F.explode("children").alias("node")), NODE, "left_anti").withColumn("_heading", is_heading())
    k = m.withColumn("block_type", F.when(F.col("_heading"), "heading").when(is_key_value(), "key_value").when(is_list(), "list").otherwise("paragraph"))
    is_ = lambda *kinds: F.col("block_type").isin(*kinds)
    columned = is_("list", "paragraph")
    k = k.withColumns({"_c": F.when(columned, F.col("column_id")).otherwise(0), "_y": F.when(is_("heading"), g.real(0)).otherwise(F.col("y")), "_x": F.when(is_("key_value", "paragraph"), F.col("x")).otherwise(g.real(0))})
    part, order = [*PAGE, "block_type"], ["_c", "_y", "_x", "node"]
    w = Window.partitionBy(*part).orderBy(*order)
    far = F.col("y") - F.lag(F.col("y") + F.col("height")).over(w) >= F.when(is_("list"), g.real(25)).otherwise(g.real(30))
    k = islands(k, part, order, F.when(is_("heading"), F.lit(True)).when(is_("key_value"), far).otherwise((F.col("column_id") != F.lag("column_id").over(w)) | far), "block_no")
    pick = F.struct("_c", "y", F.when(is_("list"), g.real(0)).otherwise(F.col("x")).alias("_x"), "node", "text", "confidence")
    b = k.groupBy(*part, "block_no").agg(
        F.array_sort(F.collect_list(pick)).alias("s"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("r"), F.max(F.col("y") + F.col("height")).alias("d"),
        F.min_by("column_id", F.struct("y", "x", "node")).alias("column_id"),
    ).withColumn("column_id", F.when(is_("heading"), -1).otherwise(F.col("column_id")))
    known = F.filter(F.transform("s", lambda v: v["confidence"]), lambda v: v.isNotNull())
    texts = F.transform("s", lambda v: v["text"])
    rest = b.select(*PAGE, "block_type", "block_no", F.when(is_("key_value", "list"), F.array_join(texts, "\n")).otherwise(F.array_join(texts, " ")).alias("text"), "x", "y", (F.col("r") - F.col("x")).alias("width"), (F.col("d") - F.col("y")).alias("height"),
                    "column_id", role(F.col("column_id")).alias("layout_role"), F.transform("s", lambda v: v["node"]).alias("children"), mean(known).alias("confidence"), F.lit(None).cast("array<array<string>>").alias("table_rows"))
    return rest.unionByName(t_)


def ordered(blocks: DataFrame) -> DataFrame:
    """Blocks with their place on the page: bands of twenty pixels, full width first, then columns."""
    no = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y", "x", "block_type", "block_no"))
    b = blocks.withColumn("node", no.cast("int"))
    return banded(b, 20.0, "layout_role = 'full_width'", "block_order").drop("band", "node")


def tokens(blocks: DataFrame) -> DataFrame:
    """Blocks as render tokens: whole-number boxes, cut toward zero."""
    i = lambda k: F.col(k).cast("int").alias(k)
    ident = F.concat(F.when(F.col("block_type") == "paragraph", "para").when(F.col("block_type") == "key_value", "kv").otherwise(F.col("block_type")), F.lit("-p"), F.col("page_number").cast("string"), F.lit("-"), F.col("block_no").cast("string"))
    return blocks.select(*PAGE, ident.alias("token_id"), "block_type", "block_order", "text", i("x"), i("y"), i("width"), i("height"), "layout_role", "column_id", F.size("children").alias("n_nodes"), "confidence", "table_rows")


def fallback_tokens(lines: DataFrame) -> DataFrame:
    """Lines one to one, where structure can't be built."""
    return lines.select(*PAGE, "region_id", F.lit("unknown").alias("block_type"), "reading_order", "text", "x1", "y1", "x2", "y2")


def text_class(text: Column) -> Column:
    """The class of a text by itself."""
    s = t.strip(text)
    return F.when((F.char_length(s) < 60) & t.is_upper(s), "heading").when(F.substring(s, 1, 1).isin("•", "-", "*"), "list").when(F.size(t.words(s)) > 5, "paragraph").otherwise("unknown")


def sections(blocks: DataFrame) -> DataFrame:
    """A heading opens a section that runs to the next one on the page; the first section may have none."""
    w = Window.partitionBy(*PAGE).orderBy("block_order")
    b = blocks.withColumn("section", F.sum((F.col("block_type") == "heading").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    s = F.collect_list(F.when(F.col("block_type") != "heading", F.struct("block_order", "text")))
    return b.groupBy(*PAGE, "section").agg(F.max(F.when(F.col("block_type") == "heading", F.col("text"))).alias("title"), F.array_join(F.transform(F.array_sort(s), lambda x: x["text"]), "\n").alias("body"), F.count("*").alias("n_blocks"))


def cleaned(text: Column) -> Column:
    """Without control characters but line ends and tabs; runs of white space of two or more as one."""
    return t.strip(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", ""), r"\s{2,}", " "))


def artifacts_removed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("text", cleaned(F.col("text"))).where(F.char_length("text") >= 2)


def merged_paragraphs(lines: DataFrame, gap: int = 8, side: int = 12) -> DataFrame:
    """Lines by (y1, x1), joined while the next begins within gap under the last and at its left side."""
    w = Window.partitionBy(*PAGE).orderBy("y1", "x1", "line_idx")
    new = (F.abs(F.lag("y2").over(w) - F.col("y1")) >= gap) | (F.abs(F.col("x1") - F.lag("x1").over(w)) >= side)
    p = islands(lines, PAGE, ["y1", "x1", "line_idx"], new, "paragraph")
    return p.groupBy(*PAGE, "paragraph").agg(F.count("*").alias("n_lines"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y1", "x1", "line_idx", "text"))), lambda v: v["text"]), " ").alias("text"))


def table_grid(words: DataFrame, gap_x: int = 10, gap_y: int = 2) -> DataFrame:
    """Rows and columns of a page as bands split by white space, and the text at each crossing; empty
    crossings have an empty text. words need line_idx as ordinal."""
    wy = Window.partitionBy(*PAGE).orderBy("y1", "line_idx")
    wx = Window.partitionBy(*PAGE).orderBy("x1", "line_idx")
    back = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    r = islands(words, PAGE, ["y1", "line_idx"], F.col("y1") > F.max("y2").over(back(wy)) + gap_y, "grid_row")
    c = islands(r, PAGE, ["x1", "line_idx"], F.col("x1") > F.max("x2").over(back(wx)) + gap_x, "grid_col")
    full = c.groupBy(*PAGE).agg(F.max("grid_row").alias("rm"), F.max("grid_col").alias("cm")).select(*PAGE, F.explode(F.sequence(F.lit(0), "rm")).alias("grid_row"), "cm").select(*PAGE, "grid_row", F.explode(F.sequence(F.lit(0), "cm")).alias("grid_col"))
    have = c.groupBy(*PAGE, "grid_row", "grid_col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "line_idx", "text"))), lambda v: v["text"]), " ").alias("text"))
    return full.join(have, [*PAGE, "grid_row", "grid_col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def merged_tokens(tokens_: DataFrame, gap: int = 20) -> DataFrame:
    """Consecutive paragraphs of a column, a cluster and the same table flag (where tokens have these) as
    one while each begins within gap under the first's box. The confidence is the running pairwise mean. A
    fold over the page's array."""
    own = lambda k, kind: (F.col(k) if k in tokens_.columns else F.lit(None)).cast(kind).alias(k)
    item = F.struct("block_order", "block_type", "column_id", own("cluster_id", "long"), own("table_candidate", "boolean"), "text", "y", "height", "confidence")
    per = tokens_.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("s"))

    def step(acc, v):
        last = F.element_at(acc, -1)
        same = last["column_id"].eqNullSafe(v["column_id"]) & last["cluster_id"].eqNullSafe(v["cluster_id"]) & last["table_candidate"].eqNullSafe(v["table_candidate"])
        joins = (F.size(acc) > 0) & (v["block_type"] == "paragraph") & (last["block_type"] == "paragraph") & same & (v["y"] - (last["y"] + last["height"]) < gap)
        grown = F.struct(*[last[k].alias(k) for k in ("block_order", "block_type", "column_id", "cluster_id", "table_candidate")], F.concat(t.strip(last["text"]), F.lit(" "), t.strip(v["text"])).alias("text"), last["y"].alias("y"), last["height"].alias("height"), ((last["confidence"] + v["confidence"]) / 2).alias("confidence"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(v)))

    # element_at(-1) of an empty array is null under when, never an error, with try_element_at
    first = F.slice("s", 1, 1)
    rest = F.slice("s", 2, F.greatest(F.lit(1), F.size("s")))
    return per.select(*PAGE, F.explode(F.aggregate(rest, first, step)).alias("m")).select(*PAGE, "m.block_order", "m.block_type", "m.column_id", "m.text", millionths(F.col("m.confidence")).alias("confidence"))
