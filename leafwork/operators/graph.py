"""Nodes of a page and the relations between them, columns by peaks, order by bands, labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from leafwork.functions import geometry as g
from leafwork.functions import text as t
from leafwork.functions.bypage import numbers, paged, swept
from leafwork.functions.nearest import near

PAGE = ["doc_id", "page_number"]
NODE = [*PAGE, "node"]


def nodes(lines: DataFrame) -> DataFrame:
    """Lines with text, as boxes of x, y, width and height."""
    body = lines.withColumn("text", t.strip("text")).where("text <> ''")
    d = lambda c: c.cast("double")
    return body.select(*PAGE, F.col("line_idx").alias("node"), F.format_string("p%d-%d", "page_number", "line_idx").alias("node_id"), d(F.col("x1")).alias("x"), d(F.col("y1")).alias("y"), d(F.col("x2") - F.col("x1")).alias("width"),
                       d(F.col("y2") - F.col("y1")).alias("height"), "text", "confidence", "page_width", "page_height")


RELATIONS = ("BELOW", "ADJACENT", "RIGHT_OF", "SAME_COLUMN", "SAME_ROW", "INSIDE", "CONTAINS")


def edges(n: DataFrame, near: float = 30.0, inside: float = 0.85, only: tuple[str, ...] = RELATIONS, ready: bool = False) -> DataFrame:
    """(page, src, dst, relation, weight) between nodes of a page, of the relations in only.

    Boxes below each other, or in each other, overlap in x, and those beside each other in y; so two
    sweeps over the boxes' sides find all pairs that may have a relation, and no others are looked at. A task
    holds whole pages, and some of their pairs at a time. ready: nodes come page by page.
    """
    kind = {f.name: f.dataType.simpleString() for f in n.schema}

    def rows(t: pa.Table, page: np.ndarray) -> pa.Table:
        cols = [np.concatenate(c) for c in zip(*related(t, page, near, inside, only))]
        if not cols:
            cols = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)]
        src, dst, name, weight = cols
        node, at = t.column("node"), pa.array(src)
        return pa.table([*[t.column(k).take(at) for k in PAGE], node.take(at), node.take(pa.array(dst)), pa.array(RELATIONS).take(pa.array(name)), pa.array(six(weight))], names=[*PAGE, "src", "dst", "relation", "weight"])

    return paged(sides(n), PAGE, ["node"], rows, ", ".join([*[f"`{k}` {kind[k]}" for k in PAGE], f"src {kind['node']}, dst {kind['node']}, relation string, weight double"]), ready)


def sides(n: DataFrame) -> DataFrame:
    return n.select(*NODE, F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2"))


def six(v: np.ndarray) -> np.ndarray:
    """v >= 0 to six digits as Spark rounds: halves of the shortest decimal form up."""
    s = v * 1e6
    out = np.floor(s + 0.5)
    for k in np.flatnonzero(np.abs(s - np.floor(s) - 0.5) < 1e-3):
        out[k] = int((Decimal(repr(float(v[k]))) * 1_000_000).quantize(Decimal(1), ROUND_HALF_UP))
    return out / 1e6


def related(t: pa.Table, page: np.ndarray, near: float, inside: float, only: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(src, dst, number of the relation, weight) of rows of whole pages by node, some at a time."""
    x1, y1, x2, y2, node = numbers(t, "x1", "y1", "x2", "y2", "node")
    area = np.fmax(0, x2 - x1) * np.fmax(0, y2 - y1)
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    wants = {k: k in only for k in RELATIONS}

    def told(name: str, ok: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray | float):
        k = np.flatnonzero(ok)
        return i[k], j[k], np.full(len(k), RELATIONS.index(name), np.int32), weight[k] if isinstance(weight, np.ndarray) else np.full(len(k), weight)

    def pairs(lo: np.ndarray, hi: np.ndarray):
        for i, j in swept(page, lo, hi):
            both = np.fmax(0, np.fmin(x2[i], x2[j]) - np.fmax(x1[i], x1[j])) * np.fmax(0, np.fmin(y2[i], y2[j]) - np.fmax(y1[i], y1[j]))
            solid = (area[i] > 0) & (area[j] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                in_i, in_j = solid & (both / area[i] >= inside), solid & (both / area[j] >= inside)
            share = np.maximum(0, np.minimum(hi[i], hi[j]) - np.maximum(lo[i], lo[j])) / np.minimum(hi[i] - lo[i], hi[j] - lo[j])
            yield i, j, in_i, in_j, share, (node[i] != node[j]) | (lo[i] != lo[j])

    if any(wants[k] for k in ("BELOW", "ADJACENT", "SAME_COLUMN", "INSIDE", "CONTAINS")):
        for i, j, in_i, in_j, share, two in pairs(x1, x2):
            apart = two & ~in_i & ~in_j
            for a, b, in_a, in_b in ((i, j, in_i, in_j), (j, i, in_j, in_i)):
                gap = y1[b] - y2[a]
                for name in ("BELOW", "ADJACENT"):
                    if wants[name]:
                        yield told(name, apart & (share > 0.3) & (gap >= 0) & (gap <= near), a, b, gap + 1)
                if wants["SAME_COLUMN"]:
                    yield told("SAME_COLUMN", apart & (share > 0.5), a, b, np.abs(cy[i] - cy[j]))
                if wants["INSIDE"]:
                    yield told("INSIDE", two & in_a, a, b, 0.1)
                if wants["CONTAINS"]:
                    yield told("CONTAINS", two & in_b & ~in_a, a, b, 0.1)
    if wants["RIGHT_OF"] or wants["SAME_ROW"]:
        for i, j, in_i, in_j, share, two in pairs(y1, y2):
            apart = two & ~in_i & ~in_j
            for a, b in ((i, j), (j, i)):
                gap = x1[b] - x2[a]
                if wants["RIGHT_OF"]:
                    yield told("RIGHT_OF", apart & (share > 0.3) & (gap >= 0) & (gap <= 2 * near), a, b, gap + 1)
                if wants["SAME_ROW"]:
                    yield told("SAME_ROW", apart & (share > 0.5), a, b, np.abs(cx[i] - cx[j]))


def boxes(t: pa.Table) -> pa.Table:
    """sides() of a table of nodes in a task."""
    x, y, w, h = numbers(t, "x", "y", "width", "height")
    return pa.table([*map(pa.array, (x, y, x + w, y + h)), t.column("node")], names=["x1", "y1", "x2", "y2", "node"])


def widened(n: DataFrame, more: str, *kernels: Callable[[pa.Table, np.ndarray], pa.Table], ready: bool = False) -> DataFrame:
    """n with the columns that kernels add one after the other to whole pages by node, in one task each: nothing is
    joined, and rows that are dealt out by document aren't moved."""

    def rows(t: pa.Table, page: np.ndarray) -> pa.Table:
        for k in kernels:
            t = k(t, page)
        return t

    return paged(n, PAGE, ["node"], rows, StructType([StructField(f.name, f.dataType) for f in [*n.schema, *StructType.fromDDL(more)]]), ready)


def unrelated(n: DataFrame) -> DataFrame:
    """(page, node) of nodes without any of the edges that edges(n) has, which aren't made rows."""
    kind = {f.name: f.dataType.simpleString() for f in n.schema}

    def rows(t: pa.Table, page: np.ndarray) -> pa.Table:
        (number,) = numbers(t, "node")
        own = np.cumsum(np.append(False, (np.diff(page) != 0) | (np.diff(number) != 0)))  # rows come by page and node
        alone = np.ones(own[-1] + 1, dtype=bool)
        for src, dst, _, _ in related(t, page, 30.0, 0.85, RELATIONS):
            alone[own[src]] = alone[own[dst]] = False
        return t.select(NODE).filter(pa.array(alone[own]))

    return paged(sides(n), PAGE, ["node"], rows, ", ".join(f"`{k}` {kind[k]}" for k in NODE))


def orphan_links(n: DataFrame, e: DataFrame | None = None) -> DataFrame:
    """Nodes without any of edges e, or of all that edges(n) has, tied to the nearest centre: by distance to six
    digits, then by number."""
    at = n.select(*NODE, (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"))
    asks = at.join(unrelated(n), NODE, "left_semi") if e is None else at.join(e.select(*PAGE, F.explode(F.array("src", "dst")).alias("node")).distinct(), NODE, "left_anti")
    found = near(at, asks, PAGE, "node", "cx", "cy")
    other = at.select(*PAGE, F.col("node").alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    d = F.round(F.sqrt(F.pow(F.col("cx") - F.col("ox"), g.real(2)) + F.pow(F.col("cy") - F.col("oy"), g.real(2))), 6)
    one = found.join(at, NODE).join(other, [*PAGE, "other"]).groupBy(*NODE).agg(F.min(F.struct(d.alias("w"), F.col("other").alias("dst"))).alias("m"))
    return one.select(*PAGE, F.col("node").alias("src"), F.col("m.dst").alias("dst"), F.lit("ADJACENT").alias("relation"), F.col("m.w").alias("weight"))


def inverse(e: DataFrame) -> DataFrame:
    """ABOVE and LEFT_OF, as the other direction of BELOW and RIGHT_OF."""
    name = F.when(F.col("relation") == "BELOW", "ABOVE").when(F.col("relation") == "RIGHT_OF", "LEFT_OF")
    return e.where(name.isNotNull()).select(*PAGE, F.col("dst").alias("src"), F.col("src").alias("dst"), name.alias("relation"), "weight")


def column_centres(n: DataFrame, gap_share: float = 0.15) -> DataFrame:
    """(page, centres): peaks of a histogram of centres in bins of forty pixels, near ones averaged."""
    w = F.col("page_width").cast("double")
    bins = F.greatest(F.lit(10), (w / 40).cast("int"))
    p = n.withColumn("cx", F.col("x") + F.col("width") / 2).withColumn("bins", bins).withColumn("bw", w / bins)
    per = p.groupBy(*PAGE).agg(F.count("*").alias("n"), F.first("bins").alias("bins"), F.first("bw").alias("bw"), F.first("page_width").alias("pw"), F.array_sort(F.collect_list("cx")).alias("cxs"),
                               F.collect_list(F.greatest(F.lit(0), F.least(F.col("bins") - 1, (F.col("cx") / F.col("bw")).cast("int")))).alias("at"))
    histogram = F.transform(F.sequence(F.lit(0), F.col("bins") - 1), lambda i: F.size(F.filter("at", lambda b: b == i)))
    per = per.withColumn("h", histogram)
    at = lambda i: F.coalesce(F.get("h", i), F.lit(0))
    top = F.greatest(g.real(2), F.col("n") * g.real(0.08))
    peaks = F.filter(F.sequence(F.lit(0), F.col("bins") - 1), lambda i: (at(i) >= top) & (at(i) >= at(i - 1)) & (at(i) >= at(i + 1)))
    centres = F.when(F.size(peaks) > 0, F.transform(peaks, lambda i: (i + g.real(0.5)) * F.col("bw"))).otherwise(F.array(F.get("cxs", F.floor(F.col("n") / 2).cast("int"))))
    per = per.withColumn("c", centres)
    near = g.real(gap_share) * F.col("pw")

    def step(acc, v):
        last = F.element_at(acc, -1)
        return F.when(v - last < near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array((last + v) / 2))).otherwise(F.concat(acc, F.array(v)))

    merged = F.aggregate(F.slice("c", 2, F.greatest(F.lit(1), F.size("c"))), F.slice("c", 1, 1), step)
    return per.select(*PAGE, F.when(F.col("n") == 1, F.array(F.get("cxs", F.lit(0)))).otherwise(merged).alias("centres"))


def assigned(n: DataFrame, centres: DataFrame) -> DataFrame:
    """n with column_id, the first of the nearest centres."""
    cx = F.col("x") + F.col("width") / 2
    best = F.array_min(F.transform("centres", lambda c, i: F.struct(F.abs(cx - c).alias("d"), i.alias("i"))))
    return n.join(centres, PAGE).withColumn("column_id", best["i"]).withColumn("num_columns", F.size("centres")).drop("centres")


def peaks(cx: np.ndarray, page_width: float, gap_share: float) -> list[float]:
    """column_centres of one page."""
    if len(cx) == 1:
        return [float(cx[0])]
    bins = max(10, int(page_width / 40))
    bw = page_width / bins
    h = np.bincount(np.clip((cx / bw).astype(np.int64), 0, bins - 1), minlength=bins)
    side = np.concatenate([[0], h, [0]])
    c = ((np.flatnonzero((h >= max(2.0, len(cx) * 0.08)) & (h >= side[:-2]) & (h >= side[2:])) + 0.5) * bw).tolist() or [float(np.sort(cx)[len(cx) // 2])]
    out = c[:1]
    for v in c[1:]:
        if v - out[-1] < gap_share * page_width:
            out[-1] = (out[-1] + v) / 2
        else:
            out.append(v)
    return out


def in_columns(t: pa.Table, page: np.ndarray, gap_share: float = 0.15) -> pa.Table:
    """Nodes of whole pages with what assigned() adds by column_centres."""
    x, w, page_width = numbers(t, "x", "width", "page_width")
    cx, edge = x + w / 2, np.append(np.flatnonzero(np.append(True, np.diff(page) != 0)), len(page)).tolist()
    column, number = np.zeros(len(page), np.int32), np.ones(len(page), np.int32)
    for lo, hi in zip(edge, edge[1:]):
        c = peaks(cx[lo:hi], float(page_width[lo]), gap_share)
        if len(c) > 1:
            column[lo:hi], number[lo:hi] = np.abs(cx[lo:hi, None] - np.array(c)).argmin(axis=1), len(c)
    return t.append_column("column_id", pa.array(column)).append_column("num_columns", pa.array(number))


def columned(n: DataFrame, ready: bool = False) -> DataFrame:
    """assigned(n, column_centres(n)) without a join: a page's nodes are together."""
    return widened(n, "column_id int, num_columns int", in_columns, ready=ready)


def banded(n: DataFrame, tolerance: float = 15.0, full: str | None = None, name: str = "resolved_order") -> DataFrame:
    """n with the band and place of its rows on their page: rows by y; bands end where y is more than tolerance
    from the band's first; within a band full-width nodes come first, then columns from the left."""
    page_ = Window.partitionBy(*PAGE)
    span = F.max(F.col("x") + F.col("width")).over(page_) - F.min("x").over(page_)
    wide = F.expr(full) if full else (F.col("num_columns") > 1) & (F.col("width") / F.when(span > 0, span).otherwise(1) > g.real(0.6))
    k = n.withColumn("_w", wide)

    def bands(t: pa.Table, page: np.ndarray) -> pa.Table:
        y, x, c, node = numbers(t, "y", "x", "column_id", "node")
        w = t.column("_w").fill_null(False).to_numpy()
        c = np.where(w, -1, c)
        order = np.lexsort((node, x, c, ~w, y, page))
        band, last, no, start = np.zeros(len(page), np.int32), -1, 0, 0.0
        own = []
        for p, v in zip(page[order].tolist(), y[order].tolist()):
            if p != last:
                last, no, start = p, 0, v
            elif abs(v - start) > tolerance:
                no, start = no + 1, v
            own.append(no)
        band[order] = own
        order = np.lexsort((node, x, y, c, ~w, band, page))
        place = np.zeros(len(page), np.int32)
        place[order] = np.arange(len(page)) - np.searchsorted(page, page)
        return t.drop_columns(["_w"]).append_column("band", pa.array(band)).append_column(name, pa.array(place))

    more = StructType.fromDDL(f"band int, `{name}` int")
    return paged(k, PAGE, ["node"], bands, StructType([StructField(f.name, f.dataType) for f in [*n.schema, *more]]))


def banded_order(n: DataFrame, tolerance: float = 15.0, full: str | None = None, name: str = "resolved_order") -> DataFrame:
    """(page, node, band, place) of banded(), without n's other columns."""
    return banded(n.select(*NODE, "x", "y", "width", "column_id", "num_columns"), tolerance, full, name).select(*NODE, "band", name)


def with_neighbours(t: pa.Table, page: np.ndarray) -> pa.Table:
    """Nodes of whole pages with the number of their edges to others below and in their row, and whether they
    are the first of their column."""
    node, y, x, column = numbers(t, "node", "y", "x", "column_id")
    own = np.cumsum(np.append(False, (np.diff(page) != 0) | (np.diff(node) != 0)))  # rows come by page and node
    n = {k: np.zeros(own[-1] + 1, np.int64) for k in ("BELOW", "SAME_ROW")}
    for src, _, name, _ in related(boxes(t), page, 30.0, 0.85, tuple(n)):
        if len(src):
            n[RELATIONS[name[0]]] += np.bincount(own[src], minlength=len(own))[: own[-1] + 1]
    order = np.lexsort((node, x, y, column, page))
    first = np.zeros(len(page), bool)
    first[order[np.append(True, (np.diff(page[order]) != 0) | (np.diff(column[order]) != 0))]] = True
    return t.append_column("below", pa.array(n["BELOW"][own])).append_column("row", pa.array(n["SAME_ROW"][own])).append_column("_first", pa.array(first))


def labels(n: DataFrame, e: DataFrame | None = None, ready: bool = False) -> DataFrame:
    """(node, label) by length, case, place, marks, neighbours in its row, and words: of nodes with columns and
    edges e, or of nodes without columns and the edges that edges(n) has, neither of which is made rows."""
    if e is None:
        m = widened(n, "column_id int, num_columns int, below long, row long, _first boolean", in_columns, with_neighbours, ready=ready)
    else:
        count = e.where(F.col("relation").isin("BELOW", "SAME_ROW")).groupBy(*PAGE, F.col("src").alias("node")).agg(F.count_if(F.col("relation") == "BELOW").alias("below"), F.count_if(F.col("relation") == "SAME_ROW").alias("row"))
        first = F.row_number().over(Window.partitionBy(*PAGE, "column_id").orderBy("y", "x", "node")) == 1
        m = n.withColumn("_first", first).join(count, NODE, "left")
    body, w = F.col("text"), F.size(t.words(F.col("text")))
    short = F.char_length(body) < 80
    label = (
        F.when(short & t.is_upper(body), "heading").when(short & (F.coalesce("below", F.lit(0)) > 0) & (F.col("y") < 200) & F.col("_first"), "heading")
        .when(F.substring(body, 1, 1).isin(*t.BULLETS[:6]), "list").when(t.is_numbered(body), "list").when(F.coalesce("row", F.lit(0)) >= 2, "table")
        .when(w > 5, "paragraph").when(F.instr(body, ":") > 0, "paragraph").otherwise("unknown")
    )
    return m.select(*NODE, label.alias("label"))


def neighbours(n: DataFrame, e: DataFrame | None = None, ready: bool = False) -> DataFrame:
    """(node, relation, ids of neighbours in order of weight) of edges e, or of all that edges(n) has, which
    then stay with their page and aren't made rows."""
    if e is not None:
        return e.groupBy(*PAGE, F.col("src").alias("node"), "relation").agg(F.transform(F.array_sort(F.collect_list(F.struct("weight", "dst"))), lambda x: x["dst"]).alias("neighbours"))
    kind = {f.name: f.dataType.simpleString() for f in n.schema}

    def lists(t: pa.Table, page: np.ndarray) -> pa.Table:
        src, dst, name, weight = (np.concatenate(c) for c in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)), *related(t, page, 30.0, 0.85, RELATIONS)))
        (number,) = numbers(t, "node")
        own = np.cumsum(np.append(False, (np.diff(page) != 0) | (np.diff(number) != 0)))  # rows come by page and node
        order = np.lexsort((number[dst], six(weight), name, own[src]))
        src, dst, name = src[order], dst[order], name[order]
        first = np.flatnonzero(np.append(True, (np.diff(own[src]) != 0) | (np.diff(name) != 0))) if len(src) else np.zeros(0, np.int64)
        node, at = t.column("node").combine_chunks(), pa.array(src[first])
        found = pa.ListArray.from_arrays(pa.array(np.append(first, len(src)), pa.int32()), node.take(pa.array(dst)))
        return pa.table([*[t.column(k).take(at) for k in PAGE], node.take(at), pa.array(RELATIONS).take(pa.array(name[first])), found], names=[*NODE, "relation", "neighbours"])

    return paged(sides(n), PAGE, ["node"], lists, ", ".join([*[f"`{k}` {kind[k]}" for k in NODE], f"relation string, neighbours array<{kind['node']}>"]), ready)
