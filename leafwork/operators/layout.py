"""Words to lines, columns, reading order, tables, paragraphs and clusters, page by page.

Every operator keys on (doc_id, page_number); the input's own ordinal is the last tie-break.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions import geometry as g
from leafwork.functions.bypage import numbers, paged, ranged, swept
from leafwork.functions.components import smallest
from leafwork.functions.intervals import placed
from leafwork.functions.islands import islands

PAGE = ["doc_id", "page_number"]


def confidence_gate(words: DataFrame, keep: float = 0.5, flag: float = 0.7) -> DataFrame:
    return words.where(F.col("confidence") >= g.real(keep)).withColumn("low_confidence", F.col("confidence") < g.real(flag))


def textlines(words: DataFrame, mid_share: float = 0.5, gap_share: float = 0.03) -> DataFrame:
    """A word joins the line of the word before it (by y1, x1) if their middles and their sides are near."""
    order = ["y1", "x1", "word_idx"]
    w = Window.partitionBy(*PAGE).orderBy(*order)
    was = {k: F.lag(k).over(w) for k in ("x1", "y1", "x2", "y2")}
    mid = F.abs((F.col("y1") + F.col("y2")) / g.real(2) - (was["y1"] + was["y2"]) / g.real(2))
    tall = ((F.col("y2") - F.col("y1")) + (was["y2"] - was["y1"])) / g.real(2)
    gap = F.greatest(F.col("x1"), was["x1"]) - F.least(F.col("x2"), was["x2"])
    same = (mid <= g.real(mid_share) * F.greatest(g.real(1), tall)) & (gap <= g.real(gap_share) * F.col("page_width"))
    lined = islands(words, PAGE, order, ~same, "line_idx")
    return lined.groupBy(*PAGE, "line_idx").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.round(F.avg("confidence"), 6).alias("confidence"), F.count("*").cast("int").alias("word_count"),
        F.array_sort(F.collect_list(F.struct("x1", "word_idx", "text"))).alias("words"),
        F.first("page_width").alias("page_width"), F.first("page_height").alias("page_height"),
    ).withColumn("text", F.array_join(F.transform("words", lambda x: x["text"]), " ")).withColumn(
        "word_ids", F.transform("words", lambda x: F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("-w"), x["word_idx"].cast("string")))
    ).withColumn("region_id", F.format_string("p%d-l%d", "page_number", "line_idx")).drop("words")


def densities(boxes: DataFrame) -> DataFrame:
    """(page, s, e, density): stretches of x over which the summed weights of boxes stay the same."""
    weight = F.when(F.col("confidence") <= 0, 5).otherwise((F.col("confidence") * 10).cast("int"))
    left, right = F.greatest(F.lit(0), "x1"), F.least("x2", "page_width")
    edges = F.array(
        F.struct(left.alias("x"), weight.alias("d")), F.struct(right.alias("x"), (-weight).alias("d")),
        F.struct(F.lit(0).alias("x"), F.lit(0).alias("d")), F.struct(F.col("page_width").alias("x"), F.lit(0).alias("d")),
    )
    ev = boxes.where(left < right).select(*PAGE, "page_width", F.explode(edges).alias("v")).groupBy(*PAGE, "page_width", F.col("v.x").alias("s")).agg(F.sum("v.d").alias("d"))
    w = Window.partitionBy(*PAGE).orderBy("s")
    run = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ev.select(*PAGE, "page_width", "s", F.lead("s").over(w).alias("e"), run.alias("density")).where("e is not null and s < e")


def column_boundaries(boxes: DataFrame, share: float = 0.05, margins: str = "as_code") -> DataFrame:
    """(page, boundaries, column_count) from runs of x that few boxes cover. margins="ignore" leaves out
    runs at the page's edges."""
    page = Window.partitionBy(*PAGE)
    d = densities(boxes).withColumn("mean", F.sum(F.col("density") * (F.col("e") - F.col("s"))).over(page) / F.col("page_width"))
    d = d.withColumn("low", F.col("density") <= g.real(share) * F.col("mean"))
    w = page.orderBy("s")
    runs = islands(d, PAGE, ["s"], F.col("low") != F.lag("low").over(w), "run").where("low").groupBy(*PAGE, "page_width", "run").agg(F.min("s").alias("s"), (F.max("e") - 1).alias("t"))
    wide = runs.where(F.col("t") - F.col("s") + 1 >= F.greatest(F.lit(5), (F.col("page_width") * g.real(0.01)).cast("int")))
    if margins == "ignore":
        wide = wide.where((F.col("s") > 0) & (F.col("t") < F.col("page_width") - 1))
    found = wide.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.floor((F.col("s") + F.col("t")) / 2).cast("int"))).alias("boundaries"))
    pages = boxes.select(*PAGE).distinct()
    none = F.array().cast("array<int>")
    return pages.join(found, PAGE, "left").select(*PAGE, F.coalesce("boundaries", none).alias("boundaries"), (F.coalesce(F.size("boundaries"), F.lit(0)) + 1).alias("column_count"))


def assigned_columns(lines: DataFrame, boundaries: DataFrame, fuzzy: float = 0.015, reach: int = 200) -> DataFrame:
    """lines with column_id. Near a boundary the side with 1.5 times the area wins, else the nearest line
    above or below that is clear of the boundary, else left."""
    b = lines.join(boundaries.select(*PAGE, "boundaries"), PAGE)
    m, cx = g.real(fuzzy) * F.col("page_width"), g.centre_x()
    hit = F.try_element_at(F.filter(F.transform("boundaries", lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda s: cx <= s["v"] + m), F.lit(1))
    b = b.withColumn("_hit", hit).withColumn("_cx", cx).withColumn("_cy", g.centre_y()).withColumn("_m", m)
    left = F.greatest(F.lit(0), F.col("_hit.v") - F.col("x1")).cast("double")
    right = F.greatest(F.lit(0), F.col("x2") - F.col("_hit.v")).cast("double")
    clear = F.col("_cx") < F.col("_hit.v") - F.col("_m")
    direct = F.when(F.col("_hit").isNull(), F.size("boundaries")).when(clear, F.col("_hit.i")).when(left > right * g.real(1.5), F.col("_hit.i")).when(right > left * g.real(1.5), F.col("_hit.i") + 1)
    b = b.withColumn("_direct", direct)
    ask = b.where(F.col("_direct").isNull()).select(*PAGE, "line_idx", "_hit", "_cy", "_m").alias("a")
    other = b.select(*PAGE, F.col("line_idx").alias("o"), F.col("_cx").alias("ox"), F.col("_cy").alias("oy")).alias("b")
    near = ask.join(other, PAGE).where((F.col("o") != F.col("line_idx")) & (F.abs(F.col("ox") - F.col("_hit.v")) > F.col("_m")) & (F.abs(F.col("_cy") - F.col("oy")) < reach))
    vote = near.groupBy(*PAGE, "line_idx").agg(F.min_by(F.when(F.col("ox") < F.col("_hit.v"), F.col("_hit.i")).otherwise(F.col("_hit.i") + 1), F.struct(F.abs(F.col("_cy") - F.col("oy")), F.col("o"))).alias("_vote"))
    return b.join(vote, [*PAGE, "line_idx"], "left").withColumn("column_id", F.coalesce("_direct", "_vote", "_hit.i").cast("int")).drop("boundaries", "_hit", "_cx", "_cy", "_m", "_direct", "_vote")


def layout_pattern(lines: DataFrame, boundaries: DataFrame) -> DataFrame:
    cx = g.centre_x()
    side = lines.groupBy(*PAGE).agg(
        F.count("*").alias("n"), F.count_if(cx < g.real(0.4) * F.col("page_width")).alias("l"), F.count_if(cx > g.real(0.6) * F.col("page_width")).alias("r")
    ).join(boundaries.select(*PAGE, "column_count"), PAGE)
    split = (F.col("l") >= 2) & (F.col("r") >= 2) & (F.col("n") - F.col("l") - F.col("r") < g.real(0.2) * F.col("n"))
    return side.select(*PAGE, F.when((F.col("column_count") >= 2) | split, "structured_columns").otherwise("raw_blocks").alias("layout_type"))


def reading_order(lines: DataFrame, column: Column | None = None) -> DataFrame:
    keyed = lines.withColumn("_c", column if column is not None else F.col("column_id")).withColumn("_a", -g.area())
    w = Window.partitionBy(*PAGE).orderBy("_c", "y1", "x1", "_a", "region_id", "line_idx")
    return keyed.withColumn("reading_order", (F.row_number().over(w) - 1).cast("int")).drop("_c", "_a")


def collisions(boxes: DataFrame, pad_x: int = 4, pad_y: int = 6, cell: int | None = None) -> DataFrame:
    """Padded boxes that overlap: pressure on each box, the push away from its neighbours, their ids. Only
    boxes that overlap in y are looked at as pairs, or with cell those that touch one band of so many
    pixels, where the pair is kept in the first one that both touch; both give the same rows. A task holds whole
    pages, and some of their pairs at a time."""
    v = boxes.select(
        *PAGE, "word_idx", "x1", "y1", "x2", "y2",
        F.greatest(F.lit(0), F.col("x1") - pad_x).alias("vx1"), F.greatest(F.lit(0), F.col("y1") - pad_y).alias("vy1"),
        F.least("page_width", F.col("x2") + pad_x).alias("vx2"), F.least("page_height", F.col("y2") + pad_y).alias("vy2"),
        F.greatest(F.lit(1), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("one"),
    )

    def met(page: np.ndarray, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not cell:
            yield from swept(page, lo, hi)
            return
        first, last = np.floor(lo / cell), np.floor(hi / cell)
        own = np.flatnonzero(first <= last)
        n = (last - first)[own].astype(np.int64) + 1
        at = np.repeat(own, n)
        band = first[at].astype(np.int64) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((word[at], band, page[at]))
        at, band = at[order], band[order]
        ends = np.append(np.flatnonzero((np.diff(page[at]) != 0) | (np.diff(band) != 0)) + 1, len(at))
        for i, j in ranged(np.arange(len(at)) + 1, ends[np.searchsorted(ends, np.arange(len(at)), side="right")]):
            once = band[i] == np.maximum(first[at[i]], first[at[j]])
            yield at[i[once]], at[j[once]]

    def push(t: pa.Table, page: np.ndarray) -> pa.Table:
        x1, y1, x2, y2, vx1, vy1, vx2, vy2, word = numbers(t, "x1", "y1", "x2", "y2", "vx1", "vy1", "vx2", "vy2", "word_idx")
        box = np.cumsum(np.append(False, (np.diff(page) != 0) | (np.diff(word) != 0)))  # rows come by page and word
        over, fx, fy = (np.zeros(len(page)) for _ in range(3))
        ends: list[np.ndarray] = [np.zeros(0, np.int64)]
        others: list[np.ndarray] = [np.zeros(0)]
        for i, j in met(page, word, vy1, vy2):
            w, h = np.minimum(vx2[i], vx2[j]) - np.maximum(vx1[i], vx1[j]), np.minimum(vy2[i], vy2[j]) - np.maximum(vy1[i], vy1[j])
            ok = (w > 0) & (h > 0) & (word[i] != word[j])
            i, j, w, h = i[ok], j[ok], w[ok], h[ok]
            for p, q in ((i, j), (j, i)):
                dx, dy = (x1[p] + x2[p]) / 2 - (x1[q] + x2[q]) / 2, (y1[p] + y2[p]) / 2 - (y1[q] + y2[q]) / 2
                across = np.abs(dx) > np.abs(dy)
                np.add.at(over, box[p], w * h)
                np.add.at(fx, box[p], np.where(across, np.where(dx > 0, w, -w), 0))
                np.add.at(fy, box[p], np.where(across, 0, np.where(dy > 0, h, -h)))
                ends.append(box[p])
                others.append(word[q])
        end, other = np.concatenate(ends), np.concatenate(others)
        other = other[np.lexsort((other, end))].astype(np.int32)
        n = np.bincount(end, minlength=len(page))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(other))
        out = t.select([*PAGE, "word_idx", "one"])
        for name, c in (("over", pa.array(over[box])), ("fx", pa.array(fx[box])), ("fy", pa.array(fy[box])), ("neighbours", lists.take(pa.array(box)))):
            out = out.append_column(name, c)
        return out

    kind = {f.name: f.dataType.simpleString() for f in v.schema}
    s = paged(v, PAGE, ["word_idx"], push, ", ".join([*[f"`{k}` {kind[k]}" for k in (*PAGE, "word_idx", "one")], "over double, fx double, fy double, neighbours array<int>"]))
    return s.select(*PAGE, "word_idx", F.round(F.col("over") / F.col("one"), 6).alias("pressure"), F.col("fx").cast("long").alias("force_x"), F.col("fy").cast("long").alias("force_y"), "neighbours")


def row_bands(lines: DataFrame, gap: int = 5) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy("y1", "line_idx")
    reach = F.max("y2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return islands(lines, PAGE, ["y1", "line_idx"], F.col("y1") > reach + gap, "row_band")


def column_bands(banded: DataFrame, share: float = 0.01, least: int = 5) -> DataFrame:
    part = [*PAGE, "row_band"]
    w = Window.partitionBy(*part).orderBy("x1", "line_idx")
    gap = F.greatest(F.lit(least), (F.col("page_width") * g.real(share)).cast("int"))
    return islands(banded, part, ["x1", "line_idx"], F.col("x1") > F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1)) + gap, "col_band")


def table_candidates(lines: DataFrame, min_rows: int = 3, min_cols: int = 2, tolerance: float = 0.15) -> DataFrame:
    """(page, n_rows, table_candidate): rows of two columns or more, at even distances."""
    rows = column_bands(row_bands(lines)).groupBy(*PAGE, "row_band").agg((F.max("col_band") + 1).alias("cols"), F.min("y1").alias("top"))
    gap = F.lead("top").over(Window.partitionBy(*PAGE).orderBy("row_band")) - F.col("top")
    s = rows.withColumn("gap", gap).groupBy(*PAGE).agg(F.count("*").alias("n"), F.count_if(F.col("cols") >= min_cols).alias("k"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("sd"))
    even = (F.coalesce("m", g.real(0)) <= 0) | (F.round(F.col("sd") / F.col("m"), 9) <= g.real(round(tolerance * 3, 9)))
    ok = (F.col("n") >= min_rows) & (F.col("k") >= F.greatest(g.real(min_rows), F.col("n") * g.real(0.6))) & even
    return s.select(*PAGE, F.col("n").cast("int").alias("n_rows"), ok.alias("table_candidate"))


def region_graph(lines: DataFrame, share: float = 0.08) -> DataFrame:
    """(page, src, dst) of lines whose gap is at most a share of the page, of those in nearby cells. Only
    lines no further from each other in y than that are looked at as pairs."""
    d = F.greatest(F.lit(10), (F.greatest("page_width", "page_height") * g.real(share)).cast("int"))
    n = lines.withColumn("d", d).withColumn("cell", F.greatest(F.lit(20), F.floor(F.col("d") / 3)))
    n = n.withColumn("gx", F.floor(g.centre_x().cast("int") / F.col("cell"))).withColumn("gy", F.floor(g.centre_y().cast("int") / F.col("cell"))).select(*PAGE, "line_idx", "x1", "y1", "x2", "y2", (F.col("y2") + F.col("d")).alias("reach"), "d", "cell", "gx", "gy")
    later = (F.col("b.y1") > F.col("a.y1")) | (F.col("b.line_idx") > F.col("a.line_idx"))
    radius = F.floor(F.col("a.d") / F.col("a.cell")) + 1
    close = (F.abs(F.col("a.gx") - F.col("b.gx")) <= radius) & (F.abs(F.col("a.gy") - F.col("b.gy")) <= radius) & (F.greatest(-g.overlap_x("a", "b"), -g.overlap_y("a", "b")) <= F.col("a.d"))
    met = placed(n, n, PAGE, "y1", "reach", "y1").where(later & close).select(*[F.col(f"a.{k}") for k in PAGE], F.col("a.line_idx").alias("i"), F.col("b.line_idx").alias("j"))
    ends = lambda s, t: F.struct(F.col(s).alias("src"), F.col(t).alias("dst"))
    return met.select(*PAGE, F.explode(F.array(ends("i", "j"), ends("j", "i"))).alias("e")).select(*PAGE, "e.*")


def page_components(nodes: DataFrame, edges: DataFrame, ordinal: str = "line_idx", name: str = "cluster_id", among: bool = False) -> DataFrame:
    """nodes with the number of their component, numbered by first node; with among, only edges between
    these nodes count. A task holds the edges of some pages."""

    def number(t: pa.Table, page: np.ndarray) -> pa.Table:
        own = t.column("_b").is_null().to_numpy()
        a, b = t.column("_a").to_numpy(), t.column("_b").fill_null(0).to_numpy()
        values, at = np.unique(np.concatenate([a, b[~own]]), return_inverse=True)
        _, at = np.unique(np.concatenate([page, page[~own]]) * len(values) + at, return_inverse=True)  # rises with page and node
        src, dst = at[: len(a)][~own], at[len(a) :]
        if among:
            known = np.isin(src, at[: len(a)][own]) & np.isin(dst, at[: len(a)][own])
            src, dst = src[known], dst[known]
        root = smallest(np.append(src, 0), np.append(dst, 0)) if (~own).any() else np.arange(len(a))
        root = np.append(root, np.arange(len(root), at.max() + 1))[at[: len(a)][own]]
        roots, rank = np.unique(root, return_inverse=True)
        first = np.full(page[-1] + 1, len(roots))
        np.minimum.at(first, page[own], rank)
        out = t.filter(pa.array(own)).select([*PAGE, "_a"])
        return out.append_column(name, pa.array((rank - first[page[own]]).astype(np.int32))).set_column(2, ordinal, pa.array(a[own].astype(np.int32)))

    kind = {f.name: f.dataType.simpleString() for f in nodes.schema}
    one = nodes.select(*PAGE, F.col(ordinal).cast("long").alias("_a"), F.lit(None).cast("long").alias("_b"))
    both = one.unionByName(edges.where("src <> dst").select(*PAGE, F.col("src").cast("long").alias("_a"), F.col("dst").cast("long").alias("_b")))
    return paged(both, PAGE, ["_b", "_a"], number, ", ".join([*[f"`{k}` {kind[k]}" for k in PAGE], f"`{ordinal}` int, `{name}` int"]))


def paragraph_clusters(lines: DataFrame, gap_share: float = 0.03, align_share: float = 0.05) -> DataFrame:
    """(page, line_idx, spatial_group_id, paragraph_candidate). A group grows from its first line: later
    lines of the column join while they lie within the gap of that line and share an edge with it."""

    def pages(t: pa.Table, page: np.ndarray) -> pa.Table:
        col, x1, y1, x2, y2, width = (c.tolist() for c in numbers(t, "column_id", "x1", "y1", "x2", "y2", "page_width"))
        group, edge = np.full(len(page), -1), np.append(np.flatnonzero(np.append(True, np.diff(page) != 0)), len(page)).tolist()
        own, flags = group.tolist(), np.zeros(len(page), dtype=bool)
        for lo, hi in zip(edge, edge[1:]):
            gap, tol, n = max(4, int(width[lo] * gap_share)), max(4, int(width[lo] * align_share)), 0
            for i in range(lo, hi):
                if own[i] >= 0:
                    continue
                own[i] = n
                for j in range(i + 1, hi):
                    if col[j] != col[i]:
                        break  # lines come by column
                    if own[j] < 0:
                        if not 0 <= y1[j] - y2[i] <= gap:
                            break
                        if abs(x1[j] - x1[i]) <= tol or abs(x2[j] - x2[i]) <= tol:
                            own[j] = n
                n += 1
            size = np.bincount(own[lo:hi])
            flags[lo:hi] = size[own[lo:hi]] > 1
        return t.select([*PAGE, "line_idx"]).append_column("spatial_group_id", pa.array(own, pa.int32())).append_column("paragraph_candidate", pa.array(flags))

    kind = {f.name: f.dataType.simpleString() for f in lines.schema}
    slim = lines.select(*PAGE, "line_idx", "column_id", "x1", "y1", "x2", "y2", "page_width")
    return paged(slim, PAGE, [F.col("column_id").asc_nulls_last(), "y1", "x1", "line_idx"], pages, f"doc_id {kind['doc_id']}, page_number {kind['page_number']}, line_idx {kind['line_idx']}, spatial_group_id int, paragraph_candidate boolean")


def greedy_merge(boxes: DataFrame, threshold: float = 0.6, min_share: float = 0.0005) -> DataFrame:
    """Boxes by falling area; each takes in the later ones whose IoU with it reaches the threshold."""

    def pages(t: pa.Table, page: np.ndarray) -> pa.Table:
        x1, y1, x2, y2, a, conf = numbers(t, "x1", "y1", "x2", "y2", "a", "confidence")  # rows come by falling area
        stop = np.searchsorted(page, page, side="right")
        takes: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in swept(page, y1, y2) if threshold > 0 else ranged(np.arange(len(page)) + 1, stop):
            both = np.maximum(np.minimum(x2[i], x2[j]) - np.maximum(x1[i], x1[j]), 0) * np.maximum(np.minimum(y2[i], y2[j]) - np.maximum(y1[i], y1[j]), 0)
            union = a[i] + a[j] - both
            near = (both >= threshold * union) & (union > 0)
            takes.append((np.minimum(i, j)[near], np.maximum(i, j)[near]))
        of = np.arange(len(page))
        if takes:
            i, j = (np.concatenate(c) for c in zip(*takes))
            order = np.lexsort((j, i))
            for p, q in zip(i[order].tolist(), j[order].tolist()):
                if of[p] == p and of[q] == q:  # neither was taken by an earlier one
                    of[q] = p
        heads, at = np.unique(of, return_inverse=True)
        hull = [np.full(len(heads), v) for v in (np.inf, np.inf, -np.inf, -np.inf, -np.inf)]
        for out, f, v in zip(hull, (np.minimum, np.minimum, np.maximum, np.maximum, np.maximum), (x1, y1, x2, y2, conf)):
            f.at(out, at, v)
        no = np.arange(len(heads)) - np.searchsorted(page[heads], page[heads])
        box = [pa.array(v.astype(np.int32)) for v in (no, *hull[:4])]
        return pa.table([*[t.column(k).take(pa.array(heads)) for k in PAGE], *box, pa.array(hull[4]), pa.array(np.bincount(at).astype(np.int32))], names=[*PAGE, "merged_idx", "x1", "y1", "x2", "y2", "confidence", "n_merged"])

    kind = boxes.schema["doc_id"].dataType.simpleString()
    some = boxes.select(*PAGE, "line_idx", "x1", "y1", "x2", "y2", "confidence", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("a"), "page_width", "page_height")
    some = some.where(F.col("a") >= g.real(min_share) * F.col("page_width") * F.col("page_height"))
    return paged(some, PAGE, [F.col("a").desc(), "line_idx"], pages, f"doc_id {kind}, page_number int, merged_idx int, x1 int, y1 int, x2 int, y2 int, confidence double, n_merged int")


def contract(boxes: DataFrame, page_width: Column, page_height: Column) -> DataFrame:
    """Valid boxes only, confidence within 0..1, numbered anew, flagged under 0.7."""
    ok = boxes.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (F.col("x2") <= page_width) & (F.col("y2") <= page_height))
    w = Window.partitionBy(*PAGE).orderBy("word_idx")
    conf = F.least(g.real(1), F.greatest(g.real(0), F.col("confidence")))
    return ok.select(*PAGE, (F.row_number().over(w) - 1).cast("int").alias("region_idx"), "x1", "y1", "x2", "y2", conf.alias("confidence"), (conf < g.real(0.7)).alias("flagged"), F.lit("text_block").alias("type"),
                     F.struct(F.format_string("page-%d", "page_number").alias("page_id"), F.array("x1", "y1", "x2", "y2").alias("bbox")).alias("crop_ref"))


#: Keys that regions must not carry, and the defaults of those that they must.
FORBIDDEN = ("header", "footer", "title", "section", "caption", "semantic_class", "paragraph_type", "section_type", "heading_level")
DEFAULTS = {"reading_order": "-1", "cluster_id": "-1", "column_id": "0", "adjacency_links": "[]", "table_candidate": "false", "paragraph_candidate": "false", "spatial_group_id": "-1"}


def contract_violations(regions: DataFrame) -> DataFrame:
    """Regions (with type and metadata, a map) that break the contract, and how: another type than
    text_block, or keys of meaning."""
    leaked = F.filter(F.map_keys("metadata"), lambda k: k.isin(*FORBIDDEN))
    why = F.when(F.col("type") != "text_block", "type").when(F.size(leaked) > 0, F.concat(F.lit("keys:"), F.array_join(F.array_sort(leaked), ",")))
    return regions.withColumn("violation", why).where("violation is not null")


def with_defaults(regions: DataFrame) -> DataFrame:
    """Regions that keep the contract, each required key at its default where it is missing."""
    filled = F.map_concat(F.map_filter(F.create_map(*[F.lit(x) for kv in DEFAULTS.items() for x in kv]), lambda k, v: ~F.array_contains(F.map_keys("metadata"), k)), F.col("metadata"))
    ok = (F.col("type") == "text_block") & ~F.exists(F.map_keys("metadata"), lambda k: k.isin(*FORBIDDEN))
    return regions.where(ok).withColumn("metadata", filled)


def wide_gap_columns(boxes: DataFrame, wide: float = 0.6, least: int = 40, gap: int = 15) -> DataFrame:
    """The older column finder: occupied runs of x of at least `least` pixels, of boxes that aren't wide,
    joined where they are closer than `gap`."""
    some = boxes.where(F.col("x2") - F.col("x1") < g.real(wide) * F.col("page_width"))
    w = Window.partitionBy(*PAGE).orderBy("x1", "line_idx")
    runs = islands(some, PAGE, ["x1", "line_idx"], F.col("x1") > F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1)), "run").groupBy(*PAGE, "run").agg(F.min("x1").alias("s"), F.max("x2").alias("e"))
    runs = runs.where(F.col("e") - F.col("s") >= least)
    near = Window.partitionBy(*PAGE).orderBy("s")
    return islands(runs, PAGE, ["s"], F.col("s") - F.lag("e").over(near) >= gap, "column_id").groupBy(*PAGE, "column_id").agg(F.min("s").alias("x1"), F.max("e").alias("x2"))


def band_order(boxes: DataFrame, columns: int) -> DataFrame:
    """The older reading order: equal vertical bands of the page, then y1, x1."""
    band = F.when(F.lit(columns == 2), F.when(F.col("x1") < F.col("page_width") / g.real(2), 0).otherwise(1)).otherwise(F.least(F.lit(columns - 1), F.floor(F.col("x1") / (F.col("page_width") / g.real(columns))).cast("int")))
    w = Window.partitionBy(*PAGE).orderBy("band", "y1", "x1", "line_idx")
    return boxes.withColumn("band", band.cast("int")).select(*PAGE, "line_idx", "band", (F.row_number().over(w) - 1).cast("int").alias("reading_order"))


def region_type(boxes: DataFrame) -> DataFrame:
    """Header, footer, figure, table or paragraph by place, size and shape."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    aspect = w / F.greatest(F.lit(1), h)
    share = w * h / (F.col("page_width") * F.col("page_height"))
    kind = (
        F.when((g.centre_y() < g.real(0.18) * F.col("page_height")) & ((w > g.real(0.55) * F.col("page_width")) | (aspect > 6)), "header")
        .when(g.centre_y() > g.real(0.9) * F.col("page_height"), "footer")
        .when((share > g.real(0.06)) & ((aspect < g.real(1.5)) | (aspect > 20)), "figure")
        .when((share >= g.real(0.02)) & (aspect >= 1) & (aspect <= 8), "table").otherwise("paragraph")
    )
    return boxes.select(*PAGE, "line_idx", kind.alias("type"))


def shape_confidence(boxes: DataFrame) -> DataFrame:
    """Confidence of a box found by shape: by aspect, how full it is, and whether it is most of the page."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    aspect = w / F.greatest(F.lit(1), h)
    base = F.when(aspect >= 3, g.real(0.8)).when(aspect >= 1, g.real(0.65)).when(aspect >= g.real(0.4), g.real(0.7)).otherwise(g.real(0.52))
    fill = F.least(g.real(1), F.greatest(g.real(0.7), F.col("fill") * g.real(1.5)))
    large = F.when(w * h > g.real(0.6) * F.col("page_width") * F.col("page_height"), g.real(0.85)).otherwise(g.real(1))
    value = F.when((w < 4) | (h < 4), g.real(0.35)).otherwise(F.least(g.real(0.95), base * fill * large))
    return boxes.select(*PAGE, "word_idx", F.round(value, 6).alias("shape_confidence"))
