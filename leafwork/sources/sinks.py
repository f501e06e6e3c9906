"""Rendered documents as text: TXT, Markdown, JSON, CSV cells, and draw commands for page formats."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions import geometry as g
from leafwork.functions import text as t

PAGE = ["doc_id", "page_number"]


def _pages(tokens: DataFrame, body, name: str) -> DataFrame:
    """Each page's tokens in order as one string; body gives a token's own."""
    return tokens.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_order", body.alias("b")))), lambda x: x["b"]), "").alias(name), F.max("num_columns").alias("num_columns"))


def _documents(pages: DataFrame, name: str) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.col(name).alias("b")))), lambda x: x["b"]), "\n").alias(name))


def columned(tokens: DataFrame) -> DataFrame:
    return tokens if "num_columns" in tokens.columns else tokens.withColumn("num_columns", F.lit(1))


def is_kind(kind: str) -> Column:
    """Classes by name, in any case; both names of key-values."""
    k = F.lower("block_type")
    return k.isin("key_value", "key_value_pair") if kind == "key_value" else k == kind


def text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def grid() -> Column:
    """Rows of a table's trimmed cells: its own, or else the text's lines parted at bars."""
    own = F.when(F.size(F.coalesce("table_rows", F.array().cast("array<array<string>>"))) > 0, F.col("table_rows")).otherwise(F.transform(text_lines(F.col("text")), lambda l: F.split(l, r" \| ", -1)))
    return F.transform(own, lambda r: F.transform(r, t.strip))


def piped(row: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))


def txt(tokens: DataFrame) -> DataFrame:
    """One text per document: a banner for each page, tokens in reading order with an empty line after
    each; headings under ##, tables as rows between bars, lists and key-values indented by two."""
    indented = F.array_join(F.transform(text_lines(F.col("text")), lambda l: F.concat(F.lit("  "), l)), "\n")
    table = F.concat(F.lit("[TABLE]\n"), F.array_join(F.transform(grid(), piped), "\n"))
    body = F.when(is_kind("heading"), F.concat(F.lit("## "), F.col("text"))).when(is_kind("table"), table).when(is_kind("key_value") | is_kind("list"), indented).otherwise(F.col("text"))
    p = _pages(columned(tokens), F.concat(F.lit("\n"), body, F.lit("\n")), "txt")
    banner = F.repeat(F.lit("="), F.lit(60))
    wide = F.when(F.col("num_columns") > 1, F.format_string(" (%d column(s))", "num_columns")).otherwise("")
    head = F.concat(banner, F.lit("\nPAGE "), F.col("page_number").cast("string"), wide, F.lit("\n"), banner, F.lit("\n"))
    return _documents(p.withColumn("txt", F.concat(head, F.col("txt"), F.lit("\n"))), "txt")


def markdown(tokens: DataFrame) -> DataFrame:
    """One text per document: # headings, pipe tables with a rule under the first row, bold keys, dashed
    items, and a rule after each page."""
    rows = grid()
    first = F.get(rows, F.lit(0))
    rule = piped(F.transform(first, lambda c: F.lit("---")))
    table = F.array_join(F.concat(F.array(piped(first), rule), F.transform(F.slice(rows, 2, F.greatest(F.lit(1), F.size(rows))), piped)), "\n")
    key = lambda l: F.concat(F.lit("**"), t.strip(F.substring_index(l, ":", 1)), F.lit(":** "), t.strip(F.regexp_replace(l, r"^[^:]*:", "")))
    pair = F.array_join(F.transform(text_lines(F.col("text")), lambda l: F.when(F.instr(l, ":") > 0, key(l)).otherwise(l)), "\n")
    item = F.array_join(F.transform(text_lines(F.col("text")), lambda l: F.concat(F.lit("- "), unbulleted(l))), "\n")
    body = F.when(is_kind("heading"), F.concat(F.lit("# "), F.col("text"))).when(is_kind("table"), table).when(is_kind("key_value"), pair).when(is_kind("list"), item).otherwise(F.col("text"))
    p = _pages(columned(tokens), F.concat(body, F.lit("\n\n")), "markdown")
    return _documents(p.withColumn("markdown", F.concat(F.col("markdown"), F.lit("---\n"))), "markdown")


def unbulleted(line: Column) -> Column:
    return F.regexp_replace(line, r"^[•\-*●○▪► ]+", "")


def docx_commands(tokens: DataFrame) -> DataFrame:
    """What a writer of a word processor's format sets, in order of (block_order, part): a page break
    before each page of a document but its first, headings of level 1, table cells (the first row bold),
    bullets, paragraphs. note is a small grey remark with the box, once a token."""
    d = lambda k: F.col(k).cast("double")
    note = F.format_string("[bbox: x=%.1f, y=%.1f, w=%.1f, h=%.1f | col=%d]", d("x"), d("y"), d("width"), d("height"), "column_id")
    none = F.lit(None).cast("string")
    command = lambda op, text, note_, row=F.lit(0), col=F.lit(0), bold=F.lit(False): F.struct(op.alias("op"), text.alias("text"), row.cast("int").alias("row"), col.cast("int").alias("col"), bold.alias("bold"), note_.alias("note"))
    # Columns of their own: within a function of each element they would be made once more for every one.
    rows, wide, items = F.col("_rows"), F.col("_wide"), F.col("_items")
    width = F.when(F.size(F.coalesce("table_rows", F.array().cast("array<array<string>>"))) > 0, F.array_max(F.transform(rows, lambda r: F.size(r)))).otherwise(F.size(F.get(rows, F.lit(0))))
    cells = F.flatten(F.transform(rows, lambda r, i: F.transform(F.slice(r, 1, wide), lambda c, j: command(F.lit("cell"), c, none, i, j, i == 0))))
    bullets = F.transform(items, lambda x, i: command(F.lit("bullet"), x, F.when(i == F.size(items) - 1, F.col("note"))))
    plain = lambda op: F.array(command(F.lit(op), F.col("text"), F.col("note")))
    tail = F.array(command(F.lit("paragraph"), F.lit(""), F.col("note")))
    start = F.lag("page_number").over(Window.partitionBy("doc_id").orderBy("page_number", "block_order"))
    noted = tokens.withColumn("note", note).withColumn("_break", start.isNotNull() & (start != F.col("page_number")))
    noted = noted.withColumn("_rows", F.when(is_kind("table"), grid())).withColumn("_wide", width).withColumn("_items", F.when(is_kind("list"), F.filter(F.transform(text_lines(F.col("text")), unbulleted), lambda x: x != "")))
    all_ = F.when(is_kind("heading"), plain("heading_1")).when(is_kind("table"), F.concat(cells, tail)).when(is_kind("list"), bullets).otherwise(plain("paragraph"))
    own = F.transform(all_, lambda c, i: F.struct(F.col("block_order").alias("block_order"), i.alias("part"), c.alias("c")))
    before = F.array(F.struct(F.lit(-1).alias("block_order"), F.lit(0).alias("part"), command(F.lit("page_break"), F.lit(""), none).alias("c")))
    return noted.select(*PAGE, F.explode(F.when(F.col("_break"), F.concat(before, F.coalesce(own, F.slice(before, 1, 0)))).otherwise(own)).alias("v")).select(*PAGE, "v.block_order", "v.part", "v.c.*")


def json_documents(tokens: DataFrame) -> DataFrame:
    """One JSON object per document: pages of tokens with type, text and box."""
    t = F.struct("block_order", F.struct("token_id", F.col("block_type").alias("type"), "text", F.struct("x", "y", "width", "height").alias("bbox"), "confidence").alias("t"))
    pages = tokens.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(t)), lambda v: v["t"]).alias("tokens"))
    p = F.array_sort(F.collect_list(F.struct("page_number", "tokens")))
    return pages.groupBy("doc_id").agg(p.alias("pages")).select("doc_id", F.to_json(F.struct("doc_id", "pages")).alias("json"))


def table_cells(tokens: DataFrame) -> DataFrame:
    """(page, token_id, row, col, value) of every table: rows of a CSV or cells of a sheet."""
    r = tokens.where("block_type = 'table'").select(*PAGE, "token_id", F.posexplode("table_rows").alias("row", "cells"))
    return r.select(*PAGE, "token_id", "row", F.posexplode("cells").alias("col", "value"))


def draw_commands(tokens: DataFrame, page_height: int = 1100) -> DataFrame:
    """What a page writer draws, y from the bottom: headings bold and centred in their box, table cells in
    a grid of rows at least fourteen high and cut to forty characters (the first row bold), other text to
    be wrapped at `width` from its first base line down, `height` apart. A size of zero is ten."""
    d = lambda c: c.cast("double")
    size = F.when(F.coalesce(F.col("font"), g.real(0)) > 0, F.col("font")).otherwise(g.real(10)) if "font" in tokens.columns else g.real(10)
    tk = tokens.withColumn("_size", size)
    common = [*PAGE, "block_order"]
    head = tk.where(is_kind("heading")).select(*common, F.lit(0).alias("part"), F.lit("centred_text").alias("op"), d(F.col("x")).alias("x"), d(page_height - F.col("y") - F.col("height")).alias("y"), d(F.col("width")).alias("width"), d(F.col("height")).alias("height"), F.lit("Helvetica-Bold").alias("face"), F.col("_size").alias("size"), "text")
    plain = tk.where(~is_kind("heading") & ~is_kind("table")).select(*common, F.lit(0).alias("part"), F.lit("wrapped_text").alias("op"), d(F.col("x") + 2).alias("x"), d(page_height - F.col("y") - F.col("_size") - 2).alias("y"), d(F.greatest(F.col("width") - 4, F.lit(50))).alias("width"), d(F.col("_size") + 2).alias("height"), F.lit("Helvetica").alias("face"), F.col("_size").alias("size"), "text")
    r = tk.where(is_kind("table")).withColumn("_g", grid()).withColumn("_h", F.greatest(F.col("height") / F.greatest(F.lit(1), F.size("_g")), g.real(14))).select("*", F.posexplode("_g").alias("row", "cells"))
    c = r.withColumn("_w", F.col("width") / F.greatest(F.lit(1), F.size("cells"))).select("*", F.posexplode("cells").alias("col", "cell"))
    cells = c.select(*common, (F.col("row") * 1000 + F.col("col")).alias("part"), F.lit("cell").alias("op"), (F.col("x") + F.col("col") * F.col("_w")).alias("x"), (page_height - (F.col("y") + F.col("row") * F.col("_h")) - F.col("_h")).alias("y"), F.col("_w").alias("width"), F.col("_h").alias("height"), F.when(F.col("row") == 0, "Helvetica-Bold").otherwise("Helvetica").alias("face"), g.real(9).alias("size"), F.substring("cell", 1, 40).alias("text"))
    return head.unionByName(plain).unionByName(cells)


def rendered(tokens: DataFrame) -> DataFrame:
    """Solved tokens as a writer takes them: boxes untouched, with the columns of their page and what
    font, weight, alignment, wrapping and spacing were chosen; only tokens that were solved. These are told after
    the window, below which the choice of a font would be made once more to tell them."""
    solved = F.col("font").isNotNull()
    columns = (F.max(F.when(solved, F.col("column_id"))).over(Window.partitionBy(*PAGE)) + 1).cast("int")
    return tokens.withColumn("num_columns", columns).where(solved).select(
        *PAGE, "token_id", F.lower("block_type").alias("block_type"), "block_order", "text", "x", "y", "width", "height", "font", "weight", F.col("align").alias("alignment"), "wrap", F.col("spacing").alias("line_spacing"),
        "column_id", "num_columns", "confidence", "table_rows",
    )


def legacy_json(regions: DataFrame, metadata: DataFrame) -> DataFrame:
    """The older document: title, metadata, sections, tables and raw_text, keys in order. A header opens
    a section of its page and the document's first is the title; paragraphs and footers are its content;
    tables are one row parted at bars. regions: page, region_order, type, text; they are read once."""
    by_page = Window.partitionBy(*PAGE).orderBy("region_order")
    n = regions.withColumn("sec", F.sum((F.col("type") == "header").cast("int")).over(by_page.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct("page_number", "region_order", "text")
    texts = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, order))), lambda v: v["text"])
    cells = lambda x: F.filter(F.transform(F.split(x, r"\|", -1), t.strip), lambda c: c != "")
    is_header = F.col("type") == "header"
    s = n.groupBy(*PAGE, "sec").agg(F.max(F.when(is_header, F.col("text"))).alias("heading"), F.max(is_header).alias("headed"), texts(F.col("type").isin("paragraph", "footer")).alias("parts"), texts(F.col("type") == "table").alias("tables"))
    of = lambda when, v: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("page_number", "sec", v.alias("v"))))), lambda x: x["v"])
    section = F.struct(F.array_join("parts", " ").alias("content"), F.coalesce("heading", F.lit("")).alias("heading"))
    whole = s.groupBy("doc_id").agg(of(F.size("parts") > 0, section).alias("sections"), F.get(of(F.col("headed"), F.col("heading")), F.lit(0)).alias("title"), F.flatten(of(F.size("tables") > 0, F.col("tables"))).alias("tables"))
    rest = whole.withColumn("tables", F.transform("tables", lambda x: F.struct(F.array(cells(x)).alias("rows"))))
    meta = F.struct("file_size", "filename", "page_count", F.array("width", "height").alias("resolution"))
    out = rest.join(metadata.select("doc_id", meta.alias("metadata")), "doc_id")
    raw = F.array_join(F.transform("sections", lambda x: x["content"]), " ")
    return out.select("doc_id", F.to_json(F.struct("metadata", raw.alias("raw_text"), "sections", "tables", F.coalesce("title", F.lit("")).alias("title"))).alias("json"))


def overlays(lines: DataFrame) -> DataFrame:
    """Boxes, order labels and one of ten colours, for a debug picture."""
    return lines.select(*PAGE, "line_idx", "x1", "y1", "x2", "y2", (F.col("line_idx") % 10).alias("colour"), F.when(F.col("confidence") < g.real(0.7), 1).otherwise(2).alias("thickness"), F.col("reading_order").cast("string").alias("label"))


def log_lines(states: DataFrame) -> DataFrame:
    """One JSON line per event, ready for an appending text writer."""
    return states.select("doc_id", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"), F.lit("INFO").alias("level"), F.col("state").alias("stage"), "doc_id", "event_id", "latency")).alias("value"))


def violations(tokens: DataFrame) -> DataFrame:
    """Rows that a writer must not get: without id, type or box."""
    bad = F.col("token_id").isNull() | F.col("block_type").isNull() | F.col("x").isNull() | (F.col("width") <= 0) | (F.col("height") <= 0)
    return tokens.where(bad).select(*PAGE, "token_id")


def export_all(outputs: dict[str, Callable[[str], None]], base: str) -> list[tuple[str, str, str]]:
    """Each writer by itself, so that one that fails doesn't stop the others: (format, status, error)."""
    done = []
    for name, write in outputs.items():
        try:
            write(f"{base}/{name}")
            done.append((name, "success", ""))
        except Exception as e:  # noqa: BLE001 - a format's failure is its result
            done.append((name, "failed", str(e)[:200]))
    return done


def atomic_file(path: str, content: bytes) -> None:
    """A single local file that is never seen half written."""
    part = f"{path}.part"
    with open(part, "wb") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
