"""Fonts that fit boxes, and where tokens stand in a viewer. Row-wise expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions import geometry as g

PAGE = ["doc_id", "page_number"]
#: Least and greatest size, line spacing, width of a character over its height.
SMALL, LARGE, SPACING, CHAR = 6.0, 18.0, 1.2, 0.55


def per_line(width: Column, font: Column) -> Column:
    return F.greatest(F.lit(1), (width / (font * g.real(CHAR))).cast("int"))


def line_count(lengths: Column, width: Column, font: Column) -> Column:
    """Sum over lines of their length over the characters that fit, at least one each."""
    n = per_line(width, font)
    return F.aggregate(lengths, g.real(0), lambda a, l: a + F.greatest(g.real(1), l / n))


def sized(tokens: DataFrame) -> DataFrame:
    """tokens with _font, the largest of thirteen sizes from 12 downward at which a text's lines fit its box
    (the smallest if none does), and _lines, how many lines it takes then. Each is a step of its own, and
    a text of one line needs no fold."""
    w, h, size = F.col("width"), F.col("height"), F.size("_lengths")
    one = F.get("_lengths", F.lit(0))

    def lines(font: Column) -> Column:
        return F.when(size == 1, F.greatest(g.real(1), one / per_line(w, font))).otherwise(line_count(F.col("_lengths"), w, font))

    sizes = [12 - 0.5 * k for k in range(13)]
    best = F.lit(None).cast("double")
    for s in reversed(sizes):
        best = F.when(lines(g.real(s)) * g.real(s) * g.real(SPACING) <= h, g.real(s)).otherwise(best)
    t = tokens.withColumn("_lengths", F.transform(F.split("text", "\n"), lambda l: F.char_length(l)))
    t = t.withColumn("_font", F.coalesce(best, g.real(SMALL)))
    return t.withColumn("_lines", lines(F.col("_font")))


def text_block(width: Column, height: Column, text: Column, full: Column) -> dict[str, Column]:
    """Of tokens that have gone through sized()."""
    font, lines = F.col("_font"), F.col("_lines")
    wrapped = F.char_length(text) * g.real(12 * CHAR) > width
    ok = lines * font * g.real(SPACING) <= height
    spacing = F.when(ok, g.real(SPACING)).otherwise(F.greatest(g.real(1), height / (lines * font)))
    status = F.when(~ok, "warning").when(font < 12, "shrunk").when(wrapped, "wrapped").otherwise("fit")
    return {"font": font, "weight": F.lit(400), "spacing": spacing, "align": F.when(full, "justify").otherwise("left"), "wrap": F.when(wrapped, "wrap").otherwise("none"), "status": status}


def heading(width: Column, text: Column, full: Column) -> dict[str, Column]:
    wrapped = F.char_length(text) * g.real(LARGE * CHAR) > width
    lines = F.char_length(text) / per_line(width, g.real(LARGE))
    font = F.when(wrapped & (lines > 2), g.real(14)).otherwise(g.real(LARGE))
    return {"font": font, "weight": F.lit(700), "spacing": g.real(SPACING), "align": F.when(full, "center").otherwise("left"), "wrap": F.when(wrapped, "wrap").otherwise("none"), "status": F.when(wrapped, "wrapped").otherwise("fit")}


def table(width: Column, rows: Column) -> dict[str, Column]:
    """The first of eleven steps from 11 downward at which the longest cell fits its column."""
    cols = F.greatest(F.lit(1), F.array_max(F.transform(rows, lambda r: F.size(r))))
    longest = F.array_max(F.transform(F.flatten(rows), lambda c: F.char_length(c)))
    each = width / cols
    none = rows.isNull() | (F.size(rows) <= 0)
    k = F.coalesce(F.try_element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: longest * (g.real(11) - g.real(0.5) * i) * g.real(CHAR) <= each), F.lit(1)), F.lit(10))
    return {
        "font": F.when(none, g.real(11)).otherwise(g.real(11) - g.real(0.5) * k), "weight": F.lit(400), "spacing": g.real(SPACING), "align": F.lit("left"), "wrap": F.when(none, "none").when(k == 10, "wrap_text").otherwise("cell"),
        "status": F.when(none | (k == 10), "warning").when(k > 0, "shrunk").otherwise("fit"),
    }


def key_value(width: Column, text: Column) -> dict[str, Column]:
    wide = F.char_length(text) * g.real(11 * CHAR) > width
    return {"font": g.real(11), "weight": F.lit(400), "spacing": g.real(SPACING), "align": F.lit("left"), "wrap": F.when(wide, "hard_wrap").otherwise("none"), "status": F.when(wide, "enable_multiline").otherwise("fit")}


def solved(tokens: DataFrame) -> DataFrame:
    """tokens with font, weight, spacing, align, wrap and status by block type."""
    w, h, x, full = F.col("width"), F.col("height"), F.col("text"), F.col("layout_role") == "full_width"
    by = {"heading": heading(w, x, full), "table": table(w, F.col("table_rows")), "key_value": key_value(w, x)}
    plain = text_block(w, h, x, full)
    out = {}
    for name, other in plain.items():
        c = None
        for kind, values in by.items():
            c = F.when(F.col("block_type") == kind, values[name]) if c is None else c.when(F.col("block_type") == kind, values[name])
        out[name] = c.otherwise(other)
    return sized(tokens).withColumns({k: F.round(v, 6) if k in ("font", "spacing") else v for k, v in out.items()}).drop("_lengths", "_font", "_lines")


def tree(tokens: DataFrame) -> DataFrame:
    """(page, block_type, n, previews): the first fifty characters of each token in order."""
    p = F.struct("block_order", F.regexp_replace(F.substring("text", 1, 50), "\n", " ↵ ").alias("p"))
    return tokens.groupBy(*PAGE, "block_type").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(p)), lambda v: v["p"]).alias("previews"))


def viewer_offsets(pages: DataFrame, gap: int = 30) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    return pages.select(*PAGE, "page_height", F.coalesce(F.sum(F.col("page_height") + gap).over(w), F.lit(0)).cast("long").alias("y_offset"))


def viewer_boxes(tokens: DataFrame, offsets: DataFrame) -> DataFrame:
    """Where each token stands in the viewer: down by its page's offset, at least twenty by fifteen."""
    t = tokens.join(offsets.select(*PAGE, "y_offset"), PAGE)
    return t.select(*PAGE, "token_id", "x", (F.col("y") + F.col("y_offset")).alias("y"), F.greatest(F.lit(20), F.col("width")).alias("width"), F.greatest(F.lit(15), F.col("height")).alias("height"))
