"""Recognised boxes: order, matching to lines, page text, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions import geometry as g
from leafwork.functions.intervals import placed
from leafwork.functions.islands import joined
from leafwork.functions.tables import kept
from leafwork.functions.text import strip

PAGE = ["doc_id", "page_number"]


def centroids(boxes: DataFrame) -> DataFrame:
    mean = lambda k: F.aggregate("quad", g.real(0), lambda s, p: s + p[k]) / g.real(4)
    return boxes.withColumns({"cx": mean("x"), "cy": mean("y")})


def ocr_order(boxes: DataFrame) -> DataFrame:
    """Rows of ten pixels, rounded half to even, then x of the first corner."""
    first = F.col("quad")[0]
    w = Window.partitionBy(*PAGE).orderBy(F.bround(first["y"] / 10) * 10, first["x"], "box_idx")
    return boxes.withColumn("ocr_order", (F.row_number().over(w) - 1).cast("int"))


def cleaned(boxes: DataFrame) -> DataFrame:
    """Text without outer white space, null as empty; confidence within 0..1, NaN and infinities as 0."""
    c = F.col("confidence")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return boxes.withColumn("text", strip(F.coalesce("text", F.lit("")))).withColumn("confidence", F.when(bad, g.real(0)).otherwise(F.least(g.real(1), F.greatest(g.real(0), c))))


def matched(lines: DataFrame, boxes: DataFrame, keep: float = 0.0) -> DataFrame:
    """lines (with reading_order) and the boxes whose centre is in them, first line in order wins: text
    joined in the boxes' order, mean confidence; a line without boxes has an empty text and 0. A centre is
    held against the lines whose rows it lies in alone."""
    b = ocr_order(centroids(boxes.where(strip(F.coalesce("text", F.lit(""))) != ""))).select(*PAGE, "box_idx", "ocr_order", "text", "confidence", "cx", "cy")
    held = kept(lines.select(*PAGE, "line_idx", "reading_order", "x1", "y1", "x2", "y2"))  # goes three ways
    met = placed(held, b, PAGE, "y1", "y2", "cy").where(F.col("b.cx").between(F.col("a.x1"), F.col("a.x2")))
    own = met.groupBy(*[F.col(f"b.{k}").alias(k) for k in (*PAGE, "box_idx", "ocr_order", "text", "confidence")]).agg(F.min(F.struct("a.reading_order", "a.line_idx")).alias("to"))
    per = own.groupBy(*PAGE, F.col("to.line_idx").alias("line_idx")).agg(joined(F.collect_list(F.struct("ocr_order", "text")), " ").alias("ocr_text"), F.round(F.avg("confidence"), 6).alias("ocr_confidence"), F.count("*").alias("n_boxes"))
    out = held.join(per, [*PAGE, "line_idx"], "left").select(*PAGE, "line_idx", "reading_order", F.coalesce("ocr_text", F.lit("")).alias("ocr_text"), F.coalesce("ocr_confidence", g.real(0)).alias("ocr_confidence"), F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"))
    return out.where(F.col("ocr_confidence") >= g.real(keep)) if keep > 0 else out


def page_text(recognised: DataFrame) -> DataFrame:
    return recognised.groupBy(*PAGE).agg(joined(F.collect_list(F.when(F.col("ocr_text") != "", F.struct("reading_order", F.col("ocr_text").alias("text")))), "\n").alias("page_text"), F.count("*").alias("n_regions"))


def metrics(recognised: DataFrame, accept: float = 0.5) -> DataFrame:
    """Counts by document; the mean confidence is taken over whole millionths, halves rounded up, so that
    it doesn't depend on the order of rows."""
    ok = F.col("ocr_confidence") >= g.real(accept)
    total, n = F.sum(F.round(F.col("ocr_confidence") * 1_000_000).cast("long")), F.count("*")
    return recognised.groupBy("doc_id").agg(
        F.count("*").alias("regions"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.count_if(F.col("ocr_text") == "").alias("blank"),
        (F.floor((2 * total + n) / (2 * n)) / g.real(1_000_000)).alias("mean_confidence"), F.countDistinct("page_number").alias("pages"),
    )


def batches(sizes: DataFrame, most: int = 64, pixels: int = 12_000_000) -> DataFrame:
    """Greedy batches of crops in order, by number and pixels: a fold over each page's array."""
    start = F.struct(F.lit(0).alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("p"), F.array().cast("array<int>").alias("out"))

    def step(a, v):
        new = (a["n"] >= most) | ((a["n"] > 0) & (a["p"] + v["px"] > pixels))
        b = F.when(new, a["b"] + 1).otherwise(a["b"])
        return F.struct(b.alias("b"), F.when(new, F.lit(1).cast("long")).otherwise(a["n"] + 1).alias("n"), F.when(new, v["px"]).otherwise(a["p"] + v["px"]).alias("p"), F.concat(a["out"], F.array(b)).alias("out"))

    seq = sizes.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_idx", F.col("px").cast("long").alias("px")))).alias("s"))
    out = seq.withColumn("b", F.aggregate("s", start, step, lambda a: a["out"])).select(*PAGE, F.explode(F.arrays_zip("s", "b")).alias("z"))
    return out.select(*PAGE, F.col("z.s.line_idx").alias("line_idx"), F.col("z.b").alias("batch"))
