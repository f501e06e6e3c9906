"""Where models and format libraries come in: what a rasteriser, a detector, a recogniser and a corrector
of text must do, each with a stub that is always there. A registry names backends by kind and says what
they can do; an unknown name is an error. Every worker loads a backend once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.functions import geometry as g
from leafwork.functions.tables import scratch
from leafwork.operators import images
from leafwork.operators.breaker import Breaker

PAGE = ["doc_id", "page_number"]
BOX = ["doc_id", "page_number", "word_idx", "x1", "y1", "x2", "y2", "confidence"]


class Rasteriser(Protocol):
    def pages(self, content: bytes) -> list[np.ndarray]:
        """Pictures of a file's pages, uint8 in BGR; ValueError where it has none or can't be read"""


class Detector(Protocol):
    def detect(self, pages: pd.DataFrame) -> pd.DataFrame:
        """doc_id, page_number, word_idx, x1, y1, x2, y2, confidence of pages with data, height, width"""


class Recogniser(Protocol):
    def read(self, image: np.ndarray) -> list[tuple[list[tuple[float, float]], str, float]]:
        """(corners, text, confidence) of each box of a whole page"""


class Corrector(Protocol):
    def correct(self, text: str) -> str:
        """A text with its grammar put right"""


class PixmapRasteriser:
    """Pages of portable pixmaps (P5, P6) one after the other in a file: the format that needs no library."""

    def pages(self, content: bytes) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(content):
            head = content[at : at + 64].split(None, 4)
            if len(head) < 4 or head[0] not in (b"P5", b"P6") or not all(x.isdigit() for x in head[1:4]):
                raise ValueError("not a pixmap")
            w, h, depth = int(head[1]), int(head[2]), 3 if head[0] == b"P6" else 1
            at += content[at : at + 64].index(head[3], content[at : at + 64].index(head[2], content[at : at + 64].index(head[1], 2) + len(head[1])) + len(head[2])) + len(head[3]) + 1
            raw = np.frombuffer(content[at : at + w * h * depth], dtype=np.uint8)
            if raw.size != w * h * depth or not raw.size:
                raise ValueError("pixmap cut short")
            img = raw.reshape(h, w, depth)
            out.append(np.ascontiguousarray(img[..., ::-1] if depth == 3 else np.repeat(img, 3, axis=2)))
            at += raw.size
        if not out:
            raise ValueError("no pages")
        return out


class GridDetector:
    """A stub: four boxes on every page."""

    def detect(self, pages: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.doc_id, r.page_number, i, 10 + 50 * (i % 2), 10 + 30 * (i // 2), 50 + 50 * (i % 2), 30 + 30 * (i // 2), 0.9) for r in pages.itertuples() for i in range(4)]
        return pd.DataFrame(rows, columns=BOX)


class ShapeDetector:
    """Blocks of text by their shape alone, no model."""

    def detect(self, pages: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pages.itertuples():
            img = picture(r)
            for i, (x1, y1, x2, y2, fill) in enumerate(images.found_blocks(img)):
                rows.append((r.doc_id, r.page_number, i, x1, y1, x2, y2, shape_confidence(x2 - x1, y2 - y1, fill, img.shape[1] * img.shape[0])))
        return pd.DataFrame(rows, columns=BOX).astype({"doc_id": "int64", "confidence": "float64"} | {k: "int32" for k in BOX[1:-1]})


class BarRecogniser:
    """A stub: each block found by shape is a box, whose text says its size."""

    def read(self, image: np.ndarray) -> list[tuple[list[tuple[float, float]], str, float]]:
        return [([(x1, y1), (x2, y1), (x2, y2), (x1, y2)], f"{x2 - x1}x{y2 - y1}", 0.9) for x1, y1, x2, y2, _ in images.found_blocks(image)]


class NoCorrector:
    def correct(self, text: str) -> str:
        return text


#: By kind and name: the class, and what it can do.
REGISTRY: dict[str, dict[str, tuple[type, dict[str, Any]]]] = {
    "rasteriser": {"pixmap": (PixmapRasteriser, {"endings": (".ppm", ".pgm")})},
    "detector": {"grid": (GridDetector, {"model": False, "level": "word"}), "shape": (ShapeDetector, {"model": False, "level": "block"})},
    "recogniser": {"bars": (BarRecogniser, {"model": False, "languages": ("en",)})},
    "corrector": {"none": (NoCorrector, {"languages": ()})},
}

#: Names for versions of a recogniser, and the versions that are supported.
VERSION_NAMES = {"latest": "PP-OCRv5", "stable": "PP-OCRv4"}
VERSIONS = ("PP-OCRv3", "PP-OCRv4", "PP-OCRv5")


def backend(kind: str, name: str):
    known = REGISTRY[kind]
    if name not in known:
        raise ValueError(f"unknown {kind}: {name}; known: {', '.join(sorted(known))}")
    return known[name][0]()


def capabilities(kind: str, name: str) -> dict[str, Any]:
    backend(kind, name)
    return REGISTRY[kind][name][1]


def version(name: Column) -> Column:
    """The version that a name stands for; null where it isn't supported."""
    full = F.coalesce(F.create_map(*[F.lit(x) for kv in VERSION_NAMES.items() for x in kv])[name], name)
    return F.when(full.isin(*VERSIONS), full)


def picture(row) -> np.ndarray:
    img = np.frombuffer(bytes(row.data), dtype=np.uint8).reshape(row.height, row.width, -1)
    return img[..., 0] if img.shape[2] == 1 else img


def shape_confidence(w: int, h: int, fill: float, page: int) -> float:
    """As layout.shape_confidence, of one box."""
    if w < 4 or h < 4:
        return 0.35
    aspect = w / max(1, h)
    base = 0.8 if aspect >= 3 else 0.65 if aspect >= 1 else 0.7 if aspect >= 0.4 else 0.52
    return min(0.95, base * min(1.0, max(0.7, fill * 1.5)) * (0.85 if w * h > 0.6 * page else 1.0))


def rasterised(files: DataFrame, name: str = "pixmap", most: int = 100) -> DataFrame:
    """(doc_key, page_number, height, width, data, error) of files with doc_key and content: a row a page,
    or one row with what is wrong (no pages, not readable, more pages than `most`)."""
    backend("rasteriser", name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = backend("rasteriser", name)
        for b in batches:
            for key, content in zip(b["doc_key"], b["content"]):
                try:
                    pages = r.pages(bytes(content or b""))
                    if len(pages) > most:
                        raise ValueError(f"{len(pages)} pages, more than {most}")
                    rows = [(key, i + 1, p.shape[0], p.shape[1], p.tobytes(), None) for i, p in enumerate(pages)]
                except ValueError as e:
                    rows = [(key, 0, 0, 0, None, str(e))]
                yield pd.DataFrame(rows, columns=["doc_key", "page_number", "height", "width", "data", "error"])

    return files.select("doc_key", "content").mapInPandas(run, "doc_key string, page_number int, height int, width int, data binary, error string")


def detection(name: str = "grid") -> tuple[images.Kernel, str]:
    """What detected() does with frames of pages, and its schema."""
    backend("detector", name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend("detector", name)
        for b in batches:
            yield model.detect(b)

    return run, "doc_id long, page_number int, word_idx int, x1 int, y1 int, x2 int, y2 int, confidence double"


def detected(pages: DataFrame, name: str = "grid") -> DataFrame:
    """Boxes of a detector."""
    return pages.mapInPandas(*detection(name))


def recognition(spark: SparkSession, name: str = "bars", make=None, breaker: Breaker | None = None, kind: str = "bigint") -> tuple[images.Kernel, str]:
    """What recognised() does with frames of pages, and its schema; kind is the type of doc_id."""
    make = make or (lambda: backend("recogniser", name))
    if name not in REGISTRY["recogniser"]:
        backend("recogniser", name)
    shared = breaker or Breaker(scratch(spark), most=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for b in batches:
            rows = []
            for r in b.itertuples():
                found, called = None, shared.allows()
                if called:
                    try:
                        found = engine.read(picture(r))
                    except Exception:  # noqa: BLE001 - whatever the engine raises, the page has failed
                        found = None
                    shared.told(found is not None)
                if found is None:
                    rows.append((r.doc_id, r.page_number, -1, [], "", 0.0, r.width, r.height, True, not called))
                else:
                    rows += [(r.doc_id, r.page_number, i, [{"x": float(x), "y": float(y)} for x, y in quad], t, float(c), r.width, r.height, False, False) for i, (quad, t, c) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[*PAGE, "box_idx", "quad", "text", "confidence", "page_width", "page_height", "failed", "given_up"])

    return run, f"doc_id {kind}, page_number int, box_idx int, quad array<struct<x:double,y:double>>, text string, confidence double, page_width int, page_height int, failed boolean, given_up boolean"


def recognised(pages: DataFrame, name: str = "bars", make=None, breaker: Breaker | None = None) -> DataFrame:
    """(page, box_idx, quad, text, confidence, page_width, page_height, failed, given_up): boxes of whole pages.

    A page on which the recogniser raises gives one row that says so, with no box. Calls go through a
    breaker that all tasks share; its default has a folder of its own for this DataFrame and opens at the
    first failure, as an engine that raised can't be trusted. Pages that come while it is open are given up
    without a call, and say that too.
    """
    return pages.select(*PAGE, "height", "width", "data").mapInPandas(*recognition(pages.sparkSession, name, make, breaker, pages.schema["doc_id"].dataType.simpleString()))


def corrected(lines: DataFrame, name: str = "none", text: str = "text") -> DataFrame:
    """lines with their text as a corrector leaves it."""
    backend("corrector", name)

    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        c = backend("corrector", name)
        return s.map(lambda x: None if x is None else c.correct(x))

    return lines.withColumn(text, fix(F.col(text)))


def relative_boxes(words: DataFrame, keep: float = 0.5, sure: float = 0.7) -> DataFrame:
    """Regions of a detector whose boxes are shares of the page: cut toward zero to pixels, clipped,
    empty ones and those under `keep` left out, numbered in order. Its pages have no columns."""
    cut = lambda k, most: F.greatest(F.lit(0), F.least((F.col(k) * F.col(most)).cast("int"), F.col(most)))
    b = words.withColumns({"_a": cut("x_min", "page_width"), "_b": cut("y_min", "page_height"), "_c": cut("x_max", "page_width"), "_d": cut("y_max", "page_height")})
    b = b.where((F.col("_c") > F.col("_a")) & (F.col("_d") > F.col("_b")) & (F.coalesce("confidence", g.real(0.8)) >= g.real(keep)))
    conf = F.coalesce("confidence", g.real(0.8))
    no = F.row_number().over(Window.partitionBy(*PAGE).orderBy("word_idx")) - 1
    return b.select(*PAGE, F.format_string("p%d-r%d", "page_number", no).alias("region_id"), F.lit("text_block").alias("type"), F.col("_a").alias("x1"), F.col("_b").alias("y1"), F.col("_c").alias("x2"), F.col("_d").alias("y2"), conf.alias("confidence"), (conf < g.real(sure)).alias("flagged"), F.lit("raw_blocks").alias("layout_type"), F.lit(0).alias("column_count"))


def crops(boxes: DataFrame, least: int = 8, share_x: float = 0.02, share_y: float = 0.08) -> DataFrame:
    """What is cut out of a page for each box: grown by shares of its size, whole pixels, within the page;
    boxes under eight pixels on a side and empty crops are left out."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    px, py = (w * g.real(share_x)).cast("int"), (h * g.real(share_y)).cast("int")
    c = boxes.where((w >= least) & (h >= least)).withColumns({
        "crop_x1": F.greatest(F.lit(0), F.col("x1") - px), "crop_y1": F.greatest(F.lit(0), F.col("y1") - py), "crop_x2": F.least(F.col("page_width"), F.col("x2") + px), "crop_y2": F.least(F.col("page_height"), F.col("y2") + py),
    })
    return c.where("crop_x2 > crop_x1 and crop_y2 > crop_y1")


def crop(img: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """The pixels of a crop in gray, as three equal channels; other types than bytes are stretched to them."""
    x1, y1, x2, y2 = box
    part = img[y1:y2, x1:x2]
    if part.dtype != np.uint8:
        low, high = float(part.min()), float(part.max())
        part = np.clip(np.rint((part - low) * (255 / (high - low) if high > low else 0)), 0, 255).astype(np.uint8)
    return np.repeat(images.gray(part)[..., None], 3, axis=2)
