"""Input files: scan, checks with a table of rejects, page limits, profiles."""

from __future__ import annotations

import os
from dataclasses import make_dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File name endings that are taken, and limits.
ENDINGS = (".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".bmp")
MAX_PAGES, MAX_MB = 50, 100


#: Keys of a profile's sections, with the defaults of what a file leaves out.
SECTIONS: dict[str, dict[str, Any]] = {
    "preprocessing": {
        "denoise": False, "deskew": False, "thresholding": False, "resize_scale": 1.0, "perspective_correction": False, "denoise_strategy": "nlmeans", "adaptive_denoise": False, "blur_safe_mode": False, "threshold_mode": "otsu",
        "clahe_clip_limit": 1.5, "sharpen": False, "sharpen_strength": 0.5, "adaptive_block_size": 31, "adaptive_C": 10, "morphology_opening": False, "morphology_kernel_size": 2, "morphology_closing": False,
    },
    "layout": {"confidence_threshold": 0.5},
    "ocr": {"device": "cpu", "language": "en", "batch_size": 8},
    "postprocess": {"confidence_threshold": 0.5, "grammar_correction": False, "merge_paragraphs": False},
    "export": {"formats": ["json"], "output_directory": "./data/output"},
}

Profile = make_dataclass("Profile", [("profile_id", str, "fast_draft"), *((k, type(v), v) for k, v in SECTIONS["preprocessing"].items())], frozen=True)
Profile.__doc__ = "How pages are prepared: the preprocessing section of a profile, under its keys."


def settings(path: str | None = None) -> dict[str, dict[str, Any]]:
    """Sections of a profile file, each key as the type of its default; keys of other names are refused.
    Without a file, or where there is none, all defaults."""
    raw: dict[str, Any] = {}
    if path and os.path.isfile(path):
        import yaml

        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
    out: dict[str, dict[str, Any]] = {"profile": {"profile_id": str(raw.get("profile_id", os.path.splitext(os.path.basename(path))[0] if path else "fast_draft"))}}
    for section, keys in SECTIONS.items():
        own = raw.get(section) or {}
        unknown = set(own) - set(keys) - {"model"}  # a layout's model names a backend, see plugins
        if unknown:
            raise ValueError(f"unknown keys in {section}: {', '.join(sorted(unknown))}")
        out[section] = {k: type(v)(own[k]) if k in own else v for k, v in keys.items()}
    return out


def profile(path: str | None = None) -> Profile:
    s = settings(path)
    return Profile(**s["profile"], **s["preprocessing"])


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Files under path, each once: path, length, first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length", F.substring("content", 1, 4).alias("head")).dropDuplicates(["path"])


def checked(files: DataFrame, max_mb: float = MAX_MB, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """files with ending, doc key and why they are rejected (null: taken)."""
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    why = F.when(F.length("head") < 4, "unreadable").when(~ending.isin(*endings), "extension").when(F.col("length") / 1048576 > max_mb, "size")
    return files.withColumn("ending", ending).withColumn("rejected", why).withColumn("doc_key", F.sha2("path", 256))


def page_limit(pages: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """Pages of documents of at most so many pages."""
    return pages.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id"))).where(F.col("_n") <= most).drop("_n")


def metadata(pages: DataFrame) -> DataFrame:
    """(doc_id, page_count, width, height of the first page)"""
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.min_by("page_width", "page_number").alias("width"), F.min_by("page_height", "page_number").alias("height"))


def images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(decoded pages, rejects) of image files."""
    read = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    return read.where("height > 0"), read.where("height <= 0").select("origin")
