"""Files of many pages as a data source: read by ranges of bytes, page by page, also as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, page_number int, height int, width int, channels int, data binary"
#: Bytes of a file that one task reads, unless the option splitBytes says otherwise.
SPLIT = 64 << 20
#: First letters of a pixmap, and its bytes for a pixel.
KINDS = {b"P5": 1, b"P6": 3}


@dataclass
class Range(InputPartition):
    """The pages of a file that begin in [lo, hi)."""

    path: str
    lo: int
    hi: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[int, str, int]]:
    """(time of change, path, size) of a file, or of the pixmaps under a folder, in order."""
    store, top = opened(path)
    root = store.get_file_info(top)
    found = [root] if root.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and (f is root or f.path.endswith((".pgm", ".ppm", ".pnm"))))


def header(head: bytes, path: str, at: int) -> tuple[int, int, int, int]:
    """(height, width, channels, bytes of the header itself) of a pixmap."""
    words, pos = [], 0
    while len(words) < 4:
        while pos < len(head) and head[pos : pos + 1].isspace():
            pos += 1
        end = pos
        while end < len(head) and not head[end : end + 1].isspace():
            end += 1
        words.append(head[pos:end])
        pos = end
        if not words[-1]:
            break
    if len(words) < 4 or words[0] not in KINDS or not all(w.isdigit() for w in words[1:]) or words[3] != b"255":
        raise ValueError(f"{path}: no pixmap of eight bits at byte {at}")
    return int(words[2]), int(words[1]), KINDS[words[0]], pos + 1


def pages(part: Range, names: list[str], wanted) -> Iterator[dict]:
    """Rows of a range's wanted pages. Of pages before it and of those that nobody wants only the header is
    read, and pixels only if names has them. A file cut short is an error."""
    store, path = opened(part.path)
    with store.open_input_file(path) as f:
        size, at, number = f.size(), 0, 0
        while at < min(size, part.hi):
            f.seek(at)
            height, width, channels, skip = header(f.read(64), part.path, at)
            number, n = number + 1, height * width * channels
            if at + skip + n > size or not n:
                raise ValueError(f"{part.path}: page {number} is cut short")
            if at >= part.lo and wanted(number):
                row = {"path": part.path, "page_number": number, "height": height, "width": width, "channels": channels}
                if "data" in names:
                    f.seek(at + skip)
                    row["data"] = f.read(n)
                yield {k: row[k] for k in names}
            at += skip + n


def spans(text: str) -> list[tuple[int, int]]:
    """Page numbers as "1-3,8" says them; nothing stands for all."""
    out = []
    for part in text.split(",") if text.strip() else []:
        lo, _, hi = part.strip().partition("-")
        out.append((int(lo), int(hi or lo)))
    return out


class _Pages:
    """What readers of a table and of a stream share."""

    def __init__(self, options: dict, names: list[str]):
        self.path, self.split, self.names = options["path"], int(options.get("splitbytes", options.get("splitBytes", SPLIT))), names
        self.spans = spans(options.get("pages", ""))

    def ranges(self, found: list[tuple[int, str, int]]) -> list[Range]:
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [Range(scheme + p, lo, min(size, lo + self.split)) for _, p, size in found for lo in range(0, size, self.split)]

    def wanted(self, number: int) -> bool:
        return not self.spans or any(lo <= number <= hi for lo, hi in self.spans)

    def rows(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no files at all
            return
        kinds = {"path": pa.string(), "data": pa.binary()}
        form = pa.schema([(k, kinds.get(k, pa.int32())) for k in self.names])
        for row in pages(part, self.names, self.wanted):
            yield pa.RecordBatch.from_pylist([row], form)


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges(files(self.path))

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class PageStream(_Pages, DataSourceStreamReader):
    """Files in order of their change; the offset is the last one's time and path, so that it stays small.
    A file that comes in with an older time than what has been read isn't seen."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = files(self.path)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        lo, hi = (start["time"], start["path"]), (end["time"], end["path"])
        return self.ranges([f for f in files(self.path) if lo < f[:2] <= hi])

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PageFiles(DataSource):
    """Format "pagefile": pixmaps (P5, P6, eight bits) one after the other in a file or the files of a folder,
    wherever pyarrow's file systems reach. A row is a page. Columns that a given schema leaves out aren't
    read, nor pages that the option pages leaves out ("1-3,8"). Options: path, splitBytes, pages.

    Filters aren't taken over from Spark: 4.1 keeps what was pushed for one query of a DataFrame in its
    next ones, which would then miss rows. A filter on page_number is Spark's; `read` has it as an option.
    """

    @classmethod
    def name(cls) -> str:
        return "pagefile"

    def schema(self) -> str:
        return SCHEMA

    def _names(self, schema) -> list[str]:
        unknown = set(schema.names) - {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"a page file has no columns {', '.join(sorted(unknown))}")
        return list(schema.names)

    def reader(self, schema) -> PageReader:
        return PageReader(self.options, self._names(schema))

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options, self._names(schema))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageFiles)


def read(spark: SparkSession, path: str, pages: str = "", columns: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """Pages of a file or folder; only those named and only these columns are read."""
    register(spark)
    of = ", ".join(c for c in SCHEMA.split(", ") if columns is None or c.split()[0] in columns)
    return spark.read.format(PageFiles.name()).schema(of).option("pages", pages).option("splitBytes", split).load(path)
