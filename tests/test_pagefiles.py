"""Files of many pages as a data source."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwork.sources import pagefiles


def page(k, h=6, w=8, channels=1):
    data = np.full((h, w, channels), k % 251, np.uint8)
    return b"P%d %d\n%d 255\n" % (5 if channels == 1 else 6, w, h) + data.tobytes()


@pytest.fixture
def source(spark):
    pagefiles.register(spark)
    return spark


def test_a_file_of_a_thousand_pages(source, tmp_path):
    path = tmp_path / "book.pgm"
    path.write_bytes(b"".join(page(k) for k in range(1, 1001)))
    df = source.read.format("pagefile").option("splitBytes", 10_000).load(str(path))
    tasks = df.rdd.getNumPartitions()
    assert tasks == -(-os.path.getsize(path) // 10_000) > 5
    got = df.select("page_number", "height", "width", "channels", F.hex(F.substring("data", 1, 1)).alias("x"), F.length("data").alias("n")).collect()
    assert sorted((r.page_number, int(r.x, 16), r.n, r.height, r.width, r.channels) for r in got) == [(k, k % 251, 48, 6, 8, 1) for k in range(1, 1001)]
    per = df.select("page_number").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(per) == tasks and max(r["count"] for r in per) < 250
    assert df.where("page_number = 7 or page_number = 9").count() == 2 and df.where("page_number > 990").count() == 10 and df.count() == 1000
    some = pagefiles.read(source, str(path), "401-402,7", ["page_number"], 10_000)
    assert sorted(r.page_number for r in some.collect()) == [7, 401, 402] and some.columns == ["page_number"]


def test_only_wanted_pages_are_read(source, tmp_path, monkeypatch):
    path = tmp_path / "book.ppm"
    path.write_bytes(b"".join(page(k, 40, 50, 3) for k in range(1, 101)))
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def __getattr__(self, name):
            return getattr(self.f, name)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    class Store:
        def open_input_file(self, p):
            return Counted(pagefiles.fs.LocalFileSystem().open_input_file(p))

    monkeypatch.setattr(pagefiles, "opened", lambda p: (Store(), p))
    reader = pagefiles.PageReader({"path": str(path), "pages": "41-42"}, ["page_number", "data"])
    rows = [r for b in reader.read(pagefiles.Range(str(path), 0, os.path.getsize(path))) for r in b.to_pylist()]
    assert [r["page_number"] for r in rows] == [41, 42] and sorted(read)[-3:] == [64, 6000, 6000]
    read.clear()
    bare = pagefiles.PageReader({"path": str(path)}, ["path", "height"])
    assert sum(b.num_rows for b in bare.read(pagefiles.Range(str(path), 0, os.path.getsize(path)))) == 100 and set(read) == {64}


def test_columns_of_a_folder(source, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.pgm").write_bytes(page(1) + page(2))
    (tmp_path / "in" / "deep" / "b.ppm").write_bytes(page(3, 5, 4, 3))
    (tmp_path / "in" / "note.txt").write_bytes(b"no pixmap")
    got = source.read.format("pagefile").schema("page_number int, channels int, path string").load(str(tmp_path / "in")).collect()
    assert sorted((os.path.basename(r.path), r.page_number, r.channels) for r in got) == [("a.pgm", 1, 1), ("a.pgm", 2, 1), ("b.ppm", 1, 3)]
    with pytest.raises(Exception, match="no columns"):
        source.read.format("pagefile").schema("text string").load(str(tmp_path / "in")).collect()
    (tmp_path / "in" / "c.pgm").write_bytes(page(1)[:-1])
    with pytest.raises(Exception, match="cut short"):
        source.read.format("pagefile").load(str(tmp_path / "in")).collect()
    assert source.read.format("pagefile").load(str(tmp_path / "nothing")).count() == 0


def test_pages_as_they_arrive(source, tmp_path):
    (tmp_path / "in").mkdir()

    def run():
        q = source.readStream.format("pagefile").option("splitBytes", 100).load(str(tmp_path / "in")).select("path", "page_number").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((os.path.basename(r.path), r.page_number) for r in source.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in" / "a.pgm").write_bytes(page(1) + page(2) + page(3))
    assert run() == [("a.pgm", 1), ("a.pgm", 2), ("a.pgm", 3)]
    (tmp_path / "in" / "b.pgm").write_bytes(page(4))
    os.utime(tmp_path / "in" / "b.pgm", (4e9, 4e9))
    assert run() == [("a.pgm", 1), ("a.pgm", 2), ("a.pgm", 3), ("b.pgm", 1)]
    assert len(run()) == 4
