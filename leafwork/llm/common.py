"""Shared pieces of the corpus operators: words, range hashes, scratch tables, batching."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer document is a pass of its own.
PASS_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where that is unset and Spark runs in
    one process (tests). On a cluster each executor would write to its own disk, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="leafwork-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/leafwork/{uuid.uuid4().hex}"


def written(df: DataFrame, spark: SparkSession) -> DataFrame:
    """df as a table in the shared folder: lineage is cut and a lost executor costs nothing. Files of the
    shuffles behind df are freed."""
    path = scratch_dir(spark)
    df.write.parquet(path)
    freed(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def freed(spark: SparkSession, rounds: int = 1) -> None:
    """Has Python and the driver collect their garbage: files of shuffles stay on disk until they do. Events
    that still wait for a listener hold the plans that they tell of, and so their shuffles; they come
    first. The last plan is often held until a second round, for which what comes next may be too large."""
    for i in range(rounds):
        if i:
            time.sleep(0.3)
        gc.collect()
        with contextlib.suppress(Py4JError):  # busy for longer than that: what is free by now
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        spark.sparkContext._jvm.System.gc()
    trimmed(spark)


def give_back() -> None:
    """Hands memory that this process has no use for back to the system: allocators keep what is free."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(spark: SparkSession) -> None:
    """give_back() for the driver: its Python, and what its JVM holds outside the heap (compilers and
    file formats leave hundreds of megabytes there), which the JVM's own command for it returns."""
    give_back()
    jvm = spark.sparkContext._jvm
    with contextlib.suppress(Py4JError):  # other JVMs have no such command
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        beans.invoke(jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave, once all that was made of them is written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def lean(run):
    """run, a function over a task's batches, which hands the memory that its worker has no use for back to
    the system before and after: workers outlive their tasks, and allocators keep what is free."""

    def own(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text) of the rows that have an id; null texts become empty ones."""
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).where(F.col("_id").isNotNull())


def far(key: Column, salt: int = 0x5BD1E995) -> Column:
    """key under a one-to-one change, so that a join deals out both of its sides anew and
    adaptive execution may split a partition that holds a hot key."""
    return key.bitwiseXOR(F.lit(salt).cast("long"))


def split_words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


class Ranges:
    """64-bit hashes of any byte ranges of a buffer, from prefix sums of a polynomial mod 2**64
    over random 64-bit values of the bytes, then mixed. seed picks the function."""

    _cache: dict = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        self.table, mult = self._function(seed)
        n = len(data)
        self.pow, self.inv = self._powers(seed, mult, n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.pow[:n], out=self.sums[1:])

    @classmethod
    def _function(cls, seed: int):
        if seed not in cls._cache:
            rng = np.random.default_rng(0xC0FFEE + seed)
            cls._cache[seed] = rng.integers(0, 2**64, 256, dtype=np.uint64), int(rng.integers(0, 2**61)) * 8 + 5
        return cls._cache[seed]

    @classmethod
    def _powers(cls, seed: int, mult: int, n: int):
        have = cls._cache.get((seed, "pow"))
        if have is None or len(have[0]) < n + 1:
            size = max(n + 1, PASS_BYTES + 1)
            out = []
            for m in (mult, pow(mult, -1, 2**64)):
                a = np.full(size, m, dtype=np.uint64)
                a[0] = 1
                out.append(np.cumprod(a, dtype=np.uint64))
            have = tuple(out)
            if size <= 4 * PASS_BYTES:
                cls._cache[(seed, "pow")] = have
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inv[start]
        return mix(h + (np.asarray(end) - np.asarray(start)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def passes(texts, limit: int = PASS_BYTES):
    """(lo, hi) slices of a list of byte strings, each of about limit bytes at most or one text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)
