"""Kernels over whole pages, many at a time, in the order in which a window has them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of whole pages that a kernel gets at a time, unless one page has more; pairs that are made at a time.
ROWS, PAIRS = 20_000, 1 << 18


def paged(df: DataFrame, keys: list[str], order: list, kernel: Callable[[pa.Table, np.ndarray], pa.Table | Iterator[pa.Table]], schema: str | StructType, ready: bool = False, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """What kernel gives, as one table or some at a time, for rows of whole groups of equal keys, sorted by
    order, and the number of each row's group from 0. Rows that are already dealt out by one of the keys aren't moved;
    with ready, rows of a group follow each other in order as they come, and none is moved or sorted. With then, what
    it makes of all that in the same task, under its schema."""
    names = df.columns
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))

    def begins(b: pa.RecordBatch, before: pa.RecordBatch | None) -> np.ndarray:
        """Rows that are the first of their group."""
        if not ready:
            return b.column(b.schema.get_field_index("_at")).to_numpy() == 1
        first = np.zeros(b.num_rows, dtype=bool)
        first[0] = before is None
        for k in keys:
            v = b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            first[1:] |= v[1:] != v[:-1]
            if before is not None:
                first[0] |= before.column(before.schema.get_field_index(k))[before.num_rows - 1].as_py() != b.column(b.schema.get_field_index(k))[0].as_py()
        return first

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, np.ndarray]] = []

        def settled() -> Iterator[pa.RecordBatch]:
            out = kernel(pa.Table.from_batches([h for h, _ in held]).select(names), np.cumsum(np.concatenate([f for _, f in held])) - 1)
            for part in [out] if isinstance(out, pa.Table) else out:
                yield from part.combine_chunks().to_batches(max_chunksize=ROWS)

        for b in batches:
            if not b.num_rows:
                continue
            flags = begins(b, held[-1][0] if held else None)
            first = np.flatnonzero(flags)
            if len(first) and sum(h.num_rows for h, _ in held) + first[-1] >= ROWS:
                if first[-1]:
                    held.append((b.slice(0, first[-1]), flags[: first[-1]]))
                yield from settled()
                held = [(b.slice(first[-1]), flags[first[-1] :])]
            else:
                held.append((b, flags))
        if held:
            yield from settled()

    run = made if then is None else lambda batches: then(made(batches))
    return (df if ready else df.withColumn("_at", at)).mapInArrow(run, schema)


def numbers(t: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as doubles, null as NaN."""
    return [t.column(k).cast(pa.float64()).to_numpy().astype(np.float64) for k in names]


def ranged(first: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every i and first[i] <= j < stop[i], about PAIRS at a time."""
    n = np.maximum(stop - first, 0)
    total = np.concatenate([[0], np.cumsum(n)])
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, side="right")) - 1)
        own = n[lo:hi]
        i = np.repeat(np.arange(lo, hi), own)
        yield i, np.repeat(first[lo:hi] - (total[lo:hi] - total[lo]), own) + np.arange(total[hi] - total[lo])
        lo = hi


def swept(page: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows of one page with lo[i] <= lo[j] < hi[i], i before j in the order of page, lo and
    place: a sweep's pairs, some at a time. Rows without lo < hi meet nothing."""
    own = np.flatnonzero(lo < hi)
    own = own[np.lexsort((lo[own], page[own]))]
    p, a, b = page[own], lo[own], hi[own]
    edge = np.searchsorted(p, np.arange((p[-1] if len(p) else -1) + 2))
    # ends of a page's rows, by a rank of lo and hi that rises with the page
    value, rank = np.unique(np.concatenate([a, b]), return_inverse=True)
    key = p.astype(np.int64) * len(value)
    stop = np.minimum(np.searchsorted(key + rank[: len(a)], key + rank[len(a) :], side="left"), edge[p + 1])
    for i, j in ranged(np.arange(len(own)) + 1, stop):
        yield own[i], own[j]
