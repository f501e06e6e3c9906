"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by size, each class (sizes from a power of two up to the next) with an index and
a threshold of its own. An item's sketch are its k smallest shingle hashes. If the share of its q
shingles that a document holds reaches the threshold t, at most floor((1 - t) q) of them are missing, so
that the document hits at least k minus that many of the sketch; k is chosen by class, so that this
least number, `hits`, grows with the size and chance hits alone don't reach it. What reaches it is
verified by exact containment of all the item's shingles. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ranges, keyed, mix, passes, table

SHINGLE, THRESHOLD = 5, 0.8
#: Shingles of items that are broadcast at once at most (16 bytes each); more go in further blocks.
BROADCAST_SHINGLES = 2_000_000
WORD = re.compile(r"\w+")


def words_of(text: str) -> bytes:
    """Lower-cased words of letters, digits and underscores, joined by one space."""
    return " ".join(WORD.findall(text.lower())).encode("utf-8", "replace")


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, and the text of each."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    brk = (data == 32) | (data == 10)
    end = np.flatnonzero(brk)
    start = np.concatenate([[0], end[:-1] + 1])
    owner = np.concatenate([[0], np.cumsum(data[end] == 10)[:-1]])
    n = len(end) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = owner[:n] == owner[width - 1 :]
    if width == 1:
        ok &= end > start
    a, b = start[:n][ok], end[width - 1 :][ok]
    h = Ranges(data, 9)
    return h.of(a, b), owner[:n][ok]


def size_class(q: np.ndarray) -> np.ndarray:
    """Class of each size: c holds 2**c to 2**(c + 1) - 1 shingles."""
    return np.log2(np.maximum(q, 1)).astype(int)


def least_hits(c: int) -> int:
    """Hits in its sketch that an item of size class c must have to be verified."""
    return 1 + (1 << c) // 16


def sketch_size(q: int, threshold: float, hits: int) -> int:
    return q - -(-round(threshold * 1000) * q // 1000) + hits


class Index:
    """Of each shingle width and size class: sketch values to items. Of each width: all shingles of the
    items, to verify with."""

    def __init__(self, items: list[tuple[int, bytes]], width: int, threshold: float):
        self.threshold = threshold
        self.ids = np.array([i for i, _ in items], dtype=object)
        #: by shingle width (that of shorter items is their own number of words)
        self.groups: dict[int, tuple] = {}
        by_width: dict[int, list[int]] = {}
        for k, (_, w) in enumerate(items):
            n = w.count(b" ") + 1 if w else 0
            if n:
                by_width.setdefault(min(n, width), []).append(k)
        for w, own in by_width.items():
            h, who = shingles([items[k][1] for k in own], w)
            pairs = np.unique(np.stack([who.astype(np.uint64), h]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
            who, h = pairs[0].astype(np.int64), pairs[1]
            size = np.bincount(who, minlength=len(own))
            order = np.lexsort((mix(h), who))
            rank = np.arange(len(h)) - (np.cumsum(size) - size)[who[order]]
            classes = []
            for c in np.unique(size_class(size[size > 0])):
                k_of = np.where((size_class(size) == c) & (size > 0), [sketch_size(int(q), threshold, least_hits(c)) for q in size], 0)
                probe = order[rank < k_of[who[order]]]
                probe = probe[np.argsort(h[probe], kind="stable")]
                classes.append((least_hits(c), np.unique(h[probe]), h[probe], who[probe]))
            vocab = np.unique(h)
            self.groups[w] = (np.array(own), classes, vocab, np.searchsorted(vocab, h), who, size)

    def hits(self, texts: list[bytes]):
        """(text, item, shingles found, shingles of the item) of each match."""
        for w, (own, classes, vocab, v_at, v_who, size) in self.groups.items():
            h, doc = shingles(texts, w)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
            on = vocab[at] == h
            h, doc, at = h[on], doc[on], at[on]
            found: dict[int, list[np.ndarray]] = {}
            for least, values, p_h, p_who in classes:
                probed = values[np.minimum(np.searchsorted(values, h), len(values) - 1)] == h
                for d in np.unique(doc[probed]):
                    seen = np.unique(h[probed & (doc == d)])
                    if len(seen) < least:
                        continue
                    lo, hi = np.searchsorted(p_h, seen), np.searchsorted(p_h, seen, side="right")
                    item, n = np.unique(np.concatenate([p_who[a:b] for a, b in zip(lo, hi)]), return_counts=True)
                    found.setdefault(int(d), []).append(item[n >= least])
            for d, cand in found.items():
                has = np.zeros(len(vocab), dtype=bool)
                has[at[doc == d]] = True
                for c in np.concatenate(cand):
                    a, b = np.searchsorted(v_who, [c, c + 1])
                    n = int(has[v_at[a:b]].sum())
                    if n * 1000 >= round(self.threshold * 1000) * size[c]:
                        yield d, self.ids[own[c]], n, int(size[c])


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = SHINGLE, threshold: float = THRESHOLD, most: int = BROADCAST_SHINGLES) -> DataFrame:
    """id_col, item_id, n_found, n_item, containment: each document and item of which at least
    `threshold` of the distinct shingles are in the document.

    Words are runs of letters, digits and underscores, lower-cased; a shingle is `width` of them, and
    an item of fewer words is one shingle of its own length. Items without words, and rows without
    an id on either side, take no part; a null text has no words. Items of one id and different texts
    are items of their own; equal items give one row, equal documents a row each. Empty tables give
    an empty result; other columns are ignored. Items are broadcast in blocks of at most `most`
    shingles, and each block meets all documents.
    """
    spark = docs.sparkSession
    base = keyed(docs, id_col, text_col)
    tests = keyed(items, item_id, item_text).dropDuplicates(["_id", "_text"])
    total = tests.agg(F.sum(F.length("_text") / 2 + 1)).first()[0] or 0  # words are under half the characters
    n_blocks = max(1, int(-(-total * 5 // (4 * most))))
    kind, item_kind = base.schema["_id"].dataType.simpleString(), tests.schema["_id"].dataType.simpleString()
    out = None
    for b in range(n_blocks):
        mine = tests.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(n_blocks)) == b).collect()  # bounded by `most`
        index = spark.sparkContext.broadcast(Index(sorted((r["_id"], words_of(r["_text"])) for r in mine), width, threshold))

        def look(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for rows in batches:
                found, texts = [], [words_of(t) for t in rows["_text"]]
                keys = rows["_id"].tolist()
                for lo, hi in passes(texts):
                    found += [(keys[lo + d], i, n, q, n / q) for d, i, n, q in index.value.hits(texts[lo:hi])]
                yield pd.DataFrame(found, columns=[id_col, item_id, "n_found", "n_item", "containment"])

        part = base.mapInPandas(look, f"`{id_col}` {kind}, `{item_id}` {item_kind}, n_found long, n_item long, containment double")
        out = part if out is None else out.unionAll(part)
    return out


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
n AS (SELECT DISTINCT least(len(w), 5) AS k FROM i WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS s FROM i JOIN n ON k = least(len(w), 5)),
sd AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS s FROM d, n WHERE len(w) >= k),
q AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_found, n_item, count(*) / n_item::DOUBLE AS containment
FROM sd JOIN si USING (k, s) JOIN q USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) * 5 >= n_item * 4
"""
