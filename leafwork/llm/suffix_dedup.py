"""Suffix-array dedup: repeated byte strings by threshold-bounded interval expansion on a BWT."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Kind, with_cuts
from .common import keyed, table

WINDOW, GRAM, FINE = 100, 32, 8


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Order of the rotations of s (numbers 0 to 256) by their first `depth` symbols at least, by prefix
    doubling from seven symbols, which fit in one number; what is alone in its rank stays in place."""
    n = len(s)
    key = np.zeros(n, dtype=np.int64)
    twice = np.concatenate([s, s[:6] if n >= 6 else np.resize(s, 6)])
    for k in range(7):
        key *= 257
        key += twice[k : k + n]
    order = np.argsort(key)
    key = key[order]
    slots, step = np.arange(n), 7
    rank = np.empty(n, dtype=np.int64)
    bits = max(1, int(n - 1).bit_length())
    while True:
        # slots are those of the order still looked at, by rank; key is what they were sorted by.
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.flatnonzero(new)
        rank[order[slots]] = slots[begin][np.cumsum(new) - 1]
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if step >= depth or not len(slots):
            return order
        own = order[slots]
        ahead = own + step
        ahead[ahead >= n] %= n
        key = (rank[own] << bits) | rank[ahead]
        if 3 * bits < 63:
            both = np.sort((key << bits) | own)
            key, order[slots] = both >> bits, both & ((1 << bits) - 1)
        else:
            by = np.argsort(key)
            key, order[slots] = key[by], own[by]
        step *= 2


def short_prefixes(bwt: np.ndarray, least: int) -> np.ndarray:
    """Of each row in order, the length it has in common with the one before if that is under `least`,
    else -1. Intervals of strings are extended backward by one symbol at a time, in order of length;
    where an extension's end isn't marked yet, its length is the common prefix there. The rows need to
    be in order by their first `least` symbols only: no longer string has its interval looked up."""
    n = len(bwt)
    by = np.argsort(bwt, kind="stable").astype(np.int32)
    lf = np.empty(n, dtype=np.int32)
    lf[by] = np.arange(n, dtype=np.int32)
    first = bwt[by]
    lcp = np.full(n + 1, -1, dtype=np.int16)
    lcp[0] = lcp[n] = 0
    of = np.zeros(n, dtype=np.int32)  # the interval that a row is in
    lo, hi = np.array([0], dtype=np.int32), np.array([n], dtype=np.int32)  # the empty string's
    for length in range(least):
        size = hi - lo
        single = lf[lo[size == 1]]
        lo, size = lo[size > 1], size[size > 1]
        at = (np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())).astype(np.int32)
        of[at] = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        # Within an interval the rows of one symbol go to neighbouring rows, and no two of its
        # symbols do: sorted by target, a new interval begins where source, symbol or run changes.
        to = np.sort(lf[at])
        source, symbol = of[by[to]], first[to]
        new = np.concatenate([[True], (to[1:] != to[:-1] + 1) | (source[1:] != source[:-1]) | (symbol[1:] != symbol[:-1])]) if len(to) else np.zeros(0, dtype=bool)
        begin = np.flatnonzero(new)
        left, right = np.concatenate([to[begin], single]), np.concatenate([to[np.append(begin[1:], len(to)) - 1] + 1 if len(to) else to, single + 1])
        fresh = lcp[right] < 0
        lcp[right[fresh]] = length
        if length == 0:
            fresh |= right == n
        lo, hi = left[fresh], right[fresh]
        if not len(lo):
            break
    return lcp[:n]


def repeats(rows: pd.DataFrame, kind: Kind) -> pd.DataFrame:
    """One shard: rows that share the first `window` bytes stand together in the suffix array, with
    no shorter common prefix between; all but the earliest place of each such class are covered."""
    size = kind.window
    texts = [bytes(t) for t in rows["text"]]
    lens = np.array([len(t) for t in texts])
    ends = np.cumsum(lens + 1) - 1
    s = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int64) + 1
    s[ends] = 0  # between texts; strings that reach it are left out below
    sa = suffix_array(s, size)
    group = np.cumsum(short_prefixes(s[sa - 1].astype(np.int16), size) >= 0)
    owner = np.repeat(np.arange(len(texts)), lens + 1)[sa]
    whole = ends[owner] - sa >= size
    sa, group, owner = sa[whole], group[whole], owner[whole]
    many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, dtype=bool)
    sa, group, owner = sa[many], group[many], owner[many]
    none = pd.DataFrame({"_id": [], "s": [], "e": []}).astype({"_id": "int64", "s": "int32", "e": "int32"})
    if not len(sa):
        return none
    ids, rank = np.unique(rows["_id"].to_numpy(np.int64), return_inverse=True)
    place = (rank[owner].astype(np.int64) << 32) + rows["pos"].to_numpy(np.int64)[owner] + sa - (ends - lens)[owner]
    lead = np.concatenate([[True], group[1:] != group[:-1]])
    low = np.minimum.reduceat(place, np.flatnonzero(lead))[np.cumsum(lead) - 1]
    place = np.sort(place[place > low])
    if not len(place):
        return none
    new = np.concatenate([[True], place[1:] > place[:-1] + 1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(place)) - 1
    return pd.DataFrame({"_id": ids[place[a] >> 32], "s": place[a] & 0xFFFFFFFF, "e": (place[b] & 0xFFFFFFFF) + size})


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_bytes, n_removed, spans (runs of removed bytes), kept (binary).

    A text is its UTF-8 bytes. A byte goes if a string of `window` bytes covers it that also starts
    earlier: in a document with a smaller id, or before in the same one; overlapping counts; strings
    are judged on the input and never cross documents. Ids are whole numbers; rows without one take no
    part; equal rows count once, and of different texts under one id the least is taken. A null text is
    empty; an empty table gives none; other columns are ignored. Equal content of segments is told by
    64-bit hashes within 64-bit anchors.
    """

    def finish(raw: bytes, runs: list) -> tuple:
        kept, at = [], 0
        for s, e in runs:
            kept.append(raw[at:s])
            at = e
        kept.append(raw[at:])
        out = b"".join(kept)
        return len(raw), len(raw) - len(out), [list(r) for r in runs], out

    base = keyed(docs, id_col, text_col).withColumn("_id", F.col("_id").cast("long"))
    kind = Kind("bytes", window, gram, FINE, False, False)
    return with_cuts(base, kind, repeats, finish, "n_bytes long, n_removed long, spans array<array<int>>, kept binary").withColumnRenamed("_id", id_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, min(hex(encode(coalesce(text, '')))) AS x FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS MATERIALIZED (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 200)) AS k, doc_id * 4294967296::HUGEINT + p AS z FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 99)) AS p FROM d WHERE length(x) >= 200)),
m AS (SELECT h.doc_id, h.p FROM h JOIN (SELECT k, min(z) AS low FROM h GROUP BY k HAVING count(*) > 1) USING (k) WHERE z > low),
e AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM m),
r AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS t FROM (SELECT *, sum((q IS NULL OR p > q + 100)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM e) GROUP BY doc_id, run),
c AS (SELECT doc_id, list(s ORDER BY s) AS ss, list(t ORDER BY s) AS ts FROM r GROUP BY doc_id),
o AS (SELECT d.doc_id, x, coalesce(ss, []) AS ss, coalesce(ts, []) AS ts FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(list_sum(list_transform(ss, lambda s, i: ts[i] - s)), 0)::BIGINT AS n_removed, len(ss)::BIGINT AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(len(ss) + 1), lambda i: substr(x, 2 * CASE WHEN i = 0 THEN 0 ELSE ts[i] END + 1, 2 * (CASE WHEN i = len(ss) THEN length(x) // 2 ELSE ss[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE ts[i] END))), ''))) AS kept_sha256 FROM o
"""
