"""Substring dedup: Aho-Corasick automata over words find every place of a recurring passage."""

from __future__ import annotations


import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Kind, with_cuts
from .common import keyed, table

WINDOW, GRAM, FINE = 50, 20, 2
#: First code point that stands for a word; surrogates lie below.
BASE = 0xE000


def locate(rows: pd.DataFrame, kind: Kind) -> pd.DataFrame:
    """One shard: the passages of `window` words that more than one document of it holds become an
    automaton, whose letters are words; every text of the shard streams through it; each place found
    in a document that isn't the passage's first is covered."""
    size = kind.window
    texts = [bytes(t).split() for t in rows["text"]]
    code: dict[bytes, str] = {}
    lines = ["".join([code.setdefault(w, chr(BASE + len(code))) for w in t]) for t in texts]
    ids, pos = rows["_id"].to_numpy(np.int64), rows["pos"].to_numpy(np.int64)
    seen: dict[str, int] = {}
    confirmed: set[str] = set()
    for line, i in zip(lines, ids):
        for o in range(len(line) - size + 1):
            w = line[o : o + size]
            if seen.setdefault(w, i) != i:
                confirmed.add(w)
    if not confirmed:
        return pd.DataFrame({"_id": [], "s": [], "e": []}).astype({"_id": "int64", "s": "int32", "e": "int32"})
    auto = ahocorasick.Automaton()
    for k, w in enumerate(sorted(confirmed)):
        auto.add_word(w, k)
    auto.make_automaton()
    first = np.full(len(confirmed), np.iinfo(np.int64).max)
    places: list[tuple[int, int, int]] = []
    for r, line in enumerate(lines):
        for end, k in auto.iter(line):
            places.append((r, end - size + 1, k))
            first[k] = min(first[k], ids[r])
    at = np.array(places, dtype=np.int64)
    at = at[ids[at[:, 0]] > first[at[:, 2]]]
    order = np.lexsort((at[:, 1], at[:, 0]))
    r, o = at[order, 0], at[order, 1]
    if not len(r):
        return pd.DataFrame({"_id": [], "s": [], "e": []}).astype({"_id": "int64", "s": "int32", "e": "int32"})
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1)])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(r)) - 1
    return pd.DataFrame({"_id": ids[r[a]], "s": pos[r[a]] + o[a], "e": pos[r[b]] + o[b] + size})


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_words, n_removed, spans (runs of removed words), kept_text.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, unchanged. A word goes if a window of `window`
    consecutive words covers it whose words also stand, in order, in a document with a smaller id;
    windows are judged on the input. kept_text is the other words joined by one space. Ids are whole
    numbers; rows without one take no part; equal rows count once, and of different texts under one id
    the least is taken. A null text has no words; an empty table gives none; other columns are ignored.
    Segments, anchors and windows are told apart by 64-bit hashes within their group (128 bits in all).
    """

    def finish(raw: bytes, runs: list) -> tuple:
        words = raw.split()
        kept, at = [], 0
        for s, e in runs:
            kept += words[at:s]
            at = e
        kept += words[at:]
        return len(words), len(words) - len(kept), [list(r) for r in runs], b" ".join(kept).decode("utf-8", "replace")

    base = keyed(docs, id_col, text_col).withColumn("_id", F.col("_id").cast("long"))
    kind = Kind("words", window, gram, FINE, True, True)
    out = with_cuts(base, kind, locate, finish, "n_words long, n_removed long, spans array<array<int>>, kept_text string")
    return out.withColumnRenamed("_id", id_col)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k FROM s),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS low FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM m WHERE low < doc_id),
r AS (SELECT e.doc_id, count(*) AS n_words, count(c.p) AS n_removed, coalesce(string_agg(e.word, ' ' ORDER BY e.p) FILTER (WHERE c.p IS NULL), '') AS kept
      FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
