"""Near-duplicates by word shingles, with no link lost.

One hash function orders shingles: those on many documents' short lists last, longer before shorter,
then by mixed bits. A document's sketch is its smallest values: as many as a document that is similar
enough can lack, and SPARE more. What two linked documents share of the union of their sketches then
has a least number, which follows from their sizes whatever the data (`least_shared`); it stands in
for an estimate, which could lose links. Inverted lists of sketch values count what each pair shares;
pairs that share enough make families, and so do lists too long to be paired, of documents that can't do
without them; within a family, exact Jaccard on full sets decides. Documents of equal sets are one from the start. Shingles are told apart by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ranges, dropped, far, freed, keyed, mix, passes, table, written
from .components import components

#: A list of more documents isn't paired; it joins those to one family that have many such lists.
PAIRED = 64
#: The most frequent sketch values, up to so many, go to the end of the order; which these are changes
#: the work and not the result. A value on fewer lists stays.
LATE, LATE_COUNT = 100_000, 16
#: Shingles that one task compares with each other at most, unless one document has more.
BLOCK_SHINGLES = 400_000
SPARE = 0.04


def normal(text: str) -> bytes:
    """Words with A-Z lower-cased, joined by one space."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def sets_of(texts: list[bytes], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingle hashes, their lengths in bytes) of each normal text; with fewer words than
    `width` the whole text is one shingle; without words there is none."""
    out: list = []
    for lo, hi in passes(texts):
        data = np.frombuffer(b"\n".join(texts[lo:hi]) + b"\n", dtype=np.uint8)
        end = np.flatnonzero((data == 32) | (data == 10))
        start = np.concatenate([[0], end[:-1] + 1])
        owner = np.concatenate([[0], np.cumsum(data[end] == 10)[:-1]])
        words = np.bincount(owner, minlength=hi - lo)
        h = Ranges(data, 3)
        n = len(end) - width + 1
        ok = np.flatnonzero(owner[: max(n, 0)] == owner[width - 1 :]) if n > 0 else np.zeros(0, np.int64)
        a, b = start[ok], end[ok + width - 1]
        full, size, who = h.of(a, b), b - a, owner[ok]
        edge = np.searchsorted(who, np.arange(hi - lo + 1))
        first = np.cumsum(words) - words
        for d in range(hi - lo):
            if words[d] < width:
                s, e = start[first[d]], end[first[d] + words[d] - 1]
                k = h.of(np.array([s]), np.array([e])) if e > s else np.zeros(0, np.uint64)
                out.append((k, np.array([e - s] * len(k))))
            else:
                k, i = np.unique(full[edge[d] : edge[d + 1]], return_index=True)
                out.append((k, size[edge[d] : edge[d + 1]][i]))
    return out


def slices(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[list, list]]:
    """(ids, sets) of a few texts at a time, so that a worker holds the sets of one pass."""
    for b in batches:
        ids, texts = b["_id"].tolist(), b["_text"].tolist()
        del b
        for lo, hi in passes(texts):
            yield ids[lo:hi], sets_of([normal(t) for t in texts[lo:hi]], width)


def order_of(k: np.ndarray, size: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Places of the shingles in the order that all documents share."""
    v = (mix(k) >> np.uint64(7)) | ((np.uint64(63) - np.minimum(size, 63).astype(np.uint64)) << np.uint64(57))
    if len(late):
        at = np.minimum(np.searchsorted(late, v), len(late) - 1)
        v = np.where(late[at] == v, v | np.uint64(1 << 63), v)
    return v


def sketch_length(n: int, percent: int, spare: float = SPARE) -> int:
    return min(n, n - -(-percent * n // 100) + 1 + int(spare * n))


def least_shared(na: Column, nb: Column, percent: int) -> Column:
    """Values that the sketches of two linked sets of these sizes share at least: up to the smaller of
    the sketches' last values both are complete, so that of one sketch all are shared but what its
    document may lack, and linked sets have percent / (100 + percent) of na + nb in common."""
    common = F.ceil(F.lit(percent) * (na + nb) / F.lit(100.0 + percent) - F.lit(1e-9))
    kept = lambda n: F.least(n, n - F.ceil(F.lit(percent) * n / F.lit(100.0) - F.lit(1e-9)) + 1 + F.floor(F.lit(SPARE) * n))
    return F.greatest(F.lit(1), F.least(kept(na) - na, kept(nb) - nb) + common)


def sketches(base: DataFrame, width: int, percent: int, late: np.ndarray) -> DataFrame:
    """(v, _id): the sketch values of each document."""
    shared = base.sparkSession.sparkContext.broadcast(late)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, sets in slices(batches, width):
            vs, ids = [], []
            for key, (k, size) in zip(keys, sets):
                if len(k):
                    m = sketch_length(len(k), percent)
                    v = order_of(k, size, shared.value)
                    v = np.partition(v, m - 1)[:m] if m < len(v) else v
                    vs.append(v)
                    ids.append(np.full(len(v), key))
            if vs:
                yield pd.DataFrame({"v": np.concatenate(vs).view(np.int64), "_id": np.concatenate(ids)})

    return base.mapInPandas(run, "v long, _id long")


def members(base: DataFrame, width: int) -> DataFrame:
    """(_id, n, rep): set size, and the smallest id of a document with an equal set; a table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, sets in slices(batches, width):
            rows = []
            for key, (k, _) in zip(keys, sets):
                with np.errstate(over="ignore"):
                    one, two = mix(k).sum(dtype=np.uint64), mix(k ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
                rows.append((key, len(k), np.uint64(one).astype(np.int64), np.uint64(two).astype(np.int64)))
            yield pd.DataFrame(rows, columns=["_id", "n", "h1", "h2"])

    each = written(base.mapInPandas(run, "_id long, n long, h1 long, h2 long"), base.sparkSession)
    reps = each.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("_id").alias("rep")).select(far(F.col("h1")).alias("j1"), far(F.col("h2")).alias("j2"), far(F.col("n")).alias("j3"), "rep")
    both = each.withColumns({"j1": far(F.col("h1")), "j2": far(F.col("h2")), "j3": far(F.col("n"))}).join(reps, ["j1", "j2", "j3"], "left")
    who = written(both.select("_id", "n", F.coalesce("rep", "_id").alias("rep")), base.sparkSession)
    dropped(each)
    return who


def linked_groups(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest id that each document reaches over links within this block."""
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    vocab, first = np.unique(flat[order], return_index=True)
    at = np.searchsorted(vocab, flat)  # place of each set's shingles
    edge = np.concatenate([[0], np.cumsum(n)])
    post, label = who[order], np.full(len(sets), -1)
    stop = np.append(first[1:], len(flat))
    left = len(sets)
    there = np.ones(len(sets), dtype=np.int64)  # how often a document is on its own shingles' lists
    for seed in np.argsort(ids, kind="stable"):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        left -= 1
        todo = [seed]
        while todo and left:
            i = todo.pop()
            mine = at[edge[i] : edge[i + 1]]
            a, c = first[mine], stop[mine] - first[mine]
            some = c > there[i]
            a, c = a[some], c[some]
            if not len(a):
                continue
            rows = post[np.repeat(a - (np.cumsum(c) - c), c) + np.arange(c.sum())]
            both = np.bincount(rows, minlength=len(sets))
            near = np.flatnonzero((label < 0) & (100 * both >= percent * (n + n[i] - both)) & (both > 0))
            label[near] = seed
            left -= len(near)
            todo += near.tolist()
            if left and len(post) > 4096 and left < len(sets) // 4 and (label[post] >= 0).mean() > 0.7:
                keep = label[post] < 0  # assigned documents need not be found again
                there = (label < 0).astype(np.int64)
                total = np.concatenate([[0], np.cumsum(keep)])
                first, stop = total[first], total[stop]
                post = post[keep]
    return ids[label]


def candidates(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges over which all linked documents hang together, of lists (v, rep, n, c), c being how many
    documents the list of v has.

    Lists of over PAIRED documents aren't paired. Of what two documents share, at most as many values stand
    on such lists as the one has that has fewer there, and the others must be found on short lists. Two linked
    documents share at least floor(SPARE * n) + 1 values, n being either's size; so a document with no more than
    SPARE * n values on long lists meets all that it is linked with on short ones. Only those with more are
    tied to the first such document of each of their long lists.
    """
    long_ = lists.where(F.col("c") > PAIRED)
    each = long_.groupBy("rep").agg(F.count("*").alias("l"), F.max("n").alias("_n"))
    many = each.where(F.col("l") > F.floor(F.lit(SPARE) * F.col("_n"))).select("rep")
    tied = long_.join(many, "rep", "left_semi").select("v", "rep")
    lead = tied.groupBy("v").agg(F.min("rep").alias("lead")).select(far(F.col("v")).alias("j"), "lead")
    stars = tied.select(far(F.col("v")).alias("j"), "rep").join(lead, "j").where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    short = lists.where(F.col("c") <= PAIRED).join(each.select("rep", "l"), "rep", "left").withColumn("l", F.coalesce("l", F.lit(0)))  # at most PAIRED rows of a value
    a, b = (short.select("v", F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("l").alias(f"l{k}")) for k in "ab")
    need = least_shared(F.col("na"), F.col("nb"), percent) - F.least("la", "lb")
    fits = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    pairs = a.join(b, "v").where((F.col("a") < F.col("b")) & fits).groupBy("a", "b", "na", "nb", "la", "lb").agg(F.count("*").alias("both")).where(F.col("both") >= need)
    return pairs.select("a", "b").unionAll(stars)


def components_of(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, n, root): set size and the smallest id reachable, of each document with an id."""
    spark = docs.sparkSession
    base = keyed(docs, id_col, text_col).withColumn("_id", F.col("_id").cast("long"))
    who = members(base, width)
    none = np.zeros(0, np.uint64)
    counted = sketches(base, width, percent, none).groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") > LATE_COUNT)
    frequent = counted.orderBy(F.desc("c"), "v").limit(LATE).select("v").toPandas()["v"].to_numpy(np.int64)  # at most LATE values
    late = np.sort(frequent.view(np.uint64))
    freed(spark, 2)

    rows = sketches(base, width, percent, late)
    # a table, so that the shuffle that counts all values is gone before the next one moves them
    several = written(rows.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select(far(F.col("v")).alias("j")), spark)
    freed(spark, 2)
    listed = rows.withColumn("j", far(F.col("v"))).join(several, "j").select("v", "_id")
    once = written(listed.join(who.select("_id", "rep", "n"), "_id").groupBy("v", "rep").agg(F.max("n").alias("n")), spark)
    dropped(several)
    freed(spark, 2)
    sizes = once.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    lists = once.withColumn("j", far(F.col("v"))).join(sizes.select(far(F.col("v")).alias("j"), "c"), "j").select("v", "rep", "n", "c")
    lists = written(lists, spark)
    dropped(once)
    family = components(candidates(lists, percent))
    dropped(lists)

    sizes = family.join(who.where("_id = rep").dropDuplicates(["_id"]).select(F.col("_id").alias("node"), "n"), "node")
    blocks = sizes.groupBy("root").agg(F.sum("n").alias("total")).select("root", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("nb"))
    dealt = sizes.join(blocks, "root").select(F.col("node").alias("_id"), "root", "nb", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("bk"))

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=1)
        for rows in batches:
            yield pd.DataFrame({"_id": rows["_id"], "z": [z.compress(normal(t)) for t in rows["_text"]]})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for rows in batches:
            texts = [z.decompress(bytes(x)) for x in rows.pop("z")]
            for lo, hi in passes(texts):
                part = rows.iloc[lo:hi]
                ks = [k.tobytes() for k, _ in sets_of(texts[lo:hi], width)]
                yield pd.DataFrame({"root": part["root"], "x": part["bk"], "nb": part["nb"], "_id": part["_id"], "k": ks})

    full = base.mapInPandas(squeeze, "_id long, z binary").join(dealt, "_id").mapInPandas(spread, "root long, x int, nb int, _id long, k binary")
    cells = full.select("root", "x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("y"), "_id", "k")
    cells = cells.select("root", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "_id", "k")

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("_id")
        ids = rows["_id"].to_numpy(np.int64)
        low = linked_groups(ids, [np.frombuffer(bytes(k), dtype=np.uint64) for k in rows["k"]], percent)
        own = low != ids
        return pd.DataFrame({"a": ids[own], "b": low[own]})

    links = written(cells.groupBy("root", "x", "y").applyInPandas(decide, "a long, b long"), spark)
    roots = components(links)
    return who.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("_id", "n", F.coalesce("root", "rep").alias("root"))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A set is the distinct runs of `width` words;
    fewer words are one shingle; without words, or for a null text, the set is empty and linked with
    nothing. Two documents are linked where 100 * intersection >= percent * union. component_id is the
    smallest id reachable; kept says whether it is the document's own. Ids are whole numbers; rows
    without one take no part. Equal rows give equal rows, and rows of one id with different texts
    share a component. Other columns are ignored; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType
    out = components_of(docs, width, percent, id_col, text_col)
    return out.select(F.col("_id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("root").cast(kind).alias("component_id"), (F.col("_id") == F.col("root")).alias("kept"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=2)


#: The rarest shingles of each set that others have too are enough to find all links by; these are counted on full sets.
SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]) WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS c FROM s GROUP BY g HAVING count(*) > 1),
k AS MATERIALIZED (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS r FROM s JOIN f USING (g) JOIN n USING (doc_id)),
a AS MATERIALIZED (SELECT doc_id, count(*) AS shared FROM k GROUP BY doc_id),
pre AS MATERIALIZED (SELECT k.doc_id, g, n FROM k JOIN a USING (doc_id) WHERE r <= n // 5 + 1),
cand AS MATERIALIZED (SELECT DISTINCT x.doc_id AS i, y.doc_id AS j FROM pre x JOIN pre y ON x.g = y.g AND x.doc_id < y.doc_id AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
l AS MATERIALIZED (SELECT i, j FROM cand JOIN s x ON x.doc_id = i JOIN s y ON y.doc_id = j AND y.g = x.g JOIN n p ON p.doc_id = i JOIN n q ON q.doc_id = j GROUP BY i, j, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
e AS MATERIALIZED (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, e.j FROM reach JOIN e ON reach.b = e.i),
root AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept FROM (SELECT DISTINCT doc_id FROM w) w LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)
"""
