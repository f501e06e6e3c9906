"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Rows go to shards of bounded size by the hash of their id, and each shard's tree is written once to
the shared folder. Queries are taken in blocks of bounded size; a block is broadcast. First each
query looks in its own shard; the score of its k-th best there is a floor for the search of all
shards, and rises along the way.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Rows of a shard on average, rows of a leaf at most, queries of a block at most.
SHARD, LEAF, BLOCK = 8192, 256, 16384


def build(x: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Nodes as arrays: rows lo..hi of order, centre, radius, and the two children (-1: a leaf)."""
    order = np.arange(len(x))
    lo, hi, left, right, centre, radius = [], [], [], [], [], []
    todo = [(0, len(x), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        me, rows = len(lo), order[a:b]
        own = x[rows].astype(np.float64)
        c = own.mean(axis=0)
        far = np.linalg.norm(own - c, axis=1)
        lo.append(a)
        hi.append(b)
        left.append(-1)
        right.append(-1)
        centre.append(c)
        radius.append(far.max())
        if parent >= 0:
            (right if side else left)[parent] = me
        if b - a > leaf and far.max() > 0:
            one = own[far.argmax()]
            two = own[np.linalg.norm(own - one, axis=1).argmax()]
            order[a:b] = rows[np.argsort(own @ (two - one), kind="stable")]
            mid = (a + b) // 2
            todo += [(mid, b, me, 1), (a, mid, me, 0)]
    return {"order": order, "lo": np.array(lo), "hi": np.array(hi), "left": np.array(left), "right": np.array(right), "centre": np.array(centre), "radius": np.array(radius)}


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where every sum is below 2**53."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


#: The score of a place that no row has taken.
NONE = np.iinfo(np.int64).min


def search(tree: dict, ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries, k) best ids and scores of this shard; NONE is the score where there are fewer. Candidates under
    a query's floor may be missing; floor rises in place to the k-th best score seen."""
    n = len(q)
    best_s = np.full((n, k), NONE)
    best_i = np.full((n, k), np.iinfo(np.int64).max)
    size = np.linalg.norm(q.astype(np.float64), axis=1)
    slack = 1e-9 * (1 + size * (np.linalg.norm(tree["centre"], axis=1).max() + tree["radius"].max()))
    # Bounds of the leaves, level by level; a node whose bound is under the floor takes its leaves along.
    found: list[tuple[np.ndarray, int, np.ndarray]] = []
    level = [(0, np.arange(n))]
    while level:
        nxt = []
        for node, who in level:
            bound = q[who].astype(np.float64) @ tree["centre"][node] + tree["radius"][node] * size[who] + slack[who]
            on = bound >= floor[who]
            who, bound = who[on], bound[on]
            if not len(who):
                continue
            if tree["left"][node] < 0:
                found.append((who, node, bound))
            else:
                nxt += [(tree["left"][node], who), (tree["right"][node], who)]
        level = nxt
    if not found:
        return best_i, best_s
    who = np.concatenate([w for w, _, _ in found])
    node = np.concatenate([np.full(len(w), m) for w, m, _ in found])
    bound = np.concatenate([b for _, _, b in found])
    order = np.lexsort((-bound, who))
    who, node, bound = who[order], node[order], bound[order]
    first = np.searchsorted(who, np.arange(n))
    turn = np.arange(len(who)) - first[who]
    # Each query visits its leaves from the highest bound down; queries at one leaf go together.
    width = 1
    at = 0
    while True:
        now = np.flatnonzero((turn >= at) & (turn < at + width) & (bound >= floor[who]))
        if not len(now):
            if at + width > turn.max(initial=0):
                break
            at, width = at + width, width * 2
            continue
        now = now[np.argsort(node[now], kind="stable")]
        cuts = np.flatnonzero(np.diff(node[now])) + 1
        for part in np.split(now, cuts):
            rows = tree["order"][tree["lo"][node[part[0]]] : tree["hi"][node[part[0]]]]
            own = who[part]
            s = product(q[own], x[rows])
            i = np.broadcast_to(ids[rows], s.shape)
            s = np.where(i == q_ids[own, None], NONE, s)
            s, i = np.concatenate([best_s[own], s], axis=1), np.concatenate([best_i[own], np.where(s == NONE, np.iinfo(np.int64).max, i)], axis=1)
            keep = np.lexsort((i, -s.astype(np.float64) if np.abs(s[s > NONE]).max(initial=0) < 2**53 else ~s), axis=1)[:, :k]
            best_s[own], best_i[own] = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
            floor[own] = np.maximum(floor[own], best_s[own, k - 1])
        at, width = at + width, width * 2
    return best_i, best_s


def whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows with an id and a vector of finite components."""
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(ok)


def _packed(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def shards(points: DataFrame, n: int) -> DataFrame:
    """(dim, shard, blob): ids, vectors and tree of each shard; points is (_id, _v of whole numbers)."""

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        ids, x = rows["_id"].to_numpy(np.int64), np.array(rows["_v"].tolist(), dtype=np.int64).reshape(len(rows), -1)
        # equal rows count once; rows of one id that differ count each
        both = np.unique(np.concatenate([ids[:, None], x], axis=1), axis=0)
        ids, x = both[:, 0], both[:, 1:]
        small = np.int16 if np.abs(x).max(initial=0) < 2**15 else np.int64
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "blob": [_packed(ids=ids, x=x.astype(small), **build(x))]})

    cut = points.select("_id", "_v", F.size("_v").alias("dim"), F.pmod(F.xxhash64("_id"), F.lit(n)).alias("shard"))
    return cut.groupBy("dim", "shard").applyInPandas(pack, "dim int, shard long, blob binary")


def top_k(points: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, shard_rows: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row that is a query, the k other rows of
    greatest inner product, ties to the smaller id; fewer where there are fewer rows.

    Components become floor(scale * x). Rows with a null id, a null vector, or a null or non-finite
    component take no part. Vectors of different lengths never meet. Equal rows count once; if rows
    of one id differ, all are candidates and the least vector asks. An empty table or no queries
    give an empty result. Other columns are ignored.
    """
    spark = points.sparkSession
    good = usable(points, id_col, vec_col).select(F.col(id_col).cast("long").alias("_id"), whole(F.col(vec_col), scale).alias("_v"), is_query.alias("_q"))
    n_rows, n_q = good.agg(F.count("*"), F.count(F.when(F.col("_q"), 1))).first()
    n = max(1, -(-n_rows // shard_rows))
    trees = written(shards(good.select("_id", "_v"), n), spark)
    asked = good.where("_q").groupBy("_id").agg(F.min("_v").alias("_v")).withColumn("shard", F.pmod(F.xxhash64("_id"), F.lit(n)))
    n_blocks = max(1, -(-n_q * 5 // (4 * block)))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(n_blocks))), spark) if n_blocks > 1 else asked.withColumn("block", F.lit(0).cast("long"))
    schema = "query_id long, vec_id long, score long"
    out = None
    for b in range(n_blocks):
        got = asked.where(F.col("block") == b).select("_id", "_v", "shard").toPandas()  # about `block` rows
        sets = {}
        for dim, rows in got.groupby(got["_v"].map(len)):
            sets[int(dim)] = (rows["_id"].to_numpy(np.int64), np.array(rows["_v"].tolist(), dtype=np.int64).reshape(len(rows), -1), rows["shard"].to_numpy(np.int64))
        shared = spark.sparkContext.broadcast(sets)

        def look(batches: Iterator[pd.DataFrame], home: bool, floors: dict | None, shared=shared) -> Iterator[pd.DataFrame]:
            floor = {d: np.array([(floors or {}).get(int(i), -(2**62)) for i in s[0]], dtype=np.int64) for d, s in shared.value.items()}
            for rows in batches:
                for dim, shard, blob in zip(rows["dim"], rows["shard"], rows["blob"]):
                    if dim not in shared.value:
                        continue
                    q_ids, q, at = shared.value[dim]
                    own = np.flatnonzero(at == shard) if home else np.arange(len(q_ids))
                    if not len(own):
                        continue
                    t = dict(np.load(io.BytesIO(blob)))
                    f = floor[dim][own]
                    i, s = search(t, t["ids"], t["x"].astype(np.int64), q_ids[own], q[own], f, k)
                    if not home:
                        floor[dim][own] = f
                    r, c = np.nonzero(s != NONE)
                    yield pd.DataFrame({"query_id": q_ids[own][r], "vec_id": i[r, c], "score": s[r, c]})

        floors: dict[int, int] = {}
        if n > 1:
            first = trees.mapInPandas(lambda it, f=look: f(it, True, None), schema)
            for r in first.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k).collect():
                floors[r["query_id"]] = r["s"]
        every = trees.mapInPandas(lambda it, f=look, fl=floors: f(it, False, fl), schema)
        out = every if out is None else out.unionAll(every)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
