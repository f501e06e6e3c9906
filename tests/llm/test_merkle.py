"""The manifest against a plain tree, on small and odd tables."""

import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from leafwork.llm import merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda *x: sha256("".join(x).encode()).hexdigest()


def leaf(d, n_chars=None):
    i, text, lang, source, n = d[:5]
    n = n if n_chars is None else n_chars
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)])


def tree(nodes):
    """Root, and each node's siblings with their sides, by plain levels."""
    proofs, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(own):
            if at ^ 1 < len(nodes):
                proofs[k].append(("<" if at & 1 else ">", nodes[at ^ 1]))
            else:
                proofs[k].append(("-", ""))
        nodes = [H(*nodes[j : j + 2]) for j in range(0, len(nodes), 2)]
        own = [at // 2 for at in own]
    return nodes[0], proofs


def whole(data):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root of every row."""
    groups = {}
    for d in data:
        groups.setdefault(d[2], []).append(d)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    out, tops = [], {}
    for g in order:
        groups[g].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        tops[g] = tree([leaf(d) for d in groups[g]])
    root, upper = tree([tops[g][0] for g in order])
    for k, g in enumerate(order):
        for d, own in zip(groups[g], tops[g][1]):
            proof = own + upper[k]
            hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            acc = leaf(d, d[4] + 1) if hit and d[4] is not None else leaf(d)
            for side, x in proof:
                acc = H(*((x, acc) if side == "<" else (acc, x)))
            out.append((d[0], leaf(d), tops[g][0], root, H(*[x for _, x in proof]), acc))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 31, 32, 33, 100])
@pytest.mark.parametrize("step", [1, 2, 5])
def test_traversal_of_a_block(n, step):
    nodes = [H(str(i)) for i in range(n)]
    height = (n - 1).bit_length()
    walk, got = merkle.walked([bytes.fromhex(x) for x in nodes], height, step), []
    while True:
        try:
            got.append(next(walk))
        except StopIteration as end:
            root = end.value.hex()
            break
    want, proofs = tree(nodes)
    assert root == want
    assert [[(s, path[32 * k : 32 * k + 32].hex() if s != "-" else "") for k, s in enumerate(sides)] for path, sides in got] == proofs


def test_stacks_stay_small():
    held = []

    class Watched(list):
        def __getitem__(self, i):
            held.append(i)
            return list.__getitem__(self, i)

    leaves = Watched([bytes.fromhex(H(str(i))) for i in range(1024)])
    n = sum(1 for _ in merkle.walked(leaves, 10, 2))
    assert n == 1024 and len(held) <= 1024 * (1 + 5)  # each level of the stack reads a leaf once


def data():
    out = [(i, f"text {i} é", ["en", "de", None, "fr", "é"][i % 5], f"s{i % 3}", i) for i in range(70)]
    return out + [(None, "no id", "en", None, None), (200, None, "en", "s", None), (201, "", "one", "s", 0), (5, "again", "de", "s", 1)] + [(7, "x", "en", "s", 1)] * 9 + [(300, "lång " * 20000, "en", "s", 5)]


@pytest.mark.parametrize("height", [1, 2, 3, 10])
def test_manifest(spark, height):
    m = merkle.manifest(spark.createDataFrame(data(), DOC).repartition(3), height=height)
    got = m.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path"), F.col("sides")).cast("binary"), 256), merkle.folded(F.col("leaf"), F.col("path"), F.col("sides"))).collect()
    want = [(*w[:5], w[3]) for w in whole(data())]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_query_and_sql(spark, tmp_path):
    rows = [d for d in data() if d[0] != 7 and d[1] != "again"]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == whole(rows)
    assert {r.doc_id for r in got if not r.verified} == {d[0] for d in rows if d[0] is not None and d[4] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, c.sql(merkle.SQL).fetchall()))


def test_small_tables_and_names(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC)).count() == 0
    d = spark.createDataFrame([(1, "a", "b", 3, 4)], "key long, grp string, node string, at int, pos int")
    r = merkle.manifest(d, "key", "grp", ("key", "node")).first()
    assert r.leaf == r.subroot == r.root == H("1:1", "1:b") and r.sides == ""
