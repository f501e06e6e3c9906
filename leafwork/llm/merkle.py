"""Merkle manifest of a dataset: a leaf for each row, a tree for each group, and every row's proof.

Leaves of a group are cut into aligned blocks of 2 ** HEIGHT. A task walks one block by fractal
traversal: a stack of existing subtrees gives the siblings of the leaf at hand, while the desired ones,
which come next at each place of the stack, grow by two steps a leaf. Block roots are leaves of the
next table, until one is left in every group; the proofs of that table follow those of the block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import far, table, written
from .ordered import laid_out, numbered

#: A block has 2 ** HEIGHT leaves; a subtree of the stack has this many levels.
HEIGHT, STEP = 10, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: In place of a sibling that isn't there.
NONE = bytes(32)


def joined(left: bytes | None, right: bytes | None) -> bytes | None:
    """The node over two nodes, of which the right one or both may be missing; digests go in as hex text."""
    if left is None:
        return None
    return sha256((left.hex() + (right.hex() if right is not None else "")).encode()).digest()


@dataclass
class Subtree:
    """Nodes of levels low to high - 1 under node `index` of level high, grown leaf by leaf."""

    low: int
    high: int
    index: int
    nodes: dict[tuple[int, int], bytes] = field(default_factory=dict)
    stack: list[tuple[int, int, bytes | None]] = field(default_factory=list)
    used: int = 0

    def grow(self, steps: int, leaf: Callable[[int], bytes | None]) -> None:
        """A step reads a leaf or joins the two topmost nodes of equal level."""
        for _ in range(steps):
            s = self.stack
            if len(s) > 1 and s[-1][0] == s[-2][0]:
                level, at, right = s.pop()
                node = (level + 1, at // 2, joined(s.pop()[2], right))
            elif self.used < 1 << self.high:
                node = (0, (self.index << self.high) + self.used, leaf((self.index << self.high) + self.used))
                self.used += 1
            else:
                return
            s.append(node)
            if self.low <= node[0] < self.high and node[2] is not None:
                self.nodes[node[:2]] = node[2]

    def top(self) -> bytes | None:
        return self.stack[0][2]


def walked(leaves: list[bytes], height: int, step: int = STEP):
    """(path, sides) of each leaf in turn, and at last the root: the siblings from below upwards, and for
    each level '<' or '>' for the side where its sibling stands, '-' where it has none. What is held beside
    the leaves is two subtrees of 2 ** (step + 1) nodes for each step levels, and a stack for each."""
    leaf = lambda i: leaves[i] if i < len(leaves) else None
    cuts = [*range(0, height, step), height]
    levels = list(zip(cuts, cuts[1:])) if height else []
    exist = [Subtree(lo, hi, 0) for lo, hi in levels]
    for t in exist:
        t.grow(2 << t.high, leaf)
    desired = [Subtree(lo, hi, 1) for lo, hi in levels[:-1]]
    for i in range(len(leaves)):
        path, sides = [], []
        for t in exist:
            for level in range(t.low, t.high):
                sibling = t.nodes.get((level, (i >> level) ^ 1))
                path.append(sibling or NONE)
                sides.append("-" if sibling is None else "<" if i >> level & 1 else ">")
        yield b"".join(path), "".join(sides)
        for t in desired:
            t.grow(2, leaf)
        for k, t in enumerate(desired):
            if (i + 1) % (1 << t.high) == 0:
                exist[k], desired[k] = t, Subtree(t.low, t.high, t.index + 1)
    return exist[-1].top() if levels else leaves[0]


def traversed(nodes: DataFrame, height: int) -> DataFrame:
    """(gid, pos, path, sides, root, n) of nodes (gid, pos, node, n), n being the number of a group's nodes:
    proofs within the aligned block, and the block's root."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n = int(rows["n"].iloc[0])
        walk, got = walked([bytes(x) for x in rows["node"]], height if n > 1 << height else (n - 1).bit_length()), []
        while True:
            try:
                got.append(next(walk))
            except StopIteration as end:
                return pd.DataFrame({"gid": rows["gid"].to_numpy(), "pos": rows["pos"].to_numpy(), "path": [p for p, _ in got], "sides": [s for _, s in got], "root": [end.value] * len(got), "n": n})

    block = F.shiftright("pos", height).alias("block")
    return nodes.select("gid", "pos", "node", "n").groupBy("gid", block).applyInPandas(run, "gid long, pos long, path binary, sides string, root binary, n long")


def climbed(nodes: DataFrame, most: int, height: int) -> DataFrame:
    """(gid, pos, path, sides, root): every node's whole proof within its group, and the group's root; most
    is the largest group's number of nodes."""
    own = written(traversed(nodes, height), nodes.sparkSession)
    if most <= 1 << height:
        return own.drop("n")
    up = lambda c: F.shiftright(c, height)
    above = own.where(F.col("pos").bitwiseAND((1 << height) - 1) == 0).select("gid", up(F.col("pos")).alias("pos"), F.col("root").alias("node"), up(F.col("n") + ((1 << height) - 1)).alias("n"))
    upper = climbed(above, -(-most // (1 << height)), height).select(far(F.col("gid")).alias("_g"), F.col("pos").alias("_b"), F.col("path").alias("_path"), F.col("sides").alias("_sides"), F.col("root").alias("_root"))
    met = own.join(upper, (far(F.col("gid")) == F.col("_g")) & (up(F.col("pos")) == F.col("_b")))
    return met.select("gid", "pos", F.concat("path", "_path").alias("path"), F.concat("sides", "_sides").alias("sides"), F.col("_root").alias("root"))


def digest(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of a row's fields: '-' for null, else the number of bytes, ':' and the value."""
    said = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said]).cast("binary"), 256)


def _levels(path: Column, sides: Column) -> Column:
    """Structs (side, sibling as hex text) from below upwards."""
    at = lambda i: F.struct(F.substring(sides, i, F.lit(1)).alias("side"), F.lower(F.hex(F.substring(path, i * 32 - 31, F.lit(32)))).alias("hex"))
    return F.when(F.length(sides) > 0, F.transform(F.sequence(F.lit(1), F.length(sides)), at)).otherwise(F.array().cast("array<struct<side:string,hex:string>>"))


def proof_text(path: Column, sides: Column) -> Column:
    """All siblings from below upwards as one string of hex text."""
    return F.array_join(F.transform(F.filter(_levels(path, sides), lambda x: x["side"] != "-"), lambda x: x["hex"]), "")


def folded(leaf: Column, path: Column, sides: Column) -> Column:
    """The root that a leaf and its siblings give."""
    over = lambda acc, x: F.sha2(F.when(x["side"] == "<", F.concat(x["hex"], acc)).when(x["side"] == ">", F.concat(acc, x["hex"])).otherwise(acc).cast("binary"), 256)
    return F.aggregate(_levels(path, sides), leaf, over)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, also: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per row of docs: id, leaf, subroot and root as hex text, and the proof (path, sides) that
    `proof_text` and `folded` read; `also` names further columns of docs to carry along.

    Within a group leaves stand by id, null first, and equal ids by leaf; of each two neighbours the
    hash of both goes on, an odd one's own hash alone, until one node is left. The groups' roots, null
    first and then by bytes, give the root in the same way. Rows that are equal get neighbouring leaves;
    a null in any field is told from an empty text; other columns are neither read nor hashed; an empty
    table gives no rows and so no root.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("grp"), F.unhex(digest([F.col(c) for c in fields])).alias("node"), *[c.alias(f"also_{k}") for k, c in (also or {}).items()])
    rows = numbered(laid_out(base, [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("node").asc()]), "at")
    groups = rows.groupBy("grp").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    groups = written(groups.withColumn("gid", (F.row_number().over(Window.orderBy(F.col("grp").asc_nulls_first())) - 1).cast("long")), spark)  # a row for each group
    count, most = groups.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    named = rows.join(groups.select(F.col("grp").alias("_grp"), "gid", "first", "n"), F.col("grp").eqNullSafe(F.col("_grp"))).withColumn("pos", F.col("at") - F.col("first"))

    own = climbed(named, most, height)
    tops = own.where("pos = 0").select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("pos"), F.col("root").alias("node"), F.lit(count).cast("long").alias("n"))
    top = written(climbed(tops, count, height).select(F.col("pos").alias("_g"), F.col("path").alias("_path"), F.col("sides").alias("_sides"), F.col("root").alias("_root")), spark)
    proofs = own.join(top, F.col("gid") == F.col("_g")).select(far(F.col("gid")).alias("_gid"), F.col("pos").alias("_pos"), F.concat("path", "_path").alias("path"), F.concat("sides", "_sides").alias("sides"), F.col("root").alias("subroot"), F.col("_root").alias("root"))
    text = lambda c: F.lower(F.hex(c))
    met = named.join(proofs, (far(F.col("gid")) == F.col("_gid")) & (F.col("pos") == F.col("_pos")))
    return met.select(F.col("id").alias(id_col), text("node").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), "path", "sides", *[F.col(f"also_{k}").alias(k) for k in also or {}])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    m = manifest(docs, also={"tampered": F.when(hit, F.unhex(changed))})
    now = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    out = m.withColumns({"proof_sha256": F.sha2(proof_text(F.col("path"), F.col("sides")).cast("binary"), 256), "folded_root": folded(now, F.col("path"), F.col("sides"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_LEAF = lambda n: "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", n, "text")) + ")"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF("n_chars")} AS leaf, {_LEAF("(n_chars + 1)")} AS other, coalesce({_CRC} % 7 = 0, false) AS hit FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS gid, count(*) AS n FROM d GROUP BY lang),
r AS (SELECT d.*, gid, n, row_number() OVER (PARTITION BY gid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
lv(gid, lvl, idx, h, n) AS (SELECT gid, 0, pos, leaf, n FROM r
  UNION ALL SELECT gid, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), max(n + 1) // 2 FROM lv WHERE n > 1 GROUP BY gid, lvl, idx // 2),
sub AS (SELECT gid, h AS subroot FROM lv WHERE n = 1),
tv(lvl, idx, h, n) AS (SELECT 0, gid, subroot, (SELECT count(*) FROM sub) FROM sub
  UNION ALL SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), max(n + 1) // 2 FROM tv WHERE n > 1 GROUP BY lvl, idx // 2),
p AS (SELECT r.gid, r.pos, lv.lvl AS step, (r.pos >> lv.lvl) & 1 AS side, s.h FROM r JOIN lv ON lv.gid = r.gid AND lv.idx = r.pos >> lv.lvl AND lv.n > 1
        LEFT JOIN lv s ON s.gid = r.gid AND s.lvl = lv.lvl AND s.idx = xor(lv.idx, 1)
      UNION ALL SELECT r.gid, r.pos, 100 + tv.lvl, (r.gid >> tv.lvl) & 1, s.h FROM r JOIN tv ON tv.idx = r.gid >> tv.lvl AND tv.n > 1
        LEFT JOIN tv s ON s.lvl = tv.lvl AND s.idx = xor(tv.idx, 1)),
q AS (SELECT gid, pos, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof_sha256, list(side ORDER BY step) AS sides, list(coalesce(h, '') ORDER BY step) AS hs FROM p GROUP BY gid, pos),
w(gid, pos, k, acc) AS (SELECT gid, pos, 0, CASE WHEN hit THEN other ELSE leaf END FROM r
  UNION ALL SELECT gid, pos, k + 1, sha256(CASE WHEN q.sides[k + 1] = 1 THEN q.hs[k + 1] || acc ELSE acc || q.hs[k + 1] END) FROM w JOIN q USING (gid, pos) WHERE k < len(q.sides)),
f AS (SELECT gid, pos, arg_max(acc, k) AS folded_root FROM w GROUP BY gid, pos)
SELECT r.doc_id, r.leaf, sub.subroot, t.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = t.h AS verified
FROM r JOIN sub USING (gid) JOIN f USING (gid, pos) LEFT JOIN q USING (gid, pos) CROSS JOIN (SELECT h FROM tv WHERE n = 1) t
"""
