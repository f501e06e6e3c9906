"""Where documents may share windows of a fixed number of symbols (bytes or words), found by anchors.

The anchor of a window is the run of `gram` symbols in it with the least hash, the first of equals; so
equal windows have equal anchors at equal places. Neighbouring windows with the same anchor form a
segment, which is what travels: a row of hashes for each, and its symbols where its anchor is found
again. An anchor routes its segments to one shard, where a matcher works on their symbols.

An anchor with many different contents (the edge of a passage that many documents hold) is cut finer:
of equal segments the first goes on, and its windows go in blocks of `fine` by their distance from the
anchor; a block is keyed by the symbols that all its windows share, so that windows with different
surroundings part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PASS_BYTES, Ranges, far, passes, written

#: An anchor with more different contents is cut finer. Either way the matcher gets all of them.
CROWD = 512
#: Rows of one anchor that go to one place of a matcher that takes copies; more are dealt out.
TOGETHER = 2000
#: Bytes of segments in one shard of a matcher, beyond which it begins the next.
SHARD_BYTES = 1 << 18
#: Longer texts are hashed piece by piece. The lower bits of a sort key hold a place in a piece.
PIECE_BYTES, PLACE = 1 << 22, np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Kind:
    """symbols: "bytes" or "words"; window, gram and fine in symbols; per_document: only documents with
    a smaller id count as earlier, not earlier places of the same one; copies: the matcher takes all
    segments, not only the first of equal ones."""

    symbols: str
    window: int
    gram: int
    fine: int
    per_document: bool
    copies: bool

    def normal(self, raw: bytes) -> bytes:
        return b" ".join(raw.split()) if self.symbols == "words" else raw

    def text(self, t: str) -> bytes:
        return self.normal(t.encode("utf-8", "surrogatepass"))

    def ends(self, raw: bytes) -> np.ndarray | None:
        """Where the words of a normal text end, after a -1; none for bytes."""
        if self.symbols == "bytes":
            return None
        return np.concatenate([[-1], np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 32), [len(raw)]])

    def cut(self, raw: bytes, a: int, z: int) -> bytes:
        """Symbols a to z of a normal text."""
        end = self.ends(raw)
        return raw[a:z] if end is None else raw[end[a] + 1 : end[z]]

    def bounds(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined texts, begin and end of each symbol in them, and symbols of each text."""
        if self.symbols == "bytes":
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            at = np.arange(len(data) + 1)
            return data, at[:-1], at[1:], np.array([len(t) for t in texts])
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        end = np.flatnonzero((data == 32) | (data == 10))
        begin = np.concatenate([[0], end[:-1] + 1])
        counts = np.bincount(np.concatenate([[0], np.cumsum(data[end] == 10)[:-1]]), minlength=len(texts))
        full = end > begin  # a text without words leaves an empty one
        return data, begin[full], end[full], np.where([len(t) > 0 for t in texts], counts, 0)


def pieces(texts: list[bytes], kind: Kind) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(texts, first symbol in its text, bytes) of one hashing pass after another. A long text comes in
    pieces that overlap by a window less one symbol, so that each window is in one piece."""
    for lo, hi in passes(texts, PASS_BYTES):
        if hi > lo + 1 or len(texts[lo]) <= PIECE_BYTES:
            yield list(range(lo, hi)), [0] * (hi - lo), texts[lo:hi]
            continue
        raw = texts[lo]
        end = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 32) if kind.symbols == "words" else None
        n = len(raw) if end is None else len(end) + 1
        each = max(kind.window, PIECE_BYTES * n // len(raw) // 4)
        for a in range(0, max(1, n - kind.window + 1), each):
            z = min(n, a + each + kind.window - 1)
            if end is None:
                yield [lo], [a], [raw[a:z]]
            else:
                yield [lo], [a], [raw[end[a - 1] + 1 if a else 0 : end[z - 1] if z < n else len(raw)]]


def segments(texts: list[bytes], kind: Kind) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, anchor hash, content hash, first window, windows) of each segment, pass by pass."""
    for which, shift, own in pieces(texts, kind):
        data, begin, end, counts = kind.bounds(own)
        n, size, k = len(begin), kind.window, kind.gram
        if n < size:
            continue
        h = Ranges(data, 3)
        v = h.of(begin[: n - k + 1], end[k - 1 :])
        low = (v & ~PLACE) | np.arange(len(v), dtype=np.uint64)  # least hash, then first place
        width, s = size - k + 1, 1
        while 2 * s <= width:
            low, s = np.minimum(low[s:], low[:-s]), 2 * s
        if s < width:
            low = np.minimum(low[width - s :], low[: s - width])
        p = (low & PLACE).astype(np.int32)
        first = np.cumsum(counts) - counts
        starts = np.zeros(len(p) + 1, dtype=np.int32)
        some = counts >= size
        np.add.at(starts, first[some], 1)
        np.add.at(starts, first[some] + counts[some] - size + 1, -1)
        ok = np.cumsum(starts)[:-1] > 0  # windows inside one text
        new = ok.copy()
        new[1:] &= (p[1:] != p[:-1]) | ~ok[:-1]
        new[first[some]] = True
        run = np.flatnonzero(new)
        stop = np.append(run[1:], len(p))
        total = np.concatenate([[0], np.cumsum(ok)])
        many = total[stop] - total[run]
        whole = Ranges(data, 4).of(begin[run], end[run + many + size - 2])
        owner = np.searchsorted(first + counts, run, side="right")
        yield np.array(which)[owner], v[p[run]], whole, run - first[owner] + np.array(shift)[owner], many


def occurrences(base: DataFrame, kind: Kind) -> DataFrame:
    """(g, seg, _id, pos, nw) of every segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = b["_id"].to_numpy(np.int64)
            for owner, g, seg, pos, nw in segments([kind.text(t) for t in b["_text"]], kind):
                yield pd.DataFrame({"g": g.view(np.int64), "seg": seg.view(np.int64), "_id": keys[owner], "pos": pos.astype(np.int32), "nw": nw.astype(np.int32)})

    return base.mapInPandas(run, "g long, seg long, _id long, pos int, nw int")


def squeezed(base: DataFrame) -> DataFrame:
    """(_id, z): texts under zstd, so that they are cheap to move."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=1)
        for rows in batches:
            yield pd.DataFrame({"_id": rows["_id"], "z": [z.compress(t.encode("utf-8", "surrogatepass")) for t in rows["_text"]]})

    return base.mapInPandas(run, "_id long, z binary")


def once_each(base: DataFrame) -> DataFrame:
    """One row for each id: equal rows count once, and of different texts the least is taken."""
    twice = base.groupBy("_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    return base.groupBy("_id").agg(F.min("_text").alias("_text")) if twice else base


@dataclass
class Asked:
    """Segments of a part of a text that begins at symbol `at`: anchor, first window, windows."""

    key: int
    part: bytes
    at: int
    g: np.ndarray
    pos: np.ndarray
    nw: np.ndarray


def asked_parts(key: int, raw: bytes, want, kind: Kind) -> Iterator[Asked]:
    """A normal text with its segments; a long one in parts of PIECE_BYTES symbols or one segment."""
    g, pos, nw = (np.array([w[c] for w in want], dtype=np.int64) for c in ("g", "pos", "nw"))
    order = np.argsort(pos)
    g, pos, nw = g[order], pos[order], nw[order]
    part = pos // max(1, PIECE_BYTES)
    for lo, hi in zip(*_runs(part)):
        a, z = int(pos[lo]), int((pos[lo:hi] + nw[lo:hi]).max()) + kind.window - 1
        yield Asked(key, kind.cut(raw, a, z), a, g[lo:hi], pos[lo:hi], nw[lo:hi])


def blocks_of(asked: list[Asked], kind: Kind) -> pd.DataFrame:
    """(g, seg, _id, pos, nw) of the blocks that segments are cut into."""
    size, k, fine = kind.window, kind.gram, kind.fine
    data, begin, end, counts = kind.bounds([x.part for x in asked])
    h, two = Ranges(data, 3), Ranges(data, 4)
    shift = np.cumsum(counts) - counts - np.array([x.at for x in asked])  # from a text's symbols to these
    own = np.repeat(np.arange(len(asked)), [len(x.pos) for x in asked])
    want, a, w = (np.concatenate([getattr(x, c) for x in asked]) for c in ("g", "pos", "nw"))
    a = a + shift[own]
    v = h.of(begin[: len(begin) - k + 1], end[k - 1 :]).view(np.int64)
    anchor, left = np.empty(len(a), dtype=np.int64), np.arange(len(a))
    for d in range(size - k + 1):  # the first such run that the last window holds
        p = a[left] + w[left] - 1 + d
        hit = v[np.minimum(p, len(v) - 1)] == want[left]
        anchor[left[hit]] = p[hit]
        left = left[~hit]
        if not len(left):
            break
    near, wide = anchor - (a + w - 1), anchor - a  # distances of the anchor in the last and first window
    n = wide // fine - near // fine + 1
    r = np.repeat(np.arange(len(a)), n)
    block = near[r] // fine + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
    most, least = np.minimum(wide[r], block * fine + fine - 1), np.maximum(near[r], block * fine)
    start, many = anchor[r] - most, most - least + 1
    c0 = anchor[r] - block * fine
    core = h.of(begin[c0], end[c0 + size - fine]) + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = two.of(begin[start], end[start + many + size - 2])
    keys = np.array([x.key for x in asked], dtype=np.int64)
    return pd.DataFrame({"g": core.view(np.int64), "seg": whole.view(np.int64), "_id": keys[own[r]], "pos": (start - shift[own[r]]).astype(np.int32), "nw": many.astype(np.int32)})


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of equal values."""
    cut = np.flatnonzero(np.diff(values)) + 1
    return np.concatenate([[0], cut])[: len(values)], np.append(cut, len(values))[: len(values)]


def again(rows: DataFrame, kind: Kind) -> DataFrame:
    """(j, c): keys that are found again, and how often; by documents where only these count."""
    own = rows.groupBy("g").agg(F.count("*").alias("c"), *([F.min("_id").alias("a"), F.max("_id").alias("z")] if kind.per_document else []))
    return own.where("a < z" if kind.per_document else "c > 1").select(far(F.col("g")).alias("j"), "c")


def covered(base: DataFrame, kind: Kind, matcher: Callable[[pd.DataFrame, Kind], pd.DataFrame]) -> DataFrame:
    """(_id, s, e): runs of symbols covered by windows that also start earlier. They may overlap.

    matcher gets rows (g, _id, pos, nw, text) of whole anchors and returns rows (_id, s, e).
    """
    spark, size = base.sparkSession, kind.window
    on_g = lambda d: d.withColumn("j", far(F.col("g")))

    def settled(rows: DataFrame) -> DataFrame:
        """rows, whether the first of equal segments stands before, and how many contents the anchor has."""
        firsts = written(rows.groupBy("g", "seg").agg(F.min(F.struct("_id", "pos")).alias("first")), spark)
        kinds = firsts.groupBy("g").agg(F.count("*").alias("k")).select(far(F.col("g")).alias("j"), "k")
        firsts = on_g(firsts).join(kinds, "j").select(far(F.col("g")).alias("j1"), far(F.col("seg")).alias("j2"), "first", "k")
        later = F.col("_id") > F.col("first._id") if kind.per_document else F.struct("_id", "pos") > F.col("first")
        own = rows.withColumns({"j1": far(F.col("g")), "j2": far(F.col("seg"))}).join(firsts, ["j1", "j2"])
        return written(own.select("g", "_id", "pos", "nw", "c", "k", later.alias("later")), spark)

    found = written(on_g(occurrences(base, kind)).join(again(occurrences(base, kind), kind), "j").select("g", "seg", "_id", "pos", "nw", "c"), spark)
    every = settled(found)
    crowded, plain = every.where(F.col("k") > CROWD), every.where(F.col("k") <= CROWD)
    asked = crowded.where("not later").groupBy("_id").agg(F.collect_list(F.struct("g", "pos", "nw")).alias("want"))

    def finer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z, held, volume = zstandard.ZstdDecompressor(), [], 0
        for rows in batches:
            for key, raw, want in zip(rows["_id"], rows["z"], rows["want"]):
                for x in asked_parts(key, kind.normal(z.decompress(bytes(raw))), want, kind):
                    held.append(x)
                    volume += len(x.part)
                    if volume >= PASS_BYTES:
                        yield blocks_of(held, kind)
                        held, volume = [], 0
        if held:
            yield blocks_of(held, kind)

    fine = squeezed(base).join(asked, "_id").mapInPandas(finer, "g long, seg long, _id long, pos int, nw int") if not crowded.isEmpty() else found.limit(0).select("g", "seg", "_id", "pos", "nw")
    fine = written(fine, spark)
    fine = settled(written(on_g(fine).join(again(fine, kind), "j").select("g", "seg", "_id", "pos", "nw", "c"), spark))
    parts = plain.unionAll(fine)

    if kind.copies:
        # A key with very many rows is dealt out; each share also gets the first of every content.
        n = F.ceil(F.col("c") / TOGETHER).cast("int")
        wanted = parts.select("_id", "g", "pos", "nw", F.when(n > 1, F.pmod(F.xxhash64("_id"), n)).otherwise(F.lit(0)).cast("int").alias("salt"))
        known = parts.where((n > 1) & ~F.col("later")).select("_id", "g", "pos", "nw", F.explode(F.sequence(F.lit(0), n - 1)).alias("salt"))
        wanted, same = wanted.unionAll(known), crowded
    else:
        wanted, same = parts.where((F.col("k") > 1) & ~F.col("later")).select("_id", "g", "pos", "nw", F.lit(0).alias("salt")), every.unionAll(fine)
    copies = same.where("later").select("_id", F.col("pos").alias("s"), (F.col("pos") + F.col("nw") + size - 1).alias("e"))
    asked = wanted.groupBy("_id").agg(F.collect_list(F.struct("g", "salt", "pos", "nw")).alias("want"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for rows in batches:
            out: dict[str, list] = {k: [] for k in ("g", "salt", "_id", "pos", "nw", "text")}
            volume = 0
            for key, raw, want in zip(rows["_id"], rows["z"], rows["want"]):
                raw = kind.normal(z.decompress(bytes(raw)))
                end = kind.ends(raw)
                for w in want:
                    p, q = w["pos"], w["pos"] + w["nw"] + size - 1
                    got = raw[p:q] if end is None else raw[end[p] + 1 : end[q]]
                    out["text"].append(got)
                    out["_id"].append(key)
                    volume += len(got)
                    for k in ("g", "salt", "pos", "nw"):
                        out[k].append(w[k])
                    if volume > 4 * PASS_BYTES:
                        yield pd.DataFrame(out)
                        out, volume = {k: [] for k in out}, 0
            yield pd.DataFrame(out)

    texts = squeezed(base).join(asked, "_id").mapInPandas(cut, "g long, salt int, _id long, pos int, nw int, text binary")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, volume = [], 0
        for rows in batches:
            held.append(rows)
            volume += int(rows["text"].map(len).sum())
            if volume >= SHARD_BYTES:
                own = pd.concat(held, ignore_index=True)
                last = (own["g"] == own["g"].iloc[-1]) & (own["salt"] == own["salt"].iloc[-1])  # it may go on
                if last.all():
                    continue
                done = own[~last].reset_index(drop=True)
                cuts = np.flatnonzero(np.diff(np.cumsum(done["text"].map(len).to_numpy()) // SHARD_BYTES)) + 1
                g, salt = done["g"].to_numpy(), done["salt"].to_numpy()
                lo = 0
                for c in [*cuts, len(done)]:
                    while c < len(done) and g[c] == g[c - 1] and salt[c] == salt[c - 1]:
                        c += 1
                    if c > lo:
                        yield matcher(done.iloc[lo:c].reset_index(drop=True), kind)
                        lo = c
                held, volume = [own[last]], int(own["text"][last].map(len).sum())
        if held:
            yield matcher(pd.concat(held, ignore_index=True), kind)

    matched = texts.repartition("g", "salt").sortWithinPartitions("g", "salt").mapInPandas(match, "_id long, s int, e int")
    return copies.unionAll(written(matched, spark))


def with_cuts(base: DataFrame, kind: Kind, matcher, finish: Callable[[str, list[tuple[int, int]]], tuple], schema: str) -> DataFrame:
    """finish(text, merged runs of removed symbols) of every document, as (_id, *schema)."""
    base = once_each(base)
    cuts = covered(base, kind, matcher).groupBy("_id").agg(F.collect_set(F.struct("s", "e")).alias("cuts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        names = ["_id", *(c.split()[0] for c in schema.split(", "))]
        for rows in batches:
            out = []
            for key, raw, own in zip(rows["_id"], rows["z"], rows["cuts"]):
                runs: list[list[int]] = []
                for s, e in sorted((c["s"], c["e"]) for c in own) if own is not None else ():
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                out.append((key, *finish(z.decompress(bytes(raw)), runs)))
            yield pd.DataFrame(out, columns=names)

    return squeezed(base).join(cuts, "_id", "left").mapInPandas(run, f"_id long, {schema}")
