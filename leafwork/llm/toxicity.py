"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

All labelled rows outside the held-out fold are packed into the shared folder. A round trains every
pack from the same model, side by side, and the changes are averaged; three models go along: of each
half of every pack, whose scores of the other half set the thresholds, and of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ranges, dropped, freed, lean, passes, table, written
from .katz import singly

#: Labelled rows in a pack on average, words in it unless one text has more, and words of a step;
#: labelled ids that are broadcast (some 75 bytes each, 15 MB), more are joined by shuffle. None of these leaves a row out.
PACK_ROWS, PACK_WORDS, STEP_WORDS, WIDE = 4096, 2 << 20, 1 << 17, 200_000
#: Rounds over all rows, whatever their number; numbers of a model that are averaged in one group;
#: steps of a threshold per unit of log odds, and the log odds beyond which all scores count as one.
ROUNDS, SLICE, GRID, FARTHEST = 3, 1 << 16, 1024, 32
BUCKETS, WIDTH = 1 << 16, 16
SPANS, FILTERS = (1, 2, 3), 16
PAD = max(SPANS) - 1
BLOCK = 1 << 20
#: Rows of a batch that are Python objects at a time.
ROWS = 256
#: Rows of each label that a language needs for a threshold of its own, and the share of rows of label 0 that
#: a threshold may take.
LEAST_HITS, MOST_FALSE = 30, 0.02
#: Held-out rows are those whose crc32(doc_id as text) leaves FOLD when divided by FOLDS.
FOLDS, FOLD = 5, 0

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), 39, *range(128, 256)]] = True


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words, 4) buckets of every text's words and their beginnings and ends, and the number of
    words of each text. Texts are lower-cased UTF-8."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    in_word = _WORD[data]
    edge = np.diff(np.concatenate([[0], in_word.view(np.int8)]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h, b = Ranges(data, 5), np.uint64(BUCKETS - 1)
    out = np.empty((len(start), 4), dtype=np.uint16)
    for k, (lo, hi, salt) in enumerate(((start, end, 0), (start, np.minimum(end, start + 4), 1), (start, np.minimum(end, start + 5), 2), (np.maximum(start, end - 4), end, 3))):
        out[:, k] = ((h.of(lo, hi) >> np.uint64(7 * salt)) + np.uint64(salt * 0x51ED)) & b
    ends = np.cumsum([len(t) + 1 for t in texts])
    return out, np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))


def edges(text: bytes) -> Iterator[tuple[int, int]]:
    """Places of blocks of about BLOCK bytes, cut at white space where there is some."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + BLOCK)
        if stop < len(text):
            cut = max(text.rfind(b" ", at + BLOCK // 2, stop), text.rfind(b"\n", at + BLOCK // 2, stop))
            stop = cut if cut > 0 else stop
        yield at, stop
        at = stop


def blocks(text: bytes) -> list[bytes]:
    """text in blocks of about BLOCK bytes, each with the last PAD words of the one before."""
    if len(text) <= BLOCK:
        return [text]
    out = []
    for at, stop in edges(text):
        tail = b" ".join(text[max(0, at - 256) : at].split()[-PAD:]) if at else b""
        out.append(tail + b" " + text[at:stop] if tail else text[at:stop])
    return out


def encoded(texts: list[str]) -> list[np.ndarray]:
    """The features of whole texts."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        raw = t.lower().encode("utf-8", "replace")
        for lo, hi in edges(raw):
            parts.append(raw[lo:hi])
            owner.append(i)
    found, counts = [np.zeros((0, 4), np.uint16)], np.zeros(len(texts), dtype=np.int64)
    for lo, hi in passes(parts):
        own, n = features(parts[lo:hi])
        found.append(own)
        np.add.at(counts, owner[lo:hi], n)
    return np.split(np.concatenate(found), np.cumsum(counts)[:-1])


@dataclass
class Model:
    embed: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = 0.5
    share: float = 0.0
    fitted: bool = False

    def parts(self) -> list[np.ndarray]:
        return [self.embed, *self.kernels, *self.biases, self.out]

    def flat(self) -> np.ndarray:
        return np.concatenate([*(q.reshape(-1) for q in self.parts()), [self.base]])

    def move(self, by: np.ndarray) -> None:
        at = 0
        for q in self.parts():
            q += by[at : at + q.size].reshape(q.shape).astype(np.float32)
            at += q.size
        self.base += float(by[at])

    def since(self, other: Model, dtype) -> np.ndarray:
        """flat() less that of other, part by part."""
        return np.concatenate([*((p.astype(np.float64) - q).astype(dtype).reshape(-1) for p, q in zip(self.parts(), other.parts())), np.array([self.base - other.base], dtype)])

    def pooled(self, words: np.ndarray, counts: np.ndarray, where: bool = False):
        """(texts, filters) maxima; with where, also the rows of the maxima and the padded rows."""
        n = counts + PAD
        first = np.cumsum(n) - n
        rows = np.zeros((int(n.sum()), WIDTH), dtype=np.float32)
        at = np.arange(len(words)) + np.repeat(PAD * np.arange(len(counts)), counts)
        e = self.embed[words[:, 0]]
        for k in range(1, words.shape[1]):
            e += self.embed[words[:, k]]
        rows[at] = e
        pads = np.ones(len(rows), dtype=bool)
        pads[at] = False
        best, place = [], []
        for s, kernel, bias in zip(SPANS, self.kernels, self.biases):
            act = rows @ kernel[:WIDTH]
            for j in range(1, s):
                act[:-j] += rows[j:] @ kernel[j * WIDTH : (j + 1) * WIDTH]
            act[pads] = 0  # what starts behind a text's last word has nothing of the next text
            top = np.maximum.reduceat(act, first, axis=0)
            best.append(np.maximum(top + bias, 0))
            if where:
                place.append(np.stack([f + act[f : f + m].argmax(axis=0) for f, m in zip(first, n)]))
        return (np.concatenate(best, axis=1), place, rows, at) if where else np.concatenate(best, axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        top = np.zeros((len(texts), len(SPANS) * FILTERS), dtype=np.float32)
        for at, to in passes(texts):
            parts, owner = [], []
            for i, t in enumerate(texts[at:to], at):
                for p in blocks(t.lower().encode("utf-8", "replace")):
                    parts.append(p)
                    owner.append(i)
            for lo, hi in passes(parts):
                np.maximum.at(top, np.array(owner[lo:hi]), self.pooled(*features(parts[lo:hi])))
        return 1 / (1 + np.exp(-(top @ self.out + self.base).astype(np.float64)))


def start(seen: np.ndarray, n0: int, n1: int, seed: int = 3) -> Model:
    """The model that training starts from: embeddings hold a feature's log odds in one place. seen has,
    for label 0 and 1, how many of all texts hold each feature. It stays as it is where a label is missing."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(n1 / (n0 + n1) if n0 + n1 else 0.0, 1e-4, 1 - 1e-4))
    embed = rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)
    kernels = [rng.normal(0, 0.3 / np.sqrt(s), (s * WIDTH, FILTERS)).astype(np.float32) for s in SPANS]
    m = Model(embed, kernels, [np.zeros(FILTERS, np.float32) for _ in SPANS], rng.normal(0, 0.1, len(SPANS) * FILTERS).astype(np.float32), float(np.log(share / (1 - share))), share=share, fitted=bool(n0 and n1))
    if not m.fitted:
        m.out[:] = 0
        return m
    odds = np.log(((seen[1] + 0.5 * share) / (n1 + 1)) / ((seen[0] + 0.5 * (1 - share)) / (n0 + 1)))
    embed[:, 0] = np.clip(odds, -3, 3) * np.minimum(1, seen.sum(0) / 5) * 0.3
    for s, k in zip(SPANS, m.kernels):
        for j in range(s):
            k[j * WIDTH, : FILTERS // 2] = np.abs(k[j * WIDTH, : FILTERS // 2]) + 0.5 / s
    m.out[:] = np.tile(np.where(np.arange(FILTERS) < FILTERS // 2, 0.2, m.out[:FILTERS]), len(SPANS))
    return m


def steps(order: np.ndarray, sizes: np.ndarray, batch: int) -> Iterator[np.ndarray]:
    """order in runs of at most `batch` texts and STEP_WORDS words, or one text."""
    lo = 0
    while lo < len(order):
        own = np.cumsum(sizes[order[lo : lo + batch]])
        hi = lo + max(1, int(np.searchsorted(own, STEP_WORDS, side="right")))
        yield order[lo:hi]
        lo = hi


def train(m: Model, words: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, batch: int = 64, rate: float = 0.01) -> None:
    """Adam on the weighted log loss, once over these texts; changes m."""
    params = m.parts()
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]  # of embeddings only rows with a gradient move
    weight = np.where(labels == 1, min(5.0, np.sqrt((1 - m.share) / m.share)), 1.0)
    step, base_m, base_v = 0, 0.0, 0.0
    for ids in steps(rng.permutation(len(words)), np.array([len(w) for w in words]), batch):
        own = [words[i] for i in ids]
        counts = np.array([len(w) for w in own])
        flat = np.concatenate(own) if counts.sum() else np.zeros((0, 4), np.uint16)
        top, place, rows, at = m.pooled(flat, counts, where=True)
        back = np.full(len(rows), -1)
        back[at] = np.arange(len(flat))
        p = 1 / (1 + np.exp(-(top @ m.out + m.base)))
        err = ((p - labels[ids]) * weight[ids] / len(ids)).astype(np.float32)
        buckets, moves = [np.zeros(0, np.uint16)], [np.zeros((0, WIDTH), np.float32)]
        g_top = err[:, None] * m.out[None, :] * (top > 0)
        last = (np.cumsum(counts + PAD) - 1)[:, None]
        g_kernels, g_biases = [], []
        for c, s in enumerate(SPANS):
            g = g_top[:, c * FILTERS : (c + 1) * FILTERS]
            gk = np.zeros_like(m.kernels[c])
            for j in range(s):
                r = np.minimum(place[c] + j, last)
                gk[j * WIDTH : (j + 1) * WIDTH] = np.einsum("df,dfw->wf", g, rows[r])
                at_word = back[r]
                ok = at_word >= 0
                if ok.any():
                    ge = (g[:, :, None] * m.kernels[c][j * WIDTH : (j + 1) * WIDTH].T[None])[ok]
                    buckets += list(flat[at_word[ok]].T)
                    moves += [ge] * flat.shape[1]
            g_kernels.append(gk)
            g_biases.append(g.sum(0))
        order = np.argsort(np.concatenate(buckets), kind="stable")
        touched, first = np.unique(np.concatenate(buckets)[order], return_index=True)
        grads = [np.add.reduceat(np.concatenate(moves)[order], first, axis=0) if len(first) else moves[0], *g_kernels, *g_biases, err @ top]
        step += 1
        scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for at, (q, g, (a, v)) in enumerate(zip(params, grads, state)):
            own = touched if at == 0 else slice(None)
            a[own] = 0.9 * a[own] + 0.1 * g
            v[own] = 0.999 * v[own] + 0.001 * g * g
            q[own] -= (scale * a[own] / (np.sqrt(v[own]) + 1e-7)).astype(np.float32)
        gb = float(err.sum())
        base_m, base_v = 0.9 * base_m + 0.1 * gb, 0.999 * base_v + 0.001 * gb * gb
        m.base -= scale * base_m / (np.sqrt(base_v) + 1e-7)


def odds(x: float) -> float:
    """The score of a place on the grid of log odds."""
    return float(1 / (1 + np.exp(-x / GRID)))


def best(bins: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The place on the grid, amid the range of thresholds, that gives the best F1 of those that take no more than
    MOST_FALSE of the rows of label 0 (one, if that is less); bins of log odds rise, n texts and hits
    texts of label 1 are in each. If every threshold takes more, the place over all bins."""
    bins, n, hits = bins[::-1].astype(np.int64), n[::-1], hits[::-1]
    false, right = np.cumsum(n - hits), np.cumsum(hits)
    f1 = np.where(false <= max(1, MOST_FALSE * false[-1]), 2 * right / (np.cumsum(n) + right[-1]), -1)
    k = int(f1.argmax())
    if f1[k] < 0:
        return float(bins[0] + 1)
    return float(bins[k] + (bins[k + 1] + 1 if k + 1 < len(bins) else bins[k])) / 2


def least_bar(bins: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The lowest place that takes no more than MOST_FALSE of the rows of label 0, or one row."""
    false = np.cumsum((n - hits)[::-1])
    over = np.flatnonzero(false > max(1, MOST_FALSE * false[-1]))
    return float(bins[::-1][over[0]] + 1) if len(over) else -np.inf


def calibrate(m: Model, counts: pd.DataFrame) -> None:
    """Each language's threshold from (lang, bin, n, hits). That of all rows is the one of the best F1. A
    language's own, by the same rule, has weight hits / (hits + LEAST_HITS) beside that of all, in log
    odds, so that few hits move it little; a language with under LEAST_HITS rows of either label takes
    that of all. No threshold takes more than MOST_FALSE of a language's rows of label 0, or one
    row: it is raised until that holds. Rows without a language take the threshold of all."""
    if not 0 < counts["hits"].sum() < counts["n"].sum():
        return
    by_bin = lambda c: c.groupby("bin")[["n", "hits"]].sum().reset_index().to_numpy().T
    every = best(*by_bin(counts))
    m.default = odds(every)
    for lang, own in counts.groupby("lang"):
        rows = by_bin(own)
        hits, clean = own["hits"].sum(), (own["n"] - own["hits"]).sum()
        share = hits / (hits + LEAST_HITS) if min(hits, clean) >= LEAST_HITS else 0.0
        m.thresholds[lang] = odds(max((share * best(*rows) if share else 0.0) + (1 - share) * every, least_bar(*rows)))


def _logits(m: Model, words: list[np.ndarray]) -> np.ndarray:
    sizes, out = np.array([len(w) for w in words]), [np.zeros(0)]
    for ids in steps(np.arange(len(words)), sizes, 256):
        flat = np.concatenate([words[i] for i in ids])
        out.append((m.pooled(flat, sizes[ids]) @ m.out + m.base).astype(np.float64))
    return np.concatenate(out)


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == FOLD


def packed(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, lang_col: str) -> DataFrame:
    """(bucket, part, y, sizes, langs, z): labels, numbers of words, languages and features of the texts of
    all labelled documents outside the held-out fold, each id once, by the hash of the id."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
        .agg(F.greatest(F.lit(0), F.least(F.lit(1), F.max(label_col).cast("int"))).alias("_y")).where(~held_out("_id"))
    )
    n = chosen.count()
    buckets = n // PACK_ROWS + 1
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), lang.alias("_lang"))
    rows = base.join(F.broadcast(chosen) if n <= WIDE else chosen, "_id").withColumn("_bucket", F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int"))
    rows = rows.repartitionById(buckets, "_bucket").groupBy("_bucket", "_id", "_y").agg(F.min(F.struct("_text", "_lang")).alias("d"))
    rows = rows.select("_bucket", "_id", "_y", "d._text", "d._lang").sortWithinPartitions("_bucket", F.xxhash64("_id"), "_id")

    form = "bucket int, part int, y binary, sizes binary, langs array<string>, z binary"
    arrow = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("y", pa.binary()), ("sizes", pa.binary()), ("langs", pa.list_(pa.string())), ("z", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, part, total = None, 0, 0
        y: list[int] = []
        langs: list[str | None] = []
        sizes: list[int] = []
        z: list[bytes] = []
        squeeze = zstandard.ZstdCompressor(level=1).compressobj()

        def out() -> pa.RecordBatch:
            z.append(squeeze.flush())
            return pa.RecordBatch.from_pydict({"bucket": [bucket], "part": [part], "y": [np.array(y, dtype=np.int8).tobytes()], "sizes": [np.array(sizes, dtype=np.int64).tobytes()], "langs": [langs], "z": [b"".join(z)]}, schema=arrow)

        for b in batches:
            for lo in range(0, b.num_rows, 64):
                c = b.slice(lo, 64).to_pydict()
                for own, label, w, lang in zip(c["_bucket"], c["_y"], encoded(c["_text"]), c["_lang"]):
                    if sizes and (own != bucket or total + len(w) > PACK_WORDS):
                        yield out()
                        part = part + 1 if own == bucket else 0
                        y, langs, sizes, z, total = [], [], [], [], 0
                        squeeze = zstandard.ZstdCompressor(level=1).compressobj()
                    bucket = own
                    y.append(label)
                    langs.append(lang)
                    sizes.append(len(w))
                    z.append(squeeze.compress(np.ascontiguousarray(w).reshape(-1).view(np.uint8)))
                    total += len(w)
        if sizes:
            yield out()

    return written(rows.mapInArrow(lean(pack), form), docs.sparkSession)


def unpacked(r) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Words, labels and halves (every other text) of a pack."""
    sizes, y = np.frombuffer(r.sizes, dtype=np.int64), np.frombuffer(r.y, dtype=np.int8).astype(np.int64)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.z), max_output_size=max(1, 8 * int(sizes.sum()))), dtype=np.uint16).reshape(-1, 4)
    return np.split(flat, np.cumsum(sizes)[:-1]), y, np.arange(len(y)) % 2


def told(packs: DataFrame, tell, dtype, mean: bool) -> dict[int, np.ndarray]:
    """Sums by model over all packs of the vectors that tell(row) gives as (model, weight, vector), or
    each number's weighted mean over the packs where it isn't 0. Summed by slices, in the order of packs."""

    kept = np.float32 if mean else np.float64
    names, ints = ("k", "at", "bucket", "part", "weight", "v"), pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in singly(batches):
            for k, weight, v in tell(r):
                cut = [v[a : a + SLICE].astype(dtype).tobytes() for a in range(0, len(v), SLICE)]
                same = lambda x, kind=ints, n=len(cut): pa.array([x] * n, kind)
                yield pa.RecordBatch.from_arrays([same(k), pa.array(range(len(cut)), ints), same(r.bucket), same(r.part), same(float(weight), pa.float64()), pa.array(cut, pa.binary())], names=names)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        num = den = 0.0
        for weight, v in rows.sort_values(["bucket", "part"])[["weight", "v"]].itertuples(index=False):
            x = np.frombuffer(v, dtype=dtype).astype(np.float64)
            num, den = num + weight * x, den + weight * (x != 0)
        return pd.DataFrame({"k": rows["k"].iloc[:1], "at": rows["at"].iloc[:1], "v": [(num / np.maximum(den, 1) if mean else num).astype(kept).tobytes()]})

    rows = packs.mapInArrow(lean(run), "k int, at int, bucket int, part int, weight double, v binary").groupBy("k", "at").applyInPandas(add, "k int, at int, v binary").collect()  # three models
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["k"], r["at"])):
        out.setdefault(r["k"], []).append(np.frombuffer(bytes(r["v"]), dtype=kept))
    freed(packs.sparkSession)
    return {k: np.concatenate(v) for k, v in out.items()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> Model:
    """A model from all labelled documents outside the held-out fold, whole texts. Its thresholds come from
    the same rows, each scored by a model of the half that the row isn't in, on a grid of 1/GRID in log odds.

    Contradicting labels of an id count as 1, labels other than 0 and 1 as the nearer. Rows without an
    id or label take no part; a null text counts as empty; of rows with one id the least text is taken,
    so that repeated rows count once; other columns are ignored. Without labelled rows, or with one
    label alone, every text gets the share of label 1.
    """
    sc = docs.sparkSession.sparkContext
    packs = packed(docs, labels, id_col, text_col, label_col, lang_col)

    def count(r):
        words, y, half = unpacked(r)
        seen, hit = np.zeros((2, 2, BUCKETS + 1)), np.zeros(BUCKETS, dtype=bool)
        for w, label, h in zip(words, y, half):
            hit[w.reshape(-1)] = True
            own = np.flatnonzero(hit)
            hit[own] = False
            seen[h, label, own] += 1
            seen[h, label, -1] += 1
        for h in (0, 1):
            yield h, 1, seen[h].reshape(-1)

    seen = told(packs, count, np.float32, mean=False)
    of = [seen.get(h, np.zeros(2 * (BUCKETS + 1))).reshape(2, -1) for h in (0, 1)]
    models = [start(x[:, :-1], int(x[0, -1]), int(x[1, -1])) for x in (*of, of[0] + of[1])]
    for turn in range(ROUNDS if models[2].fitted else 0):
        shared = sc.broadcast(models)

        def learn(r, turn=turn, shared=shared):
            words, y, half = unpacked(r)
            for k, m in enumerate(shared.value):
                ids = np.flatnonzero(half == k) if k < 2 else np.arange(len(y))
                if m.fitted and len(ids):
                    own = Model(m.embed.copy(), [x.copy() for x in m.kernels], [x.copy() for x in m.biases], m.out.copy(), m.base, share=m.share)
                    train(own, [words[i] for i in ids], y[ids], np.random.default_rng([turn, r.bucket, r.part]))
                    yield k, len(ids), own.since(m, np.float16)

        for k, by in told(packs, learn, np.float16, mean=True).items():
            models[k].move(by)
        shared.destroy()
    shared = sc.broadcast(models)

    form = pa.schema([("lang", pa.string()), ("bin", pa.int64()), ("n", pa.int64()), ("hits", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in singly(batches):
            words, y, half = unpacked(r)
            for h in (0, 1):
                ids = np.flatnonzero(half == h)
                if shared.value[1 - h].fitted and len(ids):
                    x = np.clip(_logits(shared.value[1 - h], [words[i] for i in ids]), -FARTHEST, FARTHEST)
                    c = pd.DataFrame({"lang": [r.langs[i] for i in ids], "bin": np.floor(x * GRID).astype(np.int64), "n": 1, "hits": y[ids]})
                    yield pa.RecordBatch.from_pandas(c.groupby(["lang", "bin"], dropna=False, as_index=False).sum(), form, preserve_index=False)

    judged = packs.mapInArrow(lean(judge), "lang string, bin long, n long, hits long").groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    calibrate(models[2], judged.toPandas())  # at most 2 * GRID * FARTHEST + 1 rows a language
    shared.destroy()
    dropped(packs)
    return models[2]


def rated(m: Model, batches: Iterator[pa.RecordBatch], text_col: str, lang_col: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, scores, thresholds) of all batches, a few rows at a time, so that neither a worker nor its
    executor holds a batch twice."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            rows = b.slice(lo, ROWS)
            langs = rows.column(lang_col).to_pylist() if lang_col in b.schema.names else [None] * rows.num_rows
            yield rows, m.scores([t or "" for t in rows.column(text_col).to_pylist()]), np.array([m.thresholds.get(x, m.default) for x in langs], dtype=np.float64)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id_col, score (0 to 1), predicted (1 if score >= 0.5), toxic (1 if the
    score reaches its language's calibrated threshold).

    The score depends on the text alone, the whole of it; texts longer than a block are pooled block
    by block. A null text counts as empty and has the score of an empty one. Rows without an id take
    no part; repeated rows give repeated rows; other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), lang.alias("_lang"))

    names = [id_col, "score", "predicted", "toxic"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, s, bar in rated(shared.value, batches, "_text", "_lang"):
            yield pa.RecordBatch.from_arrays([rows.column("_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array((s >= bar).astype(np.int32))], names=names)

    kind = base.schema["_id"].dataType.simpleString()
    return base.mapInArrow(lean(score), f"`{id_col}` {kind}, score double, predicted int, toxic int")


def clean(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose text's score stays under its language's threshold. A null
    text has the score of an empty one, a null language the threshold of all; rows without an id and
    repeated rows are judged like any other; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, s, bar in rated(shared.value, batches, text_col, lang_col):
            yield rows.filter(pa.array(s < bar))

    return docs.mapInArrow(lean(run), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "toxic")
