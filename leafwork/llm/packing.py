"""Best-fit packing of tokenized documents into sequences of one length.

The plan is made on the histogram of piece lengths alone, which has at most as many entries as a
sequence has tokens, whatever the corpus. Its rows say, for each length, which run of ranks goes to
which sequences; pieces look their rank up.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, mix, passes, table, written

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SEQUENCE = 4096
#: Units that lengths are rounded up to for the patterns, and documents in a pattern at most.
GRID, FEW = 64, 4
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 1_500_000


class Coder:
    """Token ids of whole texts, by the tokenizer's own rules.

    A text of plain Latin characters is cut into the tokenizer's words with array operations, and
    each distinct word is tokenized once; any other text goes to the tokenizer as it is.
    """

    _own: dict[str, Coder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        top = 0x2100
        chars = [chr(i) for i in range(top)]
        kind = np.zeros(top, dtype=np.uint8)  # 0 other, 1 letter, 2 digit, 3 space, 9 not for here
        for i, c in enumerate(chars):
            g = unicodedata.category(c)
            kind[i] = 1 if g[0] == "L" else 2 if g[0] == "N" else 3 if c.isspace() else 0
            if not (32 <= i < 0x250 and i not in (0x7F, 0x85, 0x130) or c in "\t\n\r\f\v" or 0x2010 <= i <= 0x2027):
                kind[i] = 9
        self.kind = kind
        self.value = np.random.default_rng(77).integers(0, 2**64, top, dtype=np.uint64)
        self.forget()

    @classmethod
    def at(cls, path: str) -> Coder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        counts, flat = np.zeros(len(words), dtype=np.int64), []
        for i in range(0, len(words), 512):
            part = words[i : i + 512]
            code = self.slow.encode(" ".join(part), add_special_tokens=False)
            counts[i : i + len(part)] = np.bincount(np.array(code.word_ids, dtype=np.int64), minlength=len(part))
            flat.append(np.array(code.ids, dtype=np.uint32))
        first = np.cumsum(counts) - counts + len(self.ids)
        self.ids = np.concatenate([self.ids, *flat])
        at = np.searchsorted(self.known, hashes)
        self.known, self.first, self.count = np.insert(self.known, at, hashes), np.insert(self.first, at, first), np.insert(self.count, at, counts)

    def plain(self, text: str) -> bool:
        if "<|" in text or not unicodedata.is_normalized("NFC", text):
            return False
        if text.isascii():
            return not any(c in text for c in _ODD)
        return True

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """ids of each text, in order."""
        lowered = [t.lower() if self.plain(t) else None for t in texts]
        for lo, hi in passes([t or "" for t in lowered]):
            yield from self._some(texts[lo:hi], lowered[lo:hi])

    def _some(self, texts: list[str], lowered: list) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        here = [i for i, t in enumerate(lowered) if t is not None]
        joined = "\n".join(lowered[i] for i in here) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(lowered[i]) + 1 for i in here]) if here else np.zeros(0, dtype=np.int64)
        high = cp >= len(self.kind)
        kind = self.kind[np.where(high, 0x2FF, cp)]
        odd = kind == 9
        if odd.any():
            which = np.unique(np.searchsorted(ends, np.flatnonzero(odd), side="right"))
            for w in which:
                kind[ends[w - 1] if w else 0 : ends[w]] = 3
        else:
            which = np.zeros(0, dtype=np.int64)
        before = np.concatenate([[3], kind[:-1]])
        start = (kind != 3) & ((kind != before) | (kind == 2))
        # 's 't 'm 'd and 're 've 'll are words of their own where a word begins with the mark
        marks = np.flatnonzero(start & (cp == 39))
        if len(marks):
            a = np.concatenate([cp, [10, 10, 10]])
            one, two = a[marks + 1], a[marks + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for m, n in ((marks[short], 2), (marks[long], 3)):
                start[m + 1] = False
                if n == 3:
                    start[m + 2] = False
                nxt = m + n
                nxt = nxt[nxt < len(kind)]
                start[nxt] = kind[nxt] != 3
        begin = np.flatnonzero(start)
        if len(begin):
            # a word ends where the next begins or white space does
            space = np.flatnonzero(kind == 3)
            end = np.minimum(np.append(begin[1:], len(cp)), np.append(space, len(cp))[np.searchsorted(space, begin)])
            hashes = self._hash(cp, begin, end)
            distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.searchsorted(self.known, distinct)
            new = (at == len(self.known)) | (self.known[np.minimum(at, max(len(self.known) - 1, 0))] != distinct) if len(self.known) else np.ones(len(distinct), dtype=bool)
            if new.any():
                if len(self.known) + new.sum() > REMEMBERED:
                    self.forget()
                    new[:] = True  # all words of this pass, however many
                self.learn(distinct[new], [joined[begin[k] : end[k]] for k in where[new]])
                at = np.searchsorted(self.known, distinct)
            first, count = self.first[at][back], self.count[at][back]
            total = np.cumsum(count)
            flat = self.ids[np.repeat(first - (total - count), count) + np.arange(total[-1])]
            cut = np.searchsorted(begin, ends)  # words before each text's end
            upto = np.concatenate([[0], total])[cut]
        else:
            flat, upto = np.zeros(0, dtype=np.uint32), np.zeros(len(ends), dtype=np.int64)
        low = 0
        for i, u in zip(here, upto):
            out[i] = flat[low:u]
            low = u
        for i in [*(here[w] for w in which), *(i for i, t in enumerate(lowered) if t is None)]:
            out[i] = np.array(self.slow.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
        return out

    def _hash(self, cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        v = self.value[np.minimum(cp, len(self.value) - 1)]
        # sums of values by place: a word's letters weigh with odd powers counted from its begin
        place = np.arange(len(cp)) - np.repeat(begin, np.diff(np.append(begin, len(cp)))) if begin[0] == 0 else np.arange(len(cp)) - np.concatenate([np.zeros(begin[0], dtype=np.int64), np.repeat(begin, np.diff(np.append(begin, len(cp))))])
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(v + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
        return mix(sums[end] - sums[begin])


_ODD = [chr(i) for i in range(32) if chr(i) not in "\t\n\r\f\v"] + ["\x7f"]


def tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, id_col: str, text_col: str, size: int = SEQUENCE, tokenizer: str | None = None) -> DataFrame:
    """(_id, piece, start, length, ids_crc32, part, rank): rank counts the earlier pieces of the same
    length in the same task, whose number is part."""
    base = keyed(docs, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, seen, part = Coder.at(tokenizer_path(tokenizer)), np.zeros(size + 1, dtype=np.int64), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for key, ids in zip(b["_id"], coder.encode(list(b["_text"]))):
                ids = np.append(ids, np.uint32(END_ID))
                for k, start in enumerate(range(0, len(ids), size)):
                    own = ids[start : start + size]
                    n = len(own)
                    rows.append((key, k, start, n, zlib.crc32(own.astype("<u4").tobytes()), part, seen[n]))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    kind = base.schema["_id"].dataType.simpleString()
    return base.mapInPandas(run, f"_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by an active set."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    scale = 1e-9 * max(1.0, np.abs(a.T @ b).max())
    for _ in range(rounds):
        g = a.T @ (b - a @ x)
        g[on] = -np.inf
        j = int(g.argmax())
        if g[j] <= scale:
            break
        on[j] = True
        while True:
            z = np.zeros_like(x)
            z[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if z[on].min() > 0:
                break
            bad = on & (z <= 0)
            step = (x[bad] / np.maximum(x[bad] - z[bad], 1e-300)).min()
            x += step * (z - x)
            gone = on & (x <= 1e-9)
            on &= ~gone
            x[gone] = 0
            if not on.any():
                z = x
                break
        x = z
    return x


def patterns(total: int, few: int) -> list[tuple[int, ...]]:
    """Falling lists of up to few whole numbers with the given sum."""
    out: list = []

    def grow(rest: int, most: int, head: tuple) -> None:
        if rest == 0:
            out.append(head)
        elif len(head) < few:
            for k in range(min(most, rest), -(-rest // (few - len(head))) - 1, -1):
                grow(rest - k, k, (*head, k))

    grow(total, total, ())
    return out


def plan(histogram: np.ndarray, size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), from the number of pieces by length."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    unit = max(1, -(-size // GRID))
    grid = -(-size // unit)
    bucket = -(-np.arange(size + 1) // unit)

    def best(room: int, own: dict) -> int:
        """The greatest length that fits and is there beyond what this sequence already takes."""
        have = left[: room + 1] > 0
        for k, n in own.items():
            if k <= room and left[k] <= n:
                have[k] = False
        return int(room - have[::-1].argmax()) if have.any() else 0

    def take(head: list[int], most: int) -> int:
        own: dict[int, int] = {}
        room, items = size, []
        for k in head:
            own[k] = own.get(k, 0) + 1
            items.append(k)
            room -= k
        while room > 0 and (k := best(room, own)):
            own[k] = own.get(k, 0) + 1
            items.append(k)
            room -= k
        n = min(most, min(int(left[k]) // c for k, c in own.items()))
        for k, c in own.items():
            left[k] -= n * c
        out.append((tuple(items), n))
        return n

    weight = np.bincount(bucket, weights=left, minlength=grid + 1)[1:]
    if weight.sum() > 0:
        shapes = patterns(grid, FEW)
        a = np.zeros((grid, len(shapes)))
        for j, s in enumerate(shapes):
            for k in s:
                a[k - 1, j] += 1
        # Many long documents wait for short ones: what is left over of the short costs less.
        cost = np.sqrt(np.arange(1, grid + 1) / grid)[:, None]
        counts = np.floor(nnls(a * cost, weight * cost[:, 0])).astype(np.int64)
        for j in sorted(np.flatnonzero(counts), key=lambda j: -shapes[j][0]):
            n = int(counts[j])
            while n > 0:
                head, used = [], {}
                for k in shapes[j][:-1]:
                    lo, hi = (k - 1) * unit + 1, min(k * unit, size)
                    have = left[lo : hi + 1].copy()
                    for x, c in used.items():
                        if lo <= x <= hi:
                            have[x - lo] -= c
                    x = int(have.argmax())
                    if have[x] <= 0:
                        break
                    head.append(lo + x)
                    used[lo + x] = used.get(lo + x, 0) + 1
                if len(head) < len(shapes[j]) - 1 or (not head and not best(size, {})):
                    break
                n -= take(head, n)
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        take([top], int(left[top]))
    return out


def slots(packed: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces in a sequence, first sequence, offset), sorted: a length's
    pieces fill its rows one after the other."""
    rows, used, base = [], {}, 0
    for items, n in packed:
        offset = 0
        for k in dict.fromkeys(items):
            m = items.count(k)
            rows.append((k, used.get(k, 0), m, base, offset))
            used[k] = used.get(k, 0) + m * n
            offset += m * k
        base += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and one end id; longer ones are cut into pieces of `size`, and the
    last piece may be shorter. Every piece goes whole into one sequence of at most `size` tokens, side
    by side from 0. A null text counts as empty (one end id). Rows without an id take no part; equal
    rows are packed each; other columns are ignored; an empty table gives an empty result.
    `tokenizer` is the vocabulary file's path. Numbers of sequences are gapless from 0.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col, text_col, size, tokenizer), spark)
    by_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counted = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `size` rows
    histogram = np.zeros(size + 1, dtype=np.int64)
    for r in counted:
        histogram[r["length"]] = r["n"]
    rows = spark.sparkContext.broadcast(slots(plan(histogram, size)))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["part", "length"]).select("_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = rows.value
        wide = np.int64(1) << 50  # (length, rank) as one number; ranks stay under it
        key = s[:, 0] * wide + s[:, 1]
        for b in batches:
            n, r = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            at = s[np.searchsorted(key, n * wide + r, side="right") - 1]
            r = r - at[:, 1]
            yield pd.DataFrame({id_col: b["_id"], **{c: b[c] for c in ("piece", "start", "length", "ids_crc32")}, "sequence_id": at[:, 3] + r // at[:, 2], "offset": at[:, 4] + r % at[:, 2] * n})

    kind = cut.schema["_id"].dataType.simpleString()
    return ranked.mapInPandas(place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
