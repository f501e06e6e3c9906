"""LM scoring: a Katz bigram model with Good-Turing discounts and exactly normalised backoff weights.

Texts are packed into chunks in the shared folder. A chunk asks the partitioned tables about its
distinct words, then about its distinct word pairs, as sorted blocks of hashes; the tables are built
from what the chunks bring, and answer each chunk in its own order. Words are partitioned by their
hash and pairs by that of their history, so that all pairs of a history meet in one partition, where
its backoff weight can be summed. A text is then scored token by token: the pair's discounted
probability where training has the pair, else the history's weight times the word's probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PASS_BYTES, Ranges, dropped, freed, keyed, table, written

#: Bytes of text in a chunk, unless one text has more; distinct entries that a partition of a table
#: gets on average; counts up to K are discounted.
CHUNK_BYTES, PART_ENTRIES, K = 8 << 20, 1_500_000, 5
FOLDS, FOLD = 7, 2
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def planes(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    a = np.ascontiguousarray(a)
    flat = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat).tobytes())


def numbers(raw: bytes, dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(raw)), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(dtype)


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of rising numbers; np.cumsum undoes them."""
    return np.diff(a, prepend=a.dtype.type(0))


def chunks(docs: DataFrame, size: int | None = None) -> DataFrame:
    """(chunk, ids, lens, z): ids as int64, bytes of each text, and the normal texts joined; a chunk has
    about `size` bytes of text (CHUNK_BYTES) or one text."""
    size = CHUNK_BYTES if size is None else size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        volume = 0

        def out() -> pd.DataFrame:
            lens = np.array([len(t) for t in texts], dtype=np.int64)
            return pd.DataFrame({"chunk": [(part << 32) + n], "ids": [planes(np.array(ids, dtype=np.int64))], "lens": [planes(lens)], "z": [zstandard.ZstdCompressor(level=3).compress(b"".join(texts))]})

        for b in batches:
            for key, t in zip(b["_id"], b["_text"]):
                t = b" ".join(t.encode("utf-8", "surrogatepass").lower().split())
                if texts and volume + len(t) > size:
                    yield out()
                    n, volume = n + 1, 0
                    ids.clear()
                    texts.clear()
                ids.append(key)
                texts.append(t)
                volume += len(t)
        if texts:
            yield out()

    return docs.mapInPandas(run, "chunk long, ids binary, lens binary, z binary")


def ranked(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and each number's place among them as int32: np.unique in less memory."""
    order = np.argsort(a)
    rising = a[order]
    new = np.ones(len(a), dtype=bool)
    np.not_equal(rising[1:], rising[:-1], out=new[1:])
    place = np.cumsum(new, dtype=np.int32)
    place -= 1
    back = np.empty(len(a), dtype=np.int32)
    back[order] = place
    return rising[new], back


def singly(batches: Iterator[pa.RecordBatch]):
    """Rows one by one; a batch may hold many chunks, which as Python objects would be there twice."""
    for b in batches:
        for i in range(b.num_rows):
            yield SimpleNamespace(**b.slice(i, 1).to_pylist()[0])


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


class Chunk:
    """Tokens of a chunk: doc is the text that each is from, word and history are places in vocab."""

    def __init__(self, ids: bytes, lens: bytes, z: bytes):
        self.ids, lens = numbers(ids, np.int64), numbers(lens, np.int64)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(z)), dtype=np.uint8)
        edge = np.concatenate([[0], np.cumsum(lens)])
        found, owner, lo = [], [], 0
        while lo < len(lens):  # some texts at a time: hashing takes many times their bytes
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + PASS_BYTES, side="right")) - 1)
            own = lens[lo:hi]
            data = np.full(int(own.sum()) + len(own), 10, dtype=np.uint8)
            data[np.arange(int(own.sum())) + np.repeat(np.arange(len(own)), own)] = raw[edge[lo] : edge[hi]]
            end = np.flatnonzero((data == 32) | (data == 10))
            begin = np.concatenate([[0], end[:-1] + 1])
            doc = lo + np.concatenate([[0], np.cumsum(data[end] == 10)[:-1]])
            full = end > begin
            found.append(Ranges(data, 21).of(begin[full], end[full]))
            owner.append(doc[full].astype(np.int32))
            lo = hi
        del raw
        hashes, doc = np.concatenate(found), np.concatenate(owner)
        del found, owner
        counts = np.bincount(doc, minlength=len(lens))
        first = np.cumsum(counts + 1) - counts - 1
        tokens = np.full(len(hashes) + len(lens) + 1, END, dtype=np.uint64)
        tokens[-1] = START
        tokens[np.arange(len(hashes), dtype=np.int32) + doc] = hashes  # one end after each text
        del hashes, doc
        self.vocab, word = ranked(tokens)
        del tokens
        self.doc = np.repeat(np.arange(len(lens), dtype=np.int32), counts + 1)
        self.word, self.start = word[:-1], word[-1]
        self.history = np.concatenate([word[-1:], word[:-2]])
        self.history[first] = self.start
        self.held_out = np.array([zlib.crc32(str(i).encode()) % FOLDS == FOLD for i in self.ids], dtype=bool)
        self.trains = ~self.held_out[self.doc]

    def words(self) -> np.ndarray:
        """Training count of each word of vocab."""
        return np.bincount(self.word[self.trains], minlength=len(self.vocab))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(history, word, training count) of distinct pairs by history and word, and each token's."""
        n = np.int64(len(self.vocab))
        key, back = ranked(self.history * n + self.word)
        return key // n, key % n, np.bincount(back[self.trains], minlength=len(key)), back


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of hashes: rising with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def ask_words(rows: DataFrame, parts: int) -> DataFrame:
    form = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("h", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in singly(batches):
            c = Chunk(r.ids, r.lens, r.z)
            n = c.words()
            cut = np.searchsorted(part_of(c.vocab, parts), np.arange(parts + 1))
            out = [(p, r.chunk, planes(steps(c.vocab[a:z])), planes(n[a:z])) for p, a, z in zip(range(parts), cut, cut[1:]) if z > a]
            yield batch(dict(zip(form.names, zip(*out))), form)

    return rows.mapInArrow(run, "part int, chunk long, h binary, n binary")


def tally(counts: np.ndarray) -> np.ndarray:
    """Numbers of entries with counts 1 to K + 1."""
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2]


def answer_words(rows: pd.DataFrame) -> pd.DataFrame:
    """One partition of the word table: a row of its statistics, and a row for each chunk."""
    h = [np.cumsum(numbers(x, np.uint64), dtype=np.uint64) for x in rows["h"]]
    n = np.concatenate([numbers(x, np.int64) for x in rows["n"]])
    _, back = np.unique(np.concatenate(h), return_inverse=True)
    total = np.bincount(back, weights=n).astype(np.int64)
    out = [{"chunk": None, "part": rows["part"].iloc[0], "n": None, "stats": [int(total.sum()), int((total > 0).sum()), *tally(total).tolist()]}]
    at = 0
    for chunk, x in zip(rows["chunk"], h):
        out.append({"chunk": chunk, "part": rows["part"].iloc[0], "n": planes(total[back[at : at + len(x)]]), "stats": None})
        at += len(x)
    return pd.DataFrame(out)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discounts by count 0..K+1 (1 beyond K), from the numbers of entries with counts 1 to
    K + 1. Where these give none between 0 and 1 for a count, it is (r - D) / r, D = n1 / (n1 + 2 n2)."""
    d = np.ones(K + 2)
    n1, n2 = n[0], n[1]
    flat = n1 / (n1 + 2 * n2) if n1 else 0.5
    common = (K + 1) * n[K] / n1 if n1 else 1.0
    for r in range(1, K + 1):
        x = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common != 1 else -1.0
        d[r] = x if 0 < x < 1 else (r - min(flat, 0.999)) / r
    return d


class Words:
    """Probabilities of single words, from their training counts; all unseen words are one."""

    def __init__(self, stats: list[int]):
        self.total, self.kinds, own = stats[0], stats[1], stats[2:]
        self.d = discounts(own)
        kept = self.total - sum((1 - self.d[r]) * r * own[r - 1] for r in range(1, K + 1))
        self.scale = 1.0
        if self.total and self.total - kept < 1e-9 * self.total:  # nothing is left for unseen words
            self.scale = self.total / (self.total + 1)
        self.unseen = 1.0 - kept * self.scale / self.total if self.total else 1.0

    def p(self, n: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(n))
        return np.where(n > 0, self.d[np.minimum(n, K + 1)] * n * (self.scale / self.total), self.unseen)


def ask_pairs(rows: DataFrame, parts: int) -> DataFrame:
    """rows: a chunk with `got`, the answers about its words."""

    form = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), *((k, pa.binary()) for k in ("h", "size", "w", "wn", "n"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in singly(batches):
            c = Chunk(r.ids, r.lens, r.z)
            known = gathered(r.got, np.int64)
            h, w, n, _ = c.pairs()
            of = part_of(c.vocab[h], parts)
            cut = np.searchsorted(of, np.arange(parts + 1))
            out = []
            for p, a, z in zip(range(parts), cut, cut[1:]):
                if z > a:
                    hh, size = np.unique(h[a:z], return_counts=True)
                    out.append((p, r.chunk, planes(steps(c.vocab[hh])), planes(size.astype(np.int32)), planes48(c.vocab[w[a:z]]), planes(known[w[a:z]]), planes(n[a:z])))
            yield batch(dict(zip(form.names, zip(*out))), form)

    return rows.mapInArrow(run, "part int, chunk long, h binary, size binary, w binary, wn binary, n binary")


def planes48(h: np.ndarray) -> bytes:
    """The upper 48 bits of hashes: enough to tell the words after one history apart."""
    return np.ascontiguousarray((h >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def numbers48(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(raw, dtype=np.uint8).reshape(6, -1)
    out = np.zeros((flat.shape[1], 8), dtype=np.uint8)
    out[:, :6] = flat.T
    return out.reshape(-1).view(np.uint64)


def gathered(got, dtype) -> np.ndarray:
    """Answers of all partitions in the order of the partitions, which is that of the hashes."""
    return np.concatenate([numbers(x["n"], dtype) for x in sorted(got, key=lambda x: x["part"])])


def answer_pairs(words: Words):
    """One partition of the pair table. To each chunk: of its pairs the training counts; of its
    histories the count, how many words follow it 1..K times, and the sum of these words' own
    probabilities (over all words that follow it in training)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        hs = [np.cumsum(numbers(x, np.uint64), dtype=np.uint64) for x in rows["h"]]
        sizes = [numbers(x, np.int32) for x in rows["size"]]
        w = np.concatenate([numbers48(x) for x in rows["w"]])
        n = np.concatenate([numbers(x, np.int64) for x in rows["n"]])
        wn = np.concatenate([numbers(x, np.int64) for x in rows["wn"]])
        vocab, hb = np.unique(np.concatenate(hs), return_inverse=True)
        h = np.repeat(hb, np.concatenate(sizes))
        order = np.lexsort((w, h))
        sh, sw = h[order], w[order]
        new = np.concatenate([[True], (sh[1:] != sh[:-1]) | (sw[1:] != sw[:-1])])
        kind = np.cumsum(new) - 1
        total = np.bincount(kind, weights=n[order]).astype(np.int64)
        own, p = sh[new], words.p(wn[order][new])
        seen = total > 0
        m = len(vocab)
        count = np.bincount(own, weights=total, minlength=m).astype(np.int64)
        low = np.bincount(own[seen], weights=p[seen], minlength=m)
        few = np.stack([np.bincount(own[total == r], minlength=m) for r in range(1, K + 1)])
        back = np.empty(len(h), dtype=np.int64)
        back[order] = kind
        part = rows["part"].iloc[0]
        out = [{"chunk": None, "part": part, "n": None, "count": None, "few": None, "low": None, "stats": tally(total).tolist()}]
        a = z = 0
        for chunk, x, size in zip(rows["chunk"], hs, sizes):
            mine, pairs = hb[a : a + len(x)], int(size.sum())
            out.append({"chunk": chunk, "part": part, "n": planes(total[back[z : z + pairs]]), "count": planes(count[mine]), "few": planes(few[:, mine].T.reshape(-1)), "low": planes(low[mine]), "stats": None})
            a, z = a + len(x), z + pairs
        return pd.DataFrame(out)

    return run


def backoff(count: np.ndarray, few: np.ndarray, low: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor on a history's discounted probabilities, its backoff weight): what discounts leave,
    shared among words that don't follow it in proportion to their own probabilities. A history whose
    discounts leave nothing gives up one part in count + 1; one that all words follow keeps all."""
    n = np.maximum(count, 1)
    left = (few * ((1 - d[1 : K + 1]) * np.arange(1, K + 1))).sum(axis=1) / n
    none = left < 1e-12
    factor = np.where(none, n / (n + 1.0), 1.0)
    left = np.where(none, 1.0 / (n + 1.0), left)
    rest = 1.0 - low
    all_follow = rest < 1e-12
    factor = np.where(all_follow, factor / np.maximum(1 - left, 1e-12), factor)
    weight = np.where(all_follow, 0.0, left / np.where(all_follow, 1.0, rest))
    return np.where(count > 0, factor, 0.0), np.where(count > 0, weight, 1.0)


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; after the last comes one end, a token too; the
    first word's history is a start that is no token. Documents whose crc32(id as text) mod 7 is 2 are
    held out; all others are counted, whole. base_score adds log10((c + 1) / (N + V + 1)); score is the
    sum of log10 of the model's probabilities, which for every history sum to 1 over the words of
    training and one for all others. Null texts count as empty (an end alone). Ids are whole numbers;
    rows without one take no part; equal rows each count and each score; other columns are ignored;
    an empty table gives none. Words are told apart by 64-bit hashes, words after a history by 48.
    """
    spark = docs.sparkSession
    base = keyed(docs, id_col, text_col).withColumn("_id", F.col("_id").cast("long"))
    kind = docs.schema[id_col].dataType
    packed = written(chunks(base), spark)
    volume = packed.agg(F.sum(F.length("z"))).first()[0] or 0
    parts = max(8, int(volume * 3 / 6 / PART_ENTRIES) + 1)  # packed texts are about a third, a word six bytes

    def grouped(asked: DataFrame, answer, schema: str) -> DataFrame:
        return written(asked.groupBy("part").applyInPandas(answer, schema), spark)

    known = grouped(ask_words(packed, parts), answer_words, "chunk long, part int, n binary, stats array<long>")
    stats = known.where("chunk is null").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos").collect()  # K + 3 rows
    words = Words([r["n"] for r in stats] or [0] * (K + 3))
    of_chunk = known.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("part", "n")).alias("got"))
    told = written(packed.join(of_chunk, "chunk"), spark)  # a table, as its shuffle would stay beside that of the pairs
    dropped(packed, known)
    pairs = grouped(ask_pairs(told, parts), answer_pairs(words), "chunk long, part int, n binary, count binary, few binary, low binary, stats array<long>")
    stats = pairs.where("chunk is null").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos").collect()  # K + 1 rows
    d = discounts([r["n"] for r in stats] or [0] * (K + 1))
    freed(spark, 2)  # the largest shuffle, before the answers move
    pairs_of = pairs.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("part", "n", "count", "few", "low")).alias("had"))

    long, real = pa.int64(), pa.float64()
    form = pa.schema([(id_col, long), ("held_out", pa.bool_()), ("n_tokens", long), ("n_known", long), ("train_tokens", long), ("base_score", real), ("score", real)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in singly(batches):
            c = Chunk(r.ids, r.lens, r.z)
            seen = gathered(r.got, np.int64)
            had = sorted(r.had, key=lambda x: x["part"])
            read = lambda k, dtype: np.concatenate([numbers(x[k], dtype) for x in had])
            n, count, low = read("n", np.int64), read("count", np.int64), read("low", np.float64)
            few = read("few", np.int64).reshape(-1, K)
            del r, had
            h, w, _, back = c.pairs()
            histories, at = np.unique(h, return_inverse=True)
            factor, weight = backoff(count, few, low, d)
            p_word = words.p(seen)
            direct = d[np.minimum(n, K + 1)] * n / np.maximum(count[at], 1) * factor[at]
            log = np.log10(np.maximum(np.where(n > 0, direct, weight[at] * p_word[w]), 1e-300))
            size = len(c.ids)
            plain = np.log10((seen + 1) / (words.total + words.kinds + 1))
            yield batch({
                id_col: c.ids, "held_out": c.held_out, "n_tokens": np.bincount(c.doc, minlength=size), "n_known": np.bincount(c.doc, weights=seen[c.word] > 0, minlength=size).astype(np.int64),
                "train_tokens": np.full(size, words.total), "base_score": np.bincount(c.doc, weights=plain[c.word], minlength=size), "score": np.bincount(c.doc, weights=log[back], minlength=size),
            }, form)

    out = told.join(pairs_of, "chunk").mapInArrow(score, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn(id_col, F.col(id_col).cast(kind))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))
