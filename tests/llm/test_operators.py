"""Each operator against a plain version of its rule, on small and odd inputs."""

import html
import os
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from leafwork.llm import anchors, common, decontaminate, html_extract, katz, line_dedup, near_dedup, packing, substring_dedup, suffix_dedup, topk, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, schema=DOC):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], schema)


def prose(seed, n, words=60):
    r = np.random.default_rng(seed)
    return " ".join(f"w{int(x)}" for x in r.integers(0, words, n))


PASSAGE = prose(1, 70, 5000)
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, prose(2, 200)), (6, prose(2, 200)), (7, prose(3, 120, 4000) + " " + PASSAGE + " " + prose(4, 60, 4000)),
    (8, PASSAGE), (9, prose(5, 30, 4000) + "\n" + PASSAGE), (10, "A" * 500), (11, "ñü " * 120), (12, "a\nb\nc\nd\na\nb\nc"), (13, "x\na\nb\nc\ny"), (None, "no id"), (14, "\n\n\n\n\n\n"), (15, " ".join(prose(2, 200).split()[:190] + ["other"] * 3)),
]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_line_dedup(spark):
    seen, want = set(), {}
    for i, t in ODD:
        if i is None:
            continue
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not any(x.strip(" ") for x in w):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        want[i] = (len(lines), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(docs(spark, ODD)).collect()}
    assert got == want


def test_lines_keep_all_columns(spark):
    d = docs(spark, ODD)
    out = line_dedup.without_repeats(d)
    assert out.schema == d.schema
    kept = {r.doc_id: r for r in out.collect()}
    assert 1 in kept and kept[1].text is None and None in kept and kept[13].text == "x\ny" and kept[13].n_chars == 3


@pytest.mark.parametrize("crowd, together", [(512, 2000), (1, 1)])
def test_substring_dedup(spark, monkeypatch, crowd, together):
    monkeypatch.setattr(anchors, "CROWD", crowd)
    monkeypatch.setattr(anchors, "TOGETHER", together)
    if together == 1:
        monkeypatch.setattr(anchors, "PASS_BYTES", 500)
        monkeypatch.setattr(anchors, "PIECE_BYTES", 500)
    first, want = {}, {}
    rows = [(i, words(t)) for i, t in ODD if i is not None]
    for i, w in rows:
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    for i, w in rows:
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        want[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs(spark, ODD)).collect()}
    assert got == want


@pytest.mark.parametrize("crowd, together", [(512, 2000), (1, 1)])
def test_suffix_dedup(spark, monkeypatch, crowd, together):
    monkeypatch.setattr(anchors, "CROWD", crowd)
    monkeypatch.setattr(anchors, "TOGETHER", together)
    if together == 1:
        monkeypatch.setattr(anchors, "PASS_BYTES", 500)
        monkeypatch.setattr(anchors, "PIECE_BYTES", 500)
    seen, want = set(), {}
    for i, t in ODD:
        if i is None:
            continue
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        want[i] = (len(raw), sum(cover), len(re.findall(rb"\x01+", bytes(cover))), kept)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs(spark, ODD)).collect()}
    assert got == want


def test_interval_expansion_gives_common_prefixes():
    rng = np.random.default_rng(7)
    s = np.concatenate([rng.integers(1, 4, 300), [0]]).astype(np.int32)
    sa = suffix_dedup.suffix_array(s, len(s))
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    sa = suffix_dedup.suffix_array(s, 6)
    got = suffix_dedup.short_prefixes(s[sa - 1], 6)
    for k in range(1, len(sa)):
        a, b = s[sa[k - 1] :].tolist(), s[sa[k] :].tolist()
        n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got[k] == (n if n < 6 else -1)


def brute_components(rows, width):
    sets = {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set(zip(*[w[k:] for k in range(width)])) if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near_rows():
    rng, out = np.random.default_rng(11), [(i, t) for i, t in ODD if i is not None]
    base = prose(20, 80, 900).split()
    for i in range(100, 160):
        w = list(base)
        for p in rng.integers(0, 80, int(rng.integers(0, 9))):
            w[p] = f"v{int(rng.integers(0, 9))}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("paired, block", [(64, 400_000), (3, 400_000), (3, 600)])
def test_near_dedup(spark, monkeypatch, paired, block):
    monkeypatch.setattr(near_dedup, "PAIRED", paired)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(docs(spark, rows), width=2).collect()}
    assert got == brute_components(rows, 2)


def links_of(ids, sets):
    """The smallest id that each set reaches, all pairs compared."""
    low = dict(zip(ids, ids))
    for _ in ids:
        for i, a in zip(ids, sets):
            for j, b in zip(ids, sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
    return [low[i] for i in ids]


def test_links_after_lists_are_cut():
    chain = [set(range(60 * k, 60 * k + 600)) for k in range(8)]  # each is linked with the next alone
    rng, many = np.random.default_rng(4), []
    for g in range(3):
        base = rng.integers(10**6 * g, 10**6 * (g + 1), 500)
        for k in range(12):
            many.append({*base[40 * k : 40 * k + 400].tolist(), *base[: max(0, 40 * k - 100)].tolist()})
    for sets in (chain, many, many[::-1]):
        ids = np.arange(10, 10 + len(sets))
        got = near_dedup.linked_groups(ids, [np.array(sorted(s), dtype=np.uint64) for s in sets], 80)
        assert sum(map(len, sets)) > 4096 and got.tolist() == links_of(ids.tolist(), sets)


def test_decontamination(spark):
    items = spark.createDataFrame([(1, PASSAGE), (2, "Alpha beta, gamma"), (3, None), (4, ""), (None, "x y z"), (5, prose(2, 40))], "item_id long, text string")
    rows = [*ODD, (20, "some ALPHA Beta gamma. More"), (21, " ".join(PASSAGE.split()[:50]))]
    tok = lambda t: re.findall(r"\w+", (t or "").lower())
    grams = lambda w, n: {tuple(w[p : p + n]) for p in range(len(w) - n + 1)}
    want = set()
    for i, t in rows:
        for k, x in [(1, PASSAGE), (2, "Alpha beta, gamma"), (5, prose(2, 40))]:
            n = min(5, len(tok(x)))
            q = grams(tok(x), n)
            hit = len(q & grams(tok(t), n))
            if i is not None and 5 * hit >= 4 * len(q):
                want.add((i, k, hit, len(q)))
    for most in (2_000_000, 40):
        got = {(r.doc_id, r.item_id, r.n_found, r.n_item) for r in decontaminate.contained(docs(spark, rows), items, most=most).collect()}
        assert got == want


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [*ODD, (30, prose(9, 3000, 10**6)), (31, "it's <|endoftext|> O'Re'll 'sx\x01 Σας İ 中文 £5"), (32, "a"), (32, "a")]
    tok = Tokenizer.from_file(packing.tokenizer_path(None))
    want = Counter()
    for i, t in rows:
        if i is None:
            continue
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, s in enumerate(range(0, len(ids), 512)):
            want[(i, k, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes()))] += 1
    got = packing.pack(docs(spark, rows), size=512).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 512
    assert len(by) <= 1 + -(-sum(r.length for r in got) // 512) * 1.1


def test_more_words_in_a_pass_than_are_remembered(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    coder = packing.Coder(packing.tokenizer_path(None))
    letters = lambda *a: prose(*a).translate({48 + i: 97 + i for i in range(10)})  # noqa: E731 (digits are words of one letter)
    for text in ("some words here", "some words here and " + letters(6, 400, 300), "here again", letters(6, 90, 300)):
        assert next(coder.encode([text])).tolist() == coder.slow.encode(text, add_special_tokens=False).ids


def test_plan_is_near_the_bound():
    h = np.zeros(4097, dtype=np.int64)
    for n in np.random.default_rng(3).lognormal(6, 1, 20_000).astype(int).clip(1, 4096):
        h[n] += 1
    made = packing.plan(h)
    back = np.zeros_like(h)
    for items, n in made:
        assert sum(items) <= 4096
        for k in items:
            back[k] += n
    assert (back == h).all() and sum(n for _, n in made) <= 1.01 * (h * np.arange(4097)).sum() / 4096 + 1


def test_top_k(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    v[50] = v[51] = v[52]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (None, [1.0] * 8), (450, [1.0, 2.0]), (3, v[3].tolist())]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), __import__("pyspark.sql.functions", fromlist=["col"]).col("vec_id") % 50 == 0, shard_rows=60).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    for i in range(0, 400, 50):
        s = q @ q[i]
        top = sorted((-int(s[j]), j) for j in range(400) if j != i)[:5]
        assert sorted(got.pop(i)) == [(k + 1, j, -a) for k, (a, j) in enumerate(top)]
    assert not got


def test_katz(spark, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(katz, "PART_ENTRIES", 50)
    rows = [(i, t) for i, t in ODD if i is not None] + [(i, prose(i, 60, 40)) for i in range(200, 240)]
    tok = {i: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tok}
    uni = Counter(w for i, t in tok.items() if not held[i] for w in t)
    n, kinds = sum(uni.values()), len(uni)
    got = {r.doc_id: r for r in katz.katz_scores(docs(spark, rows)).collect()}
    assert set(got) == set(tok)
    for i, t in tok.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(uni[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((uni[w] + 1) / (n + kinds + 1)) for w in t))
        assert r.score == pytest.approx(sum(katz_logs(tok, held, [w for w in t])))


def test_katz_chunk_memory():
    texts = [prose(i, 2000, 3000).encode() for i in range(60)]
    packed = katz.planes(np.arange(60)), katz.planes(np.array([len(t) for t in texts])), katz.zstandard.ZstdCompressor().compress(b"".join(texts))
    katz.Chunk(*packed)  # powers of the hash are kept
    tracemalloc.start()
    try:
        c = katz.Chunk(*packed)
        assert tracemalloc.get_traced_memory()[1] < 80 * len(c.word)
        tracemalloc.reset_peak()
        h, w, _, back = c.pairs()
        assert tracemalloc.get_traced_memory()[1] < 70 * len(c.word)
    finally:
        tracemalloc.stop()
    want = [x for i, t in enumerate(texts) for x in ["<", *t.split(), ">"][:-1]]
    assert len(c.word) == 60 * 2001 and len(set(want)) == len(np.unique(c.history))
    assert np.array_equal(h[back], c.history) and np.array_equal(w[back], c.word)


def good_turing(counts):
    n = Counter(counts)
    common = 6 * n[6] / n[1] if n[1] else 1
    flat = min(0.999, n[1] / (n[1] + 2 * n[2])) if n[1] else 0.5
    out = {}
    for r in range(1, 6):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common != 1 else -1
        out[r] = x if 0 < x < 1 else (r - flat) / r
    return out


def katz_logs(tok, held, text):
    """log10 probabilities of a text's tokens by the plain rule: a known pair's discounted share, else
    the history's weight, summed over its followers one by one, times the word's own probability."""
    key = id(tok)
    if key not in _MODELS:
        uni, pairs, after = Counter(), Counter(), {}
        for i, t in tok.items():
            if not held[i]:
                for a, b in zip(["<start>", *t], t):
                    uni[b] += 1
                    pairs[a, b] += 1
                    after.setdefault(a, set()).add(b)
        _MODELS[key] = uni, pairs, after, good_turing(uni.values()), good_turing(pairs.values())
    uni, pairs, after, d1, d2 = _MODELS[key]
    total = sum(uni.values())
    one = {w: d1.get(c, 1) * c / total for w, c in uni.items()}
    unseen = 1 - sum(one.values())
    assert unseen > 1e-6
    out = []
    for a, b in zip(["<start>", *text], text):
        own = after.get(a, ())
        n = sum(pairs[a, w] for w in own)
        direct = {w: d2.get(pairs[a, w], 1) * pairs[a, w] / n for w in own}
        left = 1 - sum(direct.values())
        if own and left < 1e-12:
            direct, left = {w: p * n / (n + 1) for w, p in direct.items()}, 1 / (n + 1)
        rest = 1 - sum(one[w] for w in own)
        out.append(np.log10(direct[b] if b in direct else (left / rest if own else 1) * one.get(b, unseen)))
        if own:
            assert sum(direct.values()) + (left / rest) * (sum(p for w, p in one.items() if w not in direct) + unseen) == pytest.approx(1)
    return out


_MODELS: dict = {}


def test_backoff_sums_to_one():
    rng = np.random.default_rng(2)
    w = katz.Words([1000, 50, 10, 8, 6, 5, 4, 3])
    for counts in ([1, 1, 2, 7], [9, 9], [1], [6] * 3):
        c = np.array(counts)
        p = w.p(rng.integers(1, 20, len(c)))
        d = katz.discounts([30, 12, 7, 5, 4, 3])
        few = np.array([[int((c == r).sum()) for r in range(1, katz.K + 1)]])
        factor, weight = katz.backoff(np.array([c.sum()]), few, np.array([p.sum()]), d)
        direct = d[np.minimum(c, katz.K + 1)] * c / c.sum() * factor[0]
        assert 0 < weight[0] and direct.sum() + weight[0] * (1 - p.sum()) == pytest.approx(1)


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(400):
        w = prose(i, int(rng.integers(5, 80)), 400).split()
        bad = i % 4 == 0
        if bad:
            w[int(rng.integers(0, len(w)))] = ["scumbag", "vequxyz", "vequabc"][i % 3]
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    d, labels = docs(spark, [*rows, (900, None), (901, ""), (None, "x")]), spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.fit(d, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(d, m).collect()}
    test = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == marks[i][1] for i in test]) > 0.95
    assert set(got) == {i for i, _ in rows} | {900, 901} and got[900].score == got[901].score
    long = "w1 " * 600_000 + "scumbag w2 w3"
    assert m.scores([long])[0] > 0.5 and m.scores(["w1 " * 600_000])[0] < 0.5
    twice = toxicity.fit(d.unionAll(d), labels)
    assert twice.default == m.default and np.array_equal(twice.out, m.out)  # repeated rows count once
    kept = toxicity.clean(d.withColumn("lang", F.lit(None).cast("string")), m)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < m.default} | {None}
    empty = toxicity.fit(d.limit(0), labels.limit(0))
    assert toxicity.toxicity(d.limit(0), empty).count() == 0


def test_toxicity_learns_from_all_labelled_rows(spark):
    ids = [i for i in range(10_500) if zlib.crc32(str(i).encode()) % 5]
    order = [r.id for r in spark.createDataFrame([(i,) for i in ids], "id long").orderBy(F.xxhash64("id")).collect()]
    late = set(order[8000:])  # label 1 is only beyond the 8000 smallest hashes
    assert len(late) > 300
    rows = [(i, prose(i, 4, 300) + (" vequxyz" if i in late else "")) for i in ids] + [(20_000, "w1 w2 vequxyz w3"), (20_001, "w1 w2 w3")]
    m = toxicity.fit(docs(spark, rows), spark.createDataFrame([(i, int(i in late)) for i in ids], "doc_id long, toxic int"))
    got = m.scores([t for _, t in rows[-2:]])
    assert got[0] > 0.5 > got[1] and got[1] < m.default <= got[0]


def test_toxicity_packs_hold_each_row_once(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PACK_ROWS", 40)
    monkeypatch.setattr(toxicity, "PACK_WORDS", 700)
    monkeypatch.setattr(toxicity, "STEP_WORDS", 300)
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    rows = [(i, None if i == 7 else prose(i, 30, 200) + (" scumbag" if i % 4 == 0 else "")) for i in range(300)]
    d, labels = docs(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    want = Counter((int(i % 4 == 0), len(words(t))) for i, t in rows if zlib.crc32(str(i).encode()) % 5)
    models = []
    for wide in (10**6, 0):  # labels broadcast, and joined by shuffle
        monkeypatch.setattr(toxicity, "WIDE", wide)
        packs = toxicity.packed(d.unionAll(d), labels, "doc_id", "text", "toxic", "lang").collect()
        assert len(packs) > 6
        got = Counter()
        for r in packs:
            w, y, _ = toxicity.unpacked(r)
            got.update(zip(y.tolist(), map(len, w)))
        assert got == want
        models.append(toxicity.fit(d, labels))
    assert np.array_equal(models[0].flat(), models[1].flat()) and models[0].thresholds == models[1].thresholds
    p = models[0].scores([t or "" for _, t in rows])
    assert np.mean((p >= 0.5) == [i % 4 == 0 for i, _ in rows]) > 0.95
    assert np.mean((p >= models[0].thresholds["en"]) == [i % 4 == 0 for i, _ in rows]) > 0.95


def test_toxicity_holds_few_texts_at_a_time():
    rng = np.random.default_rng(4)
    m = toxicity.start(rng.random((2, toxicity.BUCKETS)) * 100, 3000, 1000)
    vocabulary = prose(5, 3000, 10**6).split()
    texts = [" ".join(vocabulary[i % 2000 : i % 2000 + 300 + i % 700]) for i in range(1500)]
    want = m.scores(texts)  # powers of the hash are kept
    tracemalloc.start()
    try:
        got = m.scores(texts)
        assert tracemalloc.get_traced_memory()[1] < 40 << 20 < 6 * sum(map(len, texts))
        batch = pa.RecordBatch.from_pydict({"id": list(range(1500)), "text": texts})
        tracemalloc.reset_peak()
        parts = [(rows.num_rows, s) for rows, s, _ in toxicity.rated(m, iter([batch]), "text", "lang")]
        assert tracemalloc.get_traced_memory()[1] < 40 << 20 and max(n for n, _ in parts) <= toxicity.ROWS
    finally:
        tracemalloc.stop()
    assert np.array_equal(got, want) and np.allclose(np.concatenate([s for _, s in parts]), want, rtol=1e-5, atol=1e-7)
    alone = [float(m.scores([t])[0]) for t in texts[:40]]
    assert np.allclose(alone, want[:40], rtol=1e-5, atol=1e-7)


def test_toxicity_packs_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PACK_ROWS", 40)
    rows = [(i, prose(i, 10, 200)) for i in range(600)]
    packs = toxicity.packed(docs(spark, rows), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"), "doc_id", "text", "toxic", "lang")
    found = packs.select("bucket", F.input_file_name().alias("file")).distinct().collect()
    assert len(found) == len({r.file for r in found}) == len({r.bucket for r in found}) > 6  # a task for each


def test_html():
    page = """<html><head><title>T</title></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=a>A</a></ul></nav>
    <div class="cookie-notice">We use cookies, many, of them.</div><div id=main><article><h1>Head &amp; line</h1><p>First, with   <b>bold</b> text,<br>and more of it.<p>Second&nbsp;one, yes.
    <ul><li>item, one<li>item two</ul><div class="ad">Buy, now</div><script>if (a<b) x("</p>")</script><aside>Side</aside></article><div class="comments"><p>Nice, very nice, really.</p></div></div>
    <div class="sidebar"><p>Popular, things</p></div><form><p>Sign up, here</p></form><footer>&copy; us</footer></body></html>"""
    assert html_extract.main_text(page).split("\n\n") == ["Head & line", "First, with bold text, and more of it.", "Second one, yes.", "item, one", "item two"]
    assert html_extract.main_text("") == "" and html_extract.main_text("<p></p>") == "" and html_extract.main_text("just text") == "just text"
    assert html_extract.main_text("<div>" * 5000 + "deep text, here" + "</div>" * 5000) == "deep text, here"


HEAD, BODY = "<h1>Head</h1>", "<p>First one, with text, and more of it.</p><p>Second one, yes, and so on.</p>"
WANT = ["Head", "First one, with text, and more of it.", "Second one, yes, and so on."]
THREAD = "<section id=comments>" + "<article><p>Nice, very, long, comment, here, and there, and more, and more.</p></article>" * 3 + "</section>"


@pytest.mark.parametrize("page, more", [
    (f"<body><form><div><article>{HEAD}{BODY}</article></div></form>", []),
    (f"<body><article>{HEAD}{BODY}</article><form><p>Sign up, here</p></form>", []),
    (f"<body><div class='product-review'><article>{HEAD}{BODY}</article></div>", []),
    (f"<article><div class='entry-header'>{HEAD}</div>{BODY}</article>", []),
    (f"<article>{HEAD}{BODY}<p>Value <math><mi>x</mi></math></p></article>", ["Value x"]),
    (f"<article>{HEAD}{BODY}</article>{THREAD}", []),
    (f"<div class=header><h1>Site</h1></div><div id=content><div class=entry-header>{HEAD}</div><div class=entry-content>{BODY}</div><div class=sidebar><p>Popular, things</p></div></div>", []),
    (f"<main>{HEAD}<section>{BODY}</section><section id=discussion><h2 id=discussion>Discussion</h2><p>Short.</p></section></main>", ["Discussion", "Short."]),
    (f"<BODY><SCRIPT>x</script >{HEAD}{BODY}<DIV CLASS='Cookie-Notice'>We use</DIV></BODY>", []),
    (f"<body><header><p>Site, name</p></header>{HEAD}{BODY}<div class=ad>Buy</div><footer>foot</footer>", []),
])
def test_html_wrappers(page, more):
    assert html_extract.main_text(page).split("\n\n") == [*WANT, *more]


def test_html_case_changes_no_places():
    assert html_extract.main_text("<p>" + "\u0130" * 60 + "</p><script>var x;</script>" + BODY).split("\n\n") == ["\u0130" * 60, *WANT[1:]]


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a x="' * 170_000, "<" * 10**6, "<div>x" * 60_000, "<iframe/>" * 100_000, "<p>" + "<span>" * 30_000 + "<h1>x</h1>" * 10_000])
def test_html_of_broken_marks_ends(page):
    began = time.time()
    html_extract.main_text(page)
    assert time.time() - began < 10


def test_html_pages_against_the_article_element():
    """In the tables' pages all of the article element is wanted, and nothing else."""
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    for r in pq.read_table(path).to_pylist():
        own = re.search("<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", p))).strip() for p in re.split("</?(?:p|h1|ul|li|div)>", own)]
        assert html_extract.main_text(r["html"]) == "\n\n".join(p for p in parts if p)


def test_html_keeps_links_of_the_article():
    page = """<article><p>First, with text, and more of it.</p><h2>Sources</h2><ul><li><a href=a>Paper, one</a><li><a href=b>Paper two</a></ul>
    <table><tr><td>Data</td><td><a href=c>Table three</a></td></tr></table><div><a href=d>Next part</a></div></article>"""
    assert html_extract.main_text(page).split("\n\n") == ["First, with text, and more of it.", "Sources", "Paper, one", "Paper two", "Data", "Table three", "Next part"]


def test_html_rows(spark):
    out = html_extract.extract_text(spark.createDataFrame([(1, "u", None), (2, None, "<p>A&lt;b, c</p>")], "page_id long, url string, html string")).collect()
    assert [tuple(r) for r in sorted(out)] == [(1, "u", "", 0), (2, None, "A<b, c", 6)]


@pytest.mark.parametrize("run", [
    lambda d: line_dedup.line_dedup(d), lambda d: line_dedup.without_repeats(d), lambda d: substring_dedup.substring_dedup(d), lambda d: suffix_dedup.suffix_dedup(d),
    lambda d: near_dedup.near_dedup(d), lambda d: katz.katz_scores(d), lambda d: packing.pack(d),
])
def test_empty_tables(spark, run):
    assert run(docs(spark, [])).count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, PASSAGE, "a", "b", "c", "d"), (1, PASSAGE, "a", "b", "c", "d"), (2, PASSAGE, "a", "b", "c", "d")]
    d = spark.createDataFrame(rows, "doc_id long, text string, v string, g string, pos string, n string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(d).collect()) == [(1, 0), (2, 70)]
    assert sorted((r.doc_id, r.kept) for r in near_dedup.near_dedup(d).collect()) == [(1, True), (1, True), (2, False)]
    assert suffix_dedup.suffix_dedup(d).count() == 2 and line_dedup.line_dedup(d).count() == 3 and packing.pack(d).count() == 3


def _left(monkeypatch, folder, run):
    """Tables that a query has left in its scratch folder, and its rows."""
    monkeypatch.setattr(common, "scratch_dir", lambda spark: f"{folder}/{time.time_ns()}")
    rows = run().collect()
    return len(list(folder.iterdir())), rows


def test_katz_keeps_two_tables(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} and more") for i in range(60)], "doc_id long, text string")
    n, rows = _left(monkeypatch, tmp_path, lambda: katz.katz_scores(docs))
    assert n == 2 and len(rows) == 60  # chunks with their words' counts, answers about pairs


def test_near_dedup_keeps_what_its_result_reads(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine ten eleven {i % 3}") for i in range(30)], "doc_id long, text string")
    n, rows = _left(monkeypatch, tmp_path, lambda: near_dedup.near_dedup(docs, width=2))
    assert n <= 4 and {r.component_id for r in rows} == {0}  # sizes, families, links, roots


def bins(lang, scores, labels):
    """Counts by language and place on the grid of log odds."""
    import pandas as pd

    x = np.floor(np.log(np.asarray(scores) / (1 - np.asarray(scores))) * toxicity.GRID).astype(np.int64)
    return pd.DataFrame({"lang": lang, "bin": x, "n": 1, "hits": labels}).groupby(["lang", "bin"], as_index=False).sum()


def test_thresholds_of_small_languages_follow_all_rows():
    import pandas as pd

    r = np.random.default_rng(4)
    m = toxicity.start(np.zeros((2, toxicity.BUCKETS)), 900, 100)
    many = bins("en", [*r.uniform(0.01, 0.4, 900), *r.uniform(0.6, 0.99, 100)], [0] * 900 + [1] * 100)
    few = bins("fr", [*r.uniform(0.001, 0.3, 60), 0.002, 0.9, 0.91, 0.92, 0.93], [0] * 60 + [1] * 5)  # best F1 alone might reach down to 0.002
    loud = bins("de", [*r.uniform(0.3, 0.9, 500), *r.uniform(0.85, 0.99, 50)], [0] * 500 + [1] * 50)
    toxicity.calibrate(m, pd.concat([many, few, loud]))
    assert m.thresholds["fr"] == m.default > 0.3
    assert 0.4 < m.thresholds["en"] <= 0.7
    for lang, own in (("en", many), ("fr", few), ("de", loud)):
        place = np.log(m.thresholds[lang] / (1 - m.thresholds[lang])) * toxicity.GRID
        false = own[own["bin"] >= place - 1e-6]
        clean = (own["n"] - own["hits"]).sum()
        assert (false["n"] - false["hits"]).sum() <= max(1, toxicity.MOST_FALSE * clean)


def test_thresholds_without_a_label_stay():
    m = toxicity.start(np.zeros((2, toxicity.BUCKETS)), 10, 1)
    toxicity.calibrate(m, bins("en", [0.2, 0.3], [0, 0]))
    assert m.default == 0.5 and not m.thresholds


SECTION = "<h2>Named</h2><p>This part of the article has sentences of its own, and they are long enough to be read.</p>"


@pytest.mark.parametrize("name", ["discussion", "reviews", "legal", "tags", "share-prices", "social-history", "follow-up", "popular-science", "overlay", "recommend", "side-effects", "menu-engineering", "footnotes"])
def test_html_sections_of_an_article_stay(name):
    own = WANT + ["Named", SECTION[SECTION.index("<p>") + 3 : -4]]
    for page in (f"<body><article>{HEAD}{BODY}<section class='{name}'>{SECTION}</section></article>", f"<main>{HEAD}{BODY}<div class='{name}' id='{name}'>{SECTION}</div></main>"):
        assert html_extract.main_text(page).split("\n\n") == own


@pytest.mark.parametrize("name", ["ad", "advertisement", "sponsored", "newsletter", "newsletter-signup", "share-bar", "social-share", "comments", "cookie-notice", "notice", "sidebar", "related-posts"])
def test_html_adverts_in_an_article_go(name):
    assert html_extract.main_text(f"<body><article>{HEAD}{BODY}<section class='{name}'>{SECTION}</section></article>").split("\n\n") == WANT


@pytest.mark.parametrize("inner", ["<h2>Tags</h2><a href=a>physics</a>, <a href=b>mathematics</a>", "<ul><li>physics<li>mathematics</ul>", "<p><a href=a>Read the next one, which is long</a></p>"])
def test_html_lists_beside_the_text_go(inner):
    assert html_extract.main_text(f"<body><article>{HEAD}{BODY}<div class='tags'>{inner}</div></article>").split("\n\n") == WANT


@pytest.mark.parametrize("name", ["discussion", "reviews", "popular-science", "recommend", "overlay"])
def test_html_sections_beside_an_article_go(name):
    assert html_extract.main_text(f"<body><article>{HEAD}{BODY}</article><section class='{name}'>{SECTION}</section>").split("\n\n") == WANT


def test_html_labels():
    page = f"<article>{HEAD}{BODY}<p>Tick the <label>small box</label> below.</p><label>Menu</label></article>"
    assert html_extract.main_text(page).split("\n\n") == [*WANT, "Tick the small box below."]


def test_html_empty_and_clashing(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert html_extract.extract_text(spark.createDataFrame([], schema)).count() == 0
    out = html_extract.extract_text(spark.createDataFrame([(1, "u", "<p>A, b</p>", "other", 9)] * 2, schema)).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in out] == [(1, "A, b", 4)] * 2


def test_top_k_of_any_ids(spark):
    rng = np.random.default_rng(9)
    ids = [-1, 0, 50, 3, 4, -50, -100, 2**62, -(2**63), *range(1000, 1090)]
    v = rng.integers(-3, 4, (len(ids), 4)) / 4
    d = spark.createDataFrame([(i, x.tolist(), 1, 2.0, 3) for i, x in zip(ids, v)] + [(-1, v[0].tolist(), 1, 2.0, 3)], "vec_id long, embedding array<double>, rank int, score double, query_id int")
    for rows in (10, 1000):
        got = {}
        for r in topk.top_k(d, F.col("vec_id") % 50 == 0, shard_rows=rows).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        q = np.floor(256 * v).astype(np.int64)
        for j, i in enumerate(ids):
            if i % 50 == 0:
                top = sorted((-int(q[k] @ q[j]), o) for k, o in enumerate(ids) if o != i)[:5]
                assert sorted(got.pop(i)) == [(n + 1, o, -s) for n, (s, o) in enumerate(top)]
        assert not got
    assert topk.top_k(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("rows", [4096, 40])
def test_toxicity_trains_as_often_for_one_pack_as_for_several(spark, monkeypatch, rows):
    from leafwork.llm import toxicity as tx

    turns = set()
    monkeypatch.setattr(tx, "PACK_ROWS", rows)
    told = tx.told
    monkeypatch.setattr(tx, "told", lambda packs, tell, dtype, mean: turns.add(len(turns)) or told(packs, tell, dtype, mean))
    docs = spark.range(160).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), (F.col("id") % 7).cast("string"), F.when(F.col("id") % 2 == 0, " foul").otherwise(" fair")).alias("text"), F.lit("en").alias("lang"))
    assert tx.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))).fitted
    assert len(turns) == 1 + 3  # one for the counts, three rounds
