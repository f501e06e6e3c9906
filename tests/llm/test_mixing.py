"""The mix against a plain version of its rules, on small and odd tables."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwork.llm import mixing

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def rows(seed=1, n=120):
    r = np.random.default_rng(seed)
    out = [(i, " ".join(["w"] * int(r.integers(0, 90))), "en", f"s{int(r.integers(0, 7))}", 1) for i in range(n)]
    out += [(n, None, "en", "s0", 0), (n + 1, "", "en", None, 0), (n + 2, "a b\tc\nd", "en", None, 7), (n + 3, "w " * 5000, "en", "big", 1), (n + 4, " \n ", "en", "empty", 3)]
    return out + [(7, "x y z", "en", "s1", 5)] * 40 + [(None, "p q", "en", "s2", 3)] * 2


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = share * sum(sizes.values()), {}
    while True:
        live = [s for s in names if s not in capped]
        over = [s for s in live if left * w[s] / sum(w[x] for x in live) > cap * sizes[s] or not sizes[s]]
        if not over:
            return capped | {s: left * w[s] / sum(w[x] for x in live) for s in live}
        for s in over:
            capped[s] = cap * sizes[s]
            left -= cap * sizes[s]


def test_permutation(spark):
    for n in (1, 2, 3, 10, 257):
        keys = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long")), lambda r: F.struct(((r * 7919 + 13) % n).alias("sum"), (r * 104729 + 5).alias("mark")))
        got = [r.x for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), keys).alias("x")).collect()]
        assert sorted(got) == list(range(n))
        assert n < 100 or sum(abs(a - b) == 1 for a, b in zip(got, got[1:])) < n // 10


def test_words_taken(spark):
    data = rows()
    made = mixing.mix(spark.createDataFrame(data, DOC).repartition(5), block=16, shard_slots=32)
    docs = {r.row: r for r in made.documents.collect()}
    assert Counter((r.id, r.source, r["size"]) for r in docs.values()) == Counter((d[0], d[3], size(d[1])) for d in data)
    sizes = defaultdict(int)
    for d in data:
        sizes[d[3]] += size(d[1])
    want = targets(dict(sizes))
    source = {r.sid: r for r in made.sources.collect()}
    assert {r.source: round(r.target, 6) for r in source.values()} == {s: round(v, 6) for s, v in want.items()}
    spans = made.spans.collect()
    times, given, shards = Counter(), Counter(), Counter()
    for s in spans:
        d = docs[s.row]
        assert 0 < s.n_words and 0 <= s.first_word and s.first_word + s.n_words <= d["size"] and s.at + s.n_words <= 16
        given[d.source] += s.n_words
        times.update((s.row, k) for k in range(s.first_word, s.first_word + s.n_words))
    for s, v in want.items():
        assert abs(given[s] - v) <= 0.5
    assert max(times.values()) <= 2
    # a source's words are taken evenly: the difference is one turn at most
    for r in source.values():
        own = [times[(d.row, k)] for d in docs.values() if d.sid == r.sid for k in range(d["size"])]
        assert not own or max(own) - min(own) <= 1
    shards = Counter((s.shard, s.slot) for s in spans)
    assert {k[0] for k in shards} == set(range(max(k[0] for k in shards) + 1))
    assert all(sum(s.n_words for s in spans if (s.shard, s.slot) == k) <= 16 for k in list(shards)[:50])


def test_draws_of_a_shard_are_multinomial(spark):
    made = mixing.mix(spark.createDataFrame([(i, "w " * 64, "en", f"s{i % 3}", 1) for i in range(3000)], DOC), shard_slots=256)
    got = made.spans.groupBy("shard", "sid").agg(F.countDistinct("slot").alias("n")).toPandas().pivot(index="shard", columns="sid", values="n").fillna(0).iloc[:-2]
    p = made.sources.toPandas().set_index("sid").n_slots
    p = p / p.sum()
    for k in p.index:  # mean and spread of a binomial
        assert abs(got[k].mean() - 256 * p[k]) < 4 * np.sqrt(256 * p[k] * (1 - p[k]) / len(got)) + 2
        assert 0.4 < got[k].var() / (256 * p[k] * (1 - p[k])) < 2.2


def test_partitions_do_not_matter(spark):
    data = rows(3)
    view = lambda m: sorted(map(tuple, m.documents.join(m.spans.groupBy("row").agg(F.sum("n_words").alias("t")), "row", "left").select(F.coalesce("id", F.lit(-1)), "size", F.coalesce("t", F.lit(0))).collect()))
    a = view(mixing.mix(spark.createDataFrame(data, DOC).repartition(7)))
    assert a == view(mixing.mix(spark.createDataFrame(data[::-1], DOC).coalesce(1)))


@pytest.mark.parametrize("data", [[], [(1, "", "en", "a", 0), (2, None, "en", None, 0)], [(1, "one", "en", "a", 3)]])
def test_small_tables(spark, data):
    made = mixing.mix(spark.createDataFrame(data, DOC))
    assert made.documents.count() == len(data)
    words = sum(size(d[1]) for d in data)
    assert made.spans.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0] == int(1.5 * words + 0.5)


def test_other_columns_and_names(spark):
    d = spark.createDataFrame([(1, "a b c", "s", 9, 8, 7), (2, "d", None, 9, 8, 7)], "key long, body string, origin string, sid int, size int, row int")
    made = mixing.mix(d, "key", "body", "origin")
    assert sorted((r.id, r["size"]) for r in made.documents.collect()) == [(1, 3), (2, 1)]


def test_query_and_sql(spark, tmp_path):
    data = [d for d in dict((d[0], d) for d in rows(5)).values() if d[0] is not None]
    spark.createDataFrame(data, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op11_mixing(spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(mixing.SQL).df()
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, want[list(got.columns)].values))
    assert (got.taken <= 2 * got["size"]).all()
