"""Near-duplicates where sketch values stand on lists too long to be paired."""

import random

from leafwork.llm import near_dedup


def lists_of(spark, docs):
    """(v, rep, n, c) of the values that several documents have; the sizes are ten times the lists."""
    at = {}
    for rep, vs in docs.items():
        for v in vs:
            at.setdefault(v, []).append(rep)
    return spark.createDataFrame([(v, rep, 400, len(reps)) for v, reps in at.items() if len(reps) > 1 for rep in reps], "v long, rep long, n long, c long")


def test_a_few_long_lists_make_no_family(spark):
    docs = {d: [1, 2, 3, *range(1000 * d, 1000 * d + 90)] for d in range(1, 201)}  # three values that all have
    docs[200] = [1, 2, 3, *range(1000, 1090)]  # and a copy of document 1
    assert [tuple(r) for r in near_dedup.candidates(lists_of(spark, docs), 80).collect()] == [(1, 200)]
    docs = {d: [*range(17), 1000 * d] for d in range(1, 101)}  # too many to do without
    assert sorted(tuple(r) for r in near_dedup.candidates(lists_of(spark, docs), 80).distinct().collect()) == [(1, d) for d in range(2, 101)]


def test_no_link_is_lost_on_long_lists(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRED", 3)
    r = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        t = [r.choice(words) for _ in range(r.choice((3, 8, 30, 120)))]
        texts.append(t)
        for _ in range(r.randrange(3)):
            c = list(t)
            for _ in range(r.randrange(1 + len(c) // 12)):
                c[r.randrange(len(c))] = r.choice(words)
            texts.append(c)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{(a, b) for a, b in zip(t, t[1:])} for t in texts]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {x.doc_id: x.component_id for x in near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), width=2).collect()}
    assert got == {i: top(i) for i in range(len(docs))}
