"""Best choices and word edits against plain tables and brute force."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwork.functions import assignment, edits
from leafwork.operators import evaluate


def table(a, b):
    """The last entry of the plain table of distances, row by row."""
    codes = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([codes[x] for x in b], dtype=np.int64)
    at = np.arange(len(b) + 1)
    row = at.copy()
    for i, x in enumerate(a, 1):
        low = np.minimum(row[1:] + 1, row[:-1] + (y != codes[x]))
        row = np.minimum.accumulate(np.concatenate([[i], low]) - at) + at
    return int(row[-1])


@pytest.mark.parametrize("kept", [4, 1 << 24])
def test_edits_of_short_sequences(monkeypatch, kept):
    monkeypatch.setattr(edits, "KEPT", kept)
    r = random.Random(1)
    for _ in range(1500):
        a, b = ([r.randrange(5) for _ in range(r.randrange(0, 14))] for _ in "ab")
        changed, new, gone = edits.counted(a, b)
        assert edits.distance(a, b) == changed + new + gone == table(a, b) and new - gone == len(b) - len(a)


def test_edits_of_fifty_thousand_words():
    r = np.random.default_rng(2)
    a = r.permutation(60_000)[:50_000]
    b = np.where(r.random(50_000) < 0.9, a, r.integers(0, 60_000, 50_000))[r.random(50_000) < 0.95]
    began = time.time()
    got = edits.counted(a.tolist(), b.tolist())
    assert time.time() - began < 30 and got[1] - got[2] == len(b) - len(a)
    assert sum(got) == table(a.tolist(), b.tolist())


def test_word_errors(spark):
    many = " ".join(f"w{i}" for i in range(40_000))  # more distinct words than there are two-byte characters
    rows = [("a b c", "a x c"), ("a b", "a b c d"), ("", "x y"), ("one two", ""), ("", ""), (many, many.replace("w7 ", "") + " new"), (None, "x")]
    got = evaluate.wer(spark.createDataFrame(rows, "truth string, found string")).collect()
    assert [tuple(r)[2:6] for r in got] == [(1, 1, 0, 0), (2, 0, 2, 0), (2, 0, 2, 0), (2, 0, 0, 2), (0, 0, 0, 0), (2, 0, 1, 1), (None,) * 4]
    assert [r.wer for r in got][:5] == [0.333333, 1.0, 1.0, 1.0, 0.0]


def test_heaviest_choice():
    r = random.Random(3)
    for _ in range(600):
        p = [(i, j, r.randrange(1, 9)) for i in range(r.randrange(1, 5)) for j in range(r.randrange(1, 5)) if r.random() < 0.6][:11]
        want = max(sum(x[2] for x in c) for k in range(5) for c in itertools.combinations(p, k) if len({x[0] for x in c}) == k == len({x[1] for x in c}))
        got = [p[k] for k in assignment.heaviest(*(list(v) for v in zip(*p)))] if p else []
        assert len({x[0] for x in got}) == len(got) == len({x[1] for x in got}) and sum(x[2] for x in got) == want
    n = 400
    pairs = [(i, j, 1 + (i * 7919 + j * 104729) % 1000) for i in range(n) for j in range(max(0, i - 4), min(n, i + 5))]
    assert len(assignment.heaviest(*(list(v) for v in zip(*pairs)))) > 390


BOX = "doc_id long, page_number int, {} int, x1 int, y1 int, x2 int, y2 int"


def total(rows):
    return round(sum(r.iou for r in rows), 6)


def test_best_choice_of_boxes(spark):
    r = np.random.default_rng(5)
    rows = [[(1, p, k, int(x), int(y), int(x) + 30, int(y) + 30) for p in (1, 2, 3) for k, (x, y) in enumerate(r.integers(0, 40, (6, 2)))] for _ in "ab"]
    found, truth = (spark.createDataFrame(v, BOX.format(n)) for v, n in zip(rows, ("line_idx", "truth_idx")))
    pairs = evaluate.pairs(found, truth, 0.2).collect()
    best, greedy = evaluate.best_one_to_one(found, truth, 0.2).collect(), evaluate.one_to_one(found, truth, 0.2).collect()
    assert len({(x.page_number, x.line_idx) for x in best}) == len(best) == len({(x.page_number, x.truth_idx) for x in best})
    for page in (1, 2, 3):
        own = [x for x in pairs if x.page_number == page]

        def most(rest, a=frozenset(), b=frozenset()):
            if not rest:
                return 0.0
            x, more = rest[0], most(rest[1:], a, b)
            return more if x.line_idx in a or x.truth_idx in b else max(more, x.iou + most(rest[1:], a | {x.line_idx}, b | {x.truth_idx}))

        of = lambda v, page=page: total([x for x in v if x.page_number == page])
        assert of(best) == pytest.approx(most(own)) and of(best) >= of(greedy)
    # a chain where the greedy choice takes the middle pair
    found, truth = spark.createDataFrame([(1, 1, 0, 0, 0, 10, 10), (1, 1, 1, 4, 0, 14, 10)], BOX.format("line_idx")), spark.createDataFrame([(1, 1, 0, 1, 0, 11, 10), (1, 1, 1, 7, 0, 17, 10)], BOX.format("truth_idx"))
    assert total(evaluate.best_one_to_one(found, truth, 0.05).collect()) >= total(evaluate.one_to_one(found, truth, 0.05).collect()) > 0
    assert evaluate.best_one_to_one(found.limit(0), truth).count() == 0


def test_pairs_are_all_pairs(spark):
    r = np.random.default_rng(6)
    rows = [[(d, 1, k, *map(int, (x, y, x + w, y + h))) for d in (1, 2) for k, (x, y, w, h) in enumerate(r.integers(0, 30, (40, 4)))] for _ in "ab"]
    found, truth = (spark.createDataFrame(v, BOX.format(n)) for v, n in zip(rows, ("line_idx", "truth_idx")))

    def iou(a, b):
        i = max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
        u = (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - i
        return i / u if u else 0

    want = sorted((a[0], a[2], b[2]) for a in rows[0] for b in rows[1] if a[0] == b[0] and iou(a, b) >= 0.3)
    assert want and sorted(map(tuple, evaluate.pairs(found, truth, 0.3).select("doc_id", "line_idx", F.col("truth_idx")).collect())) == want
