"""Repair of conversations against all sequences of edits, on small and odd tables."""

import re
import zlib
from hashlib import sha256
from itertools import product

import duckdb
import numpy as np
import pytest

from leafwork.llm import conversations as cv

ROW = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        blank, dup = bare == "", (role, text) in seen
        seen.add((role, text))
        out.append((blank, not blank and dup, not blank and not dup and bare[-1] not in ".!?"))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying all sequences of edits of up to n + 3 rows that come out."""
    marks, best = faults(rows), None

    def go(i, cost, audit, out):
        nonlocal best
        if best and cost > best[0] or len(out) > len(rows) + 3:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            new = (cost, audit, tuple(out))
            best = new if best is None or new[:2] < best[:2] else best
        if not re.fullmatch("s?(ua)*u?", "".join(r[:1] or "-" for r, _ in out)):
            return
        if i < len(rows):
            (role, text), (blank, dup, short) = rows[i], marks[i]
            go(i + 1, cost + 3, audit + "D", out)
            if not blank and not dup:
                go(i + 1, cost + short, audit + "K", out + [(role, text)])
                for x in ("user", "assistant"):
                    go(i + 1, cost + 2 + short, audit + "R", out + [(x, text)])
        for x in ("user", "assistant"):
            go(i, cost + 2, audit + "I", out + [(x, "")])

    go(0, 0, "", [])
    return best


def verdict(turns, rows):
    marks, known = faults(rows), [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[:1] for r, _ in rows]
    cost, audit, out = cheapest(rows)
    return (gaps, *[sum(m[k] for m in marks) for k in range(3)], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), list(out)


TEXTS = ["one.", "two!", "three", " \n", "", "vier?\n ", "é"]


def talks(n=60, seed=3):
    r = np.random.default_rng(seed)
    for c in range(n):
        for t in range(int(r.integers(1, 7))):
            yield c, t + int(r.integers(0, 2)) * 10, str(r.choice(["user", "assistant", "system", "tool", "", "u2"], p=[0.35, 0.3, 0.15, 0.1, 0.05, 0.05])), str(r.choice(TEXTS)) + (f" {t}." if r.random() < 0.6 else "")


def plain(data):
    """{conv: [(turn, role, text)] in order} as the operator orders rows."""
    out = {}
    for c, t, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        out.setdefault(c, []).append((t is not None, t or 0, role.encode(), __import__("hashlib").md5(text.encode()).hexdigest(), t, role, text))
    return {c: [x[4:] for x in sorted(v, key=lambda x: x[:4])] for c, v in out.items()}


@pytest.mark.parametrize("bits", [0, 1, 11])
def test_repair(spark, bits):
    data = list(talks()) + [(None, 1, "user", "a."), (None, None, None, None), (500, None, "user", None), (501, 3, "system", "only.")] + [(502, 1, "user", "same.")] * 4
    got, rows = cv.repair(spark.createDataFrame(data, ROW).repartition(3), bits=bits)
    got = {r.conv_id: tuple(r)[1:] for r in got.collect()}
    said = {}
    for r in sorted(rows.collect(), key=lambda r: r.place):
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(got) == set(plain(data))
    for c, own in plain(data).items():
        want, out = verdict([x[0] for x in own], [x[1:] for x in own])
        assert got[c] == want, c
        assert said.get(c, []) == out


def test_charts_over_blocks_agree_with_one():
    r = np.random.default_rng(8)
    for _ in range(40):
        rows = [(str(r.choice(list("uuaasx"))), bool(r.random() < 0.2), bool(r.random() < 0.2)) for _ in range(int(r.integers(0, 40)))]
        whole = cv.Chart(cv.START)
        for x in rows:
            whole.scan(*x)
        scores = {cv.START: (0, "")}
        for lo in range(0, len(rows), 7):
            ways = []
            for entry in cv.GRAMMAR:
                chart = cv.Chart(entry)
                for x in rows[lo : lo + 7]:
                    chart.scan(*x)
                ways += [(entry, leave, *s) for leave, s in chart.exits().items()]
            scores = cv.chained(scores, ways)
        assert min(s for x, s in scores.items() if () in cv.GRAMMAR[x]) == whole.accepted() if rows else whole.accepted() == (0, "")


def test_short_sequences_of_roles():
    for n in range(5):
        for roles in product("uas", repeat=n):
            chart = cv.Chart(cv.START)
            for x in roles:
                chart.scan(x, False, False)
            names = {"u": "user", "a": "assistant", "s": "system"}
            assert chart.accepted() == cheapest([(names[x], f"{k}.") for k, x in enumerate(roles)])[:2]


def damage(data):
    out = []
    for c, t, role, text in data:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(c, t, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def test_query_and_sql(spark, tmp_path):
    data = list(talks(150, 5)) + [(None, 1, "user", "a."), (None, None, None, None), (-4, 9, "assistant", "ok")]
    spark.createDataFrame(data, ROW).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in cv.op13_conversation_repair(spark, str(tmp_path)).collect()}
    left, nothing = plain(damage(data)), (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    assert set(got) == {d[0] for d in data} and len(left) < len(got)
    for c, own in got.items():
        assert own == (verdict([x[0] for x in left[c]], [x[1:] for x in left[c]])[0] if c in left else nothing)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {r[0]: tuple(r[1:]) for r in con.sql(cv.SQL).fetchall()} == got


def test_long_talk_with_equal_rows(spark):
    data = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t // 100}.") for t in range(3000)] + [(1, 5000, "user", "same.")] * 200 + [(2, 0, "user", "x. " * 200000), (2, 1, "assistant", "y.")]
    got = {r.conv_id: r for r in cv.repair(spark.createDataFrame(data, ROW), bits=6)[0].collect()}
    own = plain(data)[1]
    chart = cv.Chart(cv.START)
    for (_, role, _), m in zip(own, faults([x[1:] for x in own])):
        chart.scan(role[:1], m[0] or m[1], m[2])
    assert (got[1].cost, got[1].audit) == chart.accepted()
    assert (got[2].cost, got[2].audit) == (0, "KK") and got[1].duplicate == 3000 - 60 + 199


def test_small_tables_and_names(spark):
    got, rows = cv.repair(spark.createDataFrame([], ROW))
    assert got.count() == rows.count() == 0
    d = spark.createDataFrame([("k", 1, "user", "a.", 5, 6)], "key string, n int, who string, said string, first int, pos int")
    assert tuple(cv.repair(d, "key", "n", "who", "said")[0].first())[6:8] == (2, "KI")
