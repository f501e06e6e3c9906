"""Conversation structure repair by error-correcting Earley parsing of the order of roles.

A conversation is cut into blocks of rows. Each block is parsed from every nonterminal that may be open
where it begins; what the charts say of the ways through the blocks is then chained. The repaired rows
are streamed in order, so that no task holds a conversation's texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import far, table, written
from .ordered import laid_out, numbered

#: Rules (terminal, nonterminal that follows) of each nonterminal; an empty rule may end the talk.
GRAMMAR: dict[str, list[tuple[str, ...]]] = {"talk": [("s", "first"), ("u", "open"), ()], "first": [("u", "open")], "open": [("a", "more")], "more": [("u", "open"), ()]}
START, ROLES = "talk", {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
#: 2 to this power rows of a conversation are parsed in one go.
BLOCK_BITS = 11
SPACE = " \t\n\x0b\x0c\r"

Score = tuple[int, str]
Item = tuple[str, tuple[str, ...], int]


class Chart:
    """The last column of an Earley chart over rows of roles.

    An item is a rule with a dot. All rules have their nonterminal last, so a completed tail completes
    what waits for it; an item therefore hands its own origin on when it predicts its tail, all items
    have the origin at which the chart began, and a column holds each rule and dot once. With each item goes
    the least (cost, audit) of all edits that lead to it. Scores of one item in one column span the same
    rows; two of equal cost are then no prefixes of each other, so that what follows keeps their order.
    """

    def __init__(self, entry: str):
        self.column: dict[Item, Score] = {}
        self._close([((0, ""), (entry, rule, 0)) for rule in GRAMMAR[entry]])

    def _close(self, agenda: list[tuple[Score, Item]]) -> None:
        """Predictions and insertions, cheapest first, so that the first score of an item is its least."""
        heapq.heapify(agenda)
        self.column = {}
        while agenda:
            score, item = heapq.heappop(agenda)
            if item in self.column:
                continue
            self.column[item] = score
            lhs, rule, dot = item
            if dot == 1:
                for r in GRAMMAR[rule[1]]:
                    heapq.heappush(agenda, (score, (rule[1], r, 0)))
            elif rule and rule[0] in ROLES:
                heapq.heappush(agenda, ((score[0] + INSERT, score[1] + "I"), (lhs, rule, 1)))

    def scan(self, initial: str, gone: bool, short: bool) -> None:
        """The next row: kept where its initial is what an item waits for, given a role, or deleted. gone:
        it has to be deleted; short: what stays of it costs one more."""
        agenda: list[tuple[Score, Item]] = []
        for (lhs, rule, dot), (cost, audit) in self.column.items():
            if dot:
                continue  # its predictions stand in the same column
            agenda.append(((cost + DELETE, audit + "D"), (lhs, rule, 0)))
            if rule and not gone:
                if rule[0] == initial:
                    agenda.append(((cost + KEEP + CUT_SHORT * short, audit + "K"), (lhs, rule, 1)))
                if rule[0] in ROLES:
                    agenda.append(((cost + REROLE + CUT_SHORT * short, audit + "R"), (lhs, rule, 1)))
        self._close(agenda)

    def exits(self) -> dict[str, Score]:
        """The least score for each nonterminal that may be open after the last row."""
        out: dict[str, Score] = {}
        for (lhs, _, dot), score in self.column.items():
            if not dot and (lhs not in out or score < out[lhs]):
                out[lhs] = score
        return out

    def accepted(self) -> Score:
        return min(s for (_, rule, dot), s in self.column.items() if not rule)


def chained(so_far: dict[str, Score], ways: list[tuple[str, str, int, str]]) -> dict[str, Score]:
    """Scores of what may be open after a block, from those before it and its ways (entry, exit, cost, audit)."""
    out: dict[str, Score] = {}
    for entry, leave, cost, audit in ways:
        if entry in so_far:
            new = (so_far[entry][0] + cost, so_far[entry][1] + audit)
            if leave not in out or new < out[leave]:
                out[leave] = new
    return out


class Replay:
    """Repaired rows of a conversation, row by row, from its audit; their digest."""

    def __init__(self, audit: str):
        self.audit, self.at, self.open, self.hash, self.any = audit, 0, START, sha256(), False

    def _say(self, terminal: str, role: str, text: str) -> tuple[str, str]:
        self.open = next(rule[1] for rule in GRAMMAR[self.open] if rule and rule[0] == terminal)
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True
        return role, text

    def _needed(self) -> str:
        return next(rule[0] for rule in GRAMMAR[self.open] if rule and rule[0] in ROLES)

    def inserted(self) -> list[tuple[str, str]]:
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            out.append(self._say(t := self._needed(), ROLES[t], ""))
        return out

    def row(self, role: str, text: str) -> list[tuple[str, str]]:
        """What stands in place of the next row, rows inserted before it included."""
        out = self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            out.append(self._say(role[:1], role, text))
        elif edit == "R":
            out.append(self._say(t := self._needed(), ROLES[t], text))
        return out


def faults(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A row for each row, in a table without texts: conv, first (a number for the conversation), pos in
    it, n (its rows), turn, initial, and its first fault: blank, dup or short."""
    bare = F.rtrim(F.col(text_col), F.lit(SPACE))
    slim = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.md5(F.col(text_col).cast("binary")).alias("hash"),
        F.substring(role_col, 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open_end"),
    )
    at = numbered(laid_out(slim, [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("hash").asc()]), "at")
    heads = at.groupBy("conv").agg(F.min("at").alias("first"), F.count("*").alias("n")).withColumnRenamed("conv", "_conv")
    placed = written(at.join(heads, F.col("conv").eqNullSafe(F.col("_conv"))).withColumn("pos", F.col("at") - F.col("first")).drop("_conv", "_row", "at"), rows.sparkSession)
    again = placed.where("not blank").groupBy("first", "role", "hash").agg(F.min("pos").alias("_pos"), F.count("*").alias("_c")).where("_c > 1")
    again = again.select(far(F.col("first")).alias("_f"), F.col("role").alias("_role"), F.col("hash").alias("_hash"), "_pos")
    met = placed.join(again, (far(F.col("first")) == F.col("_f")) & (F.col("role") == F.col("_role")) & (F.col("hash") == F.col("_hash")), "left")
    dup = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("_pos"), F.lit(False))
    return met.select("conv", "first", "pos", "n", "turn", "initial", "blank", dup.alias("dup"), (~F.col("blank") & ~dup & F.col("open_end")).alias("short"))


_PARSED = pa.schema([("first", pa.int64()), ("block", pa.int64()), ("blocks", pa.int64()), *[(c, pa.int64()) for c in ("blank", "dup", "short", "illegal")], ("head", pa.string()), ("tail", pa.string()), ("entry", pa.list_(pa.string())), ("leave", pa.list_(pa.string())), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string()))])
_PARSED_SQL = "first long, block long, blocks long, blank long, dup long, short long, illegal long, head string, tail string, entry array<string>, leave array<string>, cost array<long>, audit array<string>"
_LEGAL = {"su", "ua", "au"}


def parsed(marked: DataFrame, bits: int) -> DataFrame:
    """A row for each block: counts of faults, initials at both ends, and its ways from entry to exit. The
    first block is entered at the start alone."""

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], dict, dict[str, Chart]]]:
        key, sums, charts = None, {}, {}
        for b in batches:
            for first, block, n, initial, blank, dup, short in zip(*(b.column(c).to_pylist() for c in ("first", "block", "n", "initial", "blank", "dup", "short"))):
                if key is None or key[:2] != (first, block):
                    if key is not None:
                        yield key, sums, charts
                    key = (first, block, ((n - 1) >> bits) + 1)
                    sums = {"blank": 0, "dup": 0, "short": 0, "illegal": 0, "head": initial, "tail": None}
                    charts = {e: Chart(e) for e in (GRAMMAR if block else (START,))}
                for c, x in (("blank", blank), ("dup", dup), ("short", short), ("illegal", sums["tail"] is not None and sums["tail"] + initial not in _LEGAL)):
                    sums[c] += x
                sums["tail"] = initial
                for chart in charts.values():
                    chart.scan(initial, blank or dup, short)
        if key is not None:
            yield key, sums, charts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for (first, block, blocks), sums, charts in blocks_of(batches):
            if blocks == 1:
                cost, audit = charts[START].accepted()
                ways = [(START, "more", cost, audit)]
            else:
                ways = [(e, x, *score) for e, chart in charts.items() for x, score in chart.exits().items()]
            held.append({"first": first, "block": block, "blocks": blocks, **sums} | dict(zip(("entry", "leave", "cost", "audit"), map(list, zip(*ways)))))
            if len(held) >= 1000 or blocks > 1:
                yield pa.RecordBatch.from_pylist(held, _PARSED)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _PARSED)

    cut = marked.select("first", F.shiftright("pos", bits).alias("block"), "pos", "n", "initial", "blank", "dup", "short")
    return cut.repartition("first", "block").sortWithinPartitions("first", "block", "pos").mapInArrow(run, _PARSED_SQL)


_TOTAL = pa.schema([("first", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])


def totalled(blocks: DataFrame) -> DataFrame:
    """A row for each conversation, its blocks chained in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        own: dict | None = None
        scores: dict[str, Score] = {}
        tail = None
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if own is None or own["first"] != r["first"]:
                    own, scores, tail = {"first": r["first"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, {START: (0, "")}, None
                for to, c in (("blank", "blank"), ("duplicate", "dup"), ("truncated", "short"), ("illegal", "illegal")):
                    own[to] += r[c]
                own["illegal"] += tail is not None and tail + r["head"] not in _LEGAL
                tail = r["tail"]
                scores = chained(scores, list(zip(r["entry"], r["leave"], r["cost"], r["audit"])))
                if r["block"] == r["blocks"] - 1:
                    own["cost"], own["audit"] = min(scores[x] for x in scores if () in GRAMMAR[x])
                    held.append(own)
            if held:
                yield pa.RecordBatch.from_pylist(held, _TOTAL)
                held = []

    return blocks.repartition("first").sortWithinPartitions("first", "block").mapInArrow(run, "first long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: DataFrame | None = None, bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """(verdicts, repaired): a row for each conversation, and the repaired rows in order.

    verdicts: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; repaired:
    conv_col, place (from 0), role, text. Rows stand by turn, null first, then role, then the text's
    MD5; rows alike in all of these are interchangeable. The first fault of a row counts: blank (white
    space alone), duplicate (role and text seen before in the conversation), truncated (last
    character that isn't white space is none of . ! ?). Blank and duplicate rows have to go. The audit is
    the cheapest sequence of edits, D, I, K or R, after which the roles' initials are s, if any, and pairs
    of u and a, or nothing; of equal cost the least by ASCII.

    A null role or text counts as one space; rows without a conversation are one of their own; `every`
    has a column conv_col with conversations that may have no rows: they get zeros, an empty audit
    and the hash of an empty string. Other columns are ignored; an empty table gives no rows. Equal texts
    are told by 128 bits.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    marked = faults(base, "conv", "turn", "role", "text")
    told = totalled(parsed(marked, bits))
    heads = marked.groupBy("conv", "first").agg((F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0))).cast("long").alias("gaps"))
    own = heads.join(told.withColumnRenamed("first", "_first"), F.col("first") == F.col("_first")).drop("first", "_first")
    if every is not None:
        names = every.select(F.col(conv_col).alias("_conv")).distinct()
        own = names.join(own, F.col("_conv").eqNullSafe(F.col("conv")), "left").drop("conv").withColumnRenamed("_conv", "conv")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    own = written(own.select("conv", *[zero(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit")), spark)

    text = lambda c, kind: F.lit(None).cast(kind).alias(c)
    turn_kind, kind = base.schema["turn"].dataType.simpleString(), base.schema["conv"].dataType.simpleString()
    both = own.withColumns({"kind": F.lit(0), "turn": F.lit(None).cast(turn_kind), "role": text("role", "string"), "hash": text("hash", "string"), "text": text("text", "string")}).unionByName(
        base.withColumns({"kind": F.lit(1), "hash": F.md5(F.col("text").cast("binary")), "audit": text("audit", "string")} | {c: text(c, "long") for c in COUNTS})
    )
    order = [F.col("conv").asc_nulls_first(), F.col("kind").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("hash").asc()]
    stream = both.repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text", "audit", *COUNTS)

    def replayed(b: pa.RecordBatch, talk: Replay | None, head: dict | None):
        """(head, its replay, what stands in place of a row) for all rows; a head row has None."""
        for i, kind, role, words in zip(range(b.num_rows), *(b.column(c).to_pylist() for c in ("kind", "role", "text"))):
            if kind == 0:
                yield "end", talk, head, (talk.inserted() if talk else [])
                head = b.select(["conv", "audit", *COUNTS]).slice(i, 1).to_pylist()[0]
                talk = Replay(head["audit"])
            else:
                yield "row", talk, head, talk.row(role, words)
        yield "batch", talk, head, []

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk = head = form = None
        for b in batches:
            form = form or pa.schema([pa.field(conv_col, b.schema.field("conv").type), *[pa.field(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            out = []
            for what, t, h, _ in replayed(b, talk, head):
                if what == "end" and h is not None:
                    out.append(_row(h, t))
                elif what == "batch":
                    talk, head = t, h
            if out:
                yield pa.RecordBatch.from_pylist(out, form)
        if head is not None:
            talk.inserted()
            yield pa.RecordBatch.from_pylist([_row(head, talk)], form)

    def _row(h: dict, t: Replay) -> dict:
        return {conv_col: h["conv"], **{c: h[c] for c in COUNTS}, "audit": h["audit"], "repaired_sha256": t.hash.hexdigest()}

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk = head = form = None
        place = 0
        for b in batches:
            form = form or pa.schema([pa.field(conv_col, b.schema.field("conv").type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
            out = []
            for what, t, h, said in replayed(b, talk, head):
                for role, words in said:
                    out.append({conv_col: h["conv"], "place": place, "role": role, "text": words})
                    place += 1
                place = 0 if what == "end" else place
                if what == "batch":
                    talk, head = t, h
            if out:
                yield pa.RecordBatch.from_pylist(out, form)
        if head is not None and (said := talk.inserted()):
            yield pa.RecordBatch.from_pylist([{conv_col: head["conv"], "place": place + k, "role": role, "text": words} for k, (role, words) in enumerate(said)], form)

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return stream.mapInArrow(digests, f"`{conv_col}` {kind}, {counts}, audit string, repaired_sha256 string"), stream.mapInArrow(texts, f"`{conv_col}` {kind}, place long, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: by the hash of conversation and turn a row is dropped, emptied, loses its
    marks, is there twice, or is the user's; nulls count as one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how: Column = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), how.alias("_how")).where("_how <> 0")
    out = out.withColumn("text", F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))).withColumn("role", F.when(F.col("_how") == 4, "user").otherwise(F.col("role")))
    return out.withColumn("_copy", F.explode(F.when(F.col("_how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair(damaged(rows), every=rows)[0]


def _ways() -> list[tuple[str, str, str, str, int, str]]:
    """(from, edits, initial that the row needs or '', role that it gets or '', cost, to) of all edits of a row with up to
    two insertions before it, for the SQL."""
    out, step = [], {n: {r[0]: r[1] for r in rules if r} for n, rules in GRAMMAR.items()}
    for p in GRAMMAR:
        now, before, cost = p, "", 0
        for _ in range(3):
            out.append((p, before + "D", "", "", cost + DELETE, now))
            for t, to in step[now].items():
                out.append((p, before + "K", t, "", cost + KEEP, to))
                if t in ROLES:
                    out.append((p, before + "R", "", ROLES[t], cost + REROLE, to))
            t = next(t for t in step[now] if t in ROLES)
            before, cost, now = before + "I", cost + INSERT, step[now][t]
    return out


def _inserted(p: str, n: int) -> str:
    """The text of n insertions where p is open, for the SQL."""
    out = ""
    for _ in range(n):
        t, p = next((r[0], r[1]) for r in GRAMMAR[p] if r and r[0] in ROLES)
        out += "\n" + ROLES[t] + ":"
    return out


_Q = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
_ENDS = [("talk", 0), ("more", 0), ("open", 1), ("first", 2)]
SQL = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS how FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE how <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
m AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS dup, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS was FROM o),
r AS (SELECT *, NOT blank AND NOT dup AND right(bare, 1) NOT IN ('.', '!', '?') AS short FROM m),
ids AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
x AS (SELECT cid, r.* FROM r JOIN ids ON r.conv_id IS NOT DISTINCT FROM ids.conv_id),
f AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::INT)::BIGINT AS blank, sum(dup::INT)::BIGINT AS duplicate, sum(short::INT)::BIGINT AS truncated,
        sum((was IS NOT NULL AND was || left(role, 1) NOT IN ('su', 'ua', 'au'))::INT)::BIGINT AS illegal, max(k) AS n FROM x GROUP BY cid),
w(p, edits, needs, gets, cost, q, said) AS (VALUES {", ".join(f"('{p}', '{e}', '{needs}', '{gets}', {cost}, '{q}', {_Q(_inserted(p, e.count('I')))})" for p, e, needs, gets, cost, q in _ways())}),
dp(cid, k, q, s) AS (SELECT cid, 0::BIGINT, 'talk', {{'c': 0, 'a': '', 'o': ''}} FROM ids
  UNION ALL SELECT dp.cid, dp.k + 1, w.q, min({{'c': dp.s.c + w.cost + CASE WHEN x.short AND right(w.edits, 1) <> 'D' THEN 1 ELSE 0 END, 'a': dp.s.a || w.edits,
      'o': dp.s.o || w.said || CASE right(w.edits, 1) WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || x.role || ':' || x.text ELSE chr(10) || w.gets || ':' || x.text END}})
    FROM dp JOIN x ON x.cid = dp.cid AND x.k = dp.k + 1 JOIN w ON w.p = dp.q
    WHERE (right(w.edits, 1) = 'D' OR NOT (x.blank OR x.dup)) AND (w.needs = '' OR w.needs = left(x.role, 1)) GROUP BY dp.cid, dp.k, w.q),
e AS (SELECT dp.cid, min({{'c': s.c + v.n * {INSERT}, 'a': s.a || repeat('I', v.n), 'o': s.o || v.said}}) AS s
  FROM dp LEFT JOIN f USING (cid) JOIN (VALUES {", ".join(f"('{p}', {n}, {_Q(_inserted(p, n))})" for p, n in _ENDS)}) v(p, n, said) ON v.p = dp.q WHERE dp.k = coalesce(f.n, 0) GROUP BY dp.cid)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  e.s.c::BIGINT AS cost, e.s.a AS audit, sha256(substr(e.s.o, 2)) AS repaired_sha256
FROM ids JOIN e USING (cid) LEFT JOIN f USING (cid)
"""
