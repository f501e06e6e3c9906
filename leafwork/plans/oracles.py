"""SQL for DuckDB that the layout queries are held against, as chains of common table expressions."""

from __future__ import annotations

#: name: (tables that it needs, its query)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "src": ((), "SELECT doc_id, text FROM documents"),
    "w0": (("src",), "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM src WHERE text IS NOT NULL"),
    "w1": (("w0",), "SELECT * FROM (SELECT doc_id, ln, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS wn, CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 1 END AS nc, CASE WHEN doc_id % 3 = 1 THEN 36 ELSE 90 END AS wc FROM w0) WHERE text <> ''"),
    "w2": (("w1",), "SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, ln ORDER BY wn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM w1"),
    "w3": (("w2",), "SELECT *, off // wc AS vr FROM w2"),
    "tall": (("w3",), "SELECT doc_id, ln, max(vr) + 1 AS h FROM w3 GROUP BY ALL"),
    "tops": (("tall",), "SELECT doc_id, ln, coalesce(sum(h) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 2 * ln AS top FROM tall"),
    "w4": (("w3", "tops"), "SELECT w3.*, (top + vr) AS row, (top + vr) // (50 * nc) + 1 AS page_number, (top + vr) % (50 * nc) AS r FROM w3 JOIN tops USING (doc_id, ln)"),
    "words": (("w4",), """SELECT doc_id, page_number, x1, y1, least(x1 + 8 * length(text), 40 + 380 * (r // 50) + CASE WHEN nc = 2 THEN 340 ELSE 720 END) AS x2, y1 + 16 AS y2,
        word_idx, (45 + (31 * doc_id + 17 * word_idx) % 55) / 100.0::DOUBLE AS confidence, text, 800 AS page_width, 1100 AS page_height
        FROM (SELECT *, 40 + 380 * (r // 50) + 8 * (off % wc) AS x1, 40 + 20 * (r % 50) AS y1, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY ln, wn) - 1 AS word_idx FROM w4)"""),
    "gated": (("words",), "SELECT *, confidence < 0.7::DOUBLE AS low_confidence FROM words WHERE confidence >= 0.5::DOUBLE"),
    "l0": (("gated",), """SELECT *, CASE WHEN abs((y1 + y2) / 2.0::DOUBLE - (py1 + py2) / 2.0::DOUBLE) <= 0.5::DOUBLE * greatest(1, ((y2 - y1) + (py2 - py1)) / 2.0::DOUBLE)
        AND greatest(x1, px1) - least(x2, px2) <= 0.03::DOUBLE * page_width THEN 0 ELSE 1 END AS brk FROM
        (SELECT *, lag(x1) OVER o AS px1, lag(x2) OVER o AS px2, lag(y1) OVER o AS py1, lag(y2) OVER o AS py2 FROM gated WINDOW o AS (PARTITION BY doc_id, page_number ORDER BY y1, x1, word_idx))"""),
    "l1": (("l0",), "SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_number ORDER BY y1, x1, word_idx ROWS UNBOUNDED PRECEDING)::INT - 1 AS line_idx FROM l0"),
    "lines": (("l1",), """SELECT doc_id, page_number, line_idx, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(avg(confidence), 6) AS confidence, count(*) AS word_count,
        string_agg(text, ' ' ORDER BY x1, word_idx) AS text, 'p' || page_number || '-l' || line_idx AS region_id, 800 AS page_width, 1100 AS page_height FROM l1 GROUP BY doc_id, page_number, line_idx"""),
    "ev": (("lines",), """SELECT doc_id, page_number, s, sum(d) AS d FROM (SELECT doc_id, page_number, greatest(0, x1) AS s, CASE WHEN confidence <= 0 THEN 5 ELSE trunc(confidence * 10)::INT END AS d FROM lines WHERE greatest(0, x1) < least(x2, 800)
        UNION ALL SELECT doc_id, page_number, least(x2, 800), -CASE WHEN confidence <= 0 THEN 5 ELSE trunc(confidence * 10)::INT END FROM lines WHERE greatest(0, x1) < least(x2, 800)
        UNION ALL SELECT DISTINCT doc_id, page_number, unnest([0, 800]), 0 FROM lines) GROUP BY ALL"""),
    "dens": (("ev",), """SELECT * FROM (SELECT doc_id, page_number, s, lead(s) OVER o AS e, sum(d) OVER (o ROWS UNBOUNDED PRECEDING) AS density FROM ev WINDOW o AS (PARTITION BY doc_id, page_number ORDER BY s)) WHERE e IS NOT NULL AND s < e"""),
    "low": (("dens",), "SELECT *, density <= 0.05::DOUBLE * (sum(density * (e - s)) OVER (PARTITION BY doc_id, page_number) / 800::DOUBLE) AS low FROM dens"),
    "gaps": (("low",), """SELECT doc_id, page_number, min(s) AS s, max(e) - 1 AS t FROM (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_number ORDER BY s) AS run FROM
        (SELECT *, CASE WHEN low IS NOT DISTINCT FROM lag(low) OVER (PARTITION BY doc_id, page_number ORDER BY s) THEN 0 ELSE 1 END AS brk FROM low)) WHERE low GROUP BY doc_id, page_number, run HAVING max(e) - min(s) >= 8"""),
    "cols": (("gaps", "lines"), """SELECT p.doc_id, p.page_number, coalesce(list(((s + t) // 2)::INT ORDER BY s) FILTER (WHERE s IS NOT NULL), []) AS boundaries, count(s) + 1 AS column_count
        FROM (SELECT DISTINCT doc_id, page_number FROM lines) p LEFT JOIN gaps g ON p.doc_id = g.doc_id AND p.page_number = g.page_number GROUP BY ALL"""),
    "cols_inner": (("gaps", "lines"), """SELECT p.doc_id, p.page_number, coalesce(list(((s + t) // 2)::INT ORDER BY s) FILTER (WHERE s IS NOT NULL), []) AS boundaries, count(s) + 1 AS column_count
        FROM (SELECT DISTINCT doc_id, page_number FROM lines) p LEFT JOIN (SELECT * FROM gaps WHERE s > 0 AND t < 799) g ON p.doc_id = g.doc_id AND p.page_number = g.page_number GROUP BY ALL"""),
    "hit": (("lines", "cols"), "SELECT l.*, c.boundaries, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy, list_position(list_transform(c.boundaries, lambda b: (x1 + x2) / 2.0::DOUBLE <= b + 0.015::DOUBLE * 800), true) AS h FROM lines l JOIN cols c USING (doc_id, page_number)"),
    "direct": (("hit",), """SELECT *, boundaries[h] AS b, CASE WHEN coalesce(h, 0) = 0 THEN len(boundaries) WHEN cx < boundaries[h] - 0.015::DOUBLE * 800 THEN h - 1
        WHEN greatest(0, boundaries[h] - x1) > 1.5::DOUBLE * greatest(0, x2 - boundaries[h]) THEN h - 1 WHEN greatest(0, x2 - boundaries[h]) > 1.5::DOUBLE * greatest(0, boundaries[h] - x1) THEN h END AS direct FROM hit"""),
    "vote": (("direct",), """SELECT a.doc_id, a.page_number, a.line_idx, arg_min(CASE WHEN o.cx < a.b THEN a.h - 1 ELSE a.h END, abs(a.cy - o.cy) * 1000000 + o.line_idx) AS v FROM direct a JOIN direct o ON a.doc_id * 1000000 + a.page_number = o.doc_id * 1000000 + o.page_number
        AND a.line_idx <> o.line_idx AND abs(o.cx - a.b) > 0.015::DOUBLE * 800 AND abs(a.cy - o.cy) < 200 WHERE a.direct IS NULL GROUP BY ALL"""),
    "assigned": (("direct", "vote"), "SELECT d.* EXCLUDE (boundaries, cx, cy, h, b, direct), coalesce(direct, v, h - 1)::INT AS column_id FROM direct d LEFT JOIN vote USING (doc_id, page_number, line_idx)"),
    "ordered": (("assigned",), "SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY column_id, y1, x1, -((x2 - x1) * (y2 - y1)), region_id, line_idx) - 1 AS reading_order FROM assigned"),
    "bands": (("lines",), """SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_number ORDER BY y1, line_idx) - 1 AS row_band FROM (SELECT *, CASE WHEN y1 > max(y2) OVER (PARTITION BY doc_id, page_number ORDER BY y1, line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5
        OR row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y1, line_idx) = 1 THEN 1 ELSE 0 END AS brk FROM lines)"""),
    "cells": (("bands",), """SELECT * EXCLUDE (brk, b2), sum(b2) OVER (PARTITION BY doc_id, page_number, row_band ORDER BY x1, line_idx) - 1 AS col_band FROM (SELECT *, CASE WHEN x1 > max(x2) OVER (PARTITION BY doc_id, page_number, row_band ORDER BY x1, line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 8
        OR row_number() OVER (PARTITION BY doc_id, page_number, row_band ORDER BY x1, line_idx) = 1 THEN 1 ELSE 0 END AS b2 FROM bands)"""),
    "rows": (("cells",), "SELECT doc_id, page_number, row_band, max(col_band) + 1 AS k, min(y1) AS top FROM cells GROUP BY ALL"),
    "tables": (("rows",), """SELECT doc_id, page_number, count(*)::INT AS n_rows, count(*) >= 3 AND count_if(k >= 2) >= greatest(3, count(*) * 0.6::DOUBLE) AND (coalesce(avg(gap), 0) <= 0 OR round(stddev_pop(gap) / avg(gap), 9) <= 0.45::DOUBLE) AS table_candidate
        FROM (SELECT *, lead(top) OVER (PARTITION BY doc_id, page_number ORDER BY row_band) - top AS gap FROM rows) GROUP BY doc_id, page_number"""),
    "graph": (("lines",), """SELECT a.doc_id, a.page_number, a.line_idx AS src, b.line_idx AS dst FROM lines a JOIN lines b ON a.doc_id * 1000000 + a.page_number = b.doc_id * 1000000 + b.page_number AND a.line_idx <> b.line_idx
        AND abs(trunc((a.x1 + a.x2) / 2.0::DOUBLE)::INT // 29 - trunc((b.x1 + b.x2) / 2.0::DOUBLE)::INT // 29) <= 4 AND abs(trunc((a.y1 + a.y2) / 2.0::DOUBLE)::INT // 29 - trunc((b.y1 + b.y2) / 2.0::DOUBLE)::INT // 29) <= 4
        AND greatest(greatest(a.x1, b.x1) - least(a.x2, b.x2), greatest(a.y1, b.y1) - least(a.y2, b.y2)) <= 88"""),
    "pad": (("gated",), "SELECT *, greatest(0, x1 - 4) AS vx1, greatest(0, y1 - 6) AS vy1, least(800, x2 + 4) AS vx2, least(1100, y2 + 6) AS vy2 FROM gated"),
    "hits": (("pad",), """SELECT *, w * h AS over, CASE WHEN abs(dx) > abs(dy) THEN CASE WHEN dx > 0 THEN w ELSE -w END ELSE 0 END AS fx, CASE WHEN abs(dx) > abs(dy) THEN 0 WHEN dy > 0 THEN h ELSE -h END AS fy FROM
        (SELECT a.doc_id, a.page_number, a.word_idx, b.word_idx AS other, least(a.vx2, b.vx2) - greatest(a.vx1, b.vx1) AS w, least(a.vy2, b.vy2) - greatest(a.vy1, b.vy1) AS h,
        (a.x1 + a.x2) / 2.0::DOUBLE - (b.x1 + b.x2) / 2.0::DOUBLE AS dx, (a.y1 + a.y2) / 2.0::DOUBLE - (b.y1 + b.y2) / 2.0::DOUBLE AS dy
        FROM pad a JOIN pad b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.word_idx <> b.word_idx AND a.vx1 < b.vx2 AND b.vx1 < a.vx2 AND a.vy1 < b.vy2 AND b.vy1 < a.vy2)"""),
    "ledger": ((), """SELECT doc_id, n // 50 + 1 AS page_number, (n % 50) * 4 + k AS word_idx, 40 + 180 * k AS x1, 40 + 20 * (n % 50) AS y1, 40 + 180 * k + least(160, 8 * length(text)) AS x2, 56 + 20 * (n % 50) AS y2, 0.9::DOUBLE AS confidence, text, 800 AS page_width, 1100 AS page_height
        FROM (SELECT doc_id, n, unnest(c) AS text, generate_subscripts(c, 1) - 1 AS k FROM (SELECT o_orderkey // 4096 AS doc_id, row_number() OVER (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey) - 1 AS n,
        [o_orderkey::VARCHAR, o_orderstatus, round_even(o_totalprice * 100, 0)::BIGINT::VARCHAR, o_orderpriority] AS c FROM orders))"""),
}


#: Parts that several others read.
HELD = {"words", "gated", "lines", "cols", "hit", "direct", "vote"}


def sql(query: str, *needs: str, swap: dict[str, str] | None = None) -> str:
    """query over the parts that it needs, and those that these need. swap: other bodies of parts."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name not in done:
            for n in PARTS[name][0]:
                visit(n)
            done.append(name)

    for n in needs:
        visit(n)
    bodies = {n: (swap or {}).get(n, PARTS[n][1]) for n in done}
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' * (n in HELD)}({b})" for n, b in bodies.items()) + "\n" + query
