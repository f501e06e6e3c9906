"""Boxes small enough to check by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwork.functions import geometry as g
from leafwork.operators import evaluate, graph, images, layout, ocr, plugins, structure, telemetry, typography
from leafwork.sources import files

BOX = "doc_id long, page_number int, word_idx int, x1 int, y1 int, x2 int, y2 int, confidence double, text string, page_width int, page_height int"


def boxes(spark, rows, width=800, height=1100):
    return spark.createDataFrame([(1, 1, i, *b, c, f"w{i}", width, height) for i, (b, c) in enumerate(rows)], BOX)


def test_iou(spark):
    df = spark.createDataFrame([((0, 0, 10, 10), (0, 0, 10, 10)), ((0, 0, 10, 10), (20, 20, 30, 30)), ((0, 0, 20, 20), (10, 10, 30, 30))], "a struct<x1:int,y1:int,x2:int,y2:int>, b struct<x1:int,y1:int,x2:int,y2:int>")
    assert [r[0] for r in df.select(g.iou("a", "b")).collect()] == [1.0, 0.0, pytest.approx(100 / 700)]


def test_normalised(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (-0.1, -0.1, 1.1, 1.1), (0.1, 0.2, 0.9, 0.8)], "a double, b double, c double, d double")
    n = g.normalised(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(800), F.lit(1100))
    assert [tuple(r) for r in df.select(*[v.alias(k) for k, v in n.items()]).collect()] == [(0, 0, 800, 1100), (0, 0, 800, 1100), (80, 220, 720, 880)]


def test_textlines(spark):
    w = boxes(spark, [((10, 10, 100, 30), 0.9), ((110, 12, 200, 32), 0.85), ((10, 80, 150, 100), 0.88)])
    got = layout.textlines(w).orderBy("line_idx").collect()
    assert [(r.x1, r.y1, r.x2, r.y2, r.confidence, r.word_ids) for r in got] == [(10, 10, 200, 32, 0.875, ["p1-w0", "p1-w1"]), (10, 80, 150, 100, 0.88, ["p1-w2"])]


@pytest.mark.parametrize("margins, two, one", [("as_code", [24, 399, 774], [29, 769]), ("ignore", [399], [])])
def test_columns(spark, margins, two, one):
    pair = boxes(spark, [((50, 60 * i, 350, 60 * i + 40), 0.9) for i in range(5)] + [((450, 60 * i, 750, 60 * i + 40), 0.9) for i in range(5)])
    assert layout.column_boundaries(pair, margins=margins).first().boundaries == two
    assert layout.column_boundaries(boxes(spark, [((60, 60 * i, 740, 60 * i + 40), 0.9) for i in range(5)]), margins=margins).first().boundaries == one


def test_collision(spark):
    got = layout.collisions(boxes(spark, [((0, 0, 10, 10), 0.9), ((12, 0, 22, 10), 0.9), ((80, 80, 90, 90), 0.9)], 100, 100)).orderBy("word_idx").collect()
    assert [(r.pressure, r.force_x, r.force_y, r.neighbours) for r in got] == [(0.96, -6, 0, [1]), (0.96, 6, 0, [0]), (0.0, 0, 0, [])]


def test_dense_page(spark):
    w = boxes(spark, [(((i % 20) * 38, (i // 20) * 50, (i % 20) * 38 + 36, (i // 20) * 50 + 24), 0.9) for i in range(200)]).withColumn("line_idx", F.col("word_idx"))
    e = layout.region_graph(w)
    c = layout.page_components(w, e)
    assert c.count() == 200 and c.select("cluster_id").distinct().count() == 1


def test_paragraph_clusters_anchor_on_the_first_line(spark):
    w = boxes(spark, [((10, 0, 100, 20), 0.9), ((10, 30, 100, 50), 0.9), ((10, 60, 100, 80), 0.9), ((10, 300, 100, 320), 0.9)]).withColumn("line_idx", F.col("word_idx")).withColumn("column_id", F.lit(0))
    got = {r.line_idx: (r.spatial_group_id, r.paragraph_candidate) for r in layout.paragraph_clusters(w).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (1, False), 3: (2, False)}


def test_greedy_merge(spark):
    w = boxes(spark, [((0, 0, 100, 100), 0.5), ((5, 5, 100, 100), 0.9), ((300, 300, 400, 400), 0.7)]).withColumn("line_idx", F.col("word_idx"))
    assert sorted((r.x1, r.x2, r.confidence, r.n_merged) for r in layout.greedy_merge(w).collect()) == [(0, 100, 0.9, 2), (300, 400, 0.7, 1)]


def test_ocr_order_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 1, 0, [(5.0, 35.0)]), (1, 1, 1, [(9.0, 25.0)]), (1, 1, 2, [(1.0, 19.0)])], "doc_id long, page_number int, box_idx int, quad array<struct<x:double,y:double>>")
    assert [r.box_idx for r in ocr.ocr_order(df).orderBy("ocr_order").collect()] == [2, 1, 0]


def test_edges(spark):
    n = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 100.0, 20.0), (1, 1, 1, 0.0, 30.0, 100.0, 20.0)], "doc_id long, page_number int, node int, x double, y double, width double, height double")
    got = sorted((r.src, r.dst, r.relation, r.weight) for r in graph.edges(n).collect())
    assert got == [(0, 1, "ADJACENT", 11.0), (0, 1, "BELOW", 11.0), (0, 1, "SAME_COLUMN", 30.0), (1, 0, "SAME_COLUMN", 30.0)]


def test_bands_keep_their_anchor(spark):
    n = spark.createDataFrame([(1, 1, i, 10.0 * i, y, 5.0, 5.0, 0, 1) for i, y in enumerate([0.0, 14.0, 29.0])], "doc_id long, page_number int, node int, x double, y double, width double, height double, column_id int, num_columns int")
    assert {r.node: r.band for r in graph.banded_order(n).collect()} == {0: 0, 1: 0, 2: 1}


def test_typography(spark):
    df = spark.createDataFrame([("heading", "x" * 40, 200.0, 30.0, None, "left_column"), ("table", "", 200.0, 30.0, [["x" * 20, "y"]], "full_width")], "block_type string, text string, width double, height double, table_rows array<array<string>>, layout_role string")
    got = {r.block_type: (r.font, r.status) for r in typography.solved(df).collect()}
    assert got == {"heading": (18.0, "wrapped"), "table": (9.0, "shrunk")}


def test_word_error_rate(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("a b", ""), ("", "")], "truth string, found string")
    assert [(r.errors, r.wer) for r in evaluate.wer(df).collect()] == [(1, pytest.approx(1 / 3, abs=1e-6)), (2, 1.0), (0, 0.0)]


def test_wer_of_many_words(spark):
    a = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(" ".join(a), " ".join(a[:50] + ["z"] + a[51:]))], "truth string, found string")
    assert evaluate.wer(df).first().errors == 1


def test_illegal_transition(spark):
    ev = spark.sql("select * from values (1L, 1L, timestamp_ntz'2020-01-01', 'INITIALIZED', 1d), (1L, 2L, timestamp_ntz'2020-01-02', 'OCR_COMPLETED', 1d) as t(doc_id, event_id, ts, state, latency)")
    assert [tuple(r) for r in telemetry.violations(ev).collect()] == [(1, 2, "INITIALIZED", "OCR_COMPLETED")]


def test_kernels():
    rng = np.random.default_rng(42)
    img = np.full((180, 130), 242, dtype=np.uint8)
    img[20:160:12, 15:115] = 40
    img[21:160:12, 15:115] = 40
    assert images.skew(images.rotated(img, -3)) == pytest.approx(3, abs=1)
    noisy = np.clip(img + rng.integers(-12, 13, img.shape), 0, 255).astype(np.uint8)
    assert 40 <= images.otsu(noisy) < 242
    assert (images.opened(img) <= img).all() and (images.closed(img) >= img).all()
    assert images.blur_score(np.full((9, 9), 7, np.uint8)) == 0
    assert images.resized(img, 0.5).shape == (90, 65) and images.clahe(img).shape == img.shape
    assert images.nl_means(noisy[:40, :40]).std() < noisy[:40, :40].astype(float).std() + 1
    with pytest.raises(ValueError):
        images.thresholded(img, "other")
    with pytest.raises(ValueError):
        images.resized(img, 0)


def test_perspective():
    img = np.full((120, 160), 20, dtype=np.uint8)
    for y in range(15, 105):
        a = 20 + (y - 15) // 6
        img[y, a : 140 - (y - 15) // 6] = 240
    out, found = images.flattened(img)
    assert found and (out > 200).mean() > 0.95
    assert images.flattened(np.full((20, 20), 240, np.uint8))[1] is False


def test_files_and_plugins(spark, tmp_path):
    for name, size in (("a.png", 10), ("b.TXT", 10), ("c.pdf", 2)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r.path.rsplit("/", 1)[1]: r.rejected for r in files.checked(files.scan(spark, str(tmp_path))).collect()}
    assert got == {"a.png": None, "b.TXT": "extension", "c.pdf": "unreadable"}
    assert files.profile() == files.Profile() == files.profile(str(tmp_path / "fast_draft.yaml"))
    with pytest.raises(ValueError):
        plugins.backend("detector", "other")


def test_text_rules(spark):
    df = spark.createDataFrame([("ABC DEF",), ("1) one",), ("- x",), ("one two three four five six",), ("ab",)], "t string")
    assert [r[0] for r in df.select(structure.text_class(F.col("t"))).collect()] == ["heading", "unknown", "list", "paragraph", "unknown"]


def test_orphans_of_all_nodes(spark, tmp_path):
    """Against brute force: two documents with a word at the top left and others in the second column."""
    from leafwork.operators import graph
    from leafwork.plans import document_queries as q

    wide = "w" * (51 * 36)  # over 51 rows of 36, so that the next word stands in the second column
    texts = [(1, f"{wide} beta"), (7, f"{wide} {'x' * 162} gamma"), (2, "\n".join(["some words of a line"] * 12))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    n = graph.nodes(q._decorated_lines(spark, str(tmp_path)))
    used = {(r.doc_id, r.page_number, k) for r in graph.edges(n).collect() for k in (r.src, r.dst)}
    at = {(r.doc_id, r.page_number, r.node): (r.x + r.width / 2, r.y + r.height / 2) for r in n.collect()}
    want = set()
    for a in at.keys() - used:
        far = [(round(((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5, 6), b[2]) for b in at if b[:2] == a[:2] and b != a]
        want |= {(*a, d, w) for w, d in sorted(far)[:1]}
    got = {(r.doc_id, r.page_number, r.src, r.dst, r.weight) for r in q.QUERIES["graph_orphans"](spark, str(tmp_path)).collect()}
    assert got == want and {(1, 0, 1), (1, 1, 0)} <= {(g[0], g[2], g[3]) for g in got} and 7 in {g[0] for g in got}


def test_word_errors_of_whole_turns(spark, tmp_path):
    from leafwork.plans import document_queries as q

    turns = [(1, 0, " ".join(f"a{i % 90}" for i in range(150))), (1, 1, " ".join(f"a{i % 80}" for i in range(140)) + " end"), (1, 2, "one"), (2, 0, "x " * 13 + "y"), (2, 1, "x " * 13 + "z\n"), (2, 2, ""), (3, 0, None)]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in turns], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    own = {(c, t): x.split() for c, t, x in turns if x is not None}
    want = {(*k, edits(a, own[k[0], k[1] + 1]), len(a), round(edits(a, own[k[0], k[1] + 1]) / len(a), 6)) for k, a in own.items() if (k[0], k[1] + 1) in own}
    assert {tuple(r) for r in q.QUERIES["evaluate_wer"](spark, str(tmp_path)).collect()} == want


def test_one_to_one_goes_on_until_no_pair_is_left(spark):
    from leafwork.operators import evaluate

    # Along the row each box overlaps the next of the other side a little less, so a greedy choice takes one pair at a time.
    box = lambda i, x: (1, 1, i, x, 0, x + 1000, 10)
    at = [0]
    for k in range(13):
        at.append(at[-1] + 100 + 5 * k)
    cols = "doc_id long, page_number int, {} int, x1 int, y1 int, x2 int, y2 int"
    found = spark.createDataFrame([box(i, x) for i, x in enumerate(at[::2])], cols.format("line_idx"))
    truth = spark.createDataFrame([box(i, x) for i, x in enumerate(at[1::2])], cols.format("truth_idx"))
    left, want = sorted(((-r.iou, r.line_idx, r.truth_idx) for r in evaluate.pairs(found, truth).collect())), []
    while left:
        want.append(left[0][1:])
        left = [p for p in left if p[1] != left[0][1] and p[2] != left[0][2]]
    got = evaluate.one_to_one(found, truth).collect()
    assert sorted((r.line_idx, r.truth_idx) for r in got) == sorted(want) and len(want) == 7


def test_confidence_of_blocks_rounds_as_sql(spark):
    rows = [(1, 0, 0, 0.85), (1, 0, 1, 0.743333), (1, 1, 2, 0.75), (1, 1, 3, 0.78), (1, 1, 4, 0.69375), (1, 1, 5, 0.735), (1, 2, 6, 0.745), (1, 2, 7, 0.723333), (1, 3, 8, None)]
    n = spark.createDataFrame([(d, 1, b, i, f"t{i}", 0.0, 20.0 * i, 9.0, 9.0, c) for d, b, i, c in rows], "doc_id long, page_number int, block_no int, node int, text string, x double, y double, width double, height double, confidence double")
    got = {r.block_no: r.confidence for r in structure.blocks_of(n, "paragraph", ["y", "x"], " ", F.lit(0)).collect()}
    assert got == {0: 0.796667, 1: 0.739688, 2: 0.734167, 3: None}
