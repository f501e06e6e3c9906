"""Profiles, the chain of a page, plug-ins, runs with contracts and failures, outputs, ground truth."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwork.operators import evaluate, images, layout, plugins, structure
from leafwork.plans import run
from leafwork.sources import files, sinks
from leafwork.streaming import events

HIGH = """
profile_id: high_accuracy
preprocessing: {denoise: true, denoise_strategy: nlmeans, adaptive_denoise: true, blur_safe_mode: false, deskew: true, sharpen: false, sharpen_strength: 0.3, clahe_clip_limit: 2.0, thresholding: true, threshold_mode: otsu, adaptive_block_size: 31, adaptive_C: 10, morphology_opening: false, morphology_kernel_size: 2, morphology_closing: false, resize_scale: 1.0, perspective_correction: true}
layout: {model: "layoutlmv3", confidence_threshold: 0.7}
ocr: {device: cpu, language: en, batch_size: 8}
postprocess: {confidence_threshold: 0.7, grammar_correction: true, merge_paragraphs: true}
export: {formats: [json, docx], output_directory: ./data/output}
"""


def bars(h=275, w=200, step=12, ink=40, ground=242):
    img = np.full((h, w), ground, dtype=np.uint8)
    for y in range(30, h - 30, step):
        img[y : y + 5, 20 : w - 20] = ink
    return img


def scan(seed=42):
    """A tilted, noisy page."""
    rng = np.random.default_rng(seed)
    return np.clip(images.rotated(bars(), -3).astype(int) + rng.integers(-12, 13, (275, 200)), 0, 255).astype(np.uint8)


def test_profile_file(tmp_path):
    (tmp_path / "high_accuracy.yaml").write_text(HIGH)
    s = files.settings(str(tmp_path / "high_accuracy.yaml"))
    assert s["layout"] == {"confidence_threshold": 0.7} and s["export"]["formats"] == ["json", "docx"] and s["postprocess"]["grammar_correction"] is True
    p = files.profile(str(tmp_path / "high_accuracy.yaml"))
    assert (p.profile_id, p.thresholding, p.perspective_correction, p.clahe_clip_limit, p.adaptive_C) == ("high_accuracy", True, True, 2.0, 10)
    (tmp_path / "bad.yaml").write_text("preprocessing: {treshold: true}")
    with pytest.raises(ValueError):
        files.settings(str(tmp_path / "bad.yaml"))
    _, done, _ = images.prepared(scan(), p)
    assert [d.split("(")[0].split("_blur")[0] for d in done] == ["adaptive_decision", "grayscale", "denoise_skipped_already_sharp", "deskew", "clahe", "threshold_otsu", "perspective_unchanged"]
    assert images.prepared(scan(), files.Profile())[1][1:] == ["clahe(clip=1.5)"]


@pytest.mark.parametrize("change, want", [
    ({}, "nlmeans"), ({"denoise_strategy": "gaussian"}, "gaussian"), ({"denoise_strategy": "gaussian", "blur_safe_mode": True}, "nlmeans"), ({"denoise_strategy": "none"}, "none"), ({"denoise_strategy": "x"}, "unknown_strategy_skipped(x)"),
    ({"adaptive_denoise": True}, "skipped_already_sharp"),
])
def test_denoise_strategies(change, want):
    small = bars(80, 60)
    out, label = images.denoised(small, files.Profile(**change), 1500.0)
    assert label == f"{want}_blur=1500.00" and out.shape == small.shape
    assert images.denoised(small, files.Profile(**change), 900.0)[1] == "bilateral_recovery_mode_blur=900.00"


def test_blurred_pages_get_their_own_settings():
    soft = images.resized(images.resized(np.full((120, 90), 128, np.uint8), 0.5), 2.0)
    _, done, score = images.prepared(soft, files.Profile(thresholding=True))
    assert score < 300 and done == [f"adaptive_decision(blurred,blur={score:.1f})", "grayscale", "sharpen(s=0.5)", "clahe(clip=1.0)", "threshold_adaptive(bs=19,C=18)", "morphology_open(k=2)"]


def test_image_kernels():
    page = scan()
    assert abs(images.skew(images.deskewed(page))) <= 1
    ramp = np.tile(np.arange(0, 200, 2, dtype=np.uint8), (40, 1))
    assert np.abs(images.resized(ramp, 2.0)[:, 4:-4].astype(int) - np.interp((np.arange(200) + 0.5) / 2 - 0.5, np.arange(100), ramp[0])[4:-4]).max() <= 1
    assert (images.resized(np.kron(np.arange(16, dtype=np.uint8).reshape(4, 4) * 10, np.ones((4, 4), np.uint8)), 0.25) == np.arange(16).reshape(4, 4) * 10).all()
    colour = np.random.default_rng(1).integers(0, 256, (32, 32, 3), dtype=np.uint8)
    assert np.abs(images.from_lab(images.to_lab(colour)).astype(int) - colour).max() <= 1
    even = np.zeros((12, 12), np.uint8)
    even[3:7, 3:7] = 255
    even[9, 9] = 255
    opened = images.opened(even, 2)
    assert opened[9, 9] == 0 and (opened[3:7, 3:7] == 255).all() and opened.sum() == 16 * 255
    joined = images.side_by_side(np.zeros((4, 3), np.uint8), np.zeros((6, 2, 3), np.uint8))
    assert joined.shape == (6, 25, 3) and (joined[5, :3] == 255).all() and (joined[:, 3:23] == 200).all()


def test_blocks_by_shape():
    img = np.full((220, 300), 255, dtype=np.uint8)
    for y in (20, 30, 40, 50):
        img[y : y + 5, 20:120] = 0
    for y in range(110, 200, 30):
        img[y : y + 6, 160:280] = 0
    got = images.found_blocks(img)
    assert [b[:4] for b in got][0] == (20, 20, 120, 55) and len(got) == 4
    mask = np.random.default_rng(3).random((40, 50)) < 0.45
    label, n = images.components(mask)
    seen, want = np.zeros_like(label), 0
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            want += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 40 and 0 <= b < 50 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = want
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert n == want and len({(p, q) for p, q in zip(seen[mask], label[mask])}) == n
    assert images.has_bands(bars(), (0, 0, 200, 275)) and not images.has_bands(np.full((100, 100), 255, np.uint8), (0, 0, 100, 100))


def pixmap(img):
    return images.as_pixmap(img)


def test_rasteriser(spark):
    two = pixmap(bars()) + pixmap(scan())
    df = spark.createDataFrame([("a", bytearray(two)), ("b", bytearray(b"nothing")), ("c", bytearray(two[:-5])), ("d", None)], "doc_key string, content binary")
    got = {(r.doc_key, r.page_number): (r.height, r.width, r.error) for r in plugins.rasterised(df).collect()}
    assert got == {("a", 1): (275, 200, None), ("a", 2): (275, 200, None), ("b", 0): (0, 0, "not a pixmap"), ("c", 0): (0, 0, "pixmap cut short"), ("d", 0): (0, 0, "no pages")}
    assert [r.error for r in plugins.rasterised(df.where("doc_key = 'a'"), most=1).collect()] == ["2 pages, more than 1"]
    assert (plugins.PixmapRasteriser().pages(pixmap(bars()))[0][..., 1] == bars()).all()


def test_a_recogniser_that_raised_is_not_asked_again(spark):
    class Breaks:
        def __init__(self):
            self.n = 0

        def read(self, image):
            self.n += 1
            if self.n == 2:
                raise RuntimeError("out of order")
            return [([(0, 0), (1, 0), (1, 1), (0, 1)], "x", 0.9)]

    pages = spark.createDataFrame([(1, i, 2, 2, bytearray(4)) for i in range(4)], "doc_id long, page_number int, height int, width int, data binary").coalesce(1)
    got = [(r.page_number, r.text, r.failed) for r in plugins.recognised(pages, make=Breaks).orderBy("page_number").collect()]
    assert got == [(0, "x", False), (1, "", True), (2, "", True), (3, "", True)]


def test_crops():
    img = np.arange(400, dtype=np.float64).reshape(20, 20)
    assert plugins.crop(img, (2, 2, 12, 12)).shape == (10, 10, 3) and plugins.crop(img, (2, 2, 12, 12)).max() == 255


def stage(name, state, fn, **more):
    return run.Stage(name, state, fn, {"id": "bigint"}, **more)


def test_runs(spark):
    ok = lambda t: spark.range(3)
    calls = []

    def flaky(t):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("once")
        return spark.range(2)

    def fail(e):
        def f(t):
            raise e

        return f

    first = [stage("A", "LOADED", ok), stage("B", "PREPROCESSED", ok), stage("C", "LAYOUT_ANALYZED", ok)]
    done = run.execute([*first, stage("D", "OCR_COMPLETED", flaky, tries=2)])
    assert done.final_state == "COMPLETED" and len(calls) == 2 and list(done.seconds) == ["A", "B", "C", "D"] and done.status == "success" and [s for s, _ in done.states][-1] == "COMPLETED"
    bad = run.execute([first[0], stage("B", "PREPROCESSED", lambda t: "text")])
    assert bad.final_state == "FAILED" and "Contract Violation" in bad.failures[0]
    assert run.execute([stage("A", "LOADED", lambda t: spark.range(1).select(F.col("id").cast("string")))]).final_state == "FAILED"
    assert run.execute([*first, stage("D", "OCR_COMPLETED", fail(run.Recoverable("x")))]).final_state == "PARTIAL_FAILURE"
    assert run.execute([*first, stage("D", "OCR_COMPLETED", fail(RuntimeError("x")), tries=2)]).final_state == "FAILED"
    assert run.execute([*first, stage("D", "OCR_COMPLETED", fail(RuntimeError("x")), fallback=ok)]).final_state == "COMPLETED"
    assert run.execute([stage("D", "OCR_COMPLETED", ok)]).final_state == "FAILED"  # no such step from the first state
    token = run.Token()

    def cancel(t):
        token.cancel(spark)
        return spark.range(1)

    done = run.execute([stage("A", "LOADED", cancel), stage("B", "PREPROCESSED", ok)], token, spark)
    assert done.final_state == "FAILED" and list(done.tables) == ["A"]


def test_folder_to_outputs(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ppm").write_bytes(pixmap(bars(step=40)) + pixmap(bars(step=60)))
    (tmp_path / "in" / "b.txt").write_bytes(b"no picture")
    (tmp_path / "p.yaml").write_text("preprocessing: {thresholding: true}\nexport: {formats: [json, txt, docx]}")
    assert run.main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--profile", str(tmp_path / "p.yaml"), "--debug"]) == 0
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert said[0]["final_state"] == "COMPLETED" and {(x["format"], x["status"]) for x in said[1:]} == {(k, "success") for k in ("json", "txt", "docx", "overlays")}
    doc = json.loads(spark.read.text(str(tmp_path / "out" / "json")).first()[0])
    assert [p["page_number"] for p in doc["pages"]] == [1, 2]
    assert run.main(["--input", str(tmp_path / "nowhere"), "--output", str(tmp_path / "out2")]) == 1


TOKENS = "doc_id long, page_number int, token_id string, block_type string, block_order int, text string, x int, y int, width int, height int, column_id int, num_columns int, confidence double, table_rows array<array<string>>"


def test_outputs_by_their_templates(spark):
    row = lambda p, i, kind, text, table=None: (1, p, f"t{i}", kind, i, text, 10, 20, 100, 40, 0, 2 if p == 1 else 1, 0.9, table)
    t = spark.createDataFrame([row(1, 0, "heading", "TITLE"), row(1, 1, "table", "", [[" a ", "b"], ["1", "2", "3"]]), row(1, 2, "key_value", "k : v\nplain"), row(1, 3, "list", "• one\n- two"), row(2, 0, "table", "h | i\nj | k"), row(2, 1, "paragraph", "text")], TOKENS)
    line = "=" * 60
    assert sinks.txt(t).first().txt == f"{line}\nPAGE 1 (2 column(s))\n{line}\n\n## TITLE\n\n[TABLE]\n| a | b |\n| 1 | 2 | 3 |\n\n  k : v\n  plain\n\n  • one\n  - two\n\n\n{line}\nPAGE 2\n{line}\n\n[TABLE]\n| h | i |\n| j | k |\n\ntext\n\n"
    assert sinks.markdown(t).first().markdown == "# TITLE\n\n| a | b |\n| --- | --- |\n| 1 | 2 | 3 |\n\n**k:** v\nplain\n\n- one\n- two\n\n---\n\n| h | i |\n| --- | --- |\n| j | k |\n\ntext\n\n---\n"
    d = [(r.page_number, r.block_order, r.op, r.text, r.row, r.col, r.bold, r.note is not None) for r in sinks.docx_commands(t).orderBy("page_number", "block_order", "part").collect()]
    assert d[:3] == [(1, 0, "heading_1", "TITLE", 0, 0, False, True), (1, 1, "cell", "a", 0, 0, True, False), (1, 1, "cell", "b", 0, 1, True, False)]
    assert d[6:10] == [(1, 1, "paragraph", "", 0, 0, False, True), (1, 2, "paragraph", "k : v\nplain", 0, 0, False, True), (1, 3, "bullet", "one", 0, 0, False, False), (1, 3, "bullet", "two", 0, 0, False, True)]
    assert d[10][:3] == (2, -1, "page_break")
    c = [(r.x, r.y, r.width, r.height, r.face, r.text) for r in sinks.draw_commands(t).where("page_number = 1 and op = 'cell'").orderBy("part").collect()]
    assert c[0] == (10, 1060, 50, 20, "Helvetica-Bold", "a") and c[4] == (10 + 2 * 100 / 3, 1040, 100 / 3, 20, "Helvetica", "3")


def test_pages_without_large_boxes(spark):
    b = spark.createDataFrame([(1, 1, 0, 0, 0, 5, 5, 0.9, 800, 1100), (1, 2, 0, 0, 0, 500, 500, 0.9, 800, 1100)], "doc_id long, page_number int, line_idx int, x1 int, y1 int, x2 int, y2 int, confidence double, page_width int, page_height int")
    assert [(r.page_number, r.n_merged) for r in layout.greedy_merge(b).collect()] == [(2, 1)]
    assert layout.greedy_merge(b.where("page_number = 1")).count() == 0 and layout.greedy_merge(b.limit(0)).count() == 0


def test_ground_truth(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.json").write_text(json.dumps({"form": [{"id": 3, "box": [1, 2, 30, 40], "text": "Name:", "label": "question"}]}))
    assert [tuple(r) for r in evaluate.ground_truth(spark, str(tmp_path / "f"), "funsd").collect()] == [("a.json", 3, 1, 2, 30, 40, "Name:")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "b.txt").write_text("1,2,30,2,30,40,1,40,TOTAL, 5\n")
    assert [tuple(r) for r in evaluate.ground_truth(spark, str(tmp_path / "s"), "sroie").collect()] == [("b.txt", 0, 1, 2, 30, 40, "TOTAL, 5")]
    with pytest.raises(ValueError):
        evaluate.ground_truth(spark, str(tmp_path), "other")


def test_time_of_many_boxes(spark):
    b = spark.createDataFrame([(1, 1, i, i % 20 * 38, i // 20 * 50, i % 20 * 38 + 36, i // 20 * 50 + 24, 800, 1100) for i in range(200)], "doc_id long, page_number int, line_idx int, x1 int, y1 int, x2 int, y2 int, page_width int, page_height int")
    layout.region_graph(b).count()
    began = time.time()
    assert layout.region_graph(b).count() > 0 and time.time() - began < 5


def test_merged_tokens_stay_within_clusters(spark):
    row = lambda i, cluster, table: (1, 1, i, "paragraph", 0, cluster, table, f" t{i} ", 10 + i, 5, 0.8)
    t = spark.createDataFrame([row(0, 1, False), row(1, 1, False), row(2, 2, False), row(3, 2, True), row(4, 2, True)], "doc_id long, page_number int, block_order int, block_type string, column_id int, cluster_id long, table_candidate boolean, text string, y int, height int, confidence double")
    assert [r.text.strip() for r in structure.merged_tokens(t).orderBy("block_order").collect()] == ["t0 t1", "t2", "t3 t4"]


def test_files_as_they_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"x" * 9)
    got = []

    def sink(batch, number):
        got.extend((r.path.rsplit("/", 1)[1], r.rejected) for r in files.checked(batch).collect())

    for name in ("b.txt", "c.pdf"):
        events.each_batch(events.arriving_files(spark, str(tmp_path / "in")), sink, str(tmp_path / "state")).awaitTermination(120)
        (tmp_path / "in" / name).write_bytes(b"y" * 9)
    assert got[0] == ("a.png", None) and ("b.txt", "extension") in got and len(got) == 2


def test_merged_confidence_rounds_as_sql(spark):
    t = spark.createDataFrame([(1, p, i, "paragraph", 0, f"t{i}", 10 + i, 5, c) for p, cs in ((1, (0.85, 0.743333)), (2, (0.75, 0.78, 0.7))) for i, c in enumerate(cs)], "doc_id long, page_number int, block_order int, block_type string, column_id int, text string, y int, height int, confidence double")
    assert sorted((r.page_number, r.confidence) for r in structure.merged_tokens(t).collect()) == [(1, 0.796667), (2, 0.7325)]
