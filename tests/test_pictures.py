"""Pictures of pages that the plain tests of outlines and kernels don't hold."""

import os

import numpy as np
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafwork.operators import contours, images, plugins
from leafwork.sources import compositors, files

SF = "/root/testdata/sf0.001"
PROFILE = files.Profile(denoise=True, denoise_strategy="bilateral", deskew=True, thresholding=True, perspective_correction=True, resize_scale=0.5)
driver_data = pytest.mark.skipif(not os.path.exists(SF), reason="driver data not present")


@pytest.mark.parametrize("points, want", [
    ([(50, 20), (90, 60), (50, 100), (10, 60)], [(50, 20), (90, 60), (50, 100), (10, 60)]),  # stands on a corner
    ([(50, 20), (10, 60), (50, 100), (90, 60)], [(50, 20), (90, 60), (50, 100), (10, 60)]),  # the other way round
    ([(12, 12), (66, 15), (90, 60), (41, 130)], [(12, 12), (66, 15), (90, 60), (41, 130)]),  # least and greatest sums and differences name a corner twice
])
def test_corners_are_four(points, want):
    assert contours.in_order(np.array(points, dtype=np.float64)).tolist() == [list(map(float, p)) for p in want]


@pytest.mark.parametrize("points", [[(49, 25), (92, 68), (49, 111), (6, 68)], [(50, 20), (90, 60), (50, 100), (10, 60)]])
def test_page_on_a_corner_is_flattened(monkeypatch, points):
    q = contours.in_order(np.array(points, dtype=np.float64))
    monkeypatch.setattr(images, "page_corners", lambda g: q)
    y, x = np.mgrid[0:138, 0:100]
    img = np.where(abs(x - q[:, 0].mean()) + abs(y - q[:, 1].mean()) <= 44, 220, 20).astype(np.uint8)
    out, found = images.flattened(img)
    assert found and min(out.shape) >= 55 and np.median(out) == 220


@pytest.mark.parametrize("points", [[(12, 12), (66, 15), (58, 132), (41, 60)], [(10, 10), (90, 10), (50, 60), (10, 110)], [(10, 10), (90, 10), (50, 20), (10, 110)]])
def test_corners_of_no_rectangle_leave_the_page(monkeypatch, points):
    q = contours.in_order(np.array(points, dtype=np.float64))
    monkeypatch.setattr(images, "page_corners", lambda g: q)
    img = np.random.default_rng(1).integers(0, 256, (138, 100)).astype(np.uint8)
    out, found = images.flattened(img)
    assert not found and (out == img).all()


def plainly_closed(mask, h, w):
    """Closing by a rectangle, pixel by pixel: what is outside counts for neither step."""
    def near(m, y, x, flip):
        up, left = (h - 1 - h // 2, w - 1 - w // 2) if flip else (h // 2, w // 2)
        return m[max(0, y - up) : max(0, y - up + h), max(0, x - left) : max(0, x - left + w)]

    grown = np.array([[near(mask, y, x, False).any() for x in range(mask.shape[1])] for y in range(mask.shape[0])])
    return np.array([[near(grown, y, x, True).all() for x in range(mask.shape[1])] for y in range(mask.shape[0])])


@pytest.mark.parametrize("h, w", [(2, 35), (18, 3), (1, 1), (5, 4), (40, 40)])
def test_closing_by_bits(h, w):
    r = np.random.default_rng(5)
    for rows, cols, share in ((20, 31, 0.05), (33, 16, 0.3), (1, 9, 0.4), (17, 1, 0.5), (8, 8, 0.0), (8, 8, 1.1)):
        mask = r.random((rows, cols)) < share
        assert (images._closed_by(mask, h, w) == plainly_closed(mask, h, w)).all()


def test_boxes_of_parts():
    r = np.random.default_rng(6)
    for share in (0.02, 0.3, 0.45, 0.7, 1.1):
        mask = r.random((40, 33)) < share
        row, a, b, number, n = contours.runs(mask)
        label, m = contours.parts(mask)
        assert n == m
        for i, box in enumerate(contours.bounds(row, a, b, number, n).T):
            y, x = np.nonzero(label == i + 1)
            assert box.tolist() == [x.min(), y.min(), x.max() + 1, y.max() + 1]
    spiral = np.ones((31, 31), dtype=bool)
    for k in range(1, 15, 2):
        spiral[k, k - 1 : 31 - k] = spiral[k : 31 - k, 30 - k] = spiral[30 - k, k : 31 - k] = spiral[k + 2 : 31 - k, k] = False
    assert contours.parts(spiral, diagonal=False)[1] == 1 and contours.runs(~np.eye(9, dtype=bool), diagonal=False)[4] == 2
    assert images.found_blocks(np.full((30, 40), 255, np.uint8)) == []


@driver_data
@pytest.mark.parametrize("name, kernel", [("image_blocks", lambda s, p: plugins.detected(p, "shape")), ("plugin_recognised", lambda s, p: plugins.recognised(p)), ("image_prepared", lambda s, p: images.prepare(p, PROFILE).withColumn("blur", F.round("blur", 3)))])
def test_pictures_stay_in_their_task(spark, name, kernel):
    found = entry.queries()[name](spark, SF)
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    want = kernel(spark, images.drawn(compositors.text_lines(compositors.table(spark, SF, "documents"))))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))


def pictures():
    """A page of bars, one of noise, one of few values, very small ones."""
    r = np.random.default_rng(7)
    bars = np.full((60, 45), 242, np.uint8)
    for y in range(4, 56, 6):
        bars[y : y + 3, 3 : 20 + y % 23] = 40
    return [bars, r.integers(0, 256, (37, 41)).astype(np.uint8), r.choice([0, 3, 90, 255], (50, 33)).astype(np.uint8), r.integers(0, 9, (5, 6)).astype(np.uint8), np.full((9, 9), 7, np.uint8), r.integers(0, 256, (3, 300)).astype(np.uint8), r.integers(0, 256, (200, 2)).astype(np.uint8)]


def test_equalised_tile_by_tile():
    for g in pictures():
        (h, w), tiles = g.shape, 8
        ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
        maps = np.zeros((tiles, tiles, 256))
        for i, j in np.ndindex(tiles, tiles):
            t = g[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            n = np.bincount(t.ravel(), minlength=256).astype(float)
            most = max(1.0, 2.0 * t.size / 256)
            n = np.minimum(n, most) + np.maximum(n - most, 0).sum() / 256
            maps[i, j] = np.cumsum(n) * 255 / n.sum()
        fy, fx = (np.clip((np.arange(n) + 0.5) * tiles / n - 0.5, 0, tiles - 1) for n in (h, w))
        want = np.zeros(g.shape)
        for y, x in np.ndindex(h, w):
            a, b = int(fy[y]), int(fx[x])
            c, d = min(a + 1, tiles - 1), min(b + 1, tiles - 1)
            m = maps[:, :, g[y, x]]
            want[y, x] = (1 - (fy[y] - a)) * ((1 - (fx[x] - b)) * m[a, b] + (fx[x] - b) * m[a, d]) + (fy[y] - a) * ((1 - (fx[x] - b)) * m[c, b] + (fx[x] - b) * m[c, d])
        assert (images.clahe(g) == np.clip(np.rint(want), 0, 255)).all()


@pytest.mark.parametrize("d", [3, 5])
def test_bilateral_of_any_picture(d):
    for g in pictures():
        r, (h, w) = d // 2, g.shape
        p = np.pad(g.astype(float), r, mode="reflect")
        near = np.stack([p[y : y + h, x : x + w] for y in range(d) for x in range(d)])
        far = np.array([(y - r) ** 2 + (x - r) ** 2 for y in range(d) for x in range(d)])[:, None, None]
        k = np.exp(-((near - g) ** 2) / 1250 - far / 1250)
        assert (images.bilateral(g, d) == np.rint((k * near).sum(axis=0) / k.sum(axis=0))).all()


def test_skew_and_blur_of_any_picture(monkeypatch):
    for g in pictures():
        p = np.pad(g.astype(float), 1, mode="reflect")
        assert images.blur_score(g) == (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var()
        turned = [g, *(images.rotated(g, a) for a in (-7, 3)), np.pad(g, 9, constant_values=255)]
        kept = [images.skew(x) for x in turned]
        monkeypatch.setattr(images, "TURNED", 0)
        assert [images.skew(x) for x in turned] == kept
        monkeypatch.undo()
