"""Outlines of documents in pictures against corners that are known."""

import numpy as np
import pytest

from leafwork.operators import contours, images


def filled(h, w, quad, ground, inside):
    """A picture with a quadrilateral (x, y) on a ground."""
    y, x = np.mgrid[0:h, 0:w]
    on = np.ones((h, w), dtype=bool)
    for (ax, ay), (bx, by) in zip(quad, np.roll(np.array(quad), -1, axis=0)):
        on &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
    return np.where(on, inside, ground).astype(np.uint8), on


def close(got, want, by=2.0):
    assert got is not None and np.abs(got - np.array(want, dtype=float)).max() <= by, got


QUAD = [(60, 40), (330, 70), (350, 440), (40, 420)]


def test_page_with_a_dark_figure():
    img, _ = filled(500, 400, QUAD, 30, 230)
    img[150:300, 120:260] = 10
    img[330:334, 100:300] = 60
    close(images.page_corners(img), QUAD)
    out, found = images.flattened(img)
    assert found and abs(out.shape[0] - 381) <= 4 and abs(out.shape[1] - 310) <= 4 and np.median(out) > 200


def test_page_on_a_ground_of_equal_brightness():
    img, on = filled(500, 400, QUAD, 200, 200)
    inner, _ = filled(500, 400, [(64, 44), (327, 74), (346, 435), (45, 416)], 0, 1)
    img[on & (inner == 0)] = 40
    close(images.page_corners(img), QUAD)


@pytest.mark.parametrize("quad, want", [
    ([(80, 60), (460, 60), (460, 430), (80, 430)], [(80, 60), (399, 60), (399, 430), (80, 430)]),
    ([(-90, -90), (300, -90), (300, 390), (-90, 390)], [(0, 0), (300, 0), (300, 390), (0, 390)]),
])
def test_page_that_the_frame_cuts(quad, want):
    img, _ = filled(500, 400, quad, 20, 220)
    close(images.page_corners(img), want)


def test_pictures_without_a_document():
    text = np.full((300, 220), 245, np.uint8)
    for y in range(20, 280, 22):
        text[y : y + 10, 15 : 60 + (y * 7) % 140] = 30
    small, _ = filled(500, 400, [(100, 100), (200, 100), (200, 200), (100, 200)], 20, 220)
    y, x = np.mgrid[0:300, 0:300]
    disc = np.where((y - 150) ** 2 + (x - 150) ** 2 < 120**2, 220, 20).astype(np.uint8)
    for img in (np.full((200, 100), 255, np.uint8), text, small, disc, np.zeros((3, 3), np.uint8), np.zeros((1, 1), np.uint8)):
        out, found = images.flattened(img)
        assert not found and (out == img).all()


def test_noise_does_not_move_corners():
    img, _ = filled(500, 400, QUAD, 40, 210)
    noisy = np.clip(img + np.random.default_rng(2).normal(0, 6, img.shape), 0, 255).astype(np.uint8)
    close(images.page_corners(noisy), QUAD, 3.0)


def test_parts():
    r = np.random.default_rng(3)
    for diagonal in (True, False):
        for _ in range(20):
            mask = r.random((int(r.integers(1, 30)), int(r.integers(1, 30)))) < 0.45
            got, n = contours.parts(mask, diagonal)
            want, seen = np.zeros(mask.shape, int), 0
            for y, x in zip(*np.nonzero(mask)):
                if want[y, x]:
                    continue
                seen += 1
                todo = [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not want[a, b]:
                        want[a, b] = seen
                        todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or not (i and j)]
            assert n == seen and (got == want).all()


def test_border_goes_round():
    mask = np.zeros((9, 12), dtype=bool)
    mask[2:6, 3:9] = True
    b = contours.border(mask, (2, 3))
    assert len(b) == 16 and contours.size(b) == 15 and contours.length(b) == 16
    assert len(contours.polygon(b, 0.5)) == 4
    line = np.zeros((5, 9), dtype=bool)
    line[2, 1:8] = True
    assert contours.size(contours.border(line, (2, 1))) == 0
    assert contours.border(np.ones((1, 1), dtype=bool), (0, 0)).tolist() == [[0, 0]]
