"""Outlines in page pictures: edges, borders of their parts, polygons, and a document's four corners."""

from __future__ import annotations

import numpy as np

#: Thresholds of the gradient, share of the picture that a document fills at least, share
#: of a border's length by which a polygon may leave it, outlines that are looked at.
LOW, HIGH, LEAST, LEAVE, LOOK = 75, 200, 0.2, 0.02, 5
#: Neighbours (y, x) of a pixel, clockwise from the right.
AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
#: By the bits of a pixel's neighbours and the direction back: the next one clockwise that is inside.
NEXT = [[next((d for d in ((back + k) % 8 for k in range(1, 9)) if bits >> d & 1), -1) for back in range(8)] for bits in range(256)]


def _rooted(label: np.ndarray) -> np.ndarray:
    """For places that each point to one before or to themselves, where their way ends."""
    while True:
        new = label[label]
        if (new == label).all():
            return label
        label = new


def runs(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, first column, column after the last, and number from 1 of the connected part of each run of a mask,
    in the order of their first pixels, and how many parts there are: runs of a row are joined with those
    of the row above that they touch."""
    h, w = mask.shape
    flat = np.zeros(h * (w + 1) + 1, dtype=bool)
    flat[1:].reshape(h, w + 1)[:, :w] = mask
    change = np.flatnonzero(flat[1:] != flat[:-1])  # beginnings and ends by turns, as each row ends outside
    row, a = np.divmod(change[::2], w + 1)
    b = change[1::2] - row * (w + 1)
    # Of each run, the first and last run of the row above that it touches, by search in one rising key.
    reach, key = int(diagonal), row * (w + 2)
    lo = np.searchsorted(key + b, key - (w + 2) + a - reach + 1, side="left")
    hi = np.searchsorted(key + a, key - (w + 2) + b + reach, side="left")
    own = np.arange(len(row))
    label, n = _rooted(np.where(hi > lo, lo, own)), np.maximum(0, hi - lo - 1)
    below = np.repeat(own, n)
    above = np.repeat(lo + 1 - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    while len(below):
        x, y = label[below], label[above]
        on = x != y
        np.minimum.at(label, np.maximum(x, y)[on], np.minimum(x, y)[on])
        label, below, above = _rooted(label), below[on], above[on]
    number = np.cumsum(label == own)[label]
    return row, a, b, number, int(number.max(initial=0))


def parts(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Numbers from 1 of the connected parts of a mask, in the order of their first pixels, and how many."""
    _, a, b, number, n = runs(mask, diagonal)
    out = np.zeros(mask.shape, dtype=np.int32)
    out[mask] = np.repeat(number, b - a)
    return out, n


def bounds(row: np.ndarray, a: np.ndarray, b: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    """x1, y1, x2, y2 of the parts of runs(), the last two after the last pixel."""
    out = np.array([[1 << 30], [1 << 30], [0], [0]]).repeat(n, axis=1)
    for best, to, v in zip((np.minimum, np.minimum, np.maximum, np.maximum), out, (a, row, b, row + 1)):
        best.at(to, number - 1, v)
    return out


def gradients(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(g.astype(np.int32), 1, mode="reflect")
    across = p[:-2] + 2 * p[1:-1] + p[2:]
    down = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return across[:, 2:] - across[:, :-2], down[2:] - down[:-2]


def edges(g: np.ndarray, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Canny's edges: ridges of the gradient over low that hang together with one over high."""
    dx, dy = gradients(g)
    m = np.abs(dx) + np.abs(dy)
    p = np.pad(m, 1)
    at = lambda y, x: p[1 + y : 1 + y + m.shape[0], 1 + x : 1 + x + m.shape[1]]
    flat, steep = np.abs(dy) < np.tan(np.pi / 8) * np.abs(dx), np.abs(dy) > np.tan(3 * np.pi / 8) * np.abs(dx)
    falls = (dx < 0) == (dy < 0)
    ridge = np.where(flat, (m > at(0, -1)) & (m >= at(0, 1)), np.where(steep, (m > at(-1, 0)) & (m >= at(1, 0)), np.where(falls, (m > at(-1, -1)) & (m > at(1, 1)), (m > at(-1, 1)) & (m > at(1, -1)))))
    weak = ridge & (m > low)
    number, n = parts(weak)
    strong = np.zeros(n + 1, dtype=bool)
    strong[number[weak & (m > high)]] = True
    strong[0] = False
    return strong[number]


def border(mask: np.ndarray, start: tuple[int, int]) -> np.ndarray:
    """Pixels (x, y) around the part of mask whose first pixel is start, in order, by following its outer
    border: at each pixel the search goes clockwise from where the last step came from."""
    h, w = mask.shape
    p = np.pad(mask, 1).astype(np.uint8)
    # for each pixel, which of its eight neighbours are inside, as bits
    near = np.zeros((h + 2, w + 2), dtype=np.uint8)
    for d, (dy, dx) in enumerate(AROUND):
        near[1:-1, 1:-1] |= p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] << d
    near = near.tobytes()
    by = [dy * (w + 2) + dx for dy, dx in AROUND]
    begin = (start[0] + 1) * (w + 2) + start[1] + 1
    if not near[begin]:
        return np.array([[start[1], start[0]]], dtype=np.float64)
    d = NEXT[near[begin]][4]  # nothing of the part is above or to the left
    first = at = begin + by[d]
    out = [begin]
    for _ in range(4 * mask.size):
        out.append(at)
        came, d = at, NEXT[near[at]][(d + 4) % 8]
        at += by[d]
        if came == begin and at == first:
            break
    y, x = np.divmod(np.array(out[:-1]), w + 2)
    return np.stack([x - 1, y - 1], axis=1).astype(np.float64)


def size(points: np.ndarray) -> float:
    after = np.roll(points, -1, axis=0)
    return float(abs((points[:, 0] * after[:, 1] - after[:, 0] * points[:, 1]).sum()) / 2)


def length(points: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(points, -1, axis=0) - points).T).sum())


def _away(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points from the line through a and b, or from a where they are one."""
    d = b - a
    n = np.hypot(*d)
    return np.hypot(*(points - a).T) if n == 0 else np.abs(d[0] * (points[:, 1] - a[1]) - d[1] * (points[:, 0] - a[0])) / n


def polygon(points: np.ndarray, leave: float) -> np.ndarray:
    """Douglas and Peucker's polygon of a closed border: corners so that no point is further away than leave."""
    far = lambda i: int(np.hypot(*(points - points[i]).T).argmax())
    a = far(far(0))
    p = np.roll(points, -a, axis=0)
    b = int(np.hypot(*(p - p[0]).T).argmax())
    p = np.concatenate([p, p[:1]])
    keep, todo = {0, b}, [(0, b), (b, len(p) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        d = _away(p[lo + 1 : hi], p[lo], p[hi])
        k = int(d.argmax())
        if d[k] > leave:
            keep.add(lo + 1 + k)
            todo += [(lo, lo + 1 + k), (lo + 1 + k, hi)]
    out = [p[i] for i in sorted(keep)]
    i = 0
    while len(out) > 3 and i < len(out):  # the points that it began with needn't be corners
        before, after = out[i - 1], out[(i + 1) % len(out)]
        if _away(out[i][None], before, after)[0] <= leave:
            del out[i]
            i = max(0, i - 1)
        else:
            i += 1
    return np.array(out)


def quadrilateral(mask: np.ndarray, diagonal: bool, least: float, most: float) -> np.ndarray | None:
    """Corners of the first of the largest parts whose border is a quadrilateral of enough of the picture."""
    row, a, b, number, n = runs(mask, diagonal)
    x1, y1, x2, y2 = bounds(row, a, b, number, n)
    borders = []
    for i in np.flatnonzero((x2 - 1 - x1) * (y2 - 1 - y1) >= least * mask.size):
        own = number == i + 1
        part = np.zeros(mask.shape, dtype=bool)
        part[mask] = np.repeat(own, b - a)
        first = int(own.argmax())
        p = border(part, (int(row[first]), int(a[first])))
        borders.append((size(p), p))
    for _, p in sorted(borders, key=lambda v: -v[0])[:LOOK]:
        q = polygon(p, LEAVE * length(p))
        if len(q) == 4 and least * mask.size <= size(q) <= most * (mask.shape[0] - 1) * (mask.shape[1] - 1):
            return q
    return None


def in_order(q: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left, by sums and differences; where these name a corner
    twice, as of a page that stands on one, clockwise from the least sum."""
    s, d = q.sum(axis=1), q[:, 1] - q[:, 0]
    best = [s.argmin(), d.argmin(), s.argmax(), d.argmax()]
    if len(set(best)) < 4:
        after = np.roll(q, -1, axis=0)
        way = 1 if (q[:, 0] * after[:, 1] - after[:, 0] * q[:, 1]).sum() > 0 else -1
        best = [(best[0] + way * k) % 4 for k in range(4)]
    return q[best]


def convex(q: np.ndarray) -> bool:
    """Whether a polygon turns the same way at each of its corners, clockwise in a picture."""
    a, b = q - np.roll(q, 1, axis=0), np.roll(q, -1, axis=0) - q
    return bool((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0] > 0).all())


def document(g: np.ndarray, smooth: np.ndarray, least: float = LEAST) -> np.ndarray | None:
    """Corners (x, y) of a document in a gray picture, in order; smooth is the picture blurred. First the
    outlines of edges are sought; where none is closed, as with a page that the frame cuts, the fields
    between edges and frame, short of the whole picture."""
    e = edges(smooth)
    q = quadrilateral(e, True, least, 1.0)
    if q is None:
        q = quadrilateral(~e, False, least, 0.98)
    return None if q is None else in_order(q)
