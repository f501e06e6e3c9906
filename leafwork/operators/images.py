"""Page-image kernels in numpy, run over image structs by mapInPandas: published algorithms, not a
library's bits. Pictures are uint8, height x width or height x width x 3 in BGR order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from leafwork.functions.bypage import paged
from leafwork.operators import contours

#: Blur scores that part the tiers, and what a tier changes in a profile.
TIERS = ((300.0, "blurred"), (700.0, "low_quality"), (1000.0, "normal"))
OVERRIDES: dict[str, dict] = {
    "blurred": {"sharpen": True, "sharpen_strength": 0.5, "threshold_mode": "adaptive", "adaptive_block_size": 19, "adaptive_C": 18, "morphology_opening": True, "morphology_kernel_size": 2, "morphology_closing": False, "clahe_clip_limit": 1.0},
    "low_quality": {"sharpen": False, "threshold_mode": "adaptive", "adaptive_block_size": 25, "adaptive_C": 14, "morphology_opening": False, "morphology_kernel_size": 2},
    "normal": {},
    "sharp": {"sharpen": False, "morphology_opening": False, "morphology_closing": False},
}
#: What mapInPandas runs over frames of pages.
Kernel = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
#: Pictures that a task draws at a time; pixels of a picture whose turns are kept for the next one.
DRAWN, TURNED = 64, 1 << 17
#: Under the first blur score only bilateral helps; over the second a page needs nothing.
RECOVERY, SHARP = 1000.0, 700.0


def gray(img: np.ndarray) -> np.ndarray:
    if img.ndim == 2:
        return img
    return np.clip(np.rint(img[..., :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])), 0, 255).astype(np.uint8)


def _padded(img: np.ndarray, k: int, mode: str = "reflect") -> np.ndarray:
    return np.pad(img.astype(np.float64), k, mode=mode)


def blur_score(img: np.ndarray) -> float:
    """Population variance of the Laplacian."""
    p = np.pad(gray(img).astype(np.int16), 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(lap.astype(np.float64).var())


def tier(score: Column) -> Column:
    out = None
    for most, name in TIERS:
        out = F.when(score < most, name) if out is None else out.when(score < most, name)
    return out.otherwise("sharp")


def is_low_quality(score: Column, under: float = 300.0) -> Column:
    return score < under


def overridden(pages: DataFrame, p, score: str = "blur") -> DataFrame:
    """pages with the tier of their score and, under the profile's names, the settings that hold for
    them: those of the tier where it has any, else the profile's."""
    keys = sorted({k for o in OVERRIDES.values() for k in o})
    out = {"tier": tier(F.col(score))}
    for k in keys:
        c = F.lit(getattr(p, k))
        for name, o in OVERRIDES.items():
            if k in o:
                c = F.when(out["tier"] == name, F.lit(o[k])).otherwise(c)
        out[k] = c
    return pages.withColumns(out)


def denoise_decision(score: Column, adaptive: Column, strategy: str = "bilateral", blur_safe: bool = False) -> Column:
    """What denoising does, and the score: bilateral under 1000; over it nothing if adaptive, else the
    strategy, where a safe one takes the place of Gaussian."""
    strategy = "nlmeans" if blur_safe and strategy == "gaussian" else strategy
    how = F.when(score < RECOVERY, "bilateral_recovery_mode").when(adaptive & (score > SHARP), "skipped_already_sharp").otherwise(strategy)
    return F.concat(how, F.lit("_blur="), F.format_string("%.2f", score))


def denoised(img: np.ndarray, p, score: float) -> tuple[np.ndarray, str]:
    strategy = "nlmeans" if p.blur_safe_mode and p.denoise_strategy == "gaussian" else p.denoise_strategy
    if score < RECOVERY:
        return bilateral(img), f"bilateral_recovery_mode_blur={score:.2f}"
    if p.adaptive_denoise and score > SHARP:
        return img, f"skipped_already_sharp_blur={score:.2f}"
    kernels = {"none": lambda x: x, "nlmeans": nl_means, "bilateral": bilateral, "gaussian": lambda x: np.clip(np.rint(gaussian(gray(x).astype(np.float64))), 0, 255).astype(np.uint8)}
    if strategy not in kernels:
        return img, f"unknown_strategy_skipped({strategy})_blur={score:.2f}"
    return kernels[strategy](img), f"{strategy}_blur={score:.2f}"


def gaussian(img: np.ndarray, k: int = 5, sigma: float = 0.0) -> np.ndarray:
    sigma = sigma or 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    x = np.arange(k) - k // 2
    w = np.exp(-(x**2) / (2 * sigma**2))
    w /= w.sum()
    p = _padded(img, k // 2)
    rows = sum(w[i] * p[i : i + img.shape[0], :] for i in range(k))
    return sum(w[i] * rows[:, i : i + img.shape[1]] for i in range(k))


def unsharp(img: np.ndarray, strength: float = 1.0) -> np.ndarray:
    g = gray(img).astype(np.float64)
    return np.clip(np.rint((1 + strength) * g - strength * gaussian(g)), 0, 255).astype(np.uint8)


def bilateral(img: np.ndarray, d: int = 3, sigma_c: float = 25.0, sigma_s: float = 25.0) -> np.ndarray:
    """Tomasi and Manduchi 1998. Where all pixels of a square are equal nothing changes; only the others are
    looked at, and of squares of two values each pattern once."""
    g, r = gray(img), d // 2
    p = np.pad(g, r, mode="reflect")
    low, high = g.min(), g.max()
    if d == 3 and ((g == low) | (g == high)).all():
        # squares as nine bits, the first pixel's the lowest
        on, bits = (p == high).astype(np.uint16), np.zeros(g.shape, dtype=np.uint16)
        for k in range(9):
            bits |= on[k // 3 : k // 3 + g.shape[0], k % 3 : k % 3 + g.shape[1]] << k
        return _patterns(int(low), int(high), sigma_c, sigma_s).take(bits)
    flat = (_extreme(p, d, np.minimum) == _extreme(p, d, np.maximum))[r : r + g.shape[0], r : r + g.shape[1]]
    y, x = np.nonzero(~flat)
    out = g.copy()
    out[y, x] = _blended(np.stack([p[y + dy, x + dx] for dy in range(d) for dx in range(d)]), d, sigma_c, sigma_s)
    return out


def _blended(squares: np.ndarray, d: int, sigma_c: float, sigma_s: float) -> np.ndarray:
    """The middle of squares, a column each, row by row, as bilateral() has it."""
    r, whole = d // 2, squares.astype(np.int64)
    total, weight = np.zeros(squares.shape[1]), np.zeros(squares.shape[1])
    for k, (dy, dx) in enumerate(np.ndindex(d, d)):
        # a weight goes by a difference of whole numbers: one of 511, told from its place
        w = np.exp(-(np.arange(-255.0, 256.0) ** 2) / (2 * sigma_c**2) - ((dy - r) ** 2 + (dx - r) ** 2) / (2 * sigma_s**2)).take(whole[k] - whole[d * d // 2] + 255)
        total += w * whole[k]
        weight += w
    return np.clip(np.rint(total / weight), 0, 255).astype(np.uint8)


@lru_cache(maxsize=256)
def _patterns(low: int, high: int, sigma_c: float, sigma_s: float) -> np.ndarray:
    """The middle of each square of three by three pixels of two values, by its bits."""
    return _blended(np.where(np.arange(512) >> np.arange(9)[:, None] & 1, high, low), 3, sigma_c, sigma_s)


def _box_sum(a: np.ndarray, k: int) -> np.ndarray:
    p = np.pad(a, ((k // 2 + 1, k // 2), (k // 2 + 1, k // 2)), mode="edge").cumsum(0).cumsum(1)
    return p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]


def nl_means(img: np.ndarray, h: float = 10.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Buades et al. 2005: means weighted by the likeness of patches."""
    g, r = gray(img).astype(np.float64), search // 2
    p = _padded(g, r)
    total, weight = np.zeros_like(g), np.zeros_like(g)
    for dy in range(search):
        for dx in range(search):
            v = p[dy : dy + g.shape[0], dx : dx + g.shape[1]]
            w = np.exp(-np.maximum(_box_sum((v - g) ** 2, patch) / patch**2, 0) / h**2)
            total += w * v
            weight += w
    return np.clip(np.rint(total / weight), 0, 255).astype(np.uint8)


def otsu(img: np.ndarray) -> int:
    """The threshold that parts a histogram with the greatest variance between its sides."""
    n = np.bincount(gray(img).ravel(), minlength=256).astype(np.float64)
    w, m = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.nan_to_num(between, nan=-1, posinf=-1).argmax())


def thresholded(img: np.ndarray, mode: str = "otsu", block: int = 11, c: float = 2.0) -> np.ndarray:
    g = gray(img)
    if mode == "otsu":
        return np.where(g > otsu(g), 255, 0).astype(np.uint8)
    if mode == "adaptive":
        k = max(3, block | 1)
        return np.where(g > gaussian(g, k) - c, 255, 0).astype(np.uint8)
    raise ValueError(f"unknown threshold mode: {mode}")


def _extreme(img: np.ndarray, k: int, best) -> np.ndarray:
    fill = 255 if best is np.minimum else 0
    p = np.pad(img, ((k // 2, k - 1 - k // 2),) * 2, mode="constant", constant_values=fill)
    rows = p[: img.shape[0], :]
    for i in range(1, k):
        rows = best(rows, p[i : i + img.shape[0], :])
    out = rows[:, : img.shape[1]]
    for i in range(1, k):
        out = best(out, rows[:, i : i + img.shape[1]])
    return out


def _mirrored(img: np.ndarray, k: int) -> np.ndarray:
    """Turned by half where the square is even, so that the second pass takes it the other way round."""
    return img if k % 2 else img[::-1, ::-1]


def opened(img: np.ndarray, k: int = 3) -> np.ndarray:
    return _mirrored(_extreme(_mirrored(_extreme(gray(img), k, np.minimum), k), k, np.maximum), k)


def closed(img: np.ndarray, k: int = 3) -> np.ndarray:
    return _mirrored(_extreme(_mirrored(_extreme(gray(img), k, np.maximum), k), k, np.minimum), k)


#: Linear sRGB to CIE XYZ over the D65 white.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def to_lab(img: np.ndarray) -> np.ndarray:
    """CIE LAB (L from 0 to 100) of a picture in BGR."""
    c = img[..., 2::-1].astype(np.float64) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    x = (c @ _XYZ.T) / _WHITE
    f = np.where(x > 0.008856, np.cbrt(x), 7.787 * x + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] + 16) / 116
    f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], axis=-1)
    x = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) * _WHITE
    c = np.clip(x @ np.linalg.inv(_XYZ).T, 0, 1)
    c = np.where(c > 0.0031308, 1.055 * c ** (1 / 2.4) - 0.055, 12.92 * c)
    return np.clip(np.rint(c[..., ::-1] * 255), 0, 255).astype(np.uint8)


def _cubic(d: np.ndarray, a: float = -0.75) -> np.ndarray:
    """Keys' kernel of cubic convolution."""
    d = np.abs(d)
    return np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, np.where(d < 2, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a, 0.0))


def sampled(g: np.ndarray, sy: np.ndarray, sx: np.ndarray, fill: float | None = None) -> np.ndarray:
    """Values at places between pixels, by cubic convolution; outside it is fill, or the nearest pixel."""
    h, w = g.shape
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    out = np.zeros(np.broadcast(sy, sx).shape)
    for dy in range(-1, 3):
        wy = _cubic(sy - (y0 + dy))
        for dx in range(-1, 3):
            yy, xx = y0 + dy, x0 + dx
            v = g[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)]
            if fill is not None:
                v = np.where((yy >= 0) & (yy < h) & (xx >= 0) & (xx < w), v, fill)
            out += v * wy * _cubic(sx - (x0 + dx))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def clahe(img: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Zuiderveld 1994: equalisation by tiles, histograms clipped, maps blended between tiles. Of a picture
    in colour only the lightness L of CIE LAB changes."""
    if img.ndim == 3:
        lab = to_lab(img)
        lab[..., 0] = clahe(np.clip(np.rint(lab[..., 0] * 2.55), 0, 255).astype(np.uint8), clip, tiles) / 2.55
        return from_lab(lab)
    g = img
    h, w = g.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    # rows and columns of the tiles, one after the other, and whose they are
    (y, iy), (x, ix) = ((np.concatenate([np.arange(a, max(b, a + 1)) for a, b in zip(v, v[1:])]), np.repeat(np.arange(tiles), np.maximum(np.diff(v), 1))) for v in (ys, xs))
    n = np.bincount(((iy[:, None] * tiles + ix) * 256 + g[y[:, None], x]).ravel(), minlength=tiles * tiles * 256).reshape(tiles, tiles, 256).astype(np.float64)
    most = np.maximum(1.0, clip * n.sum(axis=2, keepdims=True) / 256)
    n = np.minimum(n, most) + np.maximum(n - most, 0).sum(axis=2, keepdims=True) / 256
    maps = np.cumsum(n, axis=2) * 255 / n.sum(axis=2, keepdims=True)
    fy = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = np.minimum(fy.astype(int), tiles - 1), np.minimum(fx.astype(int), tiles - 1)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    # a row of tiles is blended along x for each value that there is; pixels are then blended along y
    there, wx = np.zeros(256, dtype=bool), (fx - x0)[None, None, :]
    there[g.ravel()] = True
    some = np.ascontiguousarray(maps[:, :, there].transpose(0, 2, 1))  # by row of tiles, value, tile
    along = ((1 - wx) * some[:, :, x0] + wx * some[:, :, x1]).ravel()
    k, wy = int(there.sum()), (fy - y0)[:, None]
    at = ((np.cumsum(there) - 1) * w)[g] + np.arange(w)
    out = (1 - wy) * along.take(at + (y0 * k * w)[:, None]) + wy * along.take(at + (y1 * k * w)[:, None])
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def rotated(img: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """About the centre, bilinear, with a plain border."""
    g = gray(img).astype(np.float64)
    h, w = g.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx = np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx
    sy = np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros_like(g)
    for dy in (0, 1):
        for dx in (0, 1):
            yy, xx = y0 + dy, x0 + dx
            inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
            v = np.where(inside, g[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)], fill)
            out += v * np.abs(1 - dy - (sy - y0)) * np.abs(1 - dx - (sx - x0))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def skew(img: np.ndarray) -> float:
    """Of -15 to 15 degrees by halves, the first turn that makes row sums of ink vary most."""
    g = gray(img)
    ink = g <= otsu(g)
    angles = np.arange(-15, 15.25, 0.5)
    if not ink.any():
        return float(angles[0])
    h, w = g.shape
    if h * w <= TURNED:
        # ink before each pixel, row by row: a stretch that comes to one row has as much as is before its end
        # and not before its beginning, which is where the one before ends
        before = np.zeros(h * w + 1, dtype=np.int32)
        np.cumsum(ink, out=before[1:])
        inner, first, place, way, begin, end = _turned_stretches(h, w)
        out = w // 4 + 2
        wide = h + 2 * out
        met = np.zeros(len(angles) * wide, dtype=np.int64)
        met[place] = np.add.reduceat(before.take(inner), first, dtype=np.int32) if len(first) else 0
        row = before[::w].astype(np.float64)
        n = np.zeros(len(angles) * wide, dtype=np.int64)
        n[place + way] += met[place]
        n += np.rint(np.bincount(end, np.tile(row[1:], len(angles)), len(n)) - np.bincount(begin, np.tile(row[:-1], len(angles)), len(n))).astype(np.int64) - met
        return float(angles[int(np.argmax(np.ascontiguousarray(n.reshape(-1, wide)[:, out : out + h]).var(axis=1)))])
    y, x = np.nonzero(ink)
    return float(angles[int(np.argmax([np.bincount(row[(row >= 0) & (row < h)], minlength=h).var() for row in (_turned(y, x, h, w, a) for a in angles)]))])


def _turned(y: np.ndarray, x: np.ndarray, h: int, w: int, degrees: float) -> np.ndarray:
    """The rows to which pixels of a picture of h x w come when it is turned; some are outside it."""
    return np.rint(np.cos(np.deg2rad(degrees)) * (y - (h - 1) / 2) - np.sin(np.deg2rad(degrees)) * (x - (w - 1) / 2) + (h - 1) / 2).astype(int)


@lru_cache(maxsize=1)
def _turned_stretches(h: int, w: int) -> tuple[np.ndarray, ...]:
    """Where all pixels come by skew()'s angles, as pages of one size are turned alike. Along a row of pixels the row
    to which they come changes by one at a time. Given are the pixels where it does so, sorted by angle and
    new row; which of them is the first of its angle and row, the number of these (an angle has w // 4 + 2 rows more on
    either side than the picture, as none goes further), and how far from it the old row's is; and that number of each angle's and row's first and
    last pixel."""
    y, x = np.mgrid[0:h, 0:w]
    inner, key, ways, begin, end = [], [], [], [], []
    for k, a in enumerate(np.arange(-15, 15.25, 0.5)):
        out = w // 4 + 2
        row = _turned(y, x, h, w, a) + k * (h + 2 * out) + out
        step = np.diff(row, axis=1)
        at = np.flatnonzero(np.pad(step, ((0, 0), (1, 0))))
        order = np.argsort(row.ravel()[at], kind="stable")
        inner.append(at[order])
        key.append(row.ravel()[at][order])
        ways.append(np.full(len(at), -np.sign(step.sum())))
        begin.append(row[:, 0])
        end.append(row[:, -1])
    key = np.concatenate(key)
    first = np.flatnonzero(np.diff(key, prepend=-1) != 0)
    return np.concatenate(inner), first, key[first], np.concatenate(ways)[first], np.concatenate(begin), np.concatenate(end)


def deskewed(img: np.ndarray) -> np.ndarray:
    """Turned by the skew found, by cubic convolution; by less than half a degree not at all."""
    a, g = skew(img), gray(img).astype(np.float64)
    if abs(a) < 0.5:
        return gray(img)
    t, (h, w) = np.deg2rad(a), g.shape
    y, x = np.mgrid[0:h, 0:w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    return sampled(g, np.sin(t) * x + np.cos(t) * y + (h - 1) / 2, np.cos(t) * x - np.sin(t) * y + (w - 1) / 2, 255.0)


def resized(img: np.ndarray, scale: float) -> np.ndarray:
    """Larger by cubic convolution, smaller by means over the areas that pixels cover."""
    if scale <= 0:
        raise ValueError("scale must be over 0")
    g = gray(img).astype(np.float64)
    h, w = max(1, round(g.shape[0] * scale)), max(1, round(g.shape[1] * scale))
    if scale > 1:
        y, x = (np.arange(h) + 0.5) * g.shape[0] / h - 0.5, (np.arange(w) + 0.5) * g.shape[1] / w - 0.5
        return sampled(g, y[:, None], x[None, :])

    def means(a: np.ndarray, n: int) -> np.ndarray:
        """Means of n even stretches of the rows, by interpolating their running sums."""
        total = np.concatenate([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0)])
        edge = np.arange(n + 1) * a.shape[0] / n
        low = np.minimum(edge.astype(int), a.shape[0] - 1)
        at = total[low] + (edge - low)[:, None] * a[low]
        return np.diff(at, axis=0) * n / a.shape[0]

    return np.clip(np.rint(means(means(g, h).T, w).T), 0, 255).astype(np.uint8)


def ordered_corners(quad: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left: by their sums and differences."""
    best = lambda key: F.array_min(F.transform(quad, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p.alias("p"))))["p"]
    return F.array(best(lambda p: p["x"] + p["y"]), best(lambda p: p["y"] - p["x"]), best(lambda p: -p["x"] - p["y"]), best(lambda p: p["x"] - p["y"]))


def page_corners(img: np.ndarray, least: float = contours.LEAST) -> np.ndarray | None:
    """Corners (x, y) of the document in a picture, in order, by its outline; None if none of the largest
    outlines is a quadrilateral of at least that share of the picture."""
    g = gray(img)
    if min(g.shape) < 3:
        return None
    return contours.document(g, gaussian(g, 5), least)


def flattened(img: np.ndarray) -> tuple[np.ndarray, bool]:
    """The document seen from above, by linear interpolation, and whether it was found; else the picture
    as it is, also where the corners are no rectangle's from any side (one points inward or lies on a line
    with two others)."""
    q = page_corners(img)
    if q is None or not contours.convex(q):
        return gray(img), False
    w = max(2, int(max(np.hypot(*(q[1] - q[0])), np.hypot(*(q[2] - q[3])))))
    h = max(2, int(max(np.hypot(*(q[3] - q[0])), np.hypot(*(q[2] - q[1])))))
    target = [(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)]
    rows = [r for (u, v), (a, b) in zip(target, q) for r in ([u, v, 1, 0, 0, 0, -a * u, -a * v], [0, 0, 0, u, v, 1, -b * u, -b * v])]
    m = np.append(np.linalg.solve(np.array(rows, dtype=np.float64), q.reshape(-1)), 1).reshape(3, 3)
    v, u = np.mgrid[0:h, 0:w]
    d = m[2, 0] * u + m[2, 1] * v + 1
    g = gray(img).astype(np.float64)
    x, y = (np.clip((m[k, 0] * u + m[k, 1] * v + m[k, 2]) / d, 0, g.shape[1 - k] - 1) for k in (0, 1))
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, g.shape[1] - 1), np.minimum(y0 + 1, g.shape[0] - 1)
    fx, fy = x - x0, y - y0
    out = (g[y0, x0] * (1 - fx) + g[y0, x1] * fx) * (1 - fy) + (g[y1, x0] * (1 - fx) + g[y1, x1] * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8), True


def prepared(img: np.ndarray, p) -> tuple[np.ndarray, list[str], float]:
    """The chain of a profile over one page: picture, what was done, blur score. The tier of the page's
    blur score changes the profile first."""
    score = blur_score(img)
    name = next((n for most, n in TIERS if score < most), "sharp")
    p = replace(p, **OVERRIDES[name])
    out, done = img, [f"adaptive_decision({name},blur={score:.1f})"]
    if p.denoise or p.thresholding:
        out = gray(out)
        done.append("grayscale")
    if p.denoise:
        out, how = denoised(out, p, score)
        done.append(f"denoise_{how}")
    if p.deskew:
        out = deskewed(out)
        done.append("deskew")
    if p.sharpen:
        out = unsharp(out, p.sharpen_strength)
        done.append(f"sharpen(s={p.sharpen_strength})")
    out = clahe(out, p.clahe_clip_limit)
    done.append(f"clahe(clip={p.clahe_clip_limit})")
    if p.thresholding:
        out = thresholded(out, p.threshold_mode, p.adaptive_block_size, p.adaptive_C)
        done.append(f"threshold_{p.threshold_mode}" + (f"(bs={p.adaptive_block_size},C={p.adaptive_C})" if p.threshold_mode == "adaptive" else ""))
    k = max(1, p.morphology_kernel_size)
    if p.morphology_opening:
        out = opened(out, k)
        done.append(f"morphology_open(k={k})")
    if p.morphology_closing:
        out = closed(out, k)
        done.append(f"morphology_close(k={k})")
    if abs(p.resize_scale - 1) > 1e-6:
        out = resized(out, p.resize_scale)
        done.append(f"resize×{p.resize_scale}")
    if p.perspective_correction:
        out, found = flattened(out)
        done.append("perspective" if found else "perspective_unchanged")
    return gray(out), done, score


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 1 of the 8-connected parts of a mask, and how many."""
    return contours.parts(mask)


def _ink(img: np.ndarray) -> np.ndarray:
    """Text as true: a picture of two values by the rarer colour of its ground, others by Otsu."""
    g = gray(img)
    if not g.size or ((g == g.min()) | (g == g.max())).all():
        return g < 128 if g.mean() > 127 else g >= 128
    return g <= otsu(g)


def _number(rows: int, cols: int, wide: int, mask: np.ndarray | bool = True) -> int:
    """A mask as the bits of one whole number, each row followed by zeros up to wide."""
    m = np.zeros((rows, wide), dtype=bool)
    m[:, :cols] = mask
    return int.from_bytes(np.packbits(m, bitorder="little").tobytes(), "little")


_inside = lru_cache(maxsize=4)(_number)


def _closed_by(mask: np.ndarray, h: int, w: int) -> np.ndarray:
    """Closing by a rectangle, all pixels at once as bits of a whole number: rows are so far apart that a shift
    by the rectangle's width doesn't reach the next one."""
    rows, cols = mask.shape
    wide = -(-(cols + w) // 8) * 8
    inside = _inside(rows, cols, wide)

    def spread(m: int, up: int, left: int) -> int:
        m <<= up * wide + left
        for step, n in ((1, w), (wide, h)):
            have = 1
            while have < n:
                more = min(have, n - have)
                m |= m >> more * step
                have += more
        return m & inside

    grown = spread(_number(rows, cols, wide, mask), h // 2, w // 2)
    out = inside ^ spread(inside ^ grown, h - 1 - h // 2, w - 1 - w // 2)
    return np.unpackbits(np.frombuffer(out.to_bytes(rows * wide // 8, "little"), np.uint8), bitorder="little").reshape(rows, wide)[:, :cols].astype(bool)


def found_blocks(img: np.ndarray, least: float = 0.0008) -> list[tuple[int, int, int, int, float]]:
    """(x1, y1, x2, y2, fill) of blocks of text without a model: ink closed along lines, then between
    lines; parts whose box covers that share of the page. fill is the part's pixels over its box's."""
    ink = _closed_by(_closed_by(_ink(img), 2, 35), 18, 3)
    row, a, b, number, n = contours.runs(ink)
    x1, y1, x2, y2 = contours.bounds(row, a, b, number, n)
    area = (x2 - x1) * (y2 - y1)
    fill = np.bincount(number - 1, b - a, minlength=n) / area
    keep = area >= least * ink.size
    return list(zip(*(v[keep].tolist() for v in (x1, y1, x2, y2, fill))))


def has_bands(img: np.ndarray, box: tuple[int, int, int, int]) -> bool:
    """Whether rows of a crop over fifty pixels high pass between ink and white at least six times: a row
    has ink where its share of the fullest row's is over a tenth."""
    x1, y1, x2, y2 = box
    crop = gray(img)[max(0, y1) : y2, max(0, x1) : x2]
    if not crop.size or y2 - y1 <= 50:
        return False
    rows = _ink(crop).sum(axis=1)
    if rows.max() == 0:
        return False
    on = rows / rows.max() > 0.1
    return int((on[1:] != on[:-1]).sum()) >= 6


def side_by_side(left: np.ndarray, right: np.ndarray, gap: int = 20) -> np.ndarray:
    """Two pictures in BGR beside each other, the lower one filled up in white, a gray stripe between."""
    both = [x if x.ndim == 3 else np.repeat(x[..., None], 3, axis=2) for x in (left, right)]
    h = max(x.shape[0] for x in both)
    both = [np.pad(x, ((0, h - x.shape[0]), (0, 0), (0, 0)), constant_values=255) for x in both]
    return np.concatenate([both[0], np.full((h, gap, 3), 200, dtype=np.uint8), both[1]], axis=1)


def as_pixmap(img: np.ndarray) -> bytes:
    """A picture as a portable pixmap, which viewers read without a library here."""
    g = img if img.ndim == 3 else np.repeat(img[..., None], 3, axis=2)
    return b"P6\n%d %d\n255\n" % (g.shape[1], g.shape[0]) + np.ascontiguousarray(g[..., ::-1]).tobytes()


def preparation(p) -> tuple[Kernel, str]:
    """What prepare() does with frames of pages, and its schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                if r.data is None or r.height <= 0:
                    rows.append((r.doc_id, r.page_number, 0, 0, None, None, ["skipped_no_image"]))
                    continue
                img = np.frombuffer(bytes(r.data), dtype=np.uint8).reshape(r.height, r.width, -1)
                out, done, score = prepared(img[..., 0] if img.shape[2] == 1 else img, p)
                rows.append((r.doc_id, r.page_number, *out.shape, out.tobytes(), score, done))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "height", "width", "data", "blur", "operations"])

    return run, "doc_id long, page_number int, height int, width int, data binary, blur double, operations array<string>"


def prepare(pages: DataFrame, p) -> DataFrame:
    """(doc_id, page_number, height, width, data, blur, operations) of pages given as image columns; a page
    without a picture passes with what was skipped."""
    return pages.select("doc_id", "page_number", "height", "width", "data").mapInPandas(*preparation(p))


def drawn(lines: DataFrame, width: int = 200, height: int = 275, into: tuple[Kernel, str] | None = None) -> DataFrame:
    """Pages with lines as dark bars at a quarter of their size: pictures to run kernels on. A task draws
    DRAWN pages at a time and holds no more of them. With into, a kernel over frames of pages and its schema,
    what that gives: pictures then don't leave the task that has drawn them."""

    def draw(t: pa.Table, page: np.ndarray) -> Iterator[pa.Table]:
        x1, y1, x2, y2 = (t.column(k).to_numpy() // 4 for k in ("x1", "y1", "x2", "y2"))
        y2 = np.maximum(y2, y1 + 1)
        edge = np.flatnonzero(np.append(np.append(True, np.diff(page) != 0), True))
        for lo in range(0, len(edge) - 1, DRAWN):
            n = min(DRAWN, len(edge) - 1 - lo)
            imgs = np.full((n, height, width), 242, dtype=np.uint8)
            for k in range(n):
                img = imgs[k]
                for i in range(edge[lo + k], edge[lo + k + 1]):
                    img[y1[i] : y2[i], x1[i] : x2[i]] = 40
            of = t.select(["doc_id", "page_number"]).take(pa.array(edge[lo : lo + n]))
            size = height * width
            data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size), pa.py_buffer(imgs)])
            yield pa.table([*of.columns, pa.array(np.full(n, height, np.int32)), pa.array(np.full(n, width, np.int32)), data], names=["doc_id", "page_number", "height", "width", "data"])

    kind = {f.name: f.dataType.simpleString() for f in lines.schema}
    keys = ["doc_id", "page_number"]
    then, schema = None, f"doc_id {kind['doc_id']}, page_number {kind['page_number']}, height int, width int, data binary"
    if into:
        kernel, schema = into
        of = to_arrow_schema(StructType.fromDDL(schema))

        def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for df in kernel(b.to_pandas() for b in batches):
                yield pa.RecordBatch.from_pandas(df, schema=of, preserve_index=False)

    return paged(lines.select(*keys, "x1", "y1", "x2", "y2"), keys, ["y1", "x1"], draw, schema, then=then)
