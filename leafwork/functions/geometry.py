"""Box arithmetic as column expressions. A box is (x1, y1, x2, y2), named by a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(name: str, of: str = "") -> Column:
    return F.col(f"{of}.{name}" if of else name)


def real(x: float) -> Column:
    return F.lit(float(x))


def area(of: str = "") -> Column:
    return F.greatest(F.lit(0), c("x2", of) - c("x1", of)) * F.greatest(F.lit(0), c("y2", of) - c("y1", of))


def overlap_x(a: str, b: str) -> Column:
    return F.least(c("x2", a), c("x2", b)) - F.greatest(c("x1", a), c("x1", b))


def overlap_y(a: str, b: str) -> Column:
    return F.least(c("y2", a), c("y2", b)) - F.greatest(c("y1", a), c("y1", b))


def intersection(a: str, b: str) -> Column:
    return F.greatest(F.lit(0), overlap_x(a, b)) * F.greatest(F.lit(0), overlap_y(a, b))


def union_area(a: str, b: str) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: str, b: str) -> Column:
    u = union_area(a, b)
    return F.when(u > 0, intersection(a, b) / u).otherwise(real(0))


def centre_x(of: str = "") -> Column:
    return (c("x1", of) + c("x2", of)) / real(2)


def centre_y(of: str = "") -> Column:
    return (c("y1", of) + c("y2", of)) / real(2)


def distance(a: str, b: str) -> Column:
    return F.sqrt(F.pow(centre_x(a) - centre_x(b), real(2)) + F.pow(centre_y(a) - centre_y(b), real(2)))


def clipped(width: Column, height: Column, pad: int = 0) -> dict[str, Column]:
    """The box grown by pad on every side and cut to the page."""
    low = lambda x, most: F.greatest(F.lit(0), F.least(x, most))
    return {"x1": low(c("x1") - pad, width), "y1": low(c("y1") - pad, height), "x2": low(c("x2") + pad, width), "y2": low(c("y2") + pad, height)}


def normalised(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> dict[str, Column]:
    """Pixels of a box given in shares of the page: rounded half to even, cut to the page, corners in order."""

    def pixel(v: Column, most: Column) -> Column:
        return F.least(F.greatest(F.bround(v * most).cast("int"), F.lit(0)), most)

    a, b, p, q = pixel(x1, width), pixel(x2, width), pixel(y1, height), pixel(y2, height)
    return {"x1": F.least(a, b), "y1": F.least(p, q), "x2": F.greatest(a, b), "y2": F.greatest(p, q)}


def overlap_share(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Overlap over the smaller extent; 0 where that is 0."""
    least = F.least(hi_a - lo_a, hi_b - lo_b)
    return F.when(least > 0, F.greatest(F.lit(0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b)) / least).otherwise(real(0))


def normalised_polygon(points: Column, width: Column, height: Column) -> Column:
    """Pixels of a polygon's points given in shares of the page: rounded half to even, cut to the page."""
    pixel = lambda v, most: F.least(F.greatest(F.bround(v * most).cast("int"), F.lit(0)), most)
    return F.transform(points, lambda p: F.struct(pixel(p["x"], width).alias("x"), pixel(p["y"], height).alias("y")))
