"""Joins of intervals with the places that lie in them, as equal joins on cells of a hierarchical grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of cells are powers of two from 2 ** LEAST on; what is wider than 2 ** MOST has cells of that size.
LEAST, MOST = -20, 40


def level(width: Column) -> Column:
    """The power of two of the smallest cell that is as wide as this."""
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.ceil(F.log2(F.greatest(width.cast("double"), F.lit(2.0**LEAST)))))).cast("int")


def placed(wide: DataFrame, places: DataFrame, keys: list[str], lo: str, hi: str, at: str) -> DataFrame:
    """The rows of wide and places, as aliases a and b, with equal keys and a.lo <= b.at <= a.hi.

    An interval stands in the one or two cells of its own size that it touches, and in more only if it is
    wider than all cells; a place looks into one cell for each size that wide has (61 at most, asked for
    when this is called). So what meets in a cell is at most twice the interval's width away from it,
    whatever else the page holds, each pair meets once, and a key with very many rows is spread over its
    cells. They meet by the first key and one hash of keys, size and cell, so that sorting is cheap, and sides
    that are both dealt out by the first key stay in place; equality is that of the values. Neither side may have columns _level, _cell or _meet; nulls meet nothing.
    """
    size = F.pow(F.lit(2.0), F.col("_level"))
    cell = lambda x: F.floor(x / size)
    meet = lambda df: df.withColumn("_meet", F.xxhash64(*keys, "_level", "_cell"))
    a = wide.where(F.col(lo) <= F.col(hi)).withColumn("_level", level(F.col(hi) - F.col(lo)))
    sizes = F.array(*[F.lit(r[0]) for r in a.select("_level").distinct().orderBy("_level").collect()]).cast("array<int>")
    a = meet(a.withColumn("_cell", F.explode(F.sequence(cell(F.col(lo)), cell(F.col(hi)))))).alias("a")
    b = meet(places.withColumn("_level", F.explode(sizes)).withColumn("_cell", cell(F.col(at)))).alias("b")
    on = (F.col(f"a.{keys[0]}") == F.col(f"b.{keys[0]}")) & (F.col("a._meet") == F.col("b._meet")) & (F.col(f"b.{at}") >= F.col(f"a.{lo}")) & (F.col(f"b.{at}") <= F.col(f"a.{hi}"))
    for k in [*keys[1:], "_level", "_cell"]:
        # equal either way, but not as a key of the join
        on &= ~(F.col(f"a.{k}") < F.col(f"b.{k}")) & ~(F.col(f"a.{k}") > F.col(f"b.{k}")) & F.col(f"a.{k}").isNotNull()
    return a.join(b, on)


def overlapping(rows: DataFrame, keys: list[str], lo: str, hi: str, row: str) -> DataFrame:
    """Each unordered pair of rows, as aliases a and b, whose keys are equal and whose open intervals
    (lo, hi) meet: a sweep's pairs, b being the one that begins later, or has the larger row number."""
    later = (F.col(f"b.{lo}") > F.col(f"a.{lo}")) | ((F.col(f"b.{lo}") == F.col(f"a.{lo}")) & (F.col(f"b.{row}") > F.col(f"a.{row}")))
    return placed(rows.where(F.col(lo) < F.col(hi)), rows.where(F.col(lo) < F.col(hi)), keys, lo, hi, lo).where(later & (F.col(f"b.{lo}") < F.col(f"a.{hi}")))
