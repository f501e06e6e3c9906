"""String tests of block classification, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that begin a list item.
BULLETS = "•-*●○▪►"


def strip(x: Column | str) -> Column:
    """x without white space at its ends; most texts have none there, which their first and last characters tell."""
    x = F.col(x) if isinstance(x, str) else x
    ends = F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+$", "")).otherwise(x)


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def is_upper(x: Column) -> Column:
    return x.rlike(r"\p{Lu}") & ~x.rlike(r"[\p{Ll}\p{Lt}]")


def is_bullet(x: Column) -> Column:
    return F.substring(x, 1, 1).isin(*BULLETS) & (F.char_length(x) > 0)


def is_numbered(x: Column) -> Column:
    """Whether the first word is a number; the others aren't looked at."""
    return F.coalesce(x, F.lit("")).rlike(r"(?U)^\s*\p{Nd}+[.):]*(\s|\z)")
