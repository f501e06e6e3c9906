"""Grouping of ordered rows: by breaks between neighbours, and by distance from a group's first row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, part: list[str], order: list, breaks: Column, name: str) -> DataFrame:
    """name: number of the row's group from 0. breaks is true (or null, at the first row) where a group
    begins; it may look back with lag() or a running maximum over the same window."""
    w = Window.partitionBy(*part).orderBy(*order)
    flagged = df.withColumn("_b", F.coalesce(breaks, F.lit(True)).cast("int"))
    return flagged.withColumn(name, (F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_b")


def anchored(values: Column, tolerance: float) -> Column:
    """Group numbers of a rising array of numbers; a group ends where a value lies more than tolerance
    over the group's first."""
    start = F.struct(F.lit(None).cast("double").alias("a"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        new = acc["a"].isNull() | (F.abs(v - acc["a"]) > F.lit(float(tolerance)))
        n = F.when(new, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(F.when(new, v.cast("double")).otherwise(acc["a"]).alias("a"), n.alias("n"), F.concat(acc["out"], F.array(n)).alias("out"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def joined(pairs: Column, sep: str) -> Column:
    """Texts of structs (order..., text) in that order, as one string."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["text"]), sep)
