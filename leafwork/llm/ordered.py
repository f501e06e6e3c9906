"""Places in a global order without a task that sees a whole group: range partitions and block totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a block are 2 to this power; block totals are all that meets by group.
BLOCK_BITS = 12


def laid_out(df: DataFrame, order: list[Column], name: str = "_row") -> DataFrame:
    """df as a table in the shared folder, with a number in every row that rises in this order over all
    of the table. Rows that tie in the order are kept apart by their place in the input, so that a value
    that very many rows have is split too; what depends on their order must not tell them apart."""
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    dealt = salted.repartitionByRange(*order, F.col("_salt")).sortWithinPartitions(*order, "_salt").drop("_salt")
    return written(dealt.withColumn(name, F.monotonically_increasing_id()), df.sparkSession)


def running(df: DataFrame, group: str, at: str, value: Column, name: str, bits: int = BLOCK_BITS) -> DataFrame:
    """df with the sum of value over the rows of its group whose `at`, a long, is smaller. group may not
    be null and (group, at) has to be unique. Only a row for each block of `at` and group meets by group."""
    kept = df.withColumns({"_block": F.shiftright(at, bits), "_value": value})
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy(F.col(group).alias("_g"), F.col("_block").alias("_b")).agg(F.sum("_value").alias("_t"))
    starts = totals.select("_g", "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(group, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inside = kept.withColumn("_own", F.coalesce(F.sum("_value").over(own), F.lit(0)))
    out = inside.join(starts, (F.col(group) == F.col("_g")) & (F.col("_block") == F.col("_b")))
    return out.withColumn(name, F.col("_start") + F.col("_own")).drop("_g", "_b", "_start", "_own", "_block", "_value")


def numbered(table: DataFrame, name: str, row: str = "_row") -> DataFrame:
    """table, which `laid_out` gave, with each row's gapless number from 0 over all of it."""
    part, low = F.shiftright(row, 33), F.lit((1 << 33) - 1)
    sizes = table.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that was written
    starts = sizes.select("_p", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_start"))
    return table.withColumn("_q", part).join(F.broadcast(starts), F.col("_q") == F.col("_p")).withColumn(name, F.col("_start") + F.col(row).bitwiseAND(low)).drop("_q", "_p", "_start")
