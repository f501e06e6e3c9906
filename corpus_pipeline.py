"""From raw documents to packed training sequences, stage by stage.

Each stage is a function (spark, docs, sf_dir) of all that the stage before kept; its result is
written as Parquet in the shared folder and read again for the next. All but the last return the
columns of documents. Null texts count as empty, and an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from leafwork.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under their language's threshold, by a classifier of the labelled rows. A score that
    equals the threshold goes. Rows are judged one by one: repeated rows alike, those without an id too;
    a null or empty text has the score of an empty one, a null language the threshold of all."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; those left blank go. Rows without an
    id stay as they are; repeated rows of an id are cut alike."""
    return line_dedup.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the smallest id; of rows
    of one id the one with the least text. Texts without words are linked with nothing; rows without an
    id stay."""
    copies = near_dedup.near_dedup(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(copies, F.col("doc_id") == F.col("_gone"), "left_anti")
    if not docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
        return left
    one = left.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("d")).select("d.*")
    return one.unionByName(left.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Repeated rows go or stay together; rows without an id stay,
    as do all where there are no items."""
    leaks = decontaminate.contained(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(leaks, F.col("doc_id") == F.col("_gone"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequences and places. An empty text is a piece of one
    token, the end; rows without an id can't be told apart and take no part; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The classifier can't be written in SQL; tests hold the other stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), spark)
    return STAGES[-1][1](spark, docs, sf_dir)
