"""Tables that are made once and read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new name in the folder of spark.checkpoint.dir, which all executors share. Where that is unset and
    Spark runs in one process, a local folder takes its place; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="leafwork-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/leafwork/{uuid.uuid4().hex}"


#: Bytes of text that go to one partition; as words they take some eighty times as much while they are sorted.
PART = 4 << 20


def parts(spark: SparkSession) -> int:
    """Of how many partitions the last dealt() was."""
    return int(spark.conf.get("leafwork.parts", None) or spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, key: str = "doc_id", size: int = 0) -> DataFrame:
    """df with equal keys in one partition. There are as many as the session has, or more where size, the bytes
    of all texts, is over PART for each of these: sorts of a partition's rows then stay in memory however large
    the table is. Windows, groups and joins whose keys hold this one stay in place, and adaptive execution
    doesn't put such partitions together. For joins that needs a setting of the session, which is set here,
    as is the number for kept()."""
    conf = df.sparkSession.conf
    n = max(int(conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    conf.set("leafwork.parts", str(n))
    return df.repartition(n, key)


def again(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df, which a kernel or a union has rid of how it was dealt out, dealt out as the last dealt() was."""
    return df.repartition(parts(df.sparkSession), key)


def written(df: DataFrame) -> DataFrame:
    """df as a table under such a name: lineage is cut, and what several branches read is made once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """written() for a table that goes on being dealt out by key: it has one bucket for each of dealt()'s
    partitions, so that what reads it isn't dealt out again. df should come from dealt()."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = f"leafwork_{path.rsplit('/', 1)[1]}"
    df.write.format("parquet").bucketBy(parts(spark), key).option("path", path).saveAsTable(name)
    return spark.table(name)
