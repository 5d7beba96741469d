"""Shared pieces of the training-data operators: word rules, checkpoints, byte blocks."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space characters between words, as a Java character class and as text.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def set_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; a folder of our own only where it is unset and all runs on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files.

    What is expensive is computed once, and a lost executor costs a reread, not a rerun.
    """
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(written: DataFrame) -> None:
    """Remove the files of what cut returned, when all that was made of it is written itself."""
    file = written._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = written.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(written.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(rows: DataFrame, group: str, order: Sequence[str], count: str = "n") -> DataFrame:
    """rows with i, their place in their group from 0, and the group's size (named by count).

    Rows are dealt out by ranges of (group, order), so a group of any size lies in as many ranges as it needs; a range's first place in
    its group is the sum over the ranges before.
    """
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    ranged = cut(dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy(group, "__part").agg(F.count("*").alias("__held"), F.min("__at").alias("__low"))  # a row for each range and group in it
    own = Window.partitionBy(group)
    begins = parts.select(
        F.col(group).alias("__g"), F.col("__part").alias("__p"), "__low", (F.sum("__held").over(own.orderBy("__part")) - F.col("__held")).alias("__before"), F.sum("__held").over(own).alias(count),
    )
    met = ranged.join(begins, (F.col(group) == F.col("__g")) & (F.col("__part") == F.col("__p")))
    return met.select(*rows.columns, (F.col("__at") - F.col("__low") + F.col("__before")).alias("i"), count)


def quoted(df: DataFrame) -> list:
    """The columns of df, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def id_and_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, body): the text as UTF-8 bytes, null as empty; other columns go, whatever their names."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
