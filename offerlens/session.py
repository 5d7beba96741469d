"""Session settings that the engine's results rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, unless their path has it already."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_offerlens_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="package-")) / "offerlens.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted((root / "offerlens").rglob("*.py")):
            archive.write(source, source.relative_to(root))
    context.addPyFile(str(target))
    context._offerlens_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share: below spark.checkpoint.dir, or one of our own where all runs on one machine."""
    import tempfile

    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(named or tempfile.mkdtemp(prefix='offerlens-')).rstrip('/')}/{name}"


#: Tasks for each core, or for each split of a larger table.
TASKS = 4


def tasks(rows: DataFrame) -> int:
    """The tasks that rows are dealt to: more come with more splits."""
    return TASKS * max(rows.sparkSession.sparkContext.defaultParallelism, rows._jdf.rdd().getNumPartitions())


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, for rows that cost more to compute than to move.

    A file's splits don't say how its rows lie: all of a row group are read in one of them. More tasks come with more splits.
    """
    return rows.repartition(tasks(rows))


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows by way of files in the shared folder: computed once, read again by whoever needs them, and after a loss."""
    import uuid

    path = shared_folder(rows.sparkSession, f"{name}/{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
