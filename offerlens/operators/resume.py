"""Long work that is stopped and taken up again: what is left, in which order, and a log of what came of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Choices of a run by name: each makes a condition on a row of work from its argument.
CHOICES: dict[str, Callable[[str], Column]] = {
    "zone": lambda zone: F.col("zone_id") == zone,
    "match": lambda pattern: F.col("website").rlike(f"(?i){pattern}"),
    "key": lambda key: F.col("key") == key,
}


def settled(log: DataFrame) -> DataFrame:
    """(key): work that is done. log(key, at, outcome) has a row for each try; the last counts, and one that found nothing is no end: it is tried again."""
    last = log.groupBy("key").agg(F.max_by("outcome", "at").alias("outcome"))
    return last.where("outcome <> 'missing'").select("key")


def remaining(work: DataFrame, log: DataFrame | None = None, again: bool = False, limit: int | None = None, **choices: str) -> DataFrame:
    """The rows of work(key, ...) to be done, in the order of their keys: those chosen, but for what is settled unless `again`; the first `limit` if one is set."""
    chosen = work
    for name, argument in choices.items():
        chosen = chosen.where(CHOICES[name](argument))
    if log is not None and not again:
        chosen = chosen.join(settled(log), "key", "left_anti")
    return chosen.orderBy("key").limit(limit) if limit else chosen


def run(spark: SparkSession, path: str, schema: str, do: Callable[[DataFrame], DataFrame], folder: str, at_a_time: int = 1, batches: int | None = None) -> DataFrame:
    """The log after the files in path have gone through `do`, at_a_time of them to a batch; stopped after so many batches if told to.

    Each batch is one write to the log in folder, under its number: one that was cut off is done again and overwrites itself, so a run that was
    stopped and taken up again leaves what one run would have. Files that come later are taken up by the next run.
    """

    def done(batch: DataFrame, number: int) -> None:
        do(batch).write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
        if batches is not None and number + 1 >= batches:
            raise _Enough

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", at_a_time).parquet(path)
    query = stream.writeStream.foreachBatch(done).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception as error:
        if _Enough.__name__ not in str(error):
            raise
    return spark.read.parquet(f"{folder}/log").drop("batch")


class _Enough(Exception):
    """Ends a run that is to be stopped, after its batch was written and before that is noted: the next run does it again."""
