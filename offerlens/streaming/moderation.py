"""The photo lane as a stream: the daily limit with keyed state, and the status of submissions, equal to their batch forms."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from offerlens.operators.moderation import PER_DAY, final_status, rate_counts
from offerlens.session import shared_folder

#: Rows of a frame that is handed on.
FRAME_ROWS = 10_000
#: States that the senders of a day are dealt to.
GROUPS = 256
ADMITTED = "ip_hash bigint, day date, ts timestamp, id bigint, admitted boolean"


def rate_limit(submissions: DataFrame, most: int = PER_DAY, late: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """submissions(ip_hash, day, ts, id) as they come, with `admitted`.

    State is a count per sender and day; it ends when the watermark passes the next day, as the
    pruning of older days would have it. Within a batch rows count in the order of ts and id.
    Senders share a state by their hash, as Python is called once for each; `groups` stays as it was when the stream began.
    """

    def admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, counts = (np.frombuffer(x, np.int64) for x in state.get) if state.exists else (np.empty(0, np.int64),) * 2
        # of a flood only senders, times and ids are held, 24 bytes a row
        held = [(f["sender"].to_numpy(np.int64), f["ts"].to_numpy("datetime64[us]"), f["id"].to_numpy()) for f in frames]
        senders, ts, ids = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ids, ts, senders))
        senders, ts, ids = senders[order], ts[order], ids[order]
        own, first, came = np.unique(senders, return_index=True, return_counts=True)
        every = np.union1d(known, own)
        seen = np.zeros(len(every), np.int64)
        seen[np.searchsorted(every, known)] = counts
        mine = np.searchsorted(every, own)
        place = np.arange(len(senders)) - np.repeat(first - seen[mine], came)
        seen[mine] += came
        state.update((every.tobytes(), seen.tobytes()))
        ends = int((pd.Timestamp(key[1]) + pd.Timedelta(days=2)).timestamp() * 1000)
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)
        for low in range(0, len(senders), FRAME_ROWS):
            part = slice(low, low + FRAME_ROWS)
            ip_hash = pd.array(senders[part], dtype="Int64")
            if key[0] < 0:
                ip_hash[:] = pd.NA
            yield pd.DataFrame({"ip_hash": ip_hash, "day": key[1], "ts": ts[part], "id": ids[part], "admitted": place[part] < most})

    timed = submissions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    # rows without a sender are a group of their own
    dealt = timed.select(
        F.when(F.col("ip_hash").isNull(), -1).otherwise(F.pmod(F.xxhash64("ip_hash"), F.lit(groups))).cast("int").alias("group"), "day", "ts", "id", F.coalesce("ip_hash", F.lit(0)).cast("long").alias("sender")
    )
    return dealt.groupBy("group", "day").applyInPandasWithState(admit, ADMITTED, "senders binary, counts binary", "append", GroupStateTimeout.EventTimeTimeout)


def latest_status(events: DataFrame) -> DataFrame:
    """final_status as a streaming aggregate: its minima are mergeable, so update mode needs no history."""
    return final_status(events)


def run_once(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """All that the source holds now, through the stream, as Parquet in folder: for catching up, tests and reports.

    Run again with the same folder, it goes on from where it stopped.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, f"streams/{uuid.uuid4().hex}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows"))
    else:
        writer = writer.format("parquet").option("path", f"{folder}/rows")
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


BUCKETS = 64


def upsert(path: str, key: str, buckets: int = BUCKETS, latest: str | None = None):
    """A foreachBatch sink: the rows of a batch replace those of the same key; of several in a batch the one with the greatest `latest` (without it, the greatest row).

    The table lies in buckets of the key's hash; a batch reads and rewrites those alone that it touches, by way of a
    copy beside the table. A batch that is replayed replaces the same keys again, so the result is the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        whole = F.struct(*batch.columns)
        batch = batch.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(latest, whole) if latest else whole).alias("_row")).select("_row.*")
        dealt = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in dealt.select("_bucket").distinct().collect()]  # as many as there are buckets at most
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        rows = dealt
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            old = spark.read.schema(dealt.schema).parquet(path).where(F.col("_bucket").isin(touched))
            rows = old.join(dealt.select(key), key, "left_anti").unionByName(dealt)
        beside = f"{path.rstrip('/')}.next"
        rows.write.mode("overwrite").parquet(beside)
        spark.read.schema(dealt.schema).parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)

    return write


def upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")


RATE = "ip_hash bigint, day date, n bigint"


def _held(spark: SparkSession, path: str) -> list[int]:
    """The batches whose state lies whole under path, in order."""
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(home, "batch=*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or ())


def counted(path: str):
    """A foreachBatch sink of requests(ip_hash, day): counts by sender and day, without the days before the latest one.

    A batch adds to the state that the batch before it left and writes its own beside it, so one that is replayed counts once.
    The state before the last two is deleted. It holds the senders of one day.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [b for b in _held(spark, path) if b < batch_id]
        rate = spark.read.schema(RATE).parquet(f"{path}/batch={before[-1]}") if before else spark.createDataFrame([], RATE)
        today = batch.select("day").unionByName(rate.select("day")).agg(F.max("day")).first()[0]
        rate_counts(rate, batch, F.lit(today).cast("date")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        for old in before[:-1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={old}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return write


def counts(spark: SparkSession, path: str) -> DataFrame:
    held = _held(spark, path)
    return spark.read.schema(RATE).parquet(f"{path}/batch={held[-1]}") if held else spark.createDataFrame([], RATE)
