"""Senders share states: as many as groups at most, with the rows of the batch form."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from offerlens.streaming import moderation as streams


def test_senders_share_states_and_keep_their_own_counts(spark, tmp_path):
    schema = "id long, ip_hash long, ts timestamp"
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)
    rows = [(i, None if i % 50 == 0 else 2**60 + i * i % 997, at(i)) for i in range(3000)]
    for k in range(2):
        spark.createDataFrame(rows[k::2] if k else rows[0::2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("day", F.to_date("ts"))
    seen = streams.run_once(streams.rate_limit(source, 3), "append", str(tmp_path / "cp"))
    place = F.row_number().over(Window.partitionBy("ip_hash", "day").orderBy("ts", "id"))
    batch = spark.read.schema(schema).parquet(str(tmp_path / "in")).withColumn("day", F.to_date("ts")).withColumn("admitted", place <= 3)
    told = lambda rows: sorted((r.id, r.ip_hash or -1, r.admitted) for r in rows.collect())
    assert told(seen) == told(batch)
    assert spark.read.format("statestore").load(str(tmp_path / "cp" / "state")).count() <= streams.GROUPS + 1
