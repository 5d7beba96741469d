"""Offers share states: as many as groups at most, each with its own steps."""

import datetime as dt

import pandas as pd

from offerlens.streaming import decay
from offerlens.streaming import moderation as streams


def test_offers_share_states_and_take_their_own_steps(spark, tmp_path):
    schema = "deal_id long, confidence string, verified_at timestamp"
    day = lambda k: dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=k)
    kinds = ("likely", "verified", "unconfirmed", "disputed")
    rows = [(i, kinds[i % 4], day(i % 7)) for i in range(1200)]
    before = {k: spark.conf.get(k) for k in decay.STORE}
    try:
        for name, value in decay.STORE.items():
            spark.conf.set(name, value)
        for batch in (rows + [(None, "likely", day(0))], [(-1, "disputed", day(51))], [(0, "verified", day(55)), (4, "likely", day(1)), (-1, "disputed", day(140))]):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            changes = streams.run_once(decay.decayed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 day"), "append", str(tmp_path / "out"))
        states = spark.read.format("statestore").option("stateVarName", "said").load(str(tmp_path / "out" / "state")).count()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    want = []
    for i, kind, at in rows:
        start = at.replace(hour=0)
        want.append((i, at, kind))
        if kind == "likely":
            want.append((i, start + dt.timedelta(days=46), "unconfirmed"))
        if i and kind in ("likely", "unconfirmed"):
            want.append((i, start + dt.timedelta(days=121), "hidden"))
    want.append((0, day(55), "verified"))
    said = changes.where("deal_id >= 0").toPandas()
    assert sorted(zip(said["deal_id"], said["at"], said["effective"])) == sorted((i, pd.Timestamp(at), c) for i, at, c in want)
    assert sorted(r.effective for r in changes.where("deal_id IS NULL").collect()) == ["hidden", "likely", "unconfirmed"]
    assert states <= decay.GROUPS + 1
