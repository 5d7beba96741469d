"""Offers that grow old by themselves: each step down the ladder is a row, made by a timer when event time reaches its day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from offerlens.functions.ranking import HIDE_DAYS, UNCONFIRM_DAYS

DAY_MS = 86_400_000
#: Rows of a frame that is handed on.
FRAME_ROWS = 10_000
CHANGES = "deal_id bigint, at timestamp, verified_at timestamp, effective string"
#: Timers need a store that holds them.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: States that offers are dealt to.
GROUPS = 256
_OFFERS = pa.schema([("deal_id", pa.int64()), ("confidence", pa.string()), ("verified_ms", pa.int64())])


def ladder(offers: pd.DataFrame) -> pd.DataFrame:
    """(deal_id, verified_ms, at_ms, effective, first) of offers: what is stated, then each step on the first day on which their age is over the bound."""
    stated = offers.assign(at_ms=offers["verified_ms"], effective=offers["confidence"], first=True)
    day = offers["verified_ms"] - offers["verified_ms"] % DAY_MS
    older = offers.assign(at_ms=day + (UNCONFIRM_DAYS + 1) * DAY_MS, effective="unconfirmed", first=False)[offers["confidence"] == "likely"]
    oldest = offers.assign(at_ms=day + (HIDE_DAYS + 1) * DAY_MS, effective="hidden", first=False)[~offers["confidence"].isin(["verified", "disputed"])]
    return pd.concat([stated, older, oldest], ignore_index=True)


class Ladder(StatefulProcessor):
    """State of a group of offers: what the last verification of each said, and when; the time up to which all their steps are told.

    A later verification starts the ladder anew; one that comes late changes nothing. A group has one timer, for its next step.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getValueState("said", StructType([StructField("offers", BinaryType())]))
        self.told = handle.getValueState("told", StructType([StructField("until", LongType())]))

    def _said(self) -> pd.DataFrame:
        return pa.ipc.open_stream(self.said.get()[0]).read_all().to_pandas() if self.said.exists() else _OFFERS.empty_table().to_pandas()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = lambda offers: offers.sort_values(["verified_ms", "confidence"]).drop_duplicates("deal_id", keep="last")
        latest = last(pd.concat([last(frame[_OFFERS.names]) for frame in rows], ignore_index=True))
        said = self._said()
        before = latest["deal_id"].map(said.set_index("deal_id")["verified_ms"])
        anew = latest[before.isna() | (before < latest["verified_ms"])]
        if anew.empty:
            return
        said = pd.concat([said[~said["deal_id"].isin(anew["deal_id"])], anew], ignore_index=True)
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(said, _OFFERS, preserve_index=False)
        with pa.ipc.new_stream(sink, _OFFERS) as stream:
            stream.write_table(table)
        self.said.update((sink.getvalue().to_pybytes(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        yield from self._changes(key, said, set(anew["deal_id"]), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._changes(key, self._said(), set(), timerValues.getCurrentWatermarkInMs())

    def _changes(self, key, said: pd.DataFrame, anew: set, now: int) -> Iterator[pd.DataFrame]:
        """What is stated anew, with the steps that event time has passed already, and the others' steps since those told; a timer for the next."""
        steps = ladder(said)
        until = self.told.get()[0] if self.told.exists() else now
        self.told.update((now,))
        later = steps["at_ms"][~steps["first"] & (steps["at_ms"] > now)]
        if len(later):
            self.handle.registerTimer(int(later.min()))
        new, passed = steps["deal_id"].isin(anew), ~steps["first"] & (steps["at_ms"] <= now)
        told = steps[new & (steps["first"] | passed) | ~new & passed & (steps["at_ms"] > until)]
        for low in range(0, len(told), FRAME_ROWS):
            part = told.iloc[low : low + FRAME_ROWS]
            deal_id = part["deal_id"].astype("Int64") if key[0] >= 0 else pd.Series(pd.NA, part.index, "Int64")
            yield pd.DataFrame({"deal_id": deal_id, "at": pd.to_datetime(part["at_ms"], unit="ms"), "verified_at": pd.to_datetime(part["verified_ms"], unit="ms"), "effective": part["effective"]})

    def close(self) -> None:
        pass


def decayed(offers: DataFrame, late: str = "7 days", groups: int = GROUPS) -> DataFrame:
    """CHANGES of offers(deal_id, confidence, verified_at) as they come and as time goes on: a row for each change of what is shown.

    Event time is the latest verification less `late`; a day is over when it has passed it. Rows later than that go, as their day has been told.
    Offers share a state by their hash, as Python is called several times for each; `groups` stays as it was when the stream began.
    """
    timed = offers.withColumn("verified_at", F.col("verified_at").cast("timestamp")).withWatermark("verified_at", late)
    # offers without an id are a group of their own
    group = F.when(F.col("deal_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("deal_id"), F.lit(groups))).cast("int").alias("group")
    keyed = timed.select(group, F.coalesce("deal_id", F.lit(0)).alias("deal_id"), "confidence", "verified_at", F.unix_millis("verified_at").alias("verified_ms"))
    return keyed.groupBy("group").transformWithStateInPandas(Ladder(), CHANGES, "append", "EventTime")


def shown(changes: DataFrame) -> DataFrame:
    """(deal_id, effective): of each offer the change that came last."""
    return changes.groupBy("deal_id").agg(F.max_by("effective", F.struct("verified_at", "at")).alias("effective"))
