"""The photo lane: admission, daily limits, the state of a submission, and its metadata-free bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of admission.
PER_DAY, MOST_BYTES, LEAST_BYTES = 12, 8 * 1024 * 1024, 1024
QUEUE = 200
LID_CHARS, NAME_CHARS, NOTE_CHARS = 64, 200, 500
FINAL = ("approved", "rejected")


def rate_limited(submissions: DataFrame, most: int = PER_DAY) -> DataFrame:
    """submissions(ip_hash, day, ts, id) with `admitted`: the first `most` of a sender's day. A refused one doesn't count.

    Of a day's submissions only those that can be among its first are ranked (each task lets the others go before they are shuffled), so a sender who floods
    is no large group; where a day has more, the last that is admitted is the bound that its rows are held against.
    """
    order = Window.partitionBy("ip_hash", "day").orderBy("ts", "id")
    first = submissions.select("ip_hash", "day", "ts", "id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    bounds = first.where(F.col("place") == most).select("ip_hash", "day", F.struct("ts", "id").alias("__bound"))
    met = submissions.join(bounds, ["ip_hash", "day"], "left").select(*[submissions[c] for c in submissions.columns], "__bound")
    return met.select(*submissions.columns, (F.col("__bound").isNull() | (F.struct("ts", "id") <= F.col("__bound"))).alias("admitted"))


def rate_counts(rate: DataFrame, requests: DataFrame, today: Column) -> DataFrame:
    """rate(ip_hash, day, n) after requests(ip_hash, day), each of which adds one; days before today are dropped."""
    more = requests.select("ip_hash", "day", F.lit(1).cast("long").alias("n"))
    return rate.select("ip_hash", "day", "n").unionByName(more).where(F.col("day") >= today).groupBy("ip_hash", "day").agg(F.sum("n").alias("n"))


def photo_type(data: Column) -> Column:
    """The image type that the first bytes show, null if none."""
    hexed = F.hex(F.substring(data, 1, 12))
    return F.when(F.startswith(hexed, F.lit("FFD8FF")), "image/jpeg").when(F.startswith(hexed, F.lit("89504E470D0A1A0A")), "image/png").when(hexed.rlike("^52494646.{8}57454250"), "image/webp")


def refusal_code(over_limit: Column, is_form: Column, is_person: Column, data: Column, lid: Column) -> Column:
    """The status code of the first rule that a submission breaks, null if it is admitted."""
    size = F.octet_length(data)
    return (
        F.when(over_limit, 429).when(~is_form, 400).when(~is_person, 403).when(data.isNull(), 400).when(size > MOST_BYTES, 413).when(size < LEAST_BYTES, 400)
        .when(photo_type(data).isNull(), 415).when(F.trim(F.left(F.coalesce(lid, F.lit("")), F.lit(LID_CHARS))) == "", 400)
    )


def object_key(day: Column, id_: Column, kind: Column) -> Column:
    ending = F.when(kind == "image/png", "png").when(kind == "image/webp", "webp").otherwise("jpg")
    return F.concat(F.lit("submissions/"), day.cast("string"), F.lit("/"), id_.cast("string"), F.lit("."), ending)


def without_metadata(jpeg: bytes | None) -> bytes | None:
    """jpeg without its application segments 1 to 15 and comments; anything that isn't a sound JPEG stays as it is."""
    if not jpeg or jpeg[:2] != b"\xff\xd8":
        return jpeg
    out, at = [jpeg[:2]], 2
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            return jpeg
        kind = jpeg[at + 1]
        if kind == 0xDA:  # the image data, to the end
            return b"".join([*out, jpeg[at:]])
        if kind == 0x01 or 0xD0 <= kind <= 0xD9:
            out.append(jpeg[at : at + 2])
            at += 2
            continue
        size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(jpeg):
            return jpeg
        if not (0xE1 <= kind <= 0xEF or kind == 0xFE):
            out.append(jpeg[at : at + 2 + size])
        at += 2 + size
    return jpeg


def stripped(column: str = "data") -> Column:
    @F.pandas_udf("binary")
    def strip(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(without_metadata)

    return strip(F.col(column))


def final_status(events: DataFrame) -> DataFrame:
    """(id, status, n_refused): events(id, ts, seq, event) folded in order.

    `extract` moves a pending submission to extracted, `approve` and `reject` rule on one that is
    pending or extracted, `error` leaves it pending; anything else, and a ruling on what is ruled
    already, is refused. The state is a function of the first ruling and of whether an extraction
    came before it, so minima decide it and no history is collected.
    """
    ruling = F.col("event").isin("approve", "reject")
    at = F.struct("ts", "seq")
    grouped = events.groupBy("id").agg(F.min(F.when(ruling, F.struct("ts", "seq", "event"))).alias("r"), F.min(F.when(F.col("event") == "extract", at)).alias("e"), F.count("*").alias("n"))
    first_extract = F.col("e").isNotNull() & (F.col("r").isNull() | (F.col("e") < F.struct(F.col("r.ts").alias("ts"), F.col("r.seq").alias("seq"))))
    status = F.when(F.col("r.event") == "approve", "approved").when(F.col("r.event") == "reject", "rejected").when(F.col("e").isNotNull(), "extracted").otherwise("pending")
    used = F.when(F.col("r").isNotNull(), 1).otherwise(0) + F.when(first_extract, 1).otherwise(0)
    return grouped.select("id", status.alias("status"), (F.col("n") - used).alias("n_refused"))


def review_queue(submissions: DataFrame, status: str = "extracted", most: int = QUEUE) -> DataFrame:
    """The oldest submissions of a status: a queue page."""
    return submissions.where(F.col("status") == status).orderBy("ts", "id").limit(most)


def replaced(kept: DataFrame, new: DataFrame) -> DataFrame:
    """kept with what new says of the same venue and photo in its place."""
    return kept.join(new.select("lid", "photo_id").distinct(), ["lid", "photo_id"], "left_anti").unionByName(new)


def approved(submissions: DataFrame, base: DataFrame) -> DataFrame:
    """(lid, name, address, zone_id, website, photo_id, deals): the venue rows that approved photos make.

    submissions(lid, photo_id, approved_at, venue_name, deals) meet base(lid, name, address, zone_id, website); what base lacks is taken from the
    submission, and a venue that it doesn't have at all is named by its licence. A later photo of a venue replaces an earlier one's offers.
    """
    latest = submissions.groupBy("lid").agg(F.max_by(F.struct("photo_id", "venue_name", "deals"), F.struct("approved_at", "photo_id")).alias("s"))
    met = latest.join(base.select("lid", "name", "address", "zone_id", "website"), "lid", "left")
    told = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    return met.select(
        "lid", told(F.col("name"), F.col("s.venue_name"), F.col("lid").cast("string")).alias("name"), F.coalesce("address", F.lit("")).alias("address"), F.coalesce("zone_id", F.lit("")).alias("zone_id"), "website", "s.photo_id", "s.deals"
    )


def photo_of(submissions: DataFrame, id_: int) -> DataFrame:
    """The submission of that id: a point look-up whose predicate the source's reader gets."""
    return submissions.where(F.col("id") == id_).limit(1)
