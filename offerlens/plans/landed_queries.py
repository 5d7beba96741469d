"""Queries over what was landed and published: answers of services, documents of zones, resumed work, approved photos, decay as it happens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators import moderation, publish, resume
from offerlens.plans.lenses import lens, sql
from offerlens.session import shared_folder
from offerlens.sources import files, services
from offerlens.streaming import decay
from offerlens.streaming import moderation as streams


def _folder(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, f"{name}/{uuid.uuid4().hex}")


def _land(rows: DataFrame, spark: SparkSession, name: str) -> str:
    """rows(area, part, record) as JSON answers, one a part of an area."""
    answers = rows.groupBy("area", "part").agg(F.to_json(F.struct(F.sort_array(F.collect_list("record")).alias(name))).alias("value"))
    return _write(answers, spark, name)


#: Answers hold so many records, as a service's pages do; a file holds so many answers at most.
_PAGE, _ANSWERS = 20, 1000


def _write(answers: DataFrame, spark: SparkSession, name: str) -> str:
    """answers(area, part, value), a line each, in folders by area; every task writes of all areas, so none has an area to itself."""
    path = _folder(spark, name)
    answers.repartition("area", "part").select("area", "value").write.option("maxRecordsPerFile", _ANSWERS).partitionBy("area").text(path)
    return path


def landed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of three areas with a site and south of a line, from landed answers: other areas' files stay closed."""
    p = lens(spark, sf_dir, "place")
    where = F.when(F.col("place_id") % 7 > 0, F.struct((40 + (F.col("place_id") % 100) / 200).alias("latitude"), (-75 - (F.col("place_id") % 90) / 300).alias("longitude")))
    record = F.struct(F.col("place_id").cast("string").alias("id"), F.struct(F.col("place_name").alias("text")).alias("displayName"), F.concat("number", F.lit(" "), "street").alias("formattedAddress"), F.col("website").alias("websiteUri"), where.alias("location"))
    path = _land(p.select(F.concat(F.lit("z"), F.col("nation").cast("string")).alias("area"), F.expr(f"place_id div {_PAGE}").alias("part"), record.alias("record")), spark, "places")
    found = services.landed(spark, path, "places").where(F.col("area").isin("z1", "z3", "z7") & F.col("website").isNotNull() & (F.col("lat") < 40.375))
    return found.select("area", "place_id", "place_name", "place_address", "website", "lat", "lng")


def landed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements by area: how many there are, with a site of either tag, and where areas have only a centre."""
    p = lens(spark, sf_dir, "place")
    k = F.col("place_id")
    at = lambda lat, lng: F.struct(lat.alias("lat"), lng.alias("lon"))
    lat, lng = 40 + (k % 100) / 200, -75 - (k % 90) / 300
    tags = F.map_filter(F.map_from_arrays(F.array(F.lit("name"), F.lit("website"), F.lit("contact:website")), F.array(F.col("place_name"), F.when(k % 2 == 0, F.col("website")), F.when(k % 4 < 2, F.concat(F.lit("http://c"), k.cast("string"))))), lambda _, v: v.isNotNull())
    record = F.struct(F.when(k % 3 == 0, "way").otherwise("node").alias("type"), k.alias("id"), F.when(k % 3 > 0, lat).alias("lat"), F.when(k % 3 > 0, lng).alias("lon"), F.when(k % 3 == 0, at(lat, lng)).alias("center"), F.to_json(tags).alias("tags"))
    rows = p.select(F.concat(F.lit("z"), F.col("nation").cast("string")).alias("area"), F.expr(f"place_id div {_PAGE}").alias("part"), record.alias("record"))
    # the tags are an object of the answer, not a text
    one = F.replace(F.replace(F.replace(F.to_json("record"), F.lit('"{'), F.lit("{")), F.lit('}"'), F.lit("}")), F.lit('\\"'), F.lit('"'))
    answers = rows.select("area", "part", one.alias("text")).groupBy("area", "part").agg(F.concat(F.lit('{"elements":['), F.array_join(F.sort_array(F.collect_list("text")), ","), F.lit("]}")).alias("value"))
    path = _write(answers, spark, "elements")
    found = services.landed(spark, path, "elements").where(F.col("kind").isin("node", "way"))
    return found.groupBy("area", "kind").agg(F.count("*").alias("n"), F.count("website").alias("n_sites"), F.min("website").alias("first_site"), F.round(F.max("lat"), 6).alias("north"))


def unpriced_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published to a document for each zone, read back from those with offers alone: the machine's offers that lack items."""
    k = F.col("deal_id")
    offer = F.struct(k.alias("id"), F.when(k % 3 == 0, "staff").otherwise("auto_extract").alias("verified_by"), F.when(k % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("items"))
    offers = lens(spark, sf_dir, "deal").where("lid % 3 > 0").groupBy("lid").agg(F.sort_array(F.collect_list(offer)).alias("deals"))
    venues = lens(spark, sf_dir, "venue").join(offers, "lid", "left")
    rows = venues.select("zone_id", F.col("lid").cast("string").alias("id"), "name", F.coalesce("deals", F.array().cast("array<struct<id:bigint,verified_by:string,items:array<string>>>")).alias("deals"))
    path = _folder(spark, "documents")
    publish.write_documents(rows, path)
    return files.unpriced(files.published_offers(spark, path)).select(F.col("venue").cast("long").alias("lid"), "deal_id")


def remaining_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of a zone's venues that match and are not settled: tries that found nothing don't settle, unless a later one did."""
    work = lens(spark, sf_dir, "venue").select(F.col("lid").alias("key"), "zone_id", F.concat(F.lit("http://"), F.when(F.col("lid") % 3 == 0, "Tavern").otherwise("shop"), F.col("lid").cast("string")).alias("website"))
    log = lens(spark, sf_dir, "deal").select(F.col("lid").alias("key"), F.col("deal_id").alias("at"), F.when(F.col("deal_id") % 3 == 0, "ok").when(F.col("deal_id") % 3 == 1, "missing").otherwise("error").alias("outcome")).where("at % 8 < 3")
    return resume.remaining(work, log, zone="z7", match="tavern").select("key", "website")


def resumed_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of outcomes written by a run that is stopped after its second batch and taken up again."""
    path, folder = _folder(spark, "work"), _folder(spark, "resumed")
    lens(spark, sf_dir, "deal").select(F.col("deal_id").alias("key"), "status").repartition(6, "key").write.parquet(path)
    do = lambda batch: batch.select("key", F.when(F.col("status") == "F", "ok").otherwise("missing").alias("outcome"))
    for batches in (2, None):
        log = resume.run(spark, path, "key bigint, status string", do, folder, at_a_time=2, batches=batches)
    return log.groupBy("outcome").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.sum("key").alias("sum"))


def approved_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The venue rows of approved photos: from the base, or from the submission where the base lacks the venue or its name."""
    k = F.col("deal_id")
    subs = lens(spark, sf_dir, "deal").where("deal_id % 4 = 0").select("lid", k.alias("photo_id"), (k % 1000).alias("approved_at"), F.when(k % 3 > 0, F.concat(F.lit("Seen "), "lid")).alias("venue_name"), F.array(k).alias("deals"))
    base = lens(spark, sf_dir, "venue").where("lid % 5 > 0").select("lid", F.when(F.col("lid") % 7 > 0, F.col("name")).otherwise("").alias("name"), F.concat("lid", F.lit(" Main St")).alias("address"), "zone_id", F.lit(None).cast("string").alias("website"))
    return moderation.approved(subs, base).select("lid", "name", "address", "zone_id", "photo_id", F.col("deals")[0].alias("deal_id"))


def photo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One submission by its id: one row of one is the feature."""
    return moderation.photo_of(lens(spark, sf_dir, "submission"), 77).select("id", "ip_hash", "event_type")


#: The day on which the offers' ages are told, and how long event time waits for late rows.
_TODAY, _LATE = "2024-07-01", 7


def stream_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of each offer on a day, by a stream of verifications whose event time goes up to that day."""
    path = _folder(spark, "verifications")
    deals = lens(spark, sf_dir, "deal").select("deal_id", "confidence", F.expr(f"CAST(date_sub(DATE '{_TODAY}', age_days) AS TIMESTAMP)").alias("verified_at"))
    clock = spark.range(1).select(F.lit(-1).cast("long"), F.lit("disputed"), F.expr(f"CAST(date_add(DATE '{_TODAY}', {_LATE}) AS TIMESTAMP)"))
    deals.union(clock).write.parquet(path)
    before = {k: spark.conf.get(k) for k in decay.STORE}
    try:
        for name, value in decay.STORE.items():
            spark.conf.set(name, value)
        changes = streams.run_once(decay.decayed(spark.readStream.schema("deal_id bigint, confidence string, verified_at timestamp").parquet(path), f"{_LATE} days"), "append")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return decay.shown(changes).where("deal_id >= 0")


QUERIES = {f.__name__: f for f in (landed_places, landed_elements, unpriced_offers, remaining_work, resumed_crawl, approved_photos, photo_lookup, stream_decay)}

_LAT, _LNG = "40 + (place_id % 100)::DOUBLE / 200", "-75 - (place_id % 90)::DOUBLE / 300"
ORACLES = {
    "landed_places": sql(f"""SELECT concat('z', nation) AS area, CAST(place_id AS VARCHAR) AS place_id, place_name, concat(number, ' ', street) AS place_address, website, {_LAT} AS lat, {_LNG} AS lng
FROM place WHERE nation IN (1, 3, 7) AND website IS NOT NULL AND place_id % 7 > 0 AND {_LAT} < 40.375""", "place"),
    "landed_elements": sql(f"""SELECT concat('z', nation) AS area, CASE WHEN place_id % 3 = 0 THEN 'way' ELSE 'node' END AS kind, count(*) AS n, count(site) AS n_sites, min(site) AS first_site, round(max({_LAT}), 6) AS north
FROM (SELECT *, coalesce(CASE WHEN place_id % 2 = 0 THEN website END, CASE WHEN place_id % 4 < 2 THEN concat('http://c', place_id) END) AS site FROM place) GROUP BY 1, 2""", "place"),
    "unpriced_offers": sql("SELECT lid, max(deal_id) AS deal_id FROM deal JOIN venue USING (lid) WHERE lid % 3 > 0 AND deal_id % 3 > 0 AND deal_id % 4 > 0 GROUP BY lid", "deal", "venue"),
    "remaining_work": sql("""WITH last AS (SELECT lid, arg_max(deal_id % 3, deal_id) AS r FROM deal WHERE deal_id % 8 < 3 GROUP BY lid)
SELECT lid AS key, concat('http://Tavern', lid) AS website FROM venue WHERE zone_id = 'z7' AND lid % 3 = 0 AND lid NOT IN (SELECT lid FROM last WHERE r <> 1)""", "venue", "deal"),
    "resumed_crawl": sql("SELECT CASE WHEN status = 'F' THEN 'ok' ELSE 'missing' END AS outcome, count(*) AS n, count(DISTINCT deal_id) AS keys, sum(deal_id)::BIGINT AS sum FROM deal GROUP BY 1", "deal"),
    "approved_photos": sql("""WITH s AS (SELECT lid, arg_max(deal_id, struct_pack(a := deal_id % 1000, p := deal_id)) AS k FROM deal WHERE deal_id % 4 = 0 GROUP BY lid)
SELECT s.lid, CASE WHEN v.lid % 7 > 0 THEN v.name WHEN k % 3 > 0 THEN concat('Seen ', s.lid) ELSE CAST(s.lid AS VARCHAR) END AS name, coalesce(concat(CAST(v.lid AS VARCHAR) || ' Main St'), '') AS address, coalesce(v.zone_id, '') AS zone_id, k AS photo_id, k AS deal_id
FROM s LEFT JOIN (SELECT * FROM venue WHERE lid % 5 > 0) v ON s.lid = v.lid""", "deal", "venue"),
    "photo_lookup": "SELECT event_id AS id, user_id AS ip_hash, event_type FROM events WHERE event_id = 77",
    "stream_decay": sql("SELECT deal_id, CASE WHEN confidence IN ('verified', 'disputed') THEN confidence WHEN age_days > 120 THEN 'hidden' WHEN age_days > 45 AND confidence = 'likely' THEN 'unconfirmed' ELSE confidence END AS effective FROM deal", "deal"),
}
