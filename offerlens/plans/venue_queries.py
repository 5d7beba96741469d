"""Queries of operators whose inputs are tables of their own: venue rows, elements, prices to read, limits, mentions, windows of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import schedule
from offerlens.operators import crawl, moderation, publish, resolve, validate
from offerlens.plans.board_queries import _TYPE_SQL, _typed
from offerlens.plans.lenses import lens, sql
from offerlens.plans.text_queries import _DAYS_SAID, _K, _WINDOW_SAID, _quotes

_TODAY = "2024-01-15"


def venue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences with the place, the site and the photo of some of them."""
    licences = _typed(spark, sf_dir).join(lens(spark, sf_dir, "venue").select("lid", "zone_id"), "lid").withColumn("name", F.concat(F.lit("TAVERN ON THE HILL "), F.col("lid").cast("string"), F.lit(" LLC")))
    known, id_ = lens(spark, sf_dir, "place"), F.col("place_id")
    at = lambda ok, lat: (F.when(ok, F.lit(lat) + id_ / F.lit(1000.0)).alias("lat"), (F.lit(-75.0) - id_ / F.lit(1000.0)).alias("lng"))
    places = known.select((id_ * 3).alias("lid"), F.when(id_ % 4 == 0, "").otherwise(F.col("place_name")).alias("place_name"), "website", *at(id_ % 5 > 0, 40.0))
    sites = known.select((id_ * 2).alias("lid"), F.concat(F.lit("Element "), id_.cast("string")).alias("osm_name"), F.concat(F.lit("http://site"), id_.cast("string")).alias("website"), *at(id_ % 3 > 0, 41.0))
    file = F.concat(F.lit("img/venues/"), id_.cast("string"), F.lit(".jpg")).alias("file")
    photos, files = known.select(id_.alias("lid"), file, F.lit("Photo: Google").alias("attribution")), known.where(id_ % 2 == 0).select(file)
    rows = publish.venue_rows(licences, places, sites, photos, files)
    return rows.select("lid", "zone_id", "licence_type", "registry_name", "name", "named_by", "website", "lat", "lng", "geo_precision", F.col("photo.file").alias("photo"))


def one_per_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lid = lens(spark, sf_dir, "licence"), F.col("lid")
    hits = rows.select("lid", (lid % 3).alias("n_hits"))
    sites = rows.where(lid % 7 > 0).select("lid", F.when(lid % 5 > 0, F.concat(F.lit("node/"), (lid % 40).cast("string"))).otherwise("").alias("osm"))
    return resolve.one_per_element(hits, sites)


def quotes_to_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, id_ = lens(spark, sf_dir, "deal"), F.col("deal_id")
    hits = rows.select("lid", id_.alias("pos"), F.concat(F.lit("Special "), id_.cast("string"), F.lit(" at $"), (id_ % 9).cast("string")).alias("quote"))
    deals = rows.select("lid", F.when(id_ % 5 == 1, "auto_extract").otherwise("seed").alias("verified_by"), (id_ % 3).alias("n_items"))
    return crawl.quotes_to_price(hits, deals)


def quote_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotes(spark, sf_dir).select("k", validate.distinct_days(schedule.windows_from(F.col("quote"))).cast("long").alias("n_days"))


def rate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that a third of the submissions left, after the others."""
    rows = lens(spark, sf_dir, "submission")
    held = rows.where("id % 3 = 0").groupBy("ip_hash", "day").agg(F.count("*").alias("n"))
    return moderation.rate_counts(held, rows.where("id % 3 <> 0"), F.lit(_TODAY).cast("date"))


def article_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What articles, one for each order, say of the venue they name; of every fifth the zone is another, so it names none."""
    venues = lens(spark, sf_dir, "venue").select("lid", "zone_id", F.concat(F.lpad(F.col("lid").cast("string"), 9, "0"), F.lit(" Copper Kettle")).alias("name"))
    owner = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("lid"))
    said = _quotes(spark, sf_dir).join(owner, "k").join(venues, "lid")
    text = F.concat_ws("\n", F.lit("Top spots"), F.concat(F.lit("We like "), "name"), F.lit("HAPPY HOUR"), "items", "days", "hours", F.lit("Happy Birthday"), F.lit("Happy hour 4pm"))
    articles = said.select(F.lpad(F.col("k").cast("string"), 12, "0").alias("url"), F.when(F.col("k") % 5 == 0, "elsewhere").otherwise(F.col("zone_id")).alias("zone_id"), text.alias("text"))
    out = crawl.mentions(articles, venues).select("lid", F.posexplode("quotes").alias("pos", "quote"))
    return out.select("lid", F.col("pos").cast("long").alias("pos"), "quote")


def day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window a day of each offer's, the longest in whole hours; of equals the first by part."""
    clock = lambda c: F.concat(F.lpad(F.floor(F.col(c) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col(c) % 60).cast("string"), 2, "0"))
    rows = lens(spark, sf_dir, "window_").select("deal_id", "part_id", "supp_id", (F.col("dow") % 3 + 1).cast("int").alias("dow"), clock("start").alias("start"), clock("end").alias("end"))
    nested = rows.groupBy("deal_id").agg(F.sort_array(F.collect_list(F.struct("part_id", "supp_id", "dow", "start", "end"))).alias("w"))
    return nested.select("deal_id", F.explode(validate.one_a_day(F.col("w"))).alias("w")).select("deal_id", F.col("w.dow").cast("long").alias("dow"), "w.start", "w.end")


QUERIES = {f.__name__: f for f in (venue_rows, one_per_element, quotes_to_price, quote_days, rate_counts, article_mentions, day_windows)}
ORACLES = {
    "venue_rows": sql(f"""WITH t AS (SELECT lid, {_TYPE_SQL} AS licence_type FROM licence),
p AS (SELECT place_id * 3 AS lid, CASE WHEN place_id % 4 > 0 THEN place_name END AS name, website, CASE WHEN place_id % 5 > 0 THEN 40.0::DOUBLE + place_id / 1000.0::DOUBLE END AS lat, -75.0::DOUBLE - place_id / 1000.0::DOUBLE AS lng FROM place),
s AS (SELECT place_id * 2 AS lid, concat('Element ', place_id) AS name, concat('http://site', place_id) AS website, CASE WHEN place_id % 3 > 0 THEN 41.0::DOUBLE + place_id / 1000.0::DOUBLE END AS lat, -75.0::DOUBLE - place_id / 1000.0::DOUBLE AS lng FROM place),
f AS (SELECT place_id AS lid, concat('img/venues/', place_id, '.jpg') AS photo FROM place WHERE place_id % 2 = 0)
SELECT t.lid, v.zone_id, t.licence_type, concat('TAVERN ON THE HILL ', t.lid, ' LLC') AS registry_name, coalesce(p.name, s.name, concat('Tavern on the Hill ', t.lid)) AS name,
  CASE WHEN p.name IS NOT NULL THEN 'places' WHEN s.name IS NOT NULL THEN 'osm' ELSE 'registry' END AS named_by, coalesce(p.website, s.website) AS website, coalesce(p.lat, s.lat) AS lat,
  CASE WHEN p.lat IS NOT NULL THEN p.lng WHEN s.lat IS NOT NULL THEN s.lng END AS lng, CASE WHEN coalesce(p.lat, s.lat) IS NOT NULL THEN 'place' END AS geo_precision, f.photo
FROM t JOIN venue v ON v.lid = t.lid LEFT JOIN p ON p.lid = t.lid LEFT JOIN s ON s.lid = t.lid LEFT JOIN f ON f.lid = t.lid WHERE t.licence_type <> 'Brewery Storage'""", "licence", "venue", "place"),
    "one_per_element": sql("""WITH k AS (SELECT lid, lid % 3 AS n_hits, CAST(lid AS VARCHAR) AS said, CASE WHEN lid % 7 > 0 AND lid % 5 > 0 THEN concat('node/', lid % 40) ELSE concat('lid ', lid) END AS key FROM licence)
SELECT lid, n_hits, first_lid FROM (SELECT *, min(said) OVER (PARTITION BY key) AS first_lid, row_number() OVER (PARTITION BY key ORDER BY n_hits = 0, said) AS r FROM k) WHERE r = 1""", "licence"),
    "quotes_to_price": sql("""WITH t AS (SELECT lid, left(string_agg(concat('Special ', deal_id, ' at $', deal_id % 9), chr(10) ORDER BY deal_id), 2400) AS text FROM deal GROUP BY lid)
SELECT lid, text FROM t WHERE lid IN (SELECT lid FROM deal WHERE deal_id % 5 = 1 AND deal_id % 3 = 0)""", "deal"),
    "quote_days": f"WITH {_DAYS_SAID}, {_WINDOW_SAID} SELECT said.k, CASE WHEN ep IS NOT NULL AND s < e THEN len(list_distinct(days)) ELSE 0 END AS n_days FROM said JOIN u ON said.k = u.k",
    "rate_counts": sql(f"SELECT ip_hash, day, count(*) AS n FROM submission WHERE day >= DATE '{_TODAY}' GROUP BY ip_hash, day", "submission"),
    "article_mentions": f"""WITH l AS (SELECT k, o_custkey AS lid, concat('$', k % 9 + 2, CASE WHEN k % 2 = 0 THEN ' draft beers and chips' ELSE ' parking spots' END, ', $', k % 5 + 5, '.50 house wine') AS items,
  concat(k % 12 + 1, CASE WHEN k % 5 = 0 THEN ':30' ELSE '' END, CASE WHEN k % 3 = 0 THEN 'pm' ELSE '' END, ' - ', (k // 11) % 12 + 1, CASE WHEN k % 9 = 0 THEN '' WHEN k % 2 = 0 THEN ' pm' ELSE ' am' END) AS hours FROM {_K} JOIN orders ON k = o_orderkey WHERE k % 5 > 0),
q AS (SELECT lid, k, 0 AS p, concat('HAPPY HOUR / ', items, ' / ', hours) AS quote FROM l UNION ALL SELECT lid, k, 1, items FROM l WHERE k % 2 = 0), f AS (SELECT lid, quote, min(k * 2 + p) AS seen FROM q GROUP BY lid, quote)
SELECT lid, row_number() OVER (PARTITION BY lid ORDER BY seen) - 1 AS pos, quote FROM f""",
    "day_windows": sql("""WITH w AS (SELECT deal_id, part_id, supp_id, dow % 3 + 1 AS dow, "start", "end", concat(lpad(CAST("start" // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST("start" % 60 AS VARCHAR), 2, '0')) AS s,
  concat(lpad(CAST("end" // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST("end" % 60 AS VARCHAR), 2, '0')) AS e FROM window_)
SELECT deal_id, CAST(dow AS BIGINT) AS dow, s AS "start", e AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY deal_id, dow ORDER BY "end" // 60 - "start" // 60 DESC, part_id, supp_id, s, e) AS r FROM w) WHERE r = 1""", "window_"),
}
