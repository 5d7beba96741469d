"""Queries of the batch side: registry, resolution, validation, publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import ranking as R
from offerlens.functions import text as T
from offerlens.operators import publish, registry, resolve, validate
from offerlens.plans.feed_queries import _CONFIDENCE, _MILES
from offerlens.plans.lenses import lens, sql

ORIGIN, RADIUS = (40.089, -75.396), 20.0
LENS_TIERS = (("Restaurant", "Hotel"), ("Brewery",), ("Club",))
_TIER_SQL = "CASE WHEN licence_type IN ('Restaurant', 'Hotel') THEN 'core' WHEN licence_type = 'Brewery' THEN 'taproom' WHEN licence_type = 'Club' THEN 'club' END"


def _licences(spark: SparkSession, d: str) -> DataFrame:
    return lens(spark, d, "licence").withColumn("tier", registry.tier(F.col("licence_type"), *LENS_TIERS))


def _centroids(licences: DataFrame) -> DataFrame:
    """A gazetteer made of the ZIPs of every second licence, where the last row of a ZIP counts."""
    return licences.where("zip IS NOT NULL AND lid % 2 = 0 AND lid % 60 < 50").select("zip", F.col("lat").alias("zip_lat"), F.col("lng").alias("zip_lng"), F.col("lid").alias("ordinal"))


def _with_reasons(spark: SparkSession, d: str) -> DataFrame:
    licences = _licences(spark, d)
    rows = registry.located(licences.drop("lat", "lng"), _centroids(licences), ORIGIN)
    reason = registry.drop_reason(F.col("tier"), F.col("status"), F.col("nation") < 20, F.col("zip"), F.col("zip_lat"), F.col("miles"), RADIUS)
    return rows.withColumn("reason", reason)


_REASONS = f"""lic AS (SELECT *, {_TIER_SQL} AS tier FROM licence),
cen AS (SELECT zip, max_by(lat, lid) AS lat, max_by(lng, lid) AS lng FROM lic WHERE zip IS NOT NULL AND lid % 2 = 0 AND lid % 60 < 50 GROUP BY zip),
loc AS (SELECT l.* EXCLUDE (lat, lng), c.lat, c.lng FROM lic l LEFT JOIN cen c ON l.zip = c.zip),
reasons AS (SELECT *, CASE WHEN lower(coalesce(status, '')) <> 'active' THEN 'not active' WHEN tier = 'club' THEN 'private club' WHEN tier IS NULL THEN 'not on-premises'
  WHEN nation >= 20 THEN 'county out of scope' WHEN zip IS NULL THEN 'no zip' WHEN lat IS NULL THEN 'zip not in gazetteer' WHEN miles > 20.0 THEN 'outside radius' END AS reason
  FROM (SELECT *, {_MILES} AS miles FROM loc))"""


def registry_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each reason drops, most first."""
    counted = _with_reasons(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "reason")


def registry_zone_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_reasons(spark, sf_dir).where("reason IS NULL").withColumn("place", F.col("nation").cast("string"))
    by_place = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 3 > 0").select(F.col("n_nationkey").cast("string").alias("place"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("zone_id"))
    by_zip = rows.where("lid % 3 = 0").select("zip").distinct().select("zip", F.concat(F.lit("zip-"), "zip").alias("zone_id"))
    name = T.first_filled(F.col("premises"), F.col("licensee"))
    return registry.zoned(rows, by_place, by_zip).select("lid", name.alias("name"), "tier", "zone_id", R.tenths(F.col("miles")).alias("miles"))


def zone_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _licences(spark, sf_dir).where("tier IN ('core', 'taproom')")
    return registry.zone_counts(rows.withColumn("zone_id", F.when(F.col("nation") % 5 == 0, "").otherwise(F.concat(F.lit("z"), F.col("nation").cast("string")))))


def zone_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's report by zone: zones in their order under their names, then the sums."""
    k = F.col("nation")
    zone = F.when(k % 5 == 0, "").when(k == 7, "center_city").otherwise(F.concat(F.lit("z"), k.cast("string")))
    rows = _licences(spark, sf_dir).where("tier IN ('core', 'taproom')").withColumn("zone_id", zone)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey <> 4")
    zones = nations.select(F.when(F.col("n_nationkey") == 7, "center_city").otherwise(F.concat(F.lit("z"), F.col("n_nationkey").cast("string"))).alias("zone_id"), F.col("n_name").alias("name"), (100 - F.col("n_nationkey")).cast("int").alias("pos"))
    return registry.zone_report(rows, zones).select(F.col("line.part").cast("long").alias("part"), F.col("line.pos").cast("long").alias("pos"), "label", "n", "core", "taproom")


def _premises_lens(spark: SparkSession, d: str) -> DataFrame:
    rows = _licences(spark, d)
    return rows.select(
        "lid", F.concat(F.when(F.col("lid") % 2 == 0, "The Venue ").otherwise("THE venue "), (F.col("lid") % 300).cast("string")).alias("name"),
        F.concat((F.col("lid") % 300).cast("string"), F.lit(" Main St")).alias("address"), F.concat(F.lit("z"), F.col("nation").cast("string")).alias("zone_id"),
        F.concat(F.lit("L-"), F.col("lid").cast("string")).alias("number"), F.coalesce("tier", F.lit("none")).alias("tier"),
    )


def premises_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.premises(_premises_lens(spark, sf_dir))


def premises_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens(spark, sf_dir, "venue").select("lid", (F.col("lid") % 300).alias("premises_key"), (F.col("balance") > 5000).alias("has_photo"), (F.col("lid") % 3 == 0).alias("has_site"), (F.col("lid") % 7 > 0).alias("has_lat"))
    out = registry.collapsed(rows)
    return out.select("premises_key", "lid", F.array_join(F.transform("also_lids", lambda x: x.cast("string")), "|").alias("also_lids"), F.size("also_lids").cast("long").alias("n_also"))


def _resolution(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _licences(spark, d)
    licences = rows.select(
        "lid", T.first_filled(F.col("premises"), F.col("licensee")).alias("name"), "zip", F.regexp_extract("street", r"^(\d+)", 1).alias("number"),
        T.street_core(F.regexp_replace(F.regexp_replace("street", r"^\d+\s+", ""), r" STE \d+$", "")).alias("core"), resolve.localities(F.col("nation").cast("string"), F.col("zip")).alias("localities"),
    ).withColumn("lic_core", T.name_core(F.col("name")))
    places = lens(spark, d, "place")
    elements = resolve.keyed_elements(places.withColumn("localities", resolve.localities(F.col("nation").cast("string"), F.col("zip"))))
    return licences, elements


def tiered_site_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.tiered_match(*_resolution(spark, sf_dir))


def shared_element_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    licences, elements = _resolution(spark, sf_dir)
    return resolve.collapse_shared(resolve.tiered_match(licences, elements), licences, elements)


def site_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    licences, elements = _resolution(spark, sf_dir)
    new = resolve.tiered_match(licences, elements)
    old = licences.where("lid % 4 = 0").select("lid", F.lit(-1).cast("long").alias("place_id"), F.when(F.col("lid") % 8 == 0, "guessed: host").otherwise("address").alias("matched_by"))
    return resolve.carry_over(new, old)


def address_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens(spark, sf_dir, "licence")
    address = F.concat(F.when(F.col("lid") % 3 == 0, "RIDGE CENTER STORES 15 & 16  ").otherwise(""), "street", F.lit(", NORRISTOWN PA "), F.coalesce("zip", F.lit("none")))
    keyed = rows.select("lid", address.alias("address")).withColumn("k", T.registry_key(F.col("address")))
    return keyed.select("lid", "k.zip", "k.number", "k.core", T.address_signature(F.col("address")).alias("signature"))


def street_and_name_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens(spark, sf_dir, "place")
    return rows.select("place_id", T.street_core(F.col("street")).alias("street_core"), T.name_core(F.concat(F.lit("The "), "place_name", F.lit(" Brewing & Co."))).alias("name_core"))


def place_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    licences = lens(spark, sf_dir, "licence").select("lid", "premises", F.concat("street", F.lit(", NORRISTOWN PA "), F.coalesce("zip", F.lit(""))).alias("address"), F.col("lid").alias("k"))
    places = lens(spark, sf_dir, "place").select("place_id", "place_name", F.concat("number", F.lit(" "), "street", F.lit(", Norristown PA "), "zip").alias("place_address"), F.col("place_id").alias("k"))
    pairs = licences.join(places, "k").select("lid", F.col("premises").alias("name"), "address", "place_id", "place_name", "place_address")
    return resolve.acceptance(pairs).select("lid", "place_id", F.coalesce("matched_by", F.lit("rejected")).alias("matched_by"))


def merge_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens(spark, sf_dir, "licence").select("lid")
    sites = rows.where("lid % 3 = 0").select("lid", F.concat(F.lit("http://s"), F.col("lid").cast("string")).alias("website"), F.lit("address").alias("matched_by"))
    places = rows.select(
        "lid", F.when(F.col("lid") % 5 > 0, F.concat(F.lit("http://p"), F.col("lid").cast("string"))).alias("website"),
        F.when(F.col("lid") % 4 == 0, "street number").when(F.col("lid") % 4 == 1, "name + ZIP").when(F.col("lid") % 4 == 2, "nearby search at the geocode").alias("matched_by"),
    )
    return resolve.merge_frontier(sites, places, rows.where("lid % 50 = 1"))


def deal_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.flat_errors(lens(spark, sf_dir, "deal"), lens(spark, sf_dir, "window_"), lens(spark, sf_dir, "item"))
    return checked.select("deal_id", "type", F.coalesce("first_error", F.lit("ok")).alias("verdict"), F.col("most_in_a_day").cast("long").alias("most_in_a_day"), F.col("in_a_week").cast("long").alias("in_a_week"))


def deal_reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deal_validation(spark, sf_dir).groupBy("type", "verdict").agg(F.count("*").alias("n"))


def combo_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the cap of two a day; some offers have a second window on a day."""
    windows = lens(spark, sf_dir, "window_").select("deal_id", "dow", "supp_id")
    return validate.combo_cap(lens(spark, sf_dir, "deal"), windows.union(windows.where("supp_id % 3 = 0"))).select("deal_id", "lid", "type")


def offer_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All broken rules of offers as they are published: nested windows, items and source."""
    at = lambda c: F.format_string("%02d:%02d", F.floor(F.col(c) / 60).cast("int"), (F.col(c) % 60).cast("int"))
    windows = lens(spark, sf_dir, "window_").withColumn("end", F.when(F.col("supp_id") % 50 == 0, F.col("end") + 480).otherwise(F.col("end")))
    nested = windows.groupBy("deal_id").agg(F.collect_list(F.struct(F.col("dow").cast("int").alias("dow"), at("start").alias("start"), F.when(F.col("supp_id") % 51 == 0, "late").otherwise(at("end")).alias("end"))).alias("windows"))
    items = lens(spark, sf_dir, "item").groupBy("deal_id").agg(
        F.collect_list(F.struct("category", F.when(F.col("part_id") % 40 == 0, "Two for one").otherwise("plain").alias("label"), F.col("price").alias("price_usd"), F.col("pct").alias("discount_pct"), F.col("off").alias("amount_off_usd"))).alias("items")
    )
    k = F.col("deal_id")
    source = F.struct(
        F.when(k % 4 == 0, "venue_site").when(k % 4 == 1, "roundup").when(k % 4 == 2, "photo").otherwise("hearsay").alias("kind"), F.when(k % 9 > 0, "http://x").alias("url"), F.when(k % 27 == 0, "p").alias("photo_id"),
        F.when(k % 8 == 1, "Paper").alias("outlet"), F.when(k % 5 == 0, "May 2001").otherwise("2001-05-01").alias("published"),
    )
    rows = lens(spark, sf_dir, "deal").join(nested, "deal_id", "left").join(items, "deal_id", "left")
    fine = F.when(k % 13 == 0, "Bottomless mimosas").otherwise("Bar only")
    kind = F.when(k % 31 == 0, "raffle").otherwise(F.col("type"))
    return rows.select("deal_id", F.array_join(validate.deal_errors(kind, F.col("confidence"), F.col("windows"), F.col("items"), fine, source), "; ").alias("errors"))


def extracted_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each offer of a venue as one quote of its site: the quotes' windows together, or else those of the richest."""
    at = lambda c: F.format_string("%02d:%02d", F.floor(F.col(c) / 60).cast("int"), (F.col(c) % 60).cast("int"))
    windows = lens(spark, sf_dir, "window_").groupBy("deal_id").agg(F.sort_array(F.collect_list(F.struct(F.col("dow").cast("int").alias("dow"), at("start").alias("start"), at("end").alias("end")))).alias("windows"))
    hits = lens(spark, sf_dir, "deal").join(windows, "deal_id").select("lid", F.col("deal_id").alias("pos"), F.concat(F.lit("Happy hour, "), "priority").alias("quote"), F.lit("http://x").alias("url"), "windows")
    out = validate.extracted(hits)
    days = F.array_join(F.transform("windows", lambda w: F.concat(w["dow"].cast("string"), F.lit(" "), w["start"], F.lit("-"), w["end"])), ", ")
    return out.select("lid", F.col("lead.pos").alias("lead"), days.alias("windows"), F.coalesce(F.try_element_at("errors", F.lit(1)), F.lit("ok")).alias("verdict"))


def _sources(spark: SparkSession, d: str) -> list[DataFrame]:
    """A person's reading of a fifth of the offers, photos of another, and the crawl's of all; some are of premises that no venue has."""
    lost = F.col("deal_id") % 97 == 0
    rows = lens(spark, d, "deal").select(
        F.col("deal_id").alias("id"), F.when(lost, -F.col("deal_id")).otherwise(F.col("lid")).alias("lid"), F.when(lost, -F.col("deal_id")).otherwise(F.col("deal_id") % 4000).alias("addr"), F.col("confidence")
    )
    return [rows.where(f"id % 5 = {k}").withColumn("source", F.lit(n)) for k, n in ((0, "seed"), (1, "photo"))] + [rows.withColumn("source", F.lit("extracted"))]


def priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.priority_union(*_sources(spark, sf_dir)).select("id", "lid", "addr", "source")


def _base(spark: SparkSession, d: str) -> DataFrame:
    """All venues; every third holds the licence after its own as well."""
    also = F.when(F.col("lid") % 3 == 0, F.array(F.col("lid") + 1)).otherwise(F.array().cast("array<bigint>"))
    return lens(spark, d, "venue").select("lid", "zone_id", "name", also.alias("also_lids"), (F.col("lid") % 4000).alias("addr"))


def canonical_lid(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = publish.priority_union(*_sources(spark, sf_dir))
    return publish.canonical(deals, _base(spark, sf_dir)).select("id", "lid", "canonical")


def _board(spark: SparkSession, d: str) -> DataFrame:
    return publish.board(_base(spark, d), publish.canonical(publish.priority_union(*_sources(spark, d)), _base(spark, d)))


def board_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.bundle_order(_board(spark, sf_dir)).select("key", "zone_id", "name", "n_deals")


def zone_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.zone_index(_board(spark, sf_dir))


def price_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = lens(spark, sf_dir, "deal").select(
        "deal_id", (F.col("deal_id") % 700).alias("slug"), F.when(F.col("deal_id") % 2 == 0, "auto_extract").otherwise("staff").alias("verified_by"),
        F.when(F.col("deal_id") % 3 == 0, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>")).alias("items"),
    )
    prices = spark.range(0, 400).select(F.col("id").alias("slug"), F.array(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("items"))
    return publish.with_prices(deals, prices).select("deal_id", F.array_join("items", ",").alias("items"), "items_source")


def coordinate_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens(spark, sf_dir, "venue")
    current = rows.where("lid % 10 > 0").select(F.col("lid").alias("id"), F.concat(F.lit("a"), (F.col("lid") % 7).cast("string")).alias("queried"), "lat", "lng", F.lit("auto").alias("matched_by"))
    cache = rows.where("lid % 2 = 0").select(
        F.col("lid").alias("id"), F.concat(F.lit("a"), (F.col("lid") % 5).cast("string")).alias("queried"), F.lit(0.5).alias("lat"), F.lit(0.25).alias("lng"),
        F.when(F.col("lid") % 6 == 0, "hand").otherwise("auto").alias("matched_by"),
    )
    return publish.refreshed(cache, current).select("id", "queried", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"), "matched_by")


def slug_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens(spark, sf_dir, "venue").select("lid", F.concat(F.lit("Joe's Bar & Grill #"), (F.col("lid") % 90).cast("string")).alias("name"), F.concat(F.lit("King of "), F.col("zone_id")).alias("city"))
    return registry.slugged(rows).select("lid", "slug")


def hue_and_cache_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens(spark, sf_dir, "venue")
    return rows.select(
        "lid", T.hue(F.col("name")).cast("long").alias("hue"), T.monogram(F.col("name")).alias("monogram"), T.salted_hash("salt", F.col("name")).alias("hashed"),
        publish.cache_name(F.lit("2001-08-03"), F.col("lid"), F.col("name")).alias("cache"),
    )


def coverage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_reasons(spark, sf_dir)
    return rows.agg(
        F.count("*").alias("n"), F.count("zip").alias("with_zip"), F.count("zip_lat").alias("located"), F.count(T.blank_to_null(F.col("premises"))).alias("named"), F.countDistinct("nation").alias("counties"),
    )


def stage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.flat_errors(lens(spark, sf_dir, "deal"), lens(spark, sf_dir, "window_"), lens(spark, sf_dir, "item"))
    shown = R.effective_confidence(F.col("confidence"), F.col("age_days"))
    stage = F.when(F.col("in_a_week").isNull(), "1 no schedule").when(F.col("first_error").isNotNull(), "2 rejected").when(shown.isin("hidden", "disputed"), "3 decayed").otherwise("4 published")
    return checked.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        registry_drop_reasons, registry_zone_assign, zone_tier_counts, zone_report, premises_dedupe, premises_collapse, tiered_site_join, shared_element_collapse, site_carry_over, address_keys,
        street_and_name_cores, place_acceptance, merge_frontier, deal_validation, deal_reject_summary, combo_cap, offer_errors, extracted_schedules, priority_union, canonical_lid, board_full_outer, zone_index, price_fill,
        coordinate_refresh, slug_collisions, hue_and_cache_names, coverage_counters, stage_funnel,
    )
}

_CORE = """CASE {0} WHEN 'West Ridge Pk' THEN 'ridge' WHEN 'Main St' THEN 'main' WHEN 'North Spring Mill Avenue' THEN 'spring mill' WHEN 'Market Square' THEN 'market'
  WHEN 'W Ridge Pike' THEN 'ridge' WHEN 'MAIN STREET' THEN 'main' WHEN 'N Spring Mill Ave' THEN 'spring mill' WHEN 'Market Sq' THEN 'market' END""".format
_RES = f"""lic AS (SELECT lid, name, zip, number, {_CORE("regexp_replace(regexp_replace(street, '^[0-9]+ ', ''), ' STE [0-9]+$', '')")} AS core, nation AS locality,
   CASE WHEN name LIKE 'HOLDCO %' THEN concat('holdco ', lid) ELSE concat('tap room ', lid % 400) END AS lic_core
   FROM (SELECT *, coalesce(nullif(premises, ''), licensee) AS name, regexp_extract(street, '^([0-9]+)', 1) AS number FROM licence)),
el AS (SELECT *, {_CORE('street')} AS core, nation AS locality, lower(place_name) AS place_core FROM place),
t1 AS (SELECT zip, number, core, arg_min(place_id, struct_pack(a := website IS NULL, b := place_id)) AS id FROM el GROUP BY ALL),
t2 AS (SELECT number, core, min(place_id) AS id FROM el GROUP BY ALL HAVING count(*) = 1),
ll AS (SELECT lid, lic_core, 0 AS pos, concat('city ', locality) AS loc FROM lic UNION ALL SELECT lid, lic_core, 1, concat('zip ', zip) FROM lic WHERE zip IS NOT NULL),
t3 AS (SELECT loc, place_core, min(place_id) AS id FROM (SELECT *, concat('city ', locality) AS loc FROM el UNION ALL SELECT *, concat('zip ', zip) FROM el) GROUP BY ALL HAVING count(*) = 1),
m3 AS (SELECT loc, lic_core FROM ll GROUP BY ALL HAVING count(*) = 1),
n3 AS (SELECT lid, arg_min(t3.id, pos) AS id FROM ll JOIN m3 USING (loc, lic_core) JOIN t3 ON t3.loc = ll.loc AND t3.place_core = ll.lic_core GROUP BY lid),
matches AS (SELECT lid, place_id, matched_by FROM (SELECT l.lid, coalesce(t1.id, t2.id, n3.id) AS place_id,
    CASE WHEN t1.id IS NOT NULL THEN 'address' WHEN t2.id IS NOT NULL THEN 'number+street' ELSE 'name' END AS matched_by
  FROM lic l LEFT JOIN t1 USING (zip, number, core) LEFT JOIN t2 ON l.number = t2.number AND l.core = t2.core
  LEFT JOIN n3 ON l.lid = n3.lid) WHERE place_id IS NOT NULL)"""
_CAPS = """caps AS (SELECT deal_id, max(m) AS most_in_a_day, sum(m) AS in_a_week FROM (SELECT deal_id, dow, sum("end" - "start") AS m FROM window_ WHERE "end" <= 1440 AND "end" > "start" AND dow BETWEEN 1 AND 7 GROUP BY ALL) GROUP BY deal_id),
flaws AS (SELECT deal_id, bool_or(category = 'novelty') AS bad_category, bool_or(price IS NULL AND pct IS NULL AND off IS NULL) AS bare FROM item GROUP BY deal_id),
checked AS (SELECT d.*, c.most_in_a_day, c.in_a_week, CASE WHEN c.in_a_week IS NULL THEN 'no windows' WHEN type = 'happy_hour' AND most_in_a_day > 240 THEN 'exceeds the 4h/day cap'
  WHEN type = 'happy_hour' AND in_a_week > 1440 THEN 'exceeds the 24h/week cap' WHEN bad_category THEN 'unknown item category' WHEN bare THEN 'item has neither a price nor a discount' END AS first_error
  FROM deal d LEFT JOIN caps c ON d.deal_id = c.deal_id LEFT JOIN flaws f ON d.deal_id = f.deal_id)"""
_UNION = """src AS (SELECT deal_id AS id, CASE WHEN deal_id % 97 = 0 THEN -deal_id ELSE lid END AS lid, CASE WHEN deal_id % 97 = 0 THEN -deal_id ELSE deal_id % 4000 END AS addr FROM deal),
seed AS (SELECT *, 'seed' AS source FROM src WHERE id % 5 = 0),
photo AS (SELECT *, 'photo' AS source FROM src WHERE id % 5 = 1 AND id NOT IN (SELECT id FROM seed) AND addr NOT IN (SELECT addr FROM seed)),
one AS (SELECT * FROM seed UNION ALL SELECT * FROM photo),
merged AS (SELECT * FROM one UNION ALL SELECT *, 'extracted' FROM src WHERE id NOT IN (SELECT id FROM one) AND addr NOT IN (SELECT addr FROM one))"""
_CANON = _UNION + """,
base AS (SELECT lid, zone_id, name, lid % 4000 AS addr FROM venue),
own AS (SELECT l, min(c) AS c FROM (SELECT lid AS l, lid AS c FROM base UNION ALL SELECT lid + 1, lid FROM base WHERE lid % 3 = 0) GROUP BY l),
byaddr AS (SELECT addr, min(lid) AS c FROM base GROUP BY addr),
canon AS (SELECT m.id, m.lid, coalesce(o.c, a.c) AS canonical FROM merged m LEFT JOIN own o ON m.lid = o.l LEFT JOIN byaddr a ON m.addr = a.addr),
counted AS (SELECT key, max(n) AS n FROM (SELECT coalesce(CAST(canonical AS VARCHAR), concat('orphan:', id)) AS key, lid, count(*) AS n FROM canon GROUP BY ALL) GROUP BY key),
board AS (SELECT coalesce(CAST(b.lid AS VARCHAR), c.key) AS key, b.zone_id, b.name, coalesce(c.n, 0) AS n_deals FROM base b FULL JOIN counted c ON CAST(b.lid AS VARCHAR) = c.key)"""

ORACLES = {
    "registry_drop_reasons": sql(f"WITH {_REASONS} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasons GROUP BY 1", "licence"),
    "registry_zone_assign": sql(f"""WITH {_REASONS}, kept AS (SELECT * FROM reasons WHERE reason IS NULL), z AS (SELECT DISTINCT zip FROM kept WHERE lid % 3 = 0)
SELECT k.lid, coalesce(nullif(premises, ''), licensee) AS name, tier, coalesce(concat('r', n.n_regionkey), concat('zip-', z.zip), '') AS zone_id, round(miles, 1) AS miles
FROM kept k LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) n ON k.nation = n.n_nationkey LEFT JOIN z ON k.zip = z.zip""".replace("coalesce(concat('r', n.n_regionkey), concat('zip-', z.zip), '')", "CASE WHEN n.n_regionkey IS NOT NULL THEN concat('r', n.n_regionkey) WHEN z.zip IS NOT NULL THEN concat('zip-', z.zip) ELSE '' END"), "licence"),
    "zone_tier_counts": sql(f"""SELECT CASE WHEN grouping(zone) = 1 THEN '(total)' ELSE zone END AS zone, count(*) AS n, count(*) FILTER (tier = 'core') AS n_core, count(*) FILTER (tier = 'taproom') AS n_taproom
FROM (SELECT {_TIER_SQL} AS tier, CASE WHEN nation % 5 = 0 THEN '(unzoned)' ELSE concat('z', nation) END AS zone FROM licence) WHERE tier IN ('core', 'taproom') GROUP BY ROLLUP (zone)""", "licence"),
    "zone_report": sql(f"""WITH r AS (SELECT CASE WHEN nation % 5 = 0 THEN '(unzoned)' WHEN nation = 7 THEN 'center_city' ELSE concat('z', nation) END AS zone, {_TIER_SQL} = 'core' AS core FROM licence WHERE {_TIER_SQL} IN ('core', 'taproom')),
z AS (SELECT CASE WHEN n_nationkey = 7 THEN 'center_city' ELSE concat('z', n_nationkey) END AS zone, n_name, 100 - n_nationkey AS pos FROM nation WHERE n_nationkey <> 4),
c AS (SELECT zone, count(*) AS n, count(*) FILTER (core) AS core FROM r GROUP BY zone)
SELECT CASE WHEN zone = '(unzoned)' THEN 1 ELSE 0 END::BIGINT AS part, coalesce(pos, 0)::BIGINT AS pos, concat(coalesce(n_name, zone), CASE WHEN zone = 'center_city' THEN ' *' ELSE '' END) AS label, n, core, n - core AS taproom FROM c LEFT JOIN z USING (zone) WHERE pos IS NOT NULL OR zone = '(unzoned)'
UNION ALL SELECT 2, 0, 'in a named zone', count(*), count(*) FILTER (core), count(*) FILTER (NOT core) FROM r WHERE zone <> '(unzoned)' UNION ALL SELECT 3, 0, 'total', count(*), count(*) FILTER (core), count(*) FILTER (NOT core) FROM r""", "licence"),
    "premises_dedupe": sql(f"""WITH p AS (SELECT lid, concat(CASE WHEN lid % 2 = 0 THEN 'The Venue ' ELSE 'THE venue ' END, lid % 300) AS name, concat(lid % 300, ' Main St') AS address, concat('z', nation) AS zone_id, concat('L-', lid) AS number, coalesce({_TIER_SQL}, 'none') AS tier FROM licence)
SELECT min(lid) AS lid, min_by(name, lid) AS name, min_by(address, lid) AS address, min_by(zone_id, lid) AS zone_id, string_agg(number, '|' ORDER BY lid) AS numbers, CASE WHEN bool_or(tier = 'core') THEN 'core' ELSE min_by(tier, lid) END AS tier
FROM p GROUP BY lower(trim(name)), lower(trim(address))""", "licence"),
    "premises_collapse": sql("""WITH r AS (SELECT *, lid % 300 AS premises_key, row_number() OVER (PARTITION BY lid % 300 ORDER BY balance > 5000 DESC, lid % 3 = 0 DESC, lid % 7 > 0 DESC, lid) AS k FROM venue)
SELECT premises_key, min(lid) FILTER (k = 1) AS lid, coalesce(string_agg(CAST(lid AS VARCHAR), '|' ORDER BY lid) FILTER (k > 1), '') AS also_lids, count(*) - 1 AS n_also FROM r GROUP BY premises_key""", "venue"),
    "tiered_site_join": sql(f"WITH {_RES} SELECT * FROM matches", "licence", "place"),
    "shared_element_collapse": sql(f"""WITH {_RES}, claims AS (SELECT place_id, count(*) AS n FROM matches GROUP BY place_id)
SELECT m.lid, m.place_id, m.matched_by FROM matches m JOIN claims c USING (place_id) JOIN lic USING (lid) JOIN el USING (place_id)
WHERE c.n < 2 OR len(list_intersect(string_split(lic.lic_core, ' '), string_split(el.place_core, ' '))) > 0""".replace("CASE WHEN name LIKE 'HOLDCO %' THEN concat('holdco ', lid)", "CASE WHEN name LIKE 'HOLDCO %' THEN concat('holdco ', lid)"), "licence", "place"),
    "site_carry_over": sql(f"WITH {_RES} SELECT * FROM matches UNION ALL SELECT lid, -1, 'guessed: host' FROM lic WHERE lid % 8 = 0 AND lid NOT IN (SELECT lid FROM matches)", "licence", "place"),
    "address_keys": sql(f"""WITH a AS (SELECT lid, zip, regexp_extract(street, '^([0-9]+)', 1) AS number, {_CORE("regexp_replace(regexp_replace(street, '^[0-9]+ ', ''), ' STE [0-9]+$', '')")} AS core,
  concat(CASE WHEN lid % 3 = 0 THEN 'RIDGE CENTER STORES 15 & 16  ' ELSE '' END, street, ', NORRISTOWN PA ', coalesce(zip, 'none')) AS address FROM licence)
SELECT lid, zip, CASE WHEN zip IS NOT NULL THEN number END AS number, CASE WHEN zip IS NOT NULL THEN core END AS core,
  concat(CASE WHEN regexp_extract(address, '^\\s*([0-9]+)', 1) = '' THEN '?' ELSE regexp_extract(address, '^\\s*([0-9]+)', 1) END, '|', coalesce(zip, '?')) AS signature FROM a""", "licence"),
    "street_and_name_cores": sql(f"SELECT place_id, {_CORE('street')} AS street_core, lower(place_name) AS name_core FROM place", "place"),
    "place_acceptance": sql("""WITH j AS (SELECT l.lid, p.place_id, l.premises, l.zip AS lz, p.zip AS pz, p.place_name, regexp_extract(l.street, '^([0-9]+)', 1) AS ours, p.number AS theirs FROM licence l JOIN place p ON l.lid = p.place_id)
SELECT lid, place_id, CASE WHEN ours = theirs THEN 'street number' WHEN premises <> '' AND lz = pz THEN 'name + ZIP' ELSE 'rejected' END AS matched_by FROM j""", "licence", "place"),
    "merge_frontier": sql("""WITH s AS (SELECT lid, concat('http://s', lid) AS website, 'address' AS matched_by FROM licence WHERE lid % 3 = 0)
SELECT * FROM s UNION ALL SELECT lid, concat('http://p', lid), CASE WHEN lid % 4 = 0 THEN 'street number' ELSE 'name + ZIP' END FROM licence WHERE lid % 4 < 2 AND lid % 5 > 0 AND lid % 3 > 0 AND lid % 50 <> 1""", "licence"),
    "deal_validation": sql(f"WITH {_CAPS} SELECT deal_id, type, coalesce(first_error, 'ok') AS verdict, CAST(most_in_a_day AS BIGINT) AS most_in_a_day, CAST(in_a_week AS BIGINT) AS in_a_week FROM checked", "deal", "window_", "item"),
    "deal_reject_summary": sql(f"WITH {_CAPS} SELECT type, coalesce(first_error, 'ok') AS verdict, count(*) AS n FROM checked GROUP BY ALL", "deal", "window_", "item"),
    "combo_cap": sql("""WITH w AS (SELECT deal_id, dow FROM window_ UNION ALL SELECT deal_id, dow FROM window_ WHERE supp_id % 3 = 0),
over_cap AS (SELECT lid FROM deal JOIN w USING (deal_id) WHERE type = 'food_combo' GROUP BY lid, dow HAVING count(*) > 2) SELECT deal_id, lid, type FROM deal WHERE lid NOT IN (SELECT lid FROM over_cap)""", "deal", "window_"),
    "offer_errors": sql("""WITH w AS (SELECT deal_id, dow, "start" AS s, CASE WHEN supp_id % 50 = 0 THEN "end" + 480 ELSE "end" END AS e, supp_id % 51 = 0 AS bad FROM window_),
day AS (SELECT deal_id, dow, sum(e - s) AS m FROM w WHERE NOT bad AND e <= 1440 GROUP BY ALL),
wd AS (SELECT deal_id, bool_or(bad) AS bad, bool_or(NOT bad AND e > 1440) AS past FROM w GROUP BY deal_id),
cap AS (SELECT deal_id, max(m) AS most, sum(m) AS week FROM day GROUP BY deal_id),
i AS (SELECT deal_id, bool_or(category = 'novelty') AS odd, bool_or(price IS NULL AND pct IS NULL AND off IS NULL) AS bare, bool_or(part_id % 40 = 0) AS two FROM item GROUP BY deal_id)
SELECT d.deal_id, array_to_string(list_filter([
  CASE WHEN d.deal_id % 31 = 0 THEN 'unknown deal type' END, CASE WHEN wd.deal_id IS NULL THEN 'no windows' END, CASE WHEN wd.bad THEN 'malformed window' END, CASE WHEN wd.past THEN 'window extends past midnight' END,
  CASE WHEN d.deal_id % 31 > 0 AND type = 'happy_hour' AND most > 240 THEN 'exceeds the 4h/day cap' END, CASE WHEN d.deal_id % 31 > 0 AND type = 'happy_hour' AND week > 1440 THEN 'exceeds the 24h/week cap' END,
  CASE WHEN d.deal_id % 13 = 0 THEN 'unlawful claim: bottomless' END, CASE WHEN i.two THEN 'unlawful claim: two for one|2 for 1|2-for-1' END, CASE WHEN i.odd THEN 'unknown item category' END,
  CASE WHEN i.bare THEN 'item has neither a price nor a discount' END, CASE WHEN d.deal_id % 9 = 0 AND d.deal_id % 27 > 0 THEN 'no source' END, CASE WHEN d.deal_id % 4 = 3 THEN 'unknown source kind' END,
  CASE WHEN d.deal_id % 4 = 1 AND d.deal_id % 8 <> 1 THEN 'roundup must name who said it' END, CASE WHEN d.deal_id % 4 = 1 AND d.deal_id % 5 = 0 THEN 'roundup recency cannot be gated' END,
  CASE WHEN d.deal_id % 4 = 1 AND confidence <> 'unconfirmed' THEN 'roundup caps at unconfirmed' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM deal d LEFT JOIN wd ON d.deal_id = wd.deal_id LEFT JOIN cap ON d.deal_id = cap.deal_id LEFT JOIN i ON d.deal_id = i.deal_id""", "deal", "window_", "item"),
    "extracted_schedules": sql("""WITH q AS (SELECT d.lid, d.deal_id, count(DISTINCT w.dow) AS days, any_value(length(d.priority)) AS n FROM deal d JOIN window_ w ON d.deal_id = w.deal_id GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY days DESC, n DESC, deal_id) AS k FROM q),
p AS (SELECT o.lid, o.k, o.deal_id, w.dow, w."start" AS s, w."end" AS e, w."end" // 60 - w."start" // 60 AS span FROM o JOIN window_ w ON o.deal_id = w.deal_id),
pooled AS (SELECT *, row_number() OVER (PARTITION BY lid, dow ORDER BY span DESC, k, s, e) AS r FROM p), lead_ AS (SELECT *, row_number() OVER (PARTITION BY lid, dow ORDER BY span DESC, s, e) AS r FROM p WHERE k = 1),
t AS (SELECT lid, sum(e - s) AS pooled FROM pooled WHERE r = 1 GROUP BY lid), u AS (SELECT lid, any_value(deal_id) AS lead, sum(e - s) AS own FROM lead_ WHERE r = 1 GROUP BY lid),
c AS (SELECT lid, lead, pooled > 1440 AS back, pooled > 1440 AND own > 1440 AS bad FROM t JOIN u USING (lid)),
w AS (SELECT lid, dow, s, e, false AS back FROM pooled WHERE r = 1 UNION ALL SELECT lid, dow, s, e, true FROM lead_ WHERE r = 1)
SELECT c.lid, c.lead, string_agg(concat(dow, ' ', lpad(CAST(s // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(s % 60 AS VARCHAR), 2, '0'), '-', lpad(CAST(e // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(e % 60 AS VARCHAR), 2, '0')), ', ' ORDER BY dow) AS windows,
  CASE WHEN any_value(bad) THEN 'exceeds the 24h/week cap' ELSE 'ok' END AS verdict FROM c JOIN w ON c.lid = w.lid AND c.back = w.back GROUP BY c.lid, c.lead""", "deal", "window_"),
    "priority_union": sql(f"WITH {_UNION} SELECT * FROM merged", "deal"),
    "canonical_lid": sql(f"WITH {_CANON} SELECT * FROM canon", "deal", "venue"),
    "board_full_outer": sql(f"WITH {_CANON} SELECT * FROM board", "deal", "venue"),
    "zone_index": sql(f"WITH {_CANON} SELECT zone_id, count(*) AS venues, count(*) FILTER (n_deals > 0) AS with_deals, CAST(sum(n_deals) AS BIGINT) AS deals FROM board GROUP BY zone_id", "deal", "venue"),
    "price_fill": sql("""SELECT deal_id, CASE WHEN deal_id % 3 = 0 THEN 'own' WHEN deal_id % 2 = 0 AND deal_id % 700 < 400 THEN concat('p', deal_id % 700) ELSE '' END AS items,
  CASE WHEN deal_id % 3 > 0 AND deal_id % 2 = 0 AND deal_id % 700 < 400 THEN 'llm_extract' END AS items_source FROM deal""", "deal"),
    "coordinate_refresh": sql("""SELECT lid AS id, CASE WHEN take THEN concat('a', lid % 7) ELSE concat('a', lid % 5) END AS queried, CASE WHEN take THEN round(lat, 4) ELSE 0.5::DOUBLE END AS lat, CASE WHEN take THEN round(lng, 4) ELSE 0.25::DOUBLE END AS lng,
  CASE WHEN take THEN 'auto' WHEN lid % 6 = 0 THEN 'hand' ELSE 'auto' END AS matched_by FROM (SELECT *, lid % 2 = 1 OR (lid % 6 > 0 AND lid % 5 <> lid % 7) AS take FROM venue WHERE lid % 10 > 0)""", "venue"),
    "slug_collisions": sql("""SELECT lid, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY lid) = 1 THEN base ELSE concat(base, '-', lid) END AS slug FROM (SELECT lid, concat('joe-s-bar-grill-', lid % 90, '-king-of-', zone_id) AS base FROM venue)""", "venue"),
    "hue_and_cache_names": sql("""SELECT lid, CAST(list_reduce(list_prepend(0, list_transform(string_split(name, ''), lambda c: ascii(c))), lambda h, c: (h * 31 + c) % 360) AS BIGINT) AS hue, upper(regexp_extract(name, '([A-Za-z0-9])', 1)) AS monogram,
  sha256(concat('salt:', name)) AS hashed, concat('board-2001-08-03-', lid, '-', substr(sha256(name), 1, 8)) AS cache FROM venue""", "venue"),
    "coverage_counters": sql(f"WITH {_REASONS} SELECT count(*) AS n, count(zip) AS with_zip, count(lat) AS located, count(nullif(premises, '')) AS named, count(DISTINCT nation) AS counties FROM reasons", "licence"),
    "stage_funnel": sql(f"""WITH {_CAPS} SELECT CASE WHEN in_a_week IS NULL THEN '1 no schedule' WHEN first_error IS NOT NULL THEN '2 rejected' WHEN {_CONFIDENCE} IN ('hidden', 'disputed') THEN '3 decayed' ELSE '4 published' END AS stage, count(*) AS n FROM checked GROUP BY 1""", "deal", "window_", "item"),
}
