"""Queries of display choices, fallbacks and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import text as T
from offerlens.operators import lookup, registry
from offerlens.plans.lenses import lens, sql


def geocode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    venues = lens(spark, sf_dir, "venue").select("lid", F.concat((F.col("lid") % 50).cast("string"), F.lit("-9"), F.lit(" Main St, Town"), (F.col("lid") % 9).cast("string"), F.lit(" PA 1910"), (F.col("lid") % 9).cast("string")).alias("address"))
    full = lens(spark, sf_dir, "venue").where("lid % 4 = 0").select(F.concat((F.col("lid") % 50).cast("string"), F.lit(" Main St, Town"), (F.col("lid") % 9).cast("string"), F.lit(", 1910"), (F.col("lid") % 9).cast("string")).alias("query"), F.when(F.col("lid") % 8 == 0, 10.0).otherwise(40.0).alias("lat"), F.lit(-75.5).alias("lng")).distinct()
    towns = spark.range(7).select(F.concat(F.lit("Town"), F.col("id").cast("string"), F.lit(", 1910"), F.col("id").cast("string")).alias("query"), (F.col("id") / 10.0 + 39.7).alias("lat"), F.lit(-75.0).alias("lng"))
    out = lookup.geocoded(venues, full.unionByName(towns))
    return out.select("lid", "label", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"))


def display_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens(spark, sf_dir, "venue")
    chosen = lookup.display_name(
        F.when(F.col("lid") % 3 == 0, F.concat(F.lit("Place "), F.col("lid").cast("string"))), F.when(F.col("lid") % 2 == 0, F.concat(F.lit("Element "), F.col("lid").cast("string"))).otherwise(""),
        F.concat(F.lit("TAVERN ON THE HILL "), F.col("lid").cast("string"), F.lit(" LLC")),
    )
    where = lookup.coordinates((F.when(F.col("lid") % 3 == 0, F.col("lat")), F.col("lng"), "places"), (F.when(F.col("lid") % 2 == 0, F.col("lat") + 1), F.col("lng") + 1, "osm"))
    out = rows.select("lid", chosen.alias("n"), where.alias("c"))
    return out.select("lid", "n.name", "n.named_by", F.round("c.lat", 4).alias("lat"), F.round("c.lng", 4).alias("lng"), F.col("c.by").alias("located_by"))


def venue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight rows of a search: the limit is the search's own."""
    return lookup.search(lens(spark, sf_dir, "venue"), " 00001 ".strip()).select("lid", "name")


def venue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens(spark, sf_dir, "venue").select("lid", F.concat(F.lit("v"), F.col("lid").cast("string")).alias("id"), T.slug(F.col("name"), F.col("zone_id")).alias("slug"))
    asked = rows.select(F.when(F.col("lid") % 2 == 0, F.col("id")).when(F.col("lid") % 3 == 0, F.col("slug")).otherwise(F.concat("id", F.lit("?"))).alias("key"))
    return lookup.by_id_or_slug(rows, asked)


def image_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_orderkey") % 3000).alias("lid"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), F.when(F.col("l_quantity") < 25, 200).otherwise(404).alias("status"),
        F.when(F.col("l_suppkey") % 3 == 0, "text/html").otherwise("image/jpeg").alias("content_type"), (F.col("l_partkey") % 900).alias("width"), (F.col("l_suppkey") % 10 * 60).alias("height"),
    )
    numbered = rows.groupBy("lid", "k").agg(F.min("status").alias("status"), F.min("content_type").alias("content_type"), F.max("width").alias("width"), F.max("height").alias("height"))
    from pyspark.sql import Window

    placed = numbered.withColumn("pos", F.row_number().over(Window.partitionBy("lid").orderBy("k")) - 1)
    return lookup.first_image(placed).select("lid", F.col("pos").cast("long").alias("pos"), "reason")


def zone_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens(spark, sf_dir, "venue").groupBy("zone_id").agg(F.count("*").alias("venues"), F.count_if(F.col("balance") > 0).alias("with_deals"))
    return rows.select("zone_id", lookup.zone_label(F.col("zone_id"), F.col("with_deals"), F.col("venues")).alias("label"))


#: Types of a registry, some of them with a name of their own, one of them no place to go to.
_TYPES = (
    "Restaurant (Liquor)", "Eating Place Retail Dispenser (Malt)", "Hotel (Liquor)", "Brewery", "Brewery Pub", "Limited Winery", "Winery", "Limited Distillery", "Distillery",
    "Airport Restaurant (Liquor)", "Public Venue Restaurant", "Performing Arts Facility", "Privately-Owned Public Golf Course Rest (Liquor)", "Municipal Golf Course (Liquor)",
    "Economic Development Restaurant (Liquor)", "Brewery Storage", "Hotel (Malt)", "Club (Liquor)", "Off-Track Wagering Restaurant (Liquor)",
)


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return lens(spark, d, "licence").select("lid", F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("lid") % len(_TYPES) + 1).cast("int")).alias("licence_type"))


def licence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).groupBy("licence_type", lookup.licence_label(F.col("licence_type")).alias("label")).agg(F.count("*").alias("n"))


def walk_in_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.walk_in(_typed(spark, sf_dir))


def shared_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links say, good ones and bad ones, and the link that says the same."""
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("lid") % n + 1).cast("int"))
    text = F.concat(
        F.lit("#d="), (F.col("lid") % 11 - 2).cast("string"), F.lit("&t="), F.when(F.col("lid") % 9 == 0, "soon").otherwise((F.col("lid") % 110 - 5).cast("string")), F.lit("&f="), pick(4, "food", "zzz", "all", "cheap"),
        F.lit("&s="), pick(3, "value", "best", "soonest"), F.when(F.col("lid") % 2 == 0, F.concat(F.lit("&z=a+b%26"), (F.col("lid") % 5).cast("string"))).otherwise("&z="), F.lit("&f=drinks&v="), F.when(F.col("lid") % 5 > 0, F.col("lid").cast("string")).otherwise(""),
    )
    rows = lens(spark, sf_dir, "venue").select("lid", lookup.shared_state(text).alias("s"))
    return rows.select("lid", F.col("s.day").cast("long").alias("day"), F.col("s.slot").cast("long").alias("slot"), "s.zone", "s.filter", "s.sort", "s.venue", lookup.shared_link(F.col("s")).alias("link"))


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens(spark, sf_dir, "licence")
    return rows.select("lid", T.directions_url(F.when(F.col("lid") % 2 == 0, F.lit(40.5)), F.lit(-75.25), F.concat("street", F.lit(", Town"))).alias("link"))


def element_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens(spark, sf_dir, "place")
    tags = F.create_map(
        F.lit("website"), F.when(F.col("place_id") % 4 == 0, "call us").otherwise(F.col("website")), F.lit("url"), F.concat(F.lit(" http://u"), F.col("place_id").cast("string")),
        F.lit("brand:website"), F.lit("http://brand"), F.lit("contact:website"), F.when(F.col("place_id") % 5 == 0, F.lit("https://contact")),
    )
    return rows.select("place_id", registry.site_of(tags).alias("site"))


def arrival_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = lookup.day_options(spark, "2001-08-03")
    rows = lens(spark, sf_dir, "venue").select((F.col("lid") % 7).cast("int").alias("ahead"), (F.col("lid") % 24 * 60 - 60).cast("int").alias("slot")).join(days, "ahead")
    moment = lookup.arrival(F.when(F.col("slot") < 0, -1).otherwise(F.col("slot")), F.col("ahead"), 1020)
    return rows.groupBy("label", moment.cast("long").alias("minute")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (geocode_fallback, display_choices, venue_search, venue_lookup, image_acceptance, zone_labels, licence_labels, walk_in_licences, shared_links, directions, element_sites, arrival_moments)
}
_TYPE_SQL = "[" + ", ".join(f"'{t}'" for t in _TYPES) + f"][lid % {len(_TYPES)} + 1]"
ORACLES = {
    "geocode_fallback": sql("""WITH full_ AS (SELECT DISTINCT lid % 50 AS a, lid % 9 AS t, CASE WHEN lid % 8 = 0 THEN 10.0::DOUBLE ELSE 40.0::DOUBLE END AS lat FROM venue WHERE lid % 4 = 0),
hit AS (SELECT a, t, min(lat) AS lat FROM full_ WHERE lat BETWEEN 39.6 AND 40.5 GROUP BY ALL)
SELECT v.lid, CASE WHEN h.lat IS NOT NULL THEN 'building' ELSE 'town' END AS label, CASE WHEN h.lat IS NOT NULL THEN h.lat ELSE round((v.lid % 9) / 10.0 + 39.7, 4)::DOUBLE END AS lat, CASE WHEN h.lat IS NOT NULL THEN -75.5::DOUBLE ELSE -75.0::DOUBLE END AS lng
FROM venue v LEFT JOIN hit h ON v.lid % 50 = h.a AND v.lid % 9 = h.t WHERE h.lat IS NOT NULL OR v.lid % 9 < 7""", "venue"),
    "display_choices": sql("""SELECT lid, CASE WHEN lid % 3 = 0 THEN concat('Place ', lid) WHEN lid % 2 = 0 THEN concat('Element ', lid) ELSE concat('Tavern on the Hill ', lid) END AS name,
  CASE WHEN lid % 3 = 0 THEN 'places' WHEN lid % 2 = 0 THEN 'osm' ELSE 'registry' END AS named_by, CASE WHEN lid % 3 = 0 THEN round(lat, 4) WHEN lid % 2 = 0 THEN round(lat + 1, 4) END AS lat,
  CASE WHEN lid % 3 = 0 THEN round(lng, 4) WHEN lid % 2 = 0 THEN round(lng + 1, 4) END AS lng, CASE WHEN lid % 3 = 0 THEN 'places' WHEN lid % 2 = 0 THEN 'osm' END AS located_by FROM venue""", "venue"),
    "venue_search": "SELECT c_custkey AS lid, c_name AS name FROM customer WHERE contains(lower(c_name), '00001') ORDER BY c_custkey LIMIT 8",
    "venue_lookup": sql("""WITH r AS (SELECT lid, concat('v', lid) AS id, concat(replace(lower(name), '#', '-'), '-', zone_id) AS slug FROM venue)
SELECT CASE WHEN lid % 2 = 0 THEN id WHEN lid % 3 = 0 THEN slug ELSE concat(id, '?') END AS key, CASE WHEN lid % 2 = 0 OR lid % 3 = 0 THEN lid END AS lid FROM r""", "venue"),
    "image_acceptance": """WITH r AS (SELECT l_orderkey % 3000 AS lid, l_orderkey * 8 + l_linenumber AS k, min(CASE WHEN l_quantity < 25 THEN 200 ELSE 404 END) AS status, min(CASE WHEN l_suppkey % 3 = 0 THEN 'text/html' ELSE 'image/jpeg' END) AS ct,
  max(l_partkey % 900) AS w, max(l_suppkey % 10 * 60) AS h FROM lineitem GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY k) - 1 AS pos FROM r),
c AS (SELECT lid, pos, CASE WHEN status <> 200 THEN 'not fetched' WHEN ct <> 'image/jpeg' THEN 'not an image' WHEN greatest(w, h) < 400 OR w * h < 90000 THEN 'too small' END AS reason FROM p WHERE pos < 10)
SELECT lid, min(pos) FILTER (reason IS NULL) AS pos, CASE WHEN min(pos) FILTER (reason IS NULL) IS NULL THEN max_by(reason, pos) END AS reason FROM c GROUP BY lid""",
    "zone_labels": sql("SELECT zone_id, concat(zone_id, ' (', count(*) FILTER (balance > 0), ' of ', count(*), ')') AS label FROM venue GROUP BY zone_id", "venue"),
    "licence_labels": sql(f"""WITH t AS (SELECT {_TYPE_SQL} AS licence_type FROM licence) SELECT licence_type, CASE licence_type WHEN 'Restaurant (Liquor)' THEN 'Restaurant & bar' WHEN 'Eating Place Retail Dispenser (Malt)' THEN 'Beer & food'
  WHEN 'Hotel (Liquor)' THEN 'Hotel bar' WHEN 'Brewery' THEN 'Brewery' WHEN 'Brewery Pub' THEN 'Brewpub' WHEN 'Limited Winery' THEN 'Winery tasting room' WHEN 'Winery' THEN 'Winery' WHEN 'Limited Distillery' THEN 'Distillery tasting room'
  WHEN 'Distillery' THEN 'Distillery' WHEN 'Airport Restaurant (Liquor)' THEN 'Airport restaurant' WHEN 'Public Venue Restaurant' THEN 'Venue restaurant' WHEN 'Performing Arts Facility' THEN 'Theatre bar'
  WHEN 'Privately-Owned Public Golf Course Rest (Liquor)' THEN 'Golf club restaurant' WHEN 'Municipal Golf Course (Liquor)' THEN 'Golf course restaurant' WHEN 'Economic Development Restaurant (Liquor)' THEN 'Restaurant & bar'
  ELSE 'Licensed venue' END AS label, count(*) AS n FROM t GROUP BY ALL""", "licence"),
    "walk_in_licences": sql(f"SELECT * FROM (SELECT lid, {_TYPE_SQL} AS licence_type FROM licence) WHERE licence_type <> 'Brewery Storage'", "licence"),
    "shared_links": sql("""WITH r AS (SELECT lid, greatest(0, least(6, lid % 11 - 2)) AS day, CASE WHEN lid % 9 = 0 THEN -1 ELSE greatest(-1, least(96, lid % 110 - 5)) END AS slot, CASE WHEN lid % 2 = 0 THEN concat('a b&', lid % 5) END AS zone,
  ['food', 'all', 'all', 'cheap'][lid % 4 + 1] AS filter, ['value', 'soonest', 'soonest'][lid % 3 + 1] AS sort, CASE WHEN lid % 5 > 0 THEN CAST(lid AS VARCHAR) END AS venue FROM venue),
l AS (SELECT *, array_to_string(list_filter([CASE WHEN day > 0 THEN concat('d=', day) END, CASE WHEN slot >= 0 THEN concat('t=', slot) END, CASE WHEN zone IS NOT NULL THEN concat('z=a+b%26', lid % 5) END,
  CASE WHEN filter <> 'all' THEN concat('f=', filter) END, CASE WHEN sort <> 'soonest' THEN concat('s=', sort) END, CASE WHEN venue IS NOT NULL THEN concat('v=', venue) END], lambda x: x IS NOT NULL), '&') AS pairs FROM r)
SELECT lid, day, slot, zone, filter, sort, venue, CASE WHEN pairs = '' THEN '' ELSE concat('#', pairs) END AS link FROM l""", "venue"),
    "directions": sql("SELECT lid, concat('https://www.google.com/maps/dir/?api=1&destination=', CASE WHEN lid % 2 = 0 THEN '40.5,-75.25' ELSE replace(replace(concat(street, ', Town'), ' ', '%20'), ',', '%2C') END) AS link FROM licence", "licence"),
    "element_sites": sql("""SELECT place_id, CASE WHEN place_id % 4 > 0 AND website IS NOT NULL THEN website WHEN place_id % 5 = 0 THEN 'https://contact' ELSE concat('http://u', place_id) END AS site FROM place""", "place"),
    "arrival_moments": sql("""WITH r AS (SELECT CAST(lid % 7 AS INTEGER) AS ahead, lid % 24 * 60 - 60 AS slot FROM venue)
SELECT ['Today', 'Tomorrow', 'Sun', 'Mon', 'Tue', 'Wed', 'Thu'][ahead + 1] AS label, CASE WHEN ahead = 0 AND slot < 1020 THEN 1020 WHEN slot < 0 THEN 960 ELSE slot END AS minute, count(*) AS n FROM r GROUP BY ALL""", "venue"),
}
