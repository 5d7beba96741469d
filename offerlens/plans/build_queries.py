"""The composed build: from venues and offers of all sources to the board, its zones and their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators import build, publish, validate
from offerlens.plans.feed_queries import _CONFIDENCE
from offerlens.plans.lenses import lens, sql
from offerlens.plans.registry_queries import _CAPS
from offerlens.session import written


def _venues(spark: SparkSession, d: str) -> DataFrame:
    """Readings of venues: a seventh by a person, all by the crawl; the person's go first."""
    rows = lens(spark, d, "venue").select(F.col("lid").alias("id"), "lid", (F.col("lid") % 4000).alias("addr"), "zone_id", "name")
    by_hand = rows.where("lid % 7 = 0").select("*", F.lit("staff").alias("verified_by"), F.col("lid").alias("pos"))
    crawled = rows.select("*", F.lit("auto_extract").alias("verified_by"), (F.col("lid") + 1_000_000_000).alias("pos"))
    return written(publish.priority_union(by_hand, crawled).withColumnRenamed("id", "venue"), "venues")


def _base(spark: SparkSession, d: str) -> DataFrame:
    """Every third licence holds the one after it as well; some are in no base, some in no zone."""
    rows = lens(spark, d, "venue").where("lid % 3 <> 1 AND lid % 50 <> 49")
    also = F.when(F.col("lid") % 3 == 0, F.array(F.col("lid") + 1)).otherwise(F.array().cast("array<bigint>"))
    zone = F.when(F.col("lid") % 40 == 7, "").otherwise(F.col("zone_id"))
    return rows.select("lid", also.alias("also_lids"), (F.col("lid") % 4000).alias("addr"), zone.alias("zone_id"), F.concat(F.lit("Base "), "name").alias("name"))


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey % 6 > 0").select(F.concat(F.lit("z"), F.col("n_nationkey").cast("string")).alias("zone_id"), F.col("n_name").alias("name"))


def _offers(spark: SparkSession, d: str, venues: DataFrame) -> DataFrame:
    """Every offer of a venue that is read, with its fate: priced, held against the rules, aged."""
    items = lens(spark, d, "item").where("deal_id % 4 > 0").groupBy("deal_id").agg(F.collect_list(F.struct("category", "price", "pct", "off")).alias("items"))
    deals = lens(spark, d, "deal").join(venues.select(F.col("venue").alias("lid"), "verified_by"), "lid").join(items, "deal_id", "left").withColumn("slug", F.col("lid"))
    read = F.struct(F.when(F.col("lid") % 25 == 0, "novelty").otherwise("wine").alias("category"), F.lit(5.0).alias("price"), F.lit(None).cast("double").alias("pct"), F.lit(None).cast("double").alias("off"))
    prices = lens(spark, d, "venue").where("lid % 5 = 0").select(F.col("lid").alias("slug"), F.array(read).alias("items"))
    priced = written(publish.with_prices(deals, prices), "priced")
    flat = priced.select("deal_id", F.explode("items").alias("i")).select("deal_id", "i.*")
    errors = validate.flat_errors(priced.select("deal_id", "type", "confidence"), lens(spark, d, "window_"), flat).select("deal_id", "first_error")
    return build.offers(priced.join(errors, "deal_id"), F.when(F.col("first_error").isNotNull(), F.array("first_error")))


def _cards(spark: SparkSession, d: str, venues: DataFrame, told: DataFrame) -> DataFrame:
    windows = lens(spark, d, "window_").groupBy("deal_id").agg(F.collect_list(F.struct("dow")).alias("windows"))
    kept = told.where("fate IS NULL").join(windows, "deal_id").select(F.col("lid").alias("venue"), "deal_id", F.col("deal_id").alias("deal_pos"), "type", "confidence", "items_source", "windows")
    return build.cards(build.capped(written(kept, "kept")), venues.select("venue", "pos", "lid", "addr"), _base(spark, d))


def _board(spark: SparkSession, d: str) -> DataFrame:
    venues = _venues(spark, d)
    return build.board(_cards(spark, d, venues, _offers(spark, d, venues)), venues, _base(spark, d), _zones(spark, d))


def board_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each card of the board with the offers of one licence, by their ids."""
    ids = F.array_join(F.transform("deals", lambda x: F.concat(x["deal_id"].cast("string"), F.coalesce(F.concat(F.lit(":"), x["items_source"]), F.lit("")))), ",")
    return _board(spark, sf_dir).select("zone_id", "zone", "key", "lid", "venue", "name", F.size("deals").cast("long").alias("n_deals"), ids.alias("deals"))


def board_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.index(_board(spark, sf_dir))


def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of all offers, with subtotals by the part of the build: rejected, hidden by age, capped or shipped."""
    venues = _venues(spark, sf_dir)
    told = written(_offers(spark, sf_dir, venues), "told")
    shipped = _cards(spark, sf_dir, venues, told).select(F.explode("deals.deal_id").alias("deal_id")).withColumn("in_card", F.lit(True))
    fate = F.when(F.col("fate").startswith("rejected"), "rejected").when(F.col("fate") == "hidden", "hidden").when(F.col("in_card"), "shipped").otherwise("not on a card")
    rows = told.join(shipped, "deal_id", "left").select(fate.alias("fate"), F.coalesce(F.when(fate == "rejected", F.substring_index("fate", ": ", -1)), "type").alias("kind"))
    sets = rows.groupingSets([[F.col("fate"), F.col("kind")], [F.col("fate")], []], F.col("fate"), F.col("kind"))
    return sets.agg(F.count("*").alias("n"), F.grouping_id().alias("level")).select(F.coalesce("fate", F.lit("(all)")).alias("fate"), F.when(F.col("level") == 0, F.col("kind")).otherwise("(all)").alias("kind"), "n")


QUERIES = {f.__name__: f for f in (board_build, board_zones, build_report)}

_CHAIN = _CAPS[: _CAPS.index("flaws AS")] + f"""
vv AS (SELECT lid AS venue, lid % 4000 AS addr, zone_id, name, CASE WHEN lid % 7 = 0 THEN 'staff' ELSE 'auto_extract' END AS verified_by, CASE WHEN lid % 7 = 0 THEN lid ELSE lid + 1000000000 END AS pos FROM venue),
merged AS (SELECT * FROM vv WHERE verified_by = 'staff' UNION ALL SELECT * FROM vv WHERE verified_by <> 'staff' AND addr NOT IN (SELECT addr FROM vv WHERE verified_by = 'staff')),
d AS (SELECT deal.*, verified_by = 'auto_extract' AND lid % 5 = 0 AND (deal_id % 4 = 0 OR deal_id NOT IN (SELECT deal_id FROM item)) AS filled FROM deal JOIN merged ON deal.lid = merged.venue),
flaws AS (SELECT deal_id, bool_or(category = 'novelty') AS bad_category, bool_or(price IS NULL AND pct IS NULL AND off IS NULL) AS bare FROM (
  SELECT deal_id, category, price, pct, off FROM item WHERE deal_id % 4 > 0 UNION ALL SELECT deal_id, CASE WHEN lid % 25 = 0 THEN 'novelty' ELSE 'wine' END, 5.0, NULL, NULL FROM d WHERE filled) GROUP BY deal_id),
fates AS (SELECT *, CASE WHEN first_error IS NOT NULL THEN 'rejected' WHEN {_CONFIDENCE} = 'hidden' THEN 'hidden' END AS fate FROM (
  SELECT d.*, CASE WHEN c.in_a_week IS NULL THEN 'no windows' WHEN type = 'happy_hour' AND most_in_a_day > 240 THEN 'exceeds the 4h/day cap' WHEN type = 'happy_hour' AND in_a_week > 1440 THEN 'exceeds the 24h/week cap'
    WHEN bad_category THEN 'unknown item category' WHEN bare THEN 'item has neither a price nor a discount' END AS first_error FROM d LEFT JOIN caps c ON d.deal_id = c.deal_id LEFT JOIN flaws f ON d.deal_id = f.deal_id)),
stay AS (SELECT * FROM fates WHERE fate IS NULL AND deal_id IN (SELECT deal_id FROM window_)),
over AS (SELECT lid FROM stay JOIN window_ w ON stay.deal_id = w.deal_id WHERE type = 'food_combo' GROUP BY lid, dow HAVING count(*) > 2),
held AS (SELECT lid AS venue, count(*) AS n, string_agg(concat(deal_id, CASE WHEN filled THEN ':llm_extract' ELSE '' END), ',' ORDER BY deal_id) AS deals, list(deal_id) AS ids FROM stay WHERE lid NOT IN (SELECT lid FROM over) GROUP BY lid),
base AS (SELECT lid, lid % 4000 AS addr, CASE WHEN lid % 40 = 7 THEN '' ELSE zone_id END AS zone_id, concat('Base ', name) AS name FROM venue WHERE lid % 3 <> 1 AND lid % 50 <> 49),
own AS (SELECT l, min(c) AS c FROM (SELECT lid AS l, lid AS c FROM base UNION ALL SELECT lid + 1, lid FROM base WHERE lid % 3 = 0) GROUP BY l),
byaddr AS (SELECT addr, min(lid) AS c FROM base GROUP BY addr),
placed AS (SELECT held.*, m.pos, m.zone_id, m.name, m.verified_by, coalesce(own.c, byaddr.c) AS lid, coalesce(CAST(coalesce(own.c, byaddr.c) AS VARCHAR), concat('orphan:', held.venue)) AS key
  FROM held JOIN merged m USING (venue) LEFT JOIN own ON own.l = held.venue LEFT JOIN byaddr ON byaddr.addr = m.addr),
rich AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, pos) AS r FROM placed) WHERE r = 1),
board AS (SELECT b.zone_id, coalesce(z.n_name, b.zone_id) AS zone, key, lid, venue, name, n_deals, deals FROM (
  SELECT coalesce(r.zone_id, b.zone_id) AS zone_id, coalesce(r.key, CAST(b.lid AS VARCHAR)) AS key, coalesce(r.lid, b.lid) AS lid, r.venue, CASE WHEN r.verified_by = 'staff' THEN r.name ELSE coalesce(b.name, r.name) END AS name, coalesce(r.n, 0) AS n_deals, coalesce(r.deals, '') AS deals
  FROM base b FULL JOIN rich r ON b.lid = r.lid) b LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 6 > 0) z ON b.zone_id = concat('z', z.n_nationkey) WHERE b.zone_id <> '')"""

ORACLES = {
    "board_build": sql(f"WITH {_CHAIN} SELECT * FROM board", "venue", "deal", "window_", "item"),
    "board_zones": sql(f"WITH {_CHAIN} SELECT zone_id, zone, count(*) AS venues, count(*) FILTER (n_deals > 0) AS with_deals, sum(n_deals)::BIGINT AS deals FROM board GROUP BY ALL", "venue", "deal", "window_", "item"),
    "build_report": sql(f"""WITH {_CHAIN}, told AS (SELECT coalesce(fate, CASE WHEN deal_id IN (SELECT unnest(ids) FROM rich) THEN 'shipped' ELSE 'not on a card' END) AS fate, coalesce(first_error, type) AS kind FROM fates)
SELECT CASE WHEN grouping(fate) = 1 THEN '(all)' ELSE fate END AS fate, CASE WHEN grouping(kind) = 1 THEN '(all)' ELSE kind END AS kind, count(*) AS n FROM told GROUP BY GROUPING SETS ((fate, kind), (fate), ())""", "venue", "deal", "window_", "item"),
}
