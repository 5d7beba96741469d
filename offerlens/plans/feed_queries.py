"""Queries of the read-time engine: the ranked feed and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import ranking as R
from offerlens.operators import feed as feeds
from offerlens.plans.lenses import lens, sql

MOMENT = feeds.Moment()
NOWHERE = feeds.Moment(lat=None, lng=None)
EARLY = feeds.Moment(dow=7, now=11 * 60)


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tuple(lens(spark, d, n) for n in ("venue", "deal", "window_", "item"))


def _shown(rows: DataFrame) -> DataFrame:
    """Feed rows as the checks compare them: whole numbers as longs, measures rounded."""
    longs = [F.col(c).cast("long").alias(c) for c in ("lid", "deal_id", "age_days", "day_ahead", "starts_in", "until", "drive", "grp")]
    return rows.select("name", "zone_id", "confidence", "live", *longs, F.round("miles", 4).alias("miles"), F.round("value", 4).alias("value"), F.round("score", 3).alias("score"))


def _feed(moment: feeds.Moment = MOMENT, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(feeds.ranked(feeds.feed(*_tables(spark, sf_dir), moment, **options)))

    return run


_HIT = """
hits AS (
  SELECT deal_id, min_by(struct_pack(day_ahead := day_ahead, live := live, starts_in := starts_in, until := until, "start" := "start", "end" := "end"),
                         struct_pack(a := day_ahead, b := CASE WHEN live THEN 0 ELSE 1 END, c := starts_in, d := "start", e := "end")) AS h
  FROM (SELECT *, CASE WHEN live THEN 0 ELSE day_ahead * 1440 + "start" - {now} END AS starts_in,
               CASE WHEN live THEN "end" - {now} ELSE day_ahead * 1440 + "start" - {now} END AS until
        FROM (SELECT *, day_ahead = 0 AND "start" <= {now} AS live
              FROM (SELECT *, CASE WHEN dow = {dow} AND {now} >= "end" THEN 7 ELSE (dow - {dow} + 7) % 7 END AS day_ahead
                    FROM window_ WHERE dow BETWEEN 1 AND 7 AND "end" > "start")))
  GROUP BY deal_id)"""
_VALUE = """CASE WHEN pct IS NOT NULL THEN pct WHEN off IS NOT NULL THEN off * 12 WHEN price IS NOT NULL AND category = 'food' THEN greatest(0.0::DOUBLE, 60 - price * 4)
                 WHEN price IS NOT NULL THEN greatest(0.0::DOUBLE, 70 - price * 7) ELSE 0.0::DOUBLE END"""
_DRINK = "category IN ('draft', 'bottle_can', 'wine', 'well', 'call', 'cocktail', 'shot')"
_CONFIDENCE = """CASE WHEN confidence IN ('verified', 'disputed') OR age_days IS NULL THEN confidence WHEN age_days > 120 THEN 'hidden'
                      WHEN age_days > 45 AND confidence = 'likely' THEN 'unconfirmed' ELSE confidence END"""
_MILES = """2 * 3958.8::DOUBLE * asin(sqrt(pow(sin(radians(lat - 40.089::DOUBLE) / 2), 2) + cos(radians(40.089::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lng + 75.396::DOUBLE) / 2), 2)))"""


def _feed_sql(moment: feeds.Moment = MOMENT, zone: str | None = None, only: str = "all", sort: str = "soonest", tail: str = "", items: str = "item") -> str:
    place = f"SELECT *, greatest(1, CAST(floor(miles * 1.35::DOUBLE * 60 / 26 + 3.5::DOUBLE) AS BIGINT)) AS drive FROM (SELECT *, {_MILES} AS miles FROM venue)"
    if moment.lat is None:
        place = "SELECT *, NULL::DOUBLE AS miles, NULL::BIGINT AS drive FROM venue"
    where = f"WHERE zone_id = '{zone}'" if zone else ""
    test = {"all": "true", "food": "coalesce(has_food, false)", "drinks": "coalesce(has_drink, false)", "cheap": "coalesce(cheapest_drink < 5, false)"}[only]
    far, worth = "coalesce(miles, 999.0::DOUBLE) * 100", "(100 - least(coalesce(value, 0.0::DOUBLE), 100.0::DOUBLE))"
    doubt = "CASE confidence WHEN 'verified' THEN 0 WHEN 'likely' THEN 3 WHEN 'unconfirmed' THEN 9 WHEN 'disputed' THEN 99 ELSE 9 END"
    score = {
        "nearest": f"{far} + {doubt}",
        "value": f"{worth} * 100 + coalesce(drive, 0) + {doubt}",
        "soonest": f"CASE WHEN live THEN 120 - least(greatest(0, until - coalesce(drive, 0)), 120) ELSE starts_in END * 10 + coalesce(drive, 0) * 12 + {worth} + {doubt}",
    }[sort]
    without = """UNION ALL BY NAME SELECT lid, name, zone_id, 'unknown' AS confidence, miles, drive, 5 AS grp FROM places WHERE lid NOT IN (SELECT lid FROM deal)""" if only == "all" else ""
    return sql(
        f"""WITH places AS (SELECT * FROM ({place}) {where}), {_HIT.format(now=moment.now, dow=moment.dow)},
items AS (SELECT deal_id, max({_VALUE}) AS value, bool_or(category = 'food') AS has_food, bool_or({_DRINK}) AS has_drink, min(CASE WHEN {_DRINK} THEN price END) AS cheapest_drink FROM {items} GROUP BY deal_id),
offers AS (
  SELECT p.lid, p.name, p.zone_id, d.deal_id, d.conf AS confidence, d.age_days, h.h.day_ahead AS day_ahead, h.h.live AS live, h.h.starts_in AS starts_in, h.h.until AS until, h.h."start" AS w_start, h.h."end" AS w_end,
         p.miles, p.drive, coalesce(i.value, 0.0::DOUBLE) AS value,
         CASE WHEN h.h.live AND p.drive IS NOT NULL AND h.h.until <= p.drive THEN 4 WHEN h.h.live THEN 0 WHEN h.h.day_ahead > 0 THEN 3 WHEN h.h.starts_in <= 180 THEN 1 ELSE 2 END AS grp
  FROM (SELECT *, {_CONFIDENCE} AS conf FROM deal) d JOIN hits h ON d.deal_id = h.deal_id LEFT JOIN items i ON d.deal_id = i.deal_id JOIN places p ON d.lid = p.lid
  WHERE d.conf NOT IN ('disputed', 'hidden') AND {test}
  {without}),
feed AS (
  SELECT name, zone_id, confidence, live, lid, deal_id, CAST(age_days AS BIGINT) AS age_days, CAST(day_ahead AS BIGINT) AS day_ahead, CAST(starts_in AS BIGINT) AS starts_in,
         CAST(until AS BIGINT) AS until, w_start, w_end, CAST(drive AS BIGINT) AS drive, CAST(grp AS BIGINT) AS grp, round(miles, 4) AS miles, round(value, 4) AS value,
         round(CASE WHEN grp = 5 THEN 500000.0::DOUBLE + least({far}, 99999.0::DOUBLE) ELSE grp * 100000.0::DOUBLE + {score} END, 3) AS score
  FROM offers)
{tail or 'SELECT * EXCLUDE (w_start, w_end) FROM feed'}""",
        "venue", "deal", "window_", "item",
    )


def feed_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.feed(*_tables(spark, sf_dir), MOMENT)
    return rows.groupBy(F.col("grp").cast("long").alias("grp")).agg(
        F.count("*").alias("n"), F.count_if("live").alias("n_live"), F.count("deal_id").alias("n_deals"), F.countDistinct("lid").alias("n_venues")
    )


def feed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings of the whole feed: where each begins, and how many rows it has. Scores in thousandths, as all rows are shown."""
    rows = feeds.sections(feeds.feed(*_tables(spark, sf_dir), MOMENT), MOMENT)
    return feeds.headings(rows.select(F.round("score", 3).alias("score"), "name", "deal_id", "lid", "section"))


def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All offers, and the first page of venues without hours: 24 rows, the limit of a page of these."""
    rows = feeds.feed(*_tables(spark, sf_dir), MOMENT)
    shown = rows.where(F.col("grp") < R.UNKNOWN).unionByName(feeds.ranked(rows.where(F.col("grp") == R.UNKNOWN)).limit(feeds.PAGE_ROWS))
    return feeds.ranked(shown).select(F.col("lid"), F.col("deal_id"), F.round("score", 3).alias("score"))


def next_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = feeds.next_occurrences(lens(spark, sf_dir, "window_"), EARLY)
    return hits.select("deal_id", "live", *[F.col(c).cast("long").alias(c) for c in ("day_ahead", "starts_in", "until", "start", "end")])


def window_for_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = feeds.window_for(lens(spark, sf_dir, "window_"), MOMENT)
    return hits.select("deal_id", "live", F.col("until").cast("long").alias("until"), F.col("starts_in").cast("long").alias("starts_in"))


def decay_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = lens(spark, sf_dir, "deal")
    return deals.select("deal_id", "confidence", F.col("age_days").cast("long").alias("age_days"), R.effective_confidence(F.col("confidence"), F.col("age_days")).alias("effective"))


def schedule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows in the order of their places, last days first; some are named twice."""
    rows = lens(spark, sf_dir, "window_").select("deal_id", "dow", "start", "end", "supp_id")
    return feeds.schedule_summary(rows.withColumn("pos", 8 - F.col("dow")).union(rows.where("supp_id % 5 = 0").withColumn("pos", 20 - F.col("dow"))))


def deal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feeds.item_summary(lens(spark, sf_dir, "item"))
    return out.select("deal_id", F.round("value", 4).alias("value"), "has_food", "has_drink", "cheapest", "cheapest_drink")


def item_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lens(spark, sf_dir, "item")
    amount = R.item_amount(F.col("price"), F.col("pct"), F.col("off"))
    return items.groupBy(amount.alias("amount"), "category").agg(F.count("*").alias("n"))


def longest_window_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = lens(spark, sf_dir, "window_")
    best = F.max(F.struct((F.col("end") - F.col("start")).alias("span"), (-F.col("start")).alias("early")))
    out = windows.groupBy("deal_id", "dow").agg(best.alias("w"))
    start = -F.col("w.early")
    return out.select("deal_id", F.col("dow").cast("long").alias("dow"), start.cast("long").alias("start"), (start + F.col("w.span")).cast("long").alias("end"))


def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = lens(spark, sf_dir, "window_").select("start", "end").distinct()
    return windows.select(
        F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), R.clock(F.col("start")).alias("opens"), R.clock(F.col("end")).alias("closes"),
        R.duration(F.col("end") - F.col("start")).alias("lasts"),
    )


def distance_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = feeds.located(lens(spark, sf_dir, "venue"), MOMENT)
    road = F.col("lid") % 5 == 0
    return places.select("lid", F.round("miles", 4).alias("miles"), F.col("drive").cast("long").alias("drive"), R.miles_text(F.col("miles"), ~road).alias("text"))


def arrival_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a card says of time and trust, per visible offer; every seventh offer has no items, every tenth fine print."""
    venues, deals, windows, items = _tables(spark, sf_dir)
    rows = feeds.feed(venues, deals, windows, items.where("deal_id % 7 > 0"), MOMENT).where("deal_id IS NOT NULL")
    when = R.when_text(*[F.col(c) for c in ("live", "day_ahead", "start", "end", "starts_in", "until")])
    printed = F.when(F.col("deal_id") % 10 == 0, "Bar seats only.")
    fine = R.fine_text(*[F.col(c) for c in ("grp", "live", "until", "drive")], printed, F.col("has_items"))
    return rows.groupBy(when.alias("when_text"), fine.alias("fine_text"), R.trust_text(F.col("confidence"), F.col("age_days")).alias("trust_text")).agg(F.count("*").alias("n"))


_CLOCK = """CASE WHEN {0} >= 1440 THEN 'midnight' ELSE concat(CAST(CASE WHEN ({0} // 60) % 12 = 0 THEN 12 ELSE ({0} // 60) % 12 END AS VARCHAR),
  CASE WHEN {0} % 60 > 0 THEN concat(':', lpad(CAST({0} % 60 AS VARCHAR), 2, '0')) ELSE '' END, CASE WHEN {0} // 60 >= 12 THEN 'pm' ELSE 'am' END) END""".format
_LASTS = """CASE WHEN {0} < 60 THEN concat(CAST({0} AS VARCHAR), ' min') WHEN {0} % 60 > 0 THEN concat(CAST({0} // 60 AS VARCHAR), 'h ', CAST({0} % 60 AS VARCHAR), 'm') ELSE concat(CAST({0} // 60 AS VARCHAR), 'h') END""".format
_MONEY = "concat('$', CASE WHEN {0} = floor({0}) THEN CAST(CAST(floor({0}) AS BIGINT) AS VARCHAR) ELSE printf('%.2f', {0}) END)".format

QUERIES = {
    "feed_soonest": _feed(), "feed_nearest": _feed(sort="nearest"), "feed_value": _feed(sort="value"), "feed_no_origin": _feed(NOWHERE), "feed_zone": _feed(zone="z7"),
    "feed_filter_food": _feed(only="food"), "feed_filter_cheap": _feed(only="cheap"), "feed_filter_drinks": _feed(only="drinks"), "feed_sunday_morning": _feed(EARLY),
} | {
    f.__name__: f
    for f in (
        feed_group_counts, feed_sections, feed_page, next_occurrence, window_for_lookahead, decay_ladder, schedule_summary, deal_values, item_labels, longest_window_per_day, clock_texts,
        distance_texts, arrival_texts,
    )
}

_DAYS = "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun']"
_LONG = "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']"
ORACLES = {
    "feed_soonest": _feed_sql(), "feed_nearest": _feed_sql(sort="nearest"), "feed_value": _feed_sql(sort="value"), "feed_no_origin": _feed_sql(NOWHERE), "feed_zone": _feed_sql(zone="z7"),
    "feed_filter_food": _feed_sql(only="food"), "feed_filter_cheap": _feed_sql(only="cheap"), "feed_filter_drinks": _feed_sql(only="drinks"), "feed_sunday_morning": _feed_sql(EARLY),
    "feed_group_counts": _feed_sql(tail="SELECT grp, count(*) AS n, count(*) FILTER (live) AS n_live, count(deal_id) AS n_deals, count(DISTINCT lid) AS n_venues FROM feed GROUP BY grp"),
    "feed_sections": _feed_sql(
        tail=f"""SELECT first, section, lead(first, 1, total + 1) OVER (ORDER BY first) - first AS n FROM (
  SELECT row_number() OVER t AS first, section, lag(section) OVER t AS before, count(*) OVER () AS total FROM (
    SELECT *, CASE grp WHEN 0 THEN 'Live now' WHEN 1 THEN 'Starting soon' WHEN 2 THEN 'Later today' WHEN 4 THEN 'Ends before you''d get there'
      WHEN 5 THEN 'Hours not published' ELSE CASE WHEN day_ahead = 1 THEN 'Tomorrow' ELSE {_LONG}[(4 + day_ahead) % 7 + 1] END END AS section FROM feed) WINDOW t AS (ORDER BY score NULLS FIRST, name NULLS FIRST, deal_id NULLS FIRST, lid)) WHERE before IS DISTINCT FROM section"""
    ),
    "feed_page": _feed_sql(tail="SELECT lid, deal_id, score FROM feed WHERE grp < 5 UNION ALL SELECT * FROM (SELECT lid, deal_id, score FROM feed WHERE grp = 5 ORDER BY score, name LIMIT 24)"),
    "next_occurrence": sql(f"""WITH {_HIT.format(now=660, dow=7)} SELECT deal_id, h.live AS live, CAST(h.day_ahead AS BIGINT) AS day_ahead, CAST(h.starts_in AS BIGINT) AS starts_in, CAST(h.until AS BIGINT) AS until,
  CAST(h."start" AS BIGINT) AS "start", CAST(h."end" AS BIGINT) AS "end" FROM hits""", "window_"),
    "window_for_lookahead": sql("""SELECT deal_id, live, CAST(until AS BIGINT) AS until, CAST(starts_in AS BIGINT) AS starts_in FROM (
  SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY live DESC, starts_in, "start", until) AS k FROM (
    SELECT deal_id, "start", "start" <= 1020 AS live, CASE WHEN "start" <= 1020 THEN 0 ELSE "start" - 1020 END AS starts_in, CASE WHEN "start" <= 1020 THEN "end" - 1020 ELSE "start" - 1020 END AS until
    FROM window_ WHERE dow = 5 AND "end" > 1020 AND "start" <= 1200)) WHERE k = 1""", "window_"),
    "decay_ladder": sql(f"SELECT deal_id, confidence, CAST(age_days AS BIGINT) AS age_days, {_CONFIDENCE} AS effective FROM deal", "deal"),
    "schedule_summary": sql(f"""WITH w AS (SELECT deal_id, dow, "start", "end", 8 - dow AS pos FROM window_ UNION ALL SELECT deal_id, dow, "start", "end", 20 - dow FROM window_ WHERE supp_id % 5 = 0),
marked AS (SELECT *, CASE WHEN lag(dow) OVER (PARTITION BY deal_id, "start", "end" ORDER BY dow, pos) + 1 = dow THEN 0 ELSE 1 END AS breaks FROM w),
runs AS (SELECT deal_id, "start", "end", run, min(dow) AS a, max(dow) AS b, min(pos) AS first FROM (SELECT *, sum(breaks) OVER (PARTITION BY deal_id, "start", "end" ORDER BY dow, pos) AS run FROM marked) GROUP BY deal_id, "start", "end", run),
lines AS (SELECT deal_id, "start", "end", min(first) AS first, string_agg(CASE WHEN a = b THEN {_DAYS}[a] WHEN b = a + 1 THEN concat({_DAYS}[a], ', ', {_DAYS}[b]) ELSE concat({_DAYS}[a], '–', {_DAYS}[b]) END, ', ' ORDER BY run) AS days
  FROM runs GROUP BY deal_id, "start", "end")
SELECT deal_id, string_agg(concat(days, ' ', {_CLOCK('"start"')}, '–', {_CLOCK('"end"')}), ' · ' ORDER BY first, "start", "end") AS summary FROM lines GROUP BY deal_id""", "window_"),
    "deal_values": sql(f"""SELECT deal_id, round(max({_VALUE}), 4) AS value, bool_or(category = 'food') AS has_food, bool_or({_DRINK}) AS has_drink, min(price) AS cheapest,
  min(CASE WHEN {_DRINK} THEN price END) AS cheapest_drink FROM item GROUP BY deal_id""", "item"),
    "item_labels": sql(f"""SELECT amount, category, count(*) AS n FROM (SELECT category, CASE WHEN price IS NOT NULL THEN {_MONEY('price')} WHEN pct IS NOT NULL THEN concat(CAST(CAST(pct AS BIGINT) AS VARCHAR), '% off')
  WHEN off IS NOT NULL THEN concat({_MONEY('off')}, ' off') ELSE '' END AS amount FROM item) GROUP BY amount, category""", "item"),
    "longest_window_per_day": sql("""SELECT deal_id, CAST(dow AS BIGINT) AS dow, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end" FROM (
  SELECT *, row_number() OVER (PARTITION BY deal_id, dow ORDER BY "end" - "start" DESC, "start") AS k FROM window_) WHERE k = 1""", "window_"),
    "clock_texts": sql(f"""SELECT DISTINCT CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", {_CLOCK('"start"')} AS opens, {_CLOCK('"end"')} AS closes, {_LASTS('("end" - "start")')} AS lasts FROM window_""", "window_"),
    "distance_texts": sql(f"""SELECT lid, round(miles, 4) AS miles, greatest(1, CAST(floor(miles * 1.35::DOUBLE * 60 / 26 + 3.5::DOUBLE) AS BIGINT)) AS drive,
  CASE WHEN miles < 0.1 THEN 'here' WHEN lid % 5 = 0 THEN concat('~', CAST(CAST(floor(miles + 0.5) AS BIGINT) AS VARCHAR), ' mi') WHEN miles < 10 THEN concat(printf('%.1f', miles), ' mi')
    ELSE concat(CAST(CAST(floor(miles + 0.5) AS BIGINT) AS VARCHAR), ' mi') END AS text FROM (SELECT *, {_MILES} AS miles FROM venue)""", "venue"),
    "arrival_texts": _feed_sql(
        items="(SELECT * FROM item WHERE deal_id % 7 > 0)",
        tail=f"""SELECT when_text, trim(concat(warning, said)) AS fine_text, trust_text, count(*) AS n FROM (SELECT
  CASE WHEN live THEN concat('Ends in ', {_LASTS('until')}) WHEN day_ahead = 0 THEN concat({_CLOCK('w_start')}, ' · in ', {_LASTS('starts_in')}) ELSE concat({_CLOCK('w_start')}, '–', {_CLOCK('w_end')}) END AS when_text,
  CASE WHEN grp = 4 THEN concat('It ends in ', {_LASTS('until')}, ' and you''re about ', CAST(drive AS VARCHAR), ' minutes away. ')
    WHEN live AND drive IS NOT NULL AND greatest(0, until - drive) < 30 THEN concat('About ', {_LASTS('greatest(0, until - drive)')}, ' of it left by the time you arrive. ') ELSE '' END AS warning,
  CASE WHEN deal_id % 10 = 0 THEN 'Bar seats only.' WHEN deal_id % 7 > 0 THEN '' ELSE 'Window published without prices.' END AS said,
  concat(CASE WHEN confidence = 'unconfirmed' THEN 'Unconfirmed — call ahead · ' ELSE 'Checked ' END, CASE WHEN age_days = 0 THEN 'today' ELSE concat(CAST(age_days AS VARCHAR), 'd ago') END) AS trust_text
  FROM feed WHERE deal_id IS NOT NULL) GROUP BY ALL""",
    ),
}
