"""The live question: which offers can be reached, and are they still on?

venues(lid, name, zone_id, lat, lng), deals(deal_id, lid, type, confidence, age_days),
windows(deal_id, dow, start, end), items(deal_id, category, price, pct, off). Windows and items are
reduced to one row per offer by aggregates (a least struct, maxima), so no group is ever
collected; both are dealt by deal_id, and the offers then meet their venues by lid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions import ranking as R
from offerlens.operators import ranks
from offerlens.session import tasks


@dataclass(frozen=True)
class Moment:
    """When and where the question is asked: ISO weekday, minutes of the day, and a place or none."""

    dow: int = 5
    now: int = 17 * 60
    lat: float | None = 40.089
    lng: float | None = -75.396


def next_occurrences(windows: DataFrame, moment: Moment, few: bool = False) -> DataFrame:
    """(deal_id, day_ahead, live, starts_in, start, end, until): of each offer the next time it runs.

    The least of structs is found by sorting, so windows are dealt to tasks by the table's splits first, unless few of them are left.
    """
    hit = F.min(R.occurrence(F.col("dow"), F.col("start"), F.col("end"), moment.dow, moment.now)).alias("hit")
    rows = windows.where((F.col("dow").between(1, 7)) & (F.col("end") > F.col("start"))).select("deal_id", "dow", "start", "end")
    out = (rows if few else rows.repartition(tasks(rows), "deal_id")).groupBy("deal_id").agg(hit)
    return out.select("deal_id", "hit.day_ahead", (F.col("hit.waits") == 0).alias("live"), "hit.starts_in", "hit.start", "hit.end", "hit.until")


def item_summary(items: DataFrame) -> DataFrame:
    """(deal_id, value, has_food, has_drink, cheapest, cheapest_drink)."""
    value = R.item_value(F.col("category"), F.col("price"), F.col("pct"), F.col("off"))
    drink = F.col("category").isin(*R.DRINKS)
    return items.groupBy("deal_id").agg(
        F.max(value).alias("value"),
        F.max(F.col("category") == "food").alias("has_food"),
        F.max(drink).alias("has_drink"),
        F.min("price").alias("cheapest"),
        F.min(F.when(drink, F.col("price"))).alias("cheapest_drink"),
    )


#: Venues without hours are shown so many at a time.
PAGE_ROWS = 24
#: Predicates over item_summary that a filter name stands for.
FILTERS = {
    "all": lambda: F.lit(True),
    "food": lambda: F.coalesce("has_food", F.lit(False)),
    "cheap": lambda: F.coalesce(F.col("cheapest_drink") < 5, F.lit(False)),
    "drinks": lambda: F.coalesce("has_drink", F.lit(False)),
}


def located(venues: DataFrame, moment: Moment) -> DataFrame:
    if moment.lat is None:
        return venues.withColumns({"miles": F.lit(None).cast("double"), "drive": F.lit(None).cast("long")})
    miles = R.haversine_miles(F.lit(moment.lat), F.lit(moment.lng), F.col("lat"), F.col("lng"))
    return venues.withColumn("miles", miles).withColumn("drive", R.drive_minutes(F.col("miles")))


def feed(venues: DataFrame, deals: DataFrame, windows: DataFrame, items: DataFrame, moment: Moment = Moment(), zone: str | None = None, only: str = "all", sort: str = "soonest") -> DataFrame:
    """Ranked rows: one per visible offer that runs again, and under the filter `all` one per venue without offers."""
    places = located(venues.where(F.col("zone_id") == zone) if zone else venues, moment)
    confidence = R.effective_confidence(F.col("confidence"), F.col("age_days"))
    visible = deals.withColumn("confidence", confidence).where(~F.col("confidence").isin("disputed", "hidden"))
    if zone:  # a zone's offers are few: nothing is summed for the others
        visible = visible.join(places.select("lid"), "lid", "left_semi")
        windows, items = (t.join(visible.select("deal_id"), "deal_id", "left_semi") for t in (windows, items))
    offers = (
        visible.join(next_occurrences(windows, moment, few=bool(zone)), "deal_id")
        .join(item_summary(items), "deal_id", "left")
        .where(FILTERS.get(only, FILTERS["all"])())
        .join(places, "lid")
        .select("lid", "name", "zone_id", "deal_id", "confidence", "age_days", "day_ahead", "live", "starts_in", "until", "start", "end", "miles", "drive", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("has_food").isNotNull().alias("has_items"))
        .withColumn("grp", R.group_of(F.col("live"), F.col("until"), F.col("day_ahead"), F.col("starts_in"), F.col("drive")))
    )
    if only == "all":
        having = deals.select("lid").distinct()  # a venue's offers are many, and a join would sort them all
        without = places.join(having, "lid", "left_anti").select("lid", "name", "zone_id", F.lit("unknown").alias("confidence"), "miles", "drive", F.lit(R.UNKNOWN).alias("grp"))
        offers = offers.unionByName(without, allowMissingColumns=True)
    total = R.score(sort, F.col("grp"), F.col("live"), F.col("until"), F.col("starts_in"), F.col("miles"), F.col("drive"), F.col("value"), F.col("confidence"))
    return offers.withColumn("score", total)


def ranked(rows: DataFrame) -> DataFrame:
    """Rows in the order they are shown; ties by name and offer."""
    return rows.orderBy("score", "name", "deal_id")


def window_for(windows: DataFrame, moment: Moment, lookahead: int = R.LOOKAHEAD) -> DataFrame:
    """(deal_id, live, until, starts_in): the window that is on, or the next of the same day within lookahead."""
    today = windows.where((F.col("dow") == moment.dow) & (F.col("end") > moment.now) & (F.col("start") <= moment.now + lookahead))
    live = F.col("start") <= moment.now
    hit = F.struct(
        F.when(live, 0).otherwise(1).alias("waits"), F.when(live, 0).otherwise(F.col("start") - moment.now).alias("starts_in"), "start",
        F.when(live, F.col("end") - moment.now).otherwise(F.col("start") - moment.now).alias("until"),
    )
    out = today.groupBy("deal_id").agg(F.min(hit).alias("hit"))
    return out.select("deal_id", (F.col("hit.waits") == 0).alias("live"), "hit.until", "hit.starts_in")


def schedule_summary(windows: DataFrame) -> DataFrame:
    """(deal_id, summary): `Mon–Fri 4pm–6pm · Sat, Sun 2pm–4pm`, days of one time in runs, times in the order in which the offer names them.

    That order is windows' pos, or its days where it has none. A run goes on while each day follows the one before; a day that is named twice
    begins another. Dealt out once, by offer: all windows and groups below are of one offer. The number of tasks grows with the table, as each holds
    its part in the memory of several sorts and groupings at once.
    """
    times = ["deal_id", "start", "end"]
    rows = (windows if "pos" in windows.columns else windows.withColumn("pos", F.col("dow"))).select(*times, "dow", "pos")
    rows = rows.repartition(tasks(rows), "deal_id")
    order = Window.partitionBy(*times).orderBy("dow", "pos")
    breaks = rows.withColumn("breaks", F.coalesce(F.lag("dow").over(order) + 1 != F.col("dow"), F.lit(True)).cast("int"))
    runs = breaks.withColumn("run", F.sum("breaks").over(order)).groupBy(*times, "run").agg(F.min("dow").alias("a"), F.max("dow").alias("b"), F.min("pos").alias("first"))
    name = lambda c: F.element_at(F.array(*map(F.lit, R.DAY_SHORT)), F.col(c).cast("int"))
    label = F.when(F.col("a") == F.col("b"), name("a")).when(F.col("b") == F.col("a") + 1, F.concat(name("a"), F.lit(", "), name("b"))).otherwise(F.concat(name("a"), F.lit("–"), name("b")))
    lines = runs.groupBy(*times).agg(F.min("first").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", label.alias("t")))), lambda x: x["t"]), ", ").alias("days"))
    text = F.concat("days", F.lit(" "), R.clock(F.col("start")), F.lit("–"), R.clock(F.col("end")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "start", "end", text.alias("t")))), lambda x: x["t"]), " · ")
    return lines.groupBy("deal_id").agg(joined.alias("summary"))


def sections(rows: DataFrame, moment: Moment) -> DataFrame:
    """rows with the section that they stand in."""
    ahead = F.pmod(F.lit(moment.dow - 1) + F.coalesce("day_ahead", F.lit(0)), F.lit(7)) + 1
    return rows.withColumn("section", R.section(F.col("grp"), F.col("day_ahead"), ahead))


def headings(rows: DataFrame) -> DataFrame:
    """(first, section, n): the headings of the feed in its order: a new one where the section differs from that of the row before."""
    placed = ranks.ranked(rows, ("score", "name", "deal_id", "lid"), "section")
    opens = placed.where(F.col("before").isNull() | (F.col("before") != F.col("section"))).select("rank", "section")
    numbered = ranks.ranked(opens.withColumnRenamed("rank", "first"), ("first",), "first")
    # each heading's rows end where the next begins
    follow = numbered.select((F.col("rank") - 1).alias("rank"), F.col("first").alias("next"))
    end = F.coalesce("next", F.lit(rows.count() + 1))
    return numbered.join(follow, "rank", "left").select("first", "section", (end - F.col("first")).alias("n"))
