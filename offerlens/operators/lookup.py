"""Display choices, ordered fallbacks and look-ups over the board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import text as T
from offerlens.operators.feed import FILTERS

#: The box in which a geocode is believed (south, north, west, east).
BOX = (39.6, 40.5, -76.2, -74.7)
STRATEGIES = ("building", "street", "road", "town")
SEARCH_CHARS, SEARCH_ROWS, PAGE_ROWS = 2, 8, 24
LONG_EDGE, LEAST_PIXELS, CANDIDATES = 400, 90_000, 10


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float] = BOX) -> Column:
    return F.coalesce(lat.between(box[0], box[1]) & lng.between(box[2], box[3]), F.lit(False))


def strategies(address: Column) -> Column:
    """array<struct<rank,label,query>>: ways to ask for an address, most exact first."""
    parts = T.split_address(T.house_number(address))
    street, city, zip_code = parts["street"], parts["city"], parts["zip"]
    road = F.regexp_replace(street, r"^\d+\s+", "")
    asked = (F.concat_ws(", ", street, city, zip_code), F.concat_ws(", ", street, city), F.concat_ws(", ", road, city), F.concat_ws(", ", city, zip_code))
    return F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("label"), q.alias("query")) for i, (n, q) in enumerate(zip(STRATEGIES, asked))])


def geocoded(venues: DataFrame, answers: DataFrame) -> DataFrame:
    """(lid, label, lat, lng): of the strategies' answers the most exact one inside the box."""
    asked = venues.select("lid", F.explode(strategies(F.col("address"))).alias("s")).select("lid", "s.rank", "s.label", "s.query")
    hits = asked.join(answers, "query").where(in_box(F.col("lat"), F.col("lng")))
    return hits.groupBy("lid").agg(F.min_by(F.struct("label", "lat", "lng"), F.struct("rank", "lat", "lng")).alias("x")).select("lid", "x.*")


def display_name(place: Column, element: Column, registry: Column) -> Column:
    """struct(name, named_by): the first source that has a name."""
    return (
        F.when(F.coalesce(place, F.lit("")) != "", F.struct(place.alias("name"), F.lit("places").alias("named_by")))
        .when(F.coalesce(element, F.lit("")) != "", F.struct(element.alias("name"), F.lit("osm").alias("named_by")))
        .otherwise(F.struct(T.pretty_name(registry).alias("name"), F.lit("registry").alias("named_by")))
    )


def coordinates(*sources: tuple[Column, Column, str]) -> Column:
    """struct(lat, lng, by) of the first source with a latitude; latitude and longitude never come from two."""
    out = F.lit(None).cast("struct<lat:double,lng:double,by:string>")
    for lat, lng, name in reversed(sources):
        out = F.when(lat.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng"), F.lit(name).alias("by"))).otherwise(out)
    return out


def search(venues: DataFrame, typed: str) -> DataFrame:
    """The first eight venues, in board order, whose name holds what was typed; nothing under two characters."""
    if len(typed.strip()) < SEARCH_CHARS:
        return venues.limit(0)
    return venues.where(F.contains(F.lower("name"), F.lit(typed.strip().lower()))).orderBy("lid").limit(SEARCH_ROWS)


def by_id_or_slug(venues: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(key) with the lid of the venue of that id, else of that slug."""
    a = venues.select(F.col("id").alias("key"), F.col("lid").alias("_a"))
    b = venues.groupBy(F.col("slug").alias("key")).agg(F.min("lid").alias("_b"))
    return asked.join(a, "key", "left").join(b, "key", "left").select("key", F.coalesce("_a", "_b").alias("lid"))


def first_image(candidates: DataFrame) -> DataFrame:
    """candidates(lid, pos, status, content_type, width, height) -> (lid, pos, reason): the first of ten that passes, else the last one's reason."""
    reason = (
        F.when(F.col("status") != 200, "not fetched").when(~F.startswith("content_type", F.lit("image/")), "not an image")
        .when(F.greatest("width", "height") < LONG_EDGE, "too small").when(F.col("width") * F.col("height") < LEAST_PIXELS, "too small")
    )
    seen = candidates.where(F.col("pos") < CANDIDATES).withColumn("reason", reason)
    passed, last = F.min(F.when(F.col("reason").isNull(), F.col("pos"))), F.max_by("reason", "pos")
    return seen.groupBy("lid").agg(passed.alias("pos"), F.when(passed.isNull(), last).alias("reason"))


def zone_label(name: Column, with_deals: Column, venues: Column) -> Column:
    return F.concat(name, F.lit(" ("), F.coalesce(with_deals, venues).cast("string"), F.lit(" of "), venues.cast("string"), F.lit(")"))


#: What a registry's licence types are called, and any other.
LICENCE_LABELS = {
    "Restaurant (Liquor)": "Restaurant & bar",
    "Eating Place Retail Dispenser (Malt)": "Beer & food",
    "Hotel (Liquor)": "Hotel bar",
    "Brewery": "Brewery",
    "Brewery Pub": "Brewpub",
    "Limited Winery": "Winery tasting room",
    "Winery": "Winery",
    "Limited Distillery": "Distillery tasting room",
    "Distillery": "Distillery",
    "Airport Restaurant (Liquor)": "Airport restaurant",
    "Public Venue Restaurant": "Venue restaurant",
    "Performing Arts Facility": "Theatre bar",
    "Privately-Owned Public Golf Course Rest (Liquor)": "Golf club restaurant",
    "Municipal Golf Course (Liquor)": "Golf course restaurant",
    "Economic Development Restaurant (Liquor)": "Restaurant & bar",
}
OTHER_LICENCE = "Licensed venue"


def licence_label(licence_type: Column) -> Column:
    """A registry type in plain words."""
    names = F.create_map(*[F.lit(x) for pair in LICENCE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, licence_type), F.lit(OTHER_LICENCE))


def day_options(spark, today: str) -> DataFrame:
    """(ahead, label): Today, Tomorrow, then short names of the next five days."""
    date = F.date_add(F.lit(today).cast("date"), F.col("ahead"))
    return spark.range(7).select(F.col("id").cast("int").alias("ahead")).select("ahead", F.when(F.col("ahead") == 0, "Today").when(F.col("ahead") == 1, "Tomorrow").otherwise(F.date_format(date, "E")).alias("label"))


def arrival(slot: Column, ahead: Column, now: int) -> Column:
    """Minutes of the day to arrive at: slot -1 or one of today that is past is now; a later day without a slot is four in the afternoon."""
    return F.when((ahead == 0) & ((slot < 0) | (slot < now)), now).when(slot < 0, 16 * 60).otherwise(slot)


#: What a link says if it says nothing; the most days ahead and quarter hours of a day.
MOST_DAYS, MOST_SLOTS = 6, 96
SORTS = ("soonest", "nearest", "value")


def shared_state(fragment: Column) -> Column:
    """struct(day, slot, zone, filter, sort, venue) of a link's `#d=1&s=value`: numbers within bounds, names only if they are known.

    Of a key given twice the first counts; what isn't a number is day 0 and slot -1 (now); blank zones and venues are none.
    """
    text = F.regexp_replace(F.coalesce(fragment, F.lit("")), "^#", "")

    def of(key: str) -> Column:
        return F.when(text.rlike(f"(?:^|&){key}(?:=|&|$)"), F.try_url_decode(F.regexp_extract(text, f"(?:^|&){key}=?([^&]*)", 1)))

    def number(key: str, low: int, high: int, other: int) -> Column:
        n = F.when(F.trim(of(key)) == "", F.lit(0.0)).otherwise(F.trim(of(key)).try_cast("double"))
        return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(n, F.lit(float(other))).cast("int")))

    filled = lambda key: F.when(of(key) != "", of(key))
    return F.struct(
        number("d", 0, MOST_DAYS, 0).alias("day"), F.when(of("t").isNull(), -1).otherwise(number("t", -1, MOST_SLOTS, -1)).alias("slot"), filled("z").alias("zone"),
        F.when(of("f").isin(*FILTERS), of("f")).otherwise("all").alias("filter"), F.when(of("s").isin(*SORTS), of("s")).otherwise("soonest").alias("sort"), filled("v").alias("venue"),
    )


def shared_link(state: Column) -> Column:
    """The fragment that shared_state reads as state; what is as it would be anyway is left out, and nothing is ''."""
    told = (
        ("d", F.when(state["day"] != 0, state["day"].cast("string"))), ("t", F.when(state["slot"] >= 0, state["slot"].cast("string"))), ("z", state["zone"]),
        ("f", F.when(state["filter"] != "all", state["filter"])), ("s", F.when(state["sort"] != "soonest", state["sort"])), ("v", state["venue"]),
    )
    pairs = F.concat_ws("&", *[F.concat(F.lit(f"{key}="), F.url_encode(value)) for key, value in told])
    return F.when(pairs == "", "").otherwise(F.concat(F.lit("#"), pairs))
