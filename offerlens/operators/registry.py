"""The licence registry: why a row is dropped, which zone and tier it falls into, and one row per premises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions import ranking as R
from offerlens.functions import text as T

#: Licence types by tier.
CORE = (
    "Restaurant (Liquor)", "Eating Place Retail Dispenser (Malt)", "Hotel (Liquor)", "Hotel (Malt)", "Brewery Pub", "Public Venue Restaurant",
    "Economic Development Restaurant (Liquor)", "Economic Development Eating Place (Malt)", "Airport Restaurant (Liquor)", "Off-Track Wagering Restaurant (Liquor)",
    "Privately-Owned Public Golf Course Rest (Liquor)", "Privately Owned Public Golf Course (Malt)", "Municipal Golf Course (Liquor)", "Municipal Golf Course (Malt)",
    "Performing Arts Facility",
)
TAPROOM = ("Brewery", "Brewery Storage", "Limited Winery", "Limited Distillery", "Distillery", "Winery", "Distillery of Historic Significance")
CLUB = ("Club (Liquor)", "Club (Malt)", "Catering Club (Liquor)", "Privately Owned Private Golf Club", "Privately Owned Private Golf Club Catering Club")
EXCLUDED = ("Brewery Storage",)


def tier(licence_type: Column, core: tuple = CORE, taproom: tuple = TAPROOM, club: tuple = CLUB) -> Column:
    return F.when(licence_type.isin(*core), "core").when(licence_type.isin(*taproom), "taproom").when(licence_type.isin(*club), "club")


def walk_in(licences: DataFrame) -> DataFrame:
    """The licences of places that one can go to: storage permits are none."""
    return licences.where(~F.coalesce(F.col("licence_type").isin(*EXCLUDED), F.lit(False)))


def drop_reason(tier_: Column, status: Column, in_scope: Column, zip_code: Column, centroid: Column, miles: Column, radius: float) -> Column:
    """The first reason that applies, in this order; null for a row that stays."""
    return (
        F.when(F.lower(F.coalesce(status, F.lit(""))) != "active", "not active")
        .when(tier_ == "club", "private club")
        .when(tier_.isNull(), "not on-premises")
        .when(~F.coalesce(in_scope, F.lit(False)), "county out of scope")
        .when(zip_code.isNull(), "no zip")
        .when(centroid.isNull(), "zip not in gazetteer")
        .when(miles > radius, "outside radius")
    )


def located(licences: DataFrame, centroids: DataFrame, origin: tuple[float, float]) -> DataFrame:
    """licences with their ZIP's centroid (null if there is none) and its distance from origin; a later centroid of a ZIP replaces an earlier one."""
    last = centroids.groupBy("zip").agg(F.max_by(F.struct("zip_lat", "zip_lng"), "ordinal").alias("c")).select("zip", "c.zip_lat", "c.zip_lng")
    joined = licences.join(last, "zip", "left")
    return joined.withColumn("miles", R.haversine_miles(F.lit(origin[0]), F.lit(origin[1]), F.col("zip_lat"), F.col("zip_lng")))


def zoned(licences: DataFrame, by_place: DataFrame, by_zip: DataFrame) -> DataFrame:
    """zone_id by municipality and county, else by ZIP, else empty."""
    a = by_place.select(F.col("place"), F.col("zone_id").alias("_a"))
    b = by_zip.select(F.col("zip"), F.col("zone_id").alias("_b"))
    return licences.join(a, "place", "left").join(b, "zip", "left").withColumn("zone_id", F.coalesce("_a", "_b", F.lit(""))).drop("_a", "_b")


def premises(licences: DataFrame) -> DataFrame:
    """One row per premises (name and address, whatever their case): the first licence's columns, all its numbers, core if any is."""
    key = [F.lower(F.trim("name")).alias("_n"), F.lower(F.trim("address")).alias("_a")]
    return licences.groupBy(*key).agg(
        F.min_by(F.struct("lid", "name", "address", "zone_id"), "lid").alias("f"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lid", "number"))), lambda x: x["number"]), "|").alias("numbers"),
        F.when(F.bool_or(F.col("tier") == "core"), "core").otherwise(F.min_by("tier", "lid")).alias("tier"),
    ).select("f.*", "numbers", "tier")


def collapsed(venues: DataFrame, key: str = "premises_key") -> DataFrame:
    """Of the licences of one premises the richest (photo, site, place known; then the lowest lid), and the others as also_lids."""
    rank = F.struct((~F.col("has_photo")).alias("a"), (~F.col("has_site")).alias("b"), (~F.col("has_lat")).alias("c"), F.col("lid").alias("lid"))
    grouped = venues.groupBy(key).agg(F.min(rank)["lid"].alias("lid"), F.collect_set("lid").alias("all"))
    return grouped.select(key, "lid", F.array_sort(F.array_remove("all", F.col("lid"))).alias("also_lids"))


def zone_counts(licences: DataFrame) -> DataFrame:
    """Per zone and in total: rows, core rows, taproom rows; rows without a zone count as `(unzoned)`."""
    zone = F.when(F.coalesce("zone_id", F.lit("")) == "", "(unzoned)").otherwise(F.col("zone_id"))
    counted = licences.withColumn("zone", zone).rollup("zone").agg(F.count("*").alias("n"), F.count_if(F.col("tier") == "core").alias("n_core"), F.count_if(F.col("tier") == "taproom").alias("n_taproom"), F.grouping("zone").alias("_total"))
    return counted.withColumn("zone", F.when(F.col("_total") == 1, "(total)").otherwise(F.col("zone"))).drop("_total")


#: What the lines of sums are called, and the zone that is marked as off by default. Fixed values.
UNZONED, NAMED, TOTAL, MARKED = "(unzoned)", "in a named zone", "total", "center_city"


def zone_report(licences: DataFrame, zones: DataFrame) -> DataFrame:
    """(line, label, n, core, taproom): the zones(zone_id, name, pos) that have rows, in their order, then those without a zone, those with one together, and all.

    One pass with grouping sets: by zone, by whether there is one, and over all. A zone that zones lacks is not listed but counts in the sums.
    """
    zone = F.coalesce(F.nullif("zone_id", F.lit("")), F.lit(UNZONED))
    rows = licences.select(zone.alias("zone"), (zone != UNZONED).alias("named"), (F.col("tier") == "core").alias("core"))
    sets = rows.groupingSets([[F.col("named"), F.col("zone")], [F.col("named")], []], F.col("named"), F.col("zone"))
    counted = sets.agg(F.count("*").alias("n"), F.count_if("core").alias("core"), F.grouping("zone").alias("sum"), F.grouping("named").alias("all"))
    met = counted.join(zones.select(F.col("zone_id").alias("zone"), F.col("name"), "pos"), "zone", "left")
    own = F.col("sum") == 0
    label = F.when(F.col("all") == 1, TOTAL).when(~own, NAMED).otherwise(F.concat(F.coalesce("name", "zone"), F.when(F.col("zone") == MARKED, " *").otherwise("")))
    line = F.when(F.col("all") == 1, 3).when(~own, 2).when(F.col("zone") == UNZONED, 1).otherwise(0)
    kept = met.where(F.when(own, F.col("pos").isNotNull() | (F.col("zone") == UNZONED)).otherwise(F.coalesce("named", F.lit(True))))
    return kept.select(F.struct(line.alias("part"), F.coalesce("pos", F.lit(0)).alias("pos")).alias("line"), label.alias("label"), "n", "core", (F.col("n") - F.col("core")).alias("taproom"))


def site_of(tags: Column) -> Column:
    """The first web address among the tags that may hold one, the chain's own page last."""
    return F.coalesce(*[F.when(F.startswith(F.trim(tags[k]), F.lit("http")), F.trim(tags[k])) for k in ("website", "contact:website", "url", "brand:website")])


def slugged(venues: DataFrame) -> DataFrame:
    """slug per venue; the first holder of a slug keeps it, later ones get their lid behind it."""
    base = venues.withColumn("base", T.slug(F.col("name"), F.col("city")))
    first = F.min("lid").over(Window.partitionBy("base"))
    return base.withColumn("slug", F.when(F.col("lid") == first, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("lid").cast("string"))))
