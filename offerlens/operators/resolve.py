"""Entity resolution: registry rows and map elements, by address, by number and street, by name.

A tier is consulted only for rows that the tiers before left alone, and the weaker tiers only where
the key is unique, so a wrong neighbour is never taken for the venue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import text as T


def keyed_elements(elements: DataFrame) -> DataFrame:
    """elements(place_id, place_name, zip, number, street, locality, website) with core and name_core; repeated keys prefer a website, then the first."""
    core = T.street_core(F.col("street"))
    return elements.withColumns({"core": core, "place_core": T.name_core(F.col("place_name"))})


def localities(city: Column, zip_code: Column) -> Column:
    """Where a row can be pinned to, best first: its city, then its ZIP."""
    place, five = F.lower(F.trim(F.coalesce(city, F.lit("")))), F.left(F.coalesce(zip_code, F.lit("")), F.lit(5))
    return F.array_compact(F.array(F.when(place != "", F.concat(F.lit("city "), place)), F.when(F.length(five) == 5, F.concat(F.lit("zip "), five))))


def tiered_match(licences: DataFrame, elements: DataFrame) -> DataFrame:
    """(lid, place_id, matched_by): address, then number and street if one element has them, then name in a locality if unique there on both sides.

    licences(lid, zip, number, core, localities, lic_core). Joins against reduced build sides; the first tier that hit wins, and of
    localities the first in which the name is unique.
    """
    best = F.min(F.struct(F.col("website").isNull().alias("a"), F.col("place_id").alias("id")))["id"]
    exact = elements.where("zip IS NOT NULL AND core <> ''").groupBy("zip", "number", "core").agg(best.alias("_1"))
    street = elements.where("core <> ''").groupBy("number", "core").agg(F.count("*").alias("_n"), F.min("place_id").alias("_2")).where("_n = 1").drop("_n")
    placed = elements.where("place_core <> ''").select(F.explode("localities").alias("loc"), F.col("place_core").alias("lic_core"), "place_id")
    named = placed.groupBy("loc", "lic_core").agg(F.count("*").alias("_n"), F.min("place_id").alias("_3")).where("_n = 1").drop("_n")
    held = licences.where("lic_core <> ''").select("lid", "lic_core", F.posexplode("localities").alias("_pos", "loc"))
    alone = held.groupBy("loc", "lic_core").agg(F.count("*").alias("_m"), F.min("lid").alias("lid"), F.min("_pos").alias("_pos")).where("_m = 1")
    third = alone.join(named, ["loc", "lic_core"]).groupBy("lid").agg(F.min_by("_3", "_pos").alias("_3"))
    joined = licences.join(exact, ["zip", "number", "core"], "left").join(street, ["number", "core"], "left").join(third, "lid", "left")
    by = F.when(F.col("_1").isNotNull(), "address").when(F.col("_2").isNotNull(), "number+street").when(F.col("_3").isNotNull(), "name")
    return joined.select("lid", F.coalesce("_1", "_2", "_3").alias("place_id"), by.alias("matched_by")).where("place_id IS NOT NULL")


def collapse_shared(matches: DataFrame, licences: DataFrame, elements: DataFrame) -> DataFrame:
    """Where several licences claim one element, those stay whose name agrees with it; a lone claim stays."""
    claims = matches.groupBy("place_id").agg(F.count("*").alias("_claims"))
    named = matches.join(claims, "place_id").join(licences.select("lid", "name"), "lid").join(elements.select("place_id", "place_name"), "place_id")
    return named.where((F.col("_claims") < 2) | T.names_agree(F.col("name"), F.col("place_name"))).select("lid", "place_id", "matched_by")


def carry_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """new, and what old had guessed for venues that new lacks."""
    kept = old.where(F.startswith("matched_by", F.lit("guessed"))).join(new, "lid", "left_anti")
    return new.unionByName(kept)


#: Ways of acceptance that need no second look.
SAFE_MATCHES = ("street number", "suite number", "name + ZIP", "nearby search")


def acceptance(pairs: DataFrame) -> DataFrame:
    """pairs(lid, name, address, place_id, place_name, place_address) with why the place is accepted; null where it isn't."""
    ours, theirs = T.street_number(F.col("address")), T.street_number(F.col("place_address"))
    suite = F.regexp_extract("place_address", r"(?i)\b(?:ste|suite|unit|#)\s*([0-9]+)", 1)
    label = (
        F.when(ours == theirs, "street number").when((suite != "") & (suite == ours), "suite number")
        .when(T.places_agree(F.col("name"), F.col("place_name"), F.col("address"), F.col("place_address")), "name + ZIP")
    )
    return pairs.withColumn("matched_by", label)


def merge_frontier(sites: DataFrame, places: DataFrame, dropped: DataFrame) -> DataFrame:
    """sites, and safely matched places with a website for venues that have no site and aren't dropped by hand."""
    fit = places.where(F.col("matched_by").isin(*SAFE_MATCHES) & F.col("website").isNotNull())
    new = fit.join(sites, "lid", "left_anti").join(dropped, "lid", "left_anti")
    return sites.select("lid", "website", "matched_by").unionByName(new.select("lid", "website", "matched_by"))


def one_per_element(hits: DataFrame, sites: DataFrame) -> DataFrame:
    """(lid, n_hits, first_lid): of the licences of one map element the first, by lid as text, whose crawl found something; if none did, the first.

    hits(lid, n_hits), sites(lid, osm). A licence without an element stands for itself. first_lid is the element's place in the order of output.
    """
    known = sites.groupBy("lid").agg(F.min("osm").alias("osm"))
    lid = F.col("lid").cast("string")
    key = F.coalesce(F.concat(F.lit("element "), T.blank_to_null(F.col("osm"))), F.concat(F.lit("licence "), lid))
    best = F.min_by(F.struct("lid", "n_hits"), F.struct((F.col("n_hits") == 0).alias("none"), lid.alias("lid")))
    return hits.join(known, "lid", "left").groupBy(key.alias("key")).agg(best.alias("x"), F.min(lid).alias("first_lid")).select("x.*", "first_lid")


def first_in_order(candidates: DataFrame, key: str, rank: str, ok) -> DataFrame:
    """Of each key the first candidate, by rank, that meets ok."""
    columns = [c for c in candidates.columns if c != key]
    return candidates.where(ok).groupBy(key).agg(F.min_by(F.struct(*columns), rank).alias("x")).select(key, "x.*")


def by_number(nearby: DataFrame) -> DataFrame:
    """Of nearby(lid, address, rank, place_id, place_address) each licence's first place, by rank, whose street number is the licence's; none where no place has it.

    The nearest place is no answer: what stands next door is another business.
    """
    same = T.street_number(F.col("place_address")) == T.street_number(F.col("address"))
    return first_in_order(nearby.select("lid", "address", "rank", "place_id", "place_address"), "lid", "rank", same)


def right_wins(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left updated by right: a key's row is right's where right has one."""
    return right.unionByName(left.join(right.select(key).distinct(), key, "left_anti"))
