"""From offers of all sources to the board: prices, rules, decay, the cap on combinations, one licence's offers for each card.

The chain is one plan of joins and groupings on the offer, the licence and the address; nothing of it is collected. Whoever uses one of its tables
more than once writes it (session.written).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import ranking as R
from offerlens.operators import publish
from offerlens.operators.validate import COMBOS_A_DAY


def offers(priced: DataFrame, errors: Column) -> DataFrame:
    """priced with what became of each offer: `rejected: ` and the first broken rule, `hidden` by age, or null for those that stay.

    priced: offers with the prices that were read later filled in (publish.with_prices), as the rules are held against them too; errors: the rules
    broken, over its columns.
    """
    first = F.try_element_at(errors, F.lit(1))
    shown = R.effective_confidence(F.col("confidence"), F.col("age_days"))
    return priced.withColumn("fate", F.when(first.isNotNull(), F.concat(F.lit("rejected: "), first)).when(shown == "hidden", "hidden"))


def capped(kept: DataFrame, most: int = COMBOS_A_DAY) -> DataFrame:
    """kept without the offers of venues that have a day with more combinations than allowed: such a venue's offers go, all of them.

    kept: one row an offer with venue, type and windows(dow); a combination counts once for each of its windows.
    """
    days = kept.where("type = 'food_combo'").select("venue", F.explode("windows.dow").alias("dow")).groupBy("venue", "dow").agg(F.count("*").alias("n"))
    return kept.join(days.where(F.col("n") > most).select("venue").distinct(), "venue", "left_anti")


def cards(kept: DataFrame, venues: DataFrame, base: DataFrame) -> DataFrame:
    """(key, lid, venue, deals): the offers of each card, in their order, those of one venue alone.

    venues(venue, pos, lid, addr) come in the order pos; a venue's card is the row of base that has its licence among its own, else the first at
    its address, else its own under `orphan:`. Where venues share a card, the one with the most offers has it, the first among equals.
    """
    held = kept.groupBy("venue").agg(F.sort_array(F.collect_list(F.struct("deal_pos", "deal_id", "confidence", "items_source"))).alias("deals"))
    placed = publish.canonical(held.join(venues, "venue").withColumnRenamed("venue", "id"), base)
    key = F.coalesce(F.col("canonical").cast("string"), F.concat(F.lit("orphan:"), F.col("id").cast("string")))
    # partial aggregates: of a card's venues only the best so far is kept
    richest = placed.groupBy(key.alias("key")).agg(F.max_by(F.struct(F.col("canonical").alias("lid"), F.col("id").alias("venue"), "deals"), F.struct(F.size("deals"), -F.col("pos"))).alias("v"))
    return richest.select("key", "v.lid", "v.venue", "v.deals")


def board(richest: DataFrame, venues: DataFrame, base: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone_id, zone, key, lid, venue, name, deals): cards with offers, and every other row of base that is in a zone, by its licence.

    A card with offers stands in its venue's zone and has the venue's name where a person read it, else that of base; zones(zone_id, name) gives
    a zone's name, its id where it has none.
    """
    told = richest.join(venues.select("venue", F.col("zone_id").alias("venue_zone"), F.col("name").alias("venue_name"), "verified_by"), "venue")
    met = base.select("lid", F.col("zone_id").alias("base_zone"), F.col("name").alias("base_name")).join(told, "lid", "full_outer")
    by_hand = F.coalesce(F.col("verified_by") != "auto_extract", F.lit(False))
    name = F.when(by_hand, F.col("venue_name")).otherwise(F.coalesce("base_name", "venue_name"))
    rows = met.select(
        F.coalesce("venue_zone", "base_zone").alias("zone_id"), F.coalesce("key", F.col("lid").cast("string")).alias("key"), "lid", "venue", name.alias("name"), F.coalesce("deals", F.array().cast(richest.schema["deals"].dataType)).alias("deals")
    ).where("zone_id IS NOT NULL AND zone_id <> ''")
    return rows.join(zones.select("zone_id", F.col("name").alias("zone")), "zone_id", "left").withColumn("zone", F.coalesce("zone", "zone_id"))


def index(rows: DataFrame) -> DataFrame:
    """(zone_id, zone, venues, with_deals, deals) for the picker of zones."""
    return rows.groupBy("zone_id", "zone").agg(F.count("*").alias("venues"), F.count_if(F.size("deals") > 0).alias("with_deals"), F.sum(F.size("deals")).alias("deals"))
