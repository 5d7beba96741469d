"""Statutory and structural rules for offers, and what happens to the ones that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.ranking import minutes
from offerlens.functions.schedule import let

#: Fixed values of the rules.
TYPES = ("happy_hour", "daily_special", "food_combo")
CATEGORIES = ("draft", "bottle_can", "wine", "well", "call", "cocktail", "shot", "food")
CONFIDENCE = ("verified", "likely", "unconfirmed", "disputed")
KINDS = ("venue_site", "roundup", "aggregator", "instagram", "photo")
BANNED = ("all[- ]you[- ]can[- ]drink", "bottomless", "free drink", "two for one|2 for 1|2-for-1", "unlimited")
DAY_MINUTES, WEEK_MINUTES = 4 * 60, 24 * 60
COMBOS_A_DAY = 2


def _when(condition: Column, text: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(text))


def window_state(start: Column, end: Column) -> Column:
    """`ok`, `malformed` or `past midnight` for a window of clock strings."""
    return _state(minutes(start), minutes(end))


def _state(s: Column, e: Column) -> Column:
    return F.when(s.isNull() | e.isNull(), "malformed").when((e > 1440) | (e <= s), "past midnight").otherwise("ok")


def deal_errors(type_: Column, confidence: Column, windows: Column, items: Column, fine_print: Column, source: Column) -> Column:
    """The broken rules of a whole offer, in order; empty if it can be published.

    windows: array<struct<dow,start,end>> of clock strings; items and source as the schemas have them.
    Clocks are read once, as are the words.
    """
    ws, its = F.coalesce(windows, F.array().cast(WINDOWS)), F.coalesce(items, F.array().cast(ITEMS))
    timed = F.transform(ws, lambda w: F.struct(w["dow"].alias("dow"), minutes(w["start"]).alias("s"), minutes(w["end"]).alias("e")))
    stated = lambda t: F.transform(t, lambda w: F.struct(w["dow"].alias("dow"), (w["e"] - w["s"]).alias("span"), _state(w["s"], w["e"]).alias("state")))
    said = F.lower(F.concat_ws(" ", F.coalesce(fine_print, F.lit("")), F.array_join(F.transform(its, lambda i: F.coalesce(i["label"], F.lit(""))), " ")))
    happy, roundup = type_ == "happy_hour", source["kind"] == "roundup"

    def total(spans: Column, dow: Column | None) -> Column:
        return F.aggregate(spans, F.lit(0), lambda a, w: a + (w["span"] if dow is None else F.when(w["dow"] == dow, w["span"]).otherwise(0)))

    def capped(spans: Column) -> Column:
        days = F.array_distinct(F.transform(spans, lambda w: w["dow"]))
        return F.array(_when(happy & F.exists(days, lambda d: total(spans, d) > DAY_MINUTES), "exceeds the 4h/day cap"), _when(happy & (total(spans, None) > WEEK_MINUTES), "exceeds the 24h/week cap"))

    def of_windows(w: Column) -> Column:
        has = lambda state: F.exists(w, lambda x: x["state"] == state)
        return F.concat(
            F.array(
                _when(F.size(w) == 0, "no windows"), _when(has("malformed"), "malformed window"), _when(F.exists(w, lambda x: (x["state"] != "malformed") & ~x["dow"].between(1, 7)), "dow out of range"),
                _when(has("past midnight"), "window extends past midnight"),
            ),
            let(F.filter(w, lambda x: x["state"] == "ok"), capped),
        )

    checks = [
        F.array(_when(~F.coalesce(type_.isin(*TYPES), F.lit(False)), "unknown deal type"), _when(~F.coalesce(confidence.isin(*CONFIDENCE), F.lit(False)), "unknown confidence")),
        let(timed, lambda t: let(stated(t), of_windows)),
        let(said, lambda words: F.array(*[_when(words.rlike(p), f"unlawful claim: {p}") for p in BANNED])),
        F.array(
            _when(F.exists(its, lambda i: ~F.coalesce(i["category"].isin(*CATEGORIES), F.lit(False))), "unknown item category"),
            _when(F.exists(its, lambda i: i["price_usd"].isNull() & i["discount_pct"].isNull() & i["amount_off_usd"].isNull()), "item has neither a price nor a discount"),
            _when((F.coalesce(source["url"], F.lit("")) == "") & (F.coalesce(source["photo_id"], F.lit("")) == ""), "no source"),
            _when(~F.coalesce(source["kind"].isin(*KINDS), F.lit(False)), "unknown source kind"),
            _when(roundup & (F.coalesce(source["outlet"], F.lit("")) == ""), "roundup must name who said it"),
            _when(roundup & ~F.coalesce(source["published"], F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}$"), "roundup recency cannot be gated"),
            _when(roundup & (F.coalesce(confidence, F.lit("")) != "unconfirmed"), "roundup caps at unconfirmed"),
        ),
    ]
    return F.filter(F.concat(*checks), lambda x: x.isNotNull())


WINDOWS = "array<struct<dow:int,start:string,end:string>>"
ITEMS = "array<struct<category:string,label:string,price_usd:double,discount_pct:double,amount_off_usd:double>>"


def hour_caps(windows: DataFrame) -> DataFrame:
    """(deal_id, most_in_a_day, in_a_week) minutes of the sound windows, by two partial sums."""
    sound = windows.where((F.col("end") <= 1440) & (F.col("end") > F.col("start")) & F.col("dow").between(1, 7))
    days = sound.groupBy("deal_id", "dow").agg(F.sum(F.col("end") - F.col("start")).alias("m"))
    return days.groupBy("deal_id").agg(F.max("m").alias("most_in_a_day"), F.sum("m").alias("in_a_week"))


def flat_errors(deals: DataFrame, windows: DataFrame, items: DataFrame) -> DataFrame:
    """deals with `first_error`, the first broken rule over flat tables, null if publishable."""
    unknown = items.groupBy("deal_id").agg(
        F.bool_or(~F.col("category").isin(*CATEGORIES)).alias("bad_category"), F.bool_or(F.col("price").isNull() & F.col("pct").isNull() & F.col("off").isNull()).alias("bare")
    )
    joined = deals.join(hour_caps(windows), "deal_id", "left").join(unknown, "deal_id", "left")
    happy = F.col("type") == "happy_hour"
    error = (
        F.when(~F.col("type").isin(*TYPES), "unknown deal type").when(~F.col("confidence").isin(*CONFIDENCE), "unknown confidence").when(F.col("in_a_week").isNull(), "no windows")
        .when(happy & (F.col("most_in_a_day") > DAY_MINUTES), "exceeds the 4h/day cap").when(happy & (F.col("in_a_week") > WEEK_MINUTES), "exceeds the 24h/week cap")
        .when(F.col("bad_category"), "unknown item category").when(F.col("bare"), "item has neither a price nor a discount")
    )
    return joined.withColumn("first_error", error)


def combo_cap(deals: DataFrame, windows: DataFrame, most: int = COMBOS_A_DAY) -> DataFrame:
    """deals of venues that never offer more than `most` food combos on one day, each window counted; of the others none stays."""
    combos = deals.where(F.col("type") == "food_combo").select("deal_id", "lid").join(windows.select("deal_id", "dow"), "deal_id")
    over = combos.groupBy("lid", "dow").count().where(F.col("count") > most).select("lid").distinct()
    return deals.join(over, "lid", "left_anti")


def one_a_day(windows: Column) -> Column:
    """One of an array of windows per weekday: the longest in whole hours, of equals the first; by weekday."""

    def hours(w: Column) -> Column:
        return F.floor(minutes(w["end"]) / 60) - F.floor(minutes(w["start"]) / 60)

    def first(mine: Column) -> Column:
        return F.aggregate(mine, F.try_element_at(mine, F.lit(1)), lambda best, w: F.when(w["hours"] > best["hours"], w).otherwise(best))

    # clocks are read once, for all days
    timed = F.transform(windows, lambda w: F.struct(w.alias("w"), hours(w).alias("hours")))
    longest = let(timed, lambda ws: F.transform(F.array(*map(F.lit, range(1, 8))), lambda day: let(F.filter(ws, lambda w: w["w"]["dow"] == day), first)))
    return F.transform(F.filter(longest, lambda w: w.isNotNull()), lambda w: w["w"])


def distinct_days(windows: Column) -> Column:
    """On how many weekdays an array of windows lies."""
    return F.size(F.array_distinct(F.transform(windows, lambda w: w["dow"])))


def extracted(hits: DataFrame) -> DataFrame:
    """(lid, lead, windows, errors): hits(lid, pos, quote, url, windows) of a venue's site as one happy hour.

    The lead is the hit with the most weekdays, then the longest quote, then the first. The windows of all hits are taken
    together, in that order; if they break a rule, the lead's alone; errors are what is broken then.
    """
    order = F.struct((-distinct_days(F.col("windows"))).alias("days"), (-F.length("quote")).alias("n"), "pos")
    said = hits.where(F.size("windows") > 0).groupBy("lid").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct("pos", "quote", "url").alias("lead"), "windows"))).alias("c"))
    pooled, lead = one_a_day(F.flatten(F.transform("c", lambda c: c["windows"]))), one_a_day(F.col("c")[0]["windows"])
    rows = said.select("lid", F.col("c")[0]["lead"].alias("lead"), pooled.alias("pooled"), lead.alias("own"))
    source = F.struct(F.lit("venue_site").alias("kind"), F.col("lead.url").alias("url"), F.lit("").alias("photo_id"), F.lit("").alias("outlet"), F.lit("").alias("published"))
    check = lambda c: deal_errors(F.lit("happy_hour"), F.lit("unconfirmed"), F.col(c), F.lit(None).cast(ITEMS), F.lit(""), source)
    checked = rows.select("*", check("pooled").alias("_p"), check("own").alias("_o"))
    back = F.size("_p") > 0
    return checked.select("lid", "lead", F.when(back, F.col("own")).otherwise(F.col("pooled")).alias("windows"), F.when(back, F.col("_o")).otherwise(F.col("_p")).alias("errors"))
