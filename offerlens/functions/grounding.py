"""Proposals are kept only where the venue's own words hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions.text import normal
from offerlens.operators.validate import BANNED, CATEGORIES

LABEL_CHARS, MOST_PRICE = 30, 99


def plain_number(x: Column) -> Column:
    """5 for 5.0, 7.5 for 7.50."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.regexp_replace(F.format_string("%.2f", x), "0$", ""))


def refusal(evidence: Column, text: Column, category: Column, label: Column, price: Column, pct: Column) -> Column:
    """Why a proposed item is not kept, by the first rule that it breaks; null if it is."""
    said, name = normal(evidence), F.trim(F.coalesce(label, F.lit("")))
    forms = [F.concat(F.lit("$"), plain_number(price)), F.concat(F.lit("$"), F.format_string("%.2f", price)), F.concat(plain_number(price), F.lit(" dollar"))]
    written = F.lit(False)
    for form in forms:
        written = written | F.contains(said, form)
    out = F.when(F.length(F.coalesce(evidence, F.lit(""))) < 3, "no evidence").when(~F.contains(normal(text), said), "evidence not in the quote")
    out = out.when(~F.coalesce(category.isin(*CATEGORIES), F.lit(False)), "category").when(~F.length(name).between(1, LABEL_CHARS), "label length")
    for pattern in BANNED:
        out = out.when(name.rlike(f"(?i){pattern}"), "unlawful claim")
    return (
        out.when(price.isNull() == pct.isNull(), "needs exactly one of price and discount")
        .when(price.isNotNull() & ~((price > 0) & (price <= MOST_PRICE)), "implausible price").when(price.isNotNull() & ~written, "price not written in the evidence")
        .when(pct.isNotNull() & ~((pct > 0) & (pct < 100)), "implausible discount")
        .when(pct.isNotNull() & ~(F.contains(said, F.concat(plain_number(pct), F.lit("%"))) | F.contains(said, F.lit("half"))), "discount not written in the evidence")
    )


def grounded(deals: Column, transcript: Column) -> Column:
    """Deals with the items whose quote the transcript holds; a deal with neither items nor windows goes."""
    heard = normal(transcript)
    kept = F.transform(deals, lambda d: d.withField("items", F.filter(F.coalesce(d["items"], F.array()), lambda i: (normal(i["quote"]) != "") & F.contains(heard, normal(i["quote"])))))
    return F.filter(kept, lambda d: (F.size(d["items"]) > 0) | (F.size(F.coalesce(d["windows"], F.array())) > 0))


def ungrounded(deals: Column, transcript: Column) -> Column:
    """Labels of the items that go."""
    heard = normal(transcript)
    items = F.flatten(F.transform(deals, lambda d: F.coalesce(d["items"], F.array())))
    return F.transform(F.filter(items, lambda i: ~((normal(i["quote"]) != "") & F.contains(heard, normal(i["quote"])))), lambda i: i["label"])


def name_differs(on_menu: Column, picked: Column) -> Column:
    """Does the name on the menu, its first twelve characters, not occur in the venue that was picked?"""
    return ~F.contains(F.lower(picked), F.left(F.lower(on_menu), F.lit(12)))
