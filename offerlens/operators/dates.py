"""When was a page published? JSON-LD blocks first, then meta tags, a time element, and a date in its prose.

A date of last change is never taken: a site that stamps all its pages every night would look new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import pagetext
from offerlens.functions.schedule import let
from offerlens.session import written

#: Keys whose string values are dates of publication, in the order in which a record's own are taken. Fixed values.
DATE_KEYS = ("datePublished", "dateCreated", "uploadDate")
#: Names of meta tags that hold one. Fixed values.
META_NAMES = ("article:published_time", "datePublished", "pubdate", "date")
_STRICT = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false"}


def iso_date(text: Column) -> Column:
    """The first year-month-day in text, wherever it stands; null if there is none or the calendar lacks it."""
    found = F.regexp_extract(text, "[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)
    return F.when(~found.startswith("0000"), F.try_to_date(F.nullif(found, F.lit("")), "yyyy-MM-dd"))


def _given(attribute: str, *values: str) -> str:
    return f"{attribute}=[\"'](?:{'|'.join(values)})[\"']"


def _held(attribute: str) -> str:
    return f"{attribute}=[\"']([^\"']+)"


def _in_tag(html: Column, tag: str, *parts: str) -> Column:
    """What the first such tag holds whose attributes come in this order."""
    return iso_date(F.regexp_extract(html, f"(?is)<{tag}" + "".join("[^>]+" + p for p in parts), 1))


def tag_date(html: Column) -> Column:
    """The date of the first meta tag, or else time element, that holds one."""
    own, held = _given("property", META_NAMES[0]), _held("content")
    return F.coalesce(_in_tag(html, "meta", own, held), _in_tag(html, "meta", _given("name", *META_NAMES), held), _in_tag(html, "meta", held + "[\"']", own), _in_tag(html, "time", _held("datetime")))


def prose_date(text: Column) -> Column:
    """The first `month day, year` of the first 4000 characters; null if the calendar lacks that day."""
    spoken = rf"(?i)\b({'|'.join(pagetext.MONTHS)})\s+(\d{{1,2}}),\s+(\d{{4}})\b"

    def read(found: Column) -> Column:
        month = F.array_position(F.array(*map(F.lit, pagetext.MONTHS)), F.lower(F.regexp_extract(found, spoken, 1)))
        day = F.coalesce(F.regexp_extract(found, spoken, 2).try_cast("int"), F.lit(0))
        return F.when(month > 0, iso_date(F.format_string("%s-%02d-%02d", F.regexp_extract(found, spoken, 3), month.cast("int"), day)))

    return let(F.regexp_extract(F.left(text, F.lit(4000)), spoken, 0), read)  # the text is made once, and read again only where it speaks of a day


def linked_values(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, at, value): strings under DATE_KEYS in the JSON-LD blocks of pages; the least `at` of a page is the one to take first.

    A block that is no JSON is skipped alone. Objects and lists are opened level by level, all pages' at once: a level is one pass over the
    values of the level before, so there are as many passes as the deepest block has levels. The order is that of a stack: a record's
    own dates, then its parts from the last to the first, each with all that is in it. `at` is the block, the way
    down (places from the end) and the key.
    """
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*?application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    raw = pages.select(F.col(key).alias("key"), F.posexplode(found).alias("block", "raw"))
    blocks = raw.select("key", "block", pagetext.decoded(F.col("raw")).alias("text")).where(F.try_parse_json("text").isNotNull())
    level = written(blocks.select("key", "block", F.array().cast("array<int>").alias("way"), F.trim("text").alias("text")), "json_levels")
    out = level.select("key", F.struct("block", "way", F.lit(0).alias("name")).alias("at"), F.lit("").alias("value")).where("false")
    while not level.isEmpty():
        # twice: the text keeps the order of members further down, the variant knows what is a string
        parts = [F.from_json("text", f"map<string,{t}>", _STRICT) for t in ("string", "variant")]
        members = level.where(F.col("text").startswith("{")).select("key", "block", "way", F.posexplode(F.arrays_zip(F.map_keys(parts[0]).alias("name"), F.map_values(parts[0]).alias("text"), F.map_values(parts[1]).alias("v"))).alias("pos", "m"))
        listed = [F.from_json("text", f"array<{t}>", _STRICT) for t in ("string", "variant")]
        entries = level.where(F.col("text").startswith("[")).select("key", "block", "way", F.posexplode(F.arrays_zip(listed[0].alias("text"), listed[1].alias("v"))).alias("pos", "m"))
        open_ = [members.select("key", "block", "way", "pos", "m.name", "m.text", F.schema_of_variant("m.v").alias("kind")), entries.select("key", "block", "way", "pos", F.lit(None).cast("string").alias("name"), "m.text", F.schema_of_variant("m.v").alias("kind"))]
        both = written(open_[0].union(open_[1]), "json_levels")
        rank = F.array_position(F.array(*map(F.lit, DATE_KEYS)), F.col("name")).cast("int")
        out = out.union(both.where(F.col("kind") == "STRING").where(rank > 0).select("key", F.struct("block", "way", rank.alias("name")), "text"))
        level = both.where(F.col("kind").rlike("^(OBJECT|ARRAY)")).select("key", "block", F.concat("way", F.array(-F.col("pos"))).alias("way"), F.trim("text").alias("text"))
    return out


def published(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """pages with `published`, null where nothing tells it; key must be a page's own."""
    linked = linked_values(pages, key, html).select("key", "at", iso_date(F.col("value")).alias("date")).where("date IS NOT NULL")
    first = linked.groupBy("key").agg(F.min_by("date", "at").alias("__linked")).withColumnRenamed("key", "__key")
    rows = pages.join(first, F.col(key) == F.col("__key"), "left")
    return rows.withColumn("published", F.coalesce("__linked", tag_date(F.col(html)), prose_date(pagetext.visible_text(F.col(html))))).drop("__key", "__linked")
