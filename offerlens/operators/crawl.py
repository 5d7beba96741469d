"""What happens to pages once they are landed: roundups and their mentions, leads and their proof, photo pages, proposals as offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import pagetext
from offerlens.functions import text as T
from offerlens.session import written

BLOCK_LINES, NAME_WORDS = 6, 2
QUOTE_CHARS = 2400
PHOTO_LINKS = r"(?i)gallery|galler|photo|about|our.?story|the.?space|venue|interior|food|menu|events?"
BEST_PHOTO_LINKS = r"(?i)gallery|photo|about"
HOST_ENDINGS, HOST_STARTS = (".com", ".net"), ("", "www.")


def roundup_verdict(robots_ok: Column, status: Column, published: Column, today: Column) -> Column:
    """Why an article is dropped, by the first reason; null if it is kept."""
    return (
        F.when(~robots_ok, "robots").when(status != 200, F.concat(F.lit("http "), status.cast("string"))).when(published.isNull(), "undated")
        .when(~pagetext.fresh_enough(published, today), "older than 120d")
    )


def mentions(articles: DataFrame, venues: DataFrame) -> DataFrame:
    """(lid, quotes): articles(url, zone_id, text) x venues(lid, zone_id, name) of the same zone whose name a line holds.

    A name of one word is too weak. The first line that names a venue counts, with the five lines
    after it; its offer lines are the mention. Lines meet names by zone and the name's first word,
    which a line must hold as a word, so a zone's lines never meet all of its venues. Words bring a
    code of their line alone, once for equal lines of a zone; the lines that may hold a name are then
    read in their articles, so no text is moved for each of its words.
    """
    named = venues.withColumn("core", T.name_core(F.col("name"))).where(F.size(F.split("core", " ")) >= NAME_WORDS).groupBy("zone_id", "core").agg(F.min("lid").alias("lid")).withColumn("word", F.split("core", " ")[0])
    kept = written(articles.select("url", "zone_id", F.split("text", "\n").alias("lines")), "articles")
    plain = lambda line: F.regexp_replace(F.lower(line), r"[^\w\s]", " ")
    words = lambda plain: F.array_distinct(F.array_remove(F.split(plain, r"\s+"), ""))
    said = kept.select("url", "zone_id", F.posexplode("lines").alias("at", "line")).withColumn("plain", plain(F.col("line"))).withColumn("code", F.xxhash64("plain"))
    by_word = said.select("zone_id", "code", F.explode(words(F.col("plain"))).alias("word")).distinct()
    lines = by_word.join(named, ["zone_id", "word"]).select("zone_id", "code", "word", "core", "lid")
    maybe = said.select("url", "zone_id", "at", "code").join(lines, ["zone_id", "code"]).drop("code")
    found = maybe.join(kept, ["url", "zone_id"]).withColumn("plain", plain(F.get("lines", F.col("at"))))
    hits = found.where(F.contains("plain", F.col("core")) & F.array_contains(words(F.col("plain")), F.col("word")))
    first = hits.groupBy("url", "lid").agg(F.min(F.struct("at", "lines")).alias("x"))
    quotes = pagetext.offer_quotes(F.array_join(F.slice(F.col("x.lines"), (F.col("x.at") + 1).cast("int"), BLOCK_LINES), "\n"))
    rows = first.select("lid", "url", F.posexplode(quotes).alias("pos", "quote"))
    ordered = rows.groupBy("lid").agg(F.sort_array(F.collect_list(F.struct("url", "pos", "quote"))).alias("q"))
    return ordered.select("lid", F.array_distinct(F.transform("q", lambda x: x["quote"])).alias("quotes"))


def joined_quotes(hits: DataFrame) -> DataFrame:
    """(lid, text): a venue's quotes in order, one to a line, as much as a reader takes at once."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "quote")))
    return hits.groupBy("lid").agg(F.left(F.array_join(F.transform(ordered, lambda x: x["quote"]), "\n"), F.lit(QUOTE_CHARS)).alias("text"))


def quotes_to_price(hits: DataFrame, deals: DataFrame) -> DataFrame:
    """joined_quotes of the venues that have an offer read by machine and without prices. deals(lid, verified_by, n_items)."""
    need = deals.where((F.col("verified_by") == "auto_extract") & (F.coalesce("n_items", F.lit(0)) == 0)).select("lid")
    return joined_quotes(hits.join(need, "lid", "left_semi"))


def leads(venues: DataFrame, seeds: DataFrame) -> DataFrame:
    """(lid, rank, url): known addresses first, then guessed hosts, endings before starts before stems."""
    known = seeds.select("lid", F.col("pos").alias("rank"), "url", F.lit(True).alias("seeded"))
    shapes = F.array(*[F.struct(F.lit(1000 * (i + 1)).alias("base"), F.lit(p).alias("start"), F.lit(t).alias("ending")) for i, (t, p) in enumerate((t, p) for t in HOST_ENDINGS for p in HOST_STARTS)])
    stems = venues.select("lid", F.posexplode(T.domain_stems(F.col("name"))).alias("k", "stem")).select("lid", "k", "stem", F.explode(shapes).alias("s"))
    guessed = stems.select("lid", (F.col("s.base") + F.col("k")).alias("rank"), F.concat(F.lit("https://"), "s.start", "stem", "s.ending").alias("url"), F.lit(False).alias("seeded"))
    return known.unionByName(guessed)


def proven_sites(leads_: DataFrame, fetched: DataFrame, venues: DataFrame) -> DataFrame:
    """(lid, website, matched_by): of each venue the first lead whose landed page proves itself. venues(lid, name, places)."""
    pages = leads_.join(fetched, "url").join(venues, "lid")
    why = T.proven(F.col("text"), T.proof_words(F.col("name")), F.col("places"))
    how = F.concat(F.lit("guessed "), F.when(F.col("seeded"), "seed URL").otherwise("guessed domain"), F.lit(", proved by "), F.col("why"))
    found = pages.withColumn("why", why).where("why IS NOT NULL").withColumn("how", how)
    return found.groupBy("lid").agg(F.min_by(F.struct(F.col("url").alias("website"), F.col("how").alias("matched_by")), "rank").alias("x")).select("lid", "x.*")


def photo_pages(html: Column, page: Column, most: int = 2) -> Column:
    """Pages of the same host that may show the room, galleries first, in page order within a rank."""
    named = F.filter(pagetext.anchors(html), lambda a: a["href"].rlike(PHOTO_LINKS) | a["label"].rlike(PHOTO_LINKS))
    ranked = F.transform(
        named,
        lambda a, i: F.struct(
            F.when(F.concat(pagetext.absolute(a["href"], page), a["label"]).rlike(BEST_PHOTO_LINKS), 0).otherwise(1).alias("rank"), i.alias("pos"), pagetext.absolute(F.replace(a["href"], F.lit("&amp;"), F.lit("&")), page).alias("url")
        ),
    )
    bare = lambda u: F.regexp_replace(u, "/+$", "")
    own = F.filter(ranked, lambda a: (pagetext.host_of(a["url"]) == pagetext.host_of(page)) & (bare(a["url"]) != bare(page)))
    return F.slice(F.array_distinct(F.transform(F.array_sort(own), lambda a: a["url"])), 1, most)


def pages_to_try(html: Column, page: Column, dead: Column) -> Column:
    """The root of the site for a dead deep link, else the page and its photo pages."""
    root = F.concat(F.regexp_extract(page, "^([a-zA-Z]+://[^/?#]+)", 1), F.lit("/"))
    return F.when(dead, F.array(root)).otherwise(F.concat(F.array(page), photo_pages(html, page)))


def asset_allowed(url: Column, page: Column, robots_ok: Column) -> Column:
    """An image of another host belongs to the page that shows it; one of the same host obeys its robots."""
    return (pagetext.host_of(url) != pagetext.host_of(page)) | robots_ok


def topped_up(extra: Column, queue: Column, most: int = 3) -> Column:
    return F.slice(F.array_distinct(F.concat(extra, queue)), 1, most)


def photo_path(venue: Column) -> Column:
    return F.concat(F.lit("img/venues/"), venue.cast("string"), F.lit(".jpg"))


def attribution(authors: Column) -> Column:
    named = F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: a != "")
    return F.when(F.size(F.coalesce(authors, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Photo: "), F.array_join(named, ", "), F.lit(" / Google"))).otherwise("Photo: Google")


def photo_offers(deals: Column, photo_id: Column, submitted: Column, today: Column) -> Column:
    """Grounded proposals as offers: never better than unconfirmed, and their source is the photo."""
    return F.transform(
        deals,
        lambda d: F.struct(
            F.coalesce(d["type"], F.lit("happy_hour")).alias("type"), d["windows"].alias("windows"), F.transform(d["items"], lambda i: i.dropFields("quote")).alias("items"), F.lit("unconfirmed").alias("confidence"),
            today.alias("last_verified_at"), F.lit("photo_submission").alias("verified_by"), F.struct(F.lit("photo").alias("kind"), photo_id.alias("photo_id"), submitted.alias("submitted")).alias("source"),
        ),
    )
