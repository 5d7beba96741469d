"""Pages that a host lists in its sitemaps, found in landed documents by a walk of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions import pagetext
from offerlens.session import written

#: Fixed values of the walk: sitemaps that are opened, how an address stands in one, and how much of it is read.
BUDGET = 3
LOC = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"
BODY = 2_000_000
HEAD = 2_000
#: Of an index, the sitemaps that are followed: those named so, this many at most, or else its first.
PAGE_MAPS = "(?i)page|post"
FOLLOWED = 2


def listed(hosts: DataFrame, documents: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(host, fetched, found): of each hosts(host, base) the sitemaps that were opened, in order, and the best links in them.

    documents(url, allowed, status, content_type, body): what a request for url was answered with; a url that is not there got no answer.
    The walk is breadth-first from base/sitemap.xml. All hosts go one step at a time: the first of a host's queue that is allowed
    and was not opened before is met with its document by a join on url and takes one of the budget, whatever it
    holds; an index puts its best sitemaps behind the queue, a list of pages gives its best links. So there are `budget` joins, however many
    hosts and sitemaps there are, and a host's state is its queue, at most 1 + FOLLOWED * budget urls.
    """
    strings = F.array().cast("array<string>")
    state = hosts.select("host", F.array(F.concat("base", F.lit("/sitemap.xml"))).alias("queue"), strings.alias("seen"), strings.alias("fetched"), strings.alias("found"))
    for _ in range(budget):
        waiting = state.select("host", "seen", F.posexplode("queue").alias("pos", "url")).where(~F.array_contains("seen", F.col("url")))
        met = waiting.join(documents, "url", "left").where(F.coalesce("allowed", F.lit(True)))
        first = met.groupBy("host").agg(F.min_by(F.struct("pos", "url", "status", "content_type", "body"), "pos").alias("doc"))
        read = (F.col("doc.status") == 200) & F.col("doc.content_type").contains("xml")
        body = F.when(F.coalesce(read, F.lit(False)), F.left("doc.body", F.lit(BODY)))
        locs = F.coalesce(F.transform(F.regexp_extract_all(body, F.lit(LOC), F.lit(1)), pagetext.decoded), strings)
        index = F.coalesce(F.lower(F.left(body, F.lit(HEAD))).contains("<sitemapindex"), F.lit(False))
        held = state.join(first.select("host", "doc.pos", "doc.url", locs.alias("locs"), index.alias("index")), "host", "left")
        maps = F.slice(F.filter("locs", lambda u: u.rlike(PAGE_MAPS)), 1, FOLLOWED)
        more = F.when(F.size(maps) > 0, maps).otherwise(F.slice("locs", 1, 1))
        seen = F.when(F.col("url").isNotNull(), F.array_append("seen", F.col("url"))).otherwise(F.col("seen"))
        best = F.filter("locs", lambda u: u.rlike(pagetext.BEST_LINKS))
        fresh = F.array_except(best, F.col("seen"))  # each once, in order
        stepped = held.select(
            "host", seen.alias("seen0"), F.when(F.col("url").isNull(), strings).otherwise(F.concat(F.slice("queue", F.col("pos") + 2, F.size("queue")), F.when(F.col("index"), more).otherwise(strings))).alias("queue"),
            F.when(F.col("url").isNotNull(), F.array_append("fetched", F.col("url"))).otherwise(F.col("fetched")).alias("fetched"), "found",
            F.when(F.col("index") | F.col("url").isNull(), strings).otherwise(F.array_remove(fresh, F.col("url"))).alias("new"),
        ).select("host", "queue", F.concat("seen0", "new").alias("seen"), "fetched", F.concat("found", "new").alias("found"))
        state = written(stepped, "sitemap_steps")
    return state.select("host", "fetched", "found")


def topped_up(queue: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """queue(host, links) with the sitemap's links first, where none of its own is of the best; the first `most` of them."""
    joined = queue.join(found.select("host", "found"), "host", "left")
    lacks = ~F.exists("links", lambda u: u.rlike(pagetext.BEST_LINKS))
    more = F.array_except(F.coalesce("found", F.array().cast("array<string>")), F.col("links"))
    return joined.select("host", F.slice(F.when(lacks, F.concat(more, "links")).otherwise(F.col("links")), 1, most).alias("links"))
