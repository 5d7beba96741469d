"""Queries of the crawl: dates of pages, sitemaps, robots and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import pagetext, schedule
from offerlens.functions import text as T
from offerlens.operators import dates, resolve, robots, sitemaps
from offerlens.plans.lenses import lens, sql
from offerlens.plans.text_queries import _HOST, _VISIBLE

#: A page's date, and what tells it: text that Spark and DuckDB read alike.
_DAY = "CAST(DATE '2024-01-01' + CAST(page_id % 700 AS INTEGER) AS VARCHAR(10))"
_LATER = "CAST(DATE '2024-01-01' + CAST(page_id % 700 + 30 AS INTEGER) AS VARCHAR(10))"
_LD = "<script type=\"application/ld+json\">"
_TOLD = f"""CASE page_id % 14
WHEN 0 THEN concat('{_LD}{{"@graph": [{{"@type": "WebPage", "dateModified": "', {_LATER}, '"}}, {{"@type": "Article", "datePublished": "', {_DAY}, 'T08:00:00Z"}}]}}</script>')
WHEN 1 THEN concat('{_LD}{{"dateModified": "', {_DAY}, '"}}</script>')
WHEN 2 THEN concat('{_LD}{{"datePublished": "2026-02-30", "dateCreated": "', {_DAY}, '", "uploadDate": "', {_LATER}, '"}}</script>')
WHEN 3 THEN concat('{_LD}{{"datePublished": "', {_LATER}, '"</script>{_LD}{{&quot;a&quot;: {{&quot;uploadDate&quot;: &quot;on ', {_DAY}, '&quot;}}}}</script>')
WHEN 4 THEN concat('<meta property="article:published_time" content="since ', {_DAY}, ' 10:00">')
WHEN 5 THEN concat('<meta content="', {_DAY}, '" property="article:published_time">')
WHEN 6 THEN concat('<time class="x" datetime="', {_DAY}, '">then</time>')
WHEN 7 THEN '<p>Written on March 9, 2025 by us</p>'
WHEN 8 THEN concat('{_LD}{{"z": {{"datePublished": "', {_LATER}, '"}}, "a": {{"m": [{{"dateCreated": "2020-05-05"}}, {{"dateCreated": "', {_DAY}, '"}}]}}}}</script>')
WHEN 9 THEN concat('{_LD}{{"datePublished": {{"value": "', {_LATER}, '"}}, "dateCreated": 20240101}}</script><meta name="pubdate" content="', {_DAY}, '">')
WHEN 10 THEN concat('{_LD}[{{"dateCreated": "', {_LATER}, '"}}, {{"b": 1, "dateCreated": "', {_DAY}, '"}}]</script>')
WHEN 11 THEN '<p>Written on February 30, 2025 by us</p>'
WHEN 12 THEN concat('<meta name="date" content="soon"><time datetime="', {_DAY}, '">')
ELSE '' END"""
#: Some way into the page, where its body begins.
_DATED = f"replace(html, '<body>', concat({_TOLD}, '<body>'))"


def published_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page, given one of many ways to tell a date, the day that it was published."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", f"{_DATED} AS html")
    return dates.published(pages).select("page_id", F.col("published").cast("string").alias("published"))


#: Documents of each host's sitemaps, from its pages.
_HOSTED = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_BEST = "concat('https://', host, '/', CAST(page_id AS VARCHAR(20)), CASE WHEN page_id % 3 = 0 THEN '/happy-hour?a=1&amp;b=2' WHEN page_id % 7 = 0 THEN '/specials' ELSE '/about' END)"
_KIND = "(length(host) + CAST(low % 3 AS INTEGER)) % 6"


def _sitemap_sql(listed) -> str:
    """Rows (url, allowed, status, content_type, body); listed: an aggregate of a text, in order of page_id, that the engine has."""
    loc = listed(f"concat('<loc> ', {_BEST}, ' </loc>')")
    even = listed(f"CASE WHEN page_id % 2 = 0 THEN concat('<loc>', {_BEST}, '</loc>') ELSE '' END")
    index = "'<?xml?><SitemapIndex><loc>https://', host, '/misc.xml</loc><loc>https://', host, '/page-map.xml</loc><loc>https://', host, '/post-map.xml</loc><loc>https://', host, '/page-map2.xml</loc></SitemapIndex>'"
    bare = "'<sitemapindex><loc>https://', host, '/misc.xml</loc><loc>https://', host, '/other.xml</loc></sitemapindex>'"
    deep = "'<sitemapindex><loc>https://', host, '/sitemap.xml</loc><loc>https://', host, '/deep-page.xml</loc></sitemapindex>'"
    return f"""
h AS (SELECT {_HOSTED} AS host, page_id FROM pages),
m AS (SELECT host, min(page_id) AS low, {loc} AS every, {even} AS even FROM h GROUP BY host),
k AS (SELECT *, {_KIND} AS kind FROM m),
documents_ AS (
SELECT concat('https://', host, '/sitemap.xml') AS url, kind <> 5 AS allowed, CASE WHEN kind = 1 THEN 404 ELSE 200 END AS status, CASE WHEN kind = 1 THEN 'text/html' ELSE 'application/xml' END AS content_type,
  CASE WHEN kind IN (0, 1, 5) THEN concat('<urlset>', every, '</urlset>') WHEN kind IN (2, 3) THEN concat({index}) ELSE concat({bare}) END AS body FROM k
UNION ALL SELECT concat('https://', host, '/misc.xml'), true, 200, 'text/xml', concat('<urlset>', every, '</urlset>') FROM k
UNION ALL SELECT concat('https://', host, '/page-map.xml'), kind = 2, 200, 'text/xml', concat('<urlset>', even, '</urlset>') FROM k
UNION ALL SELECT concat('https://', host, '/post-map.xml'), true, 200, 'text/xml', concat({deep}) FROM k
UNION ALL SELECT concat('https://', host, '/deep-page.xml'), true, 200, 'text/xml', concat('<urlset>', every, '</urlset>') FROM k)"""


def sitemap_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each host of pages, the links that the walk over its sitemaps finds."""
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("_sitemap_pages")
    listed = lambda text: f"listagg({text}, '') WITHIN GROUP (ORDER BY page_id)"
    made = _sitemap_sql(listed).replace("FROM pages)", "FROM _sitemap_pages)")
    documents = spark.sql(f"WITH {made} SELECT * FROM documents_")
    hosts = spark.sql(f"SELECT DISTINCT {_HOSTED} AS host FROM _sitemap_pages").select("host", F.concat(F.lit("https://"), "host").alias("base"))
    found = sitemaps.listed(hosts, documents)
    return found.select("host", F.size("fetched").cast("long").alias("n_fetched"), F.posexplode_outer("found").alias("pos", "link")).select("host", "n_fetched", F.col("pos").cast("long").alias("pos"), "link")


#: Rules by host, in the order of the file; agents by group.
_ROBOTS = """CASE length(host) % 5
WHEN 0 THEN concat('User-agent: *', chr(10), 'Disallow: /fr/', chr(10), 'Allow: /fr/8', chr(10), 'Disallow: /en/1 # some')
WHEN 1 THEN concat('# ours', chr(13), chr(10), 'User-Agent: other', chr(10), 'Disallow: /', chr(10), 'User-agent: OfferBot', chr(10), 'User-agent: third', chr(10), 'Allow: /en/7', chr(10), 'Disallow: /en', chr(10), 'User-agent: *', chr(10), 'Disallow: /')
WHEN 2 THEN concat('User-agent: *', chr(10), 'Disallow:')
WHEN 3 THEN 'Disallow: /' ELSE '' END"""
_ASKED = f"SELECT page_id, url, {_HOSTED} AS host FROM pages"
_STATUS = "CASE WHEN length(host) % 7 = 0 THEN 403 WHEN length(host) % 7 = 1 THEN 500 ELSE 200 END"
#: What either client was told, by page.
_FIRST = """CASE WHEN page_id % 8 = 0 THEN 403 WHEN page_id % 8 = 1 THEN 404 WHEN page_id % 16 = 2 THEN NULL ELSE 200 END AS status1,
CASE WHEN page_id % 16 = 2 THEN 'Timeout' END AS error1,
CASE WHEN page_id % 8 = 3 THEN 'application/PDF' WHEN page_id % 16 = 4 THEN 'image/png; x=1' WHEN page_id % 16 = 12 THEN '' ELSE 'text/html; charset=utf-8' END AS type1,
CASE WHEN page_id % 16 = 3 THEN '' WHEN page_id % 16 = 11 THEN 'Happy hour Mon - Fri 4pm - 6pm' ELSE concat('<p>Happy hour Mon - Fri ', CAST(page_id % 5 + 1 AS VARCHAR(5)), 'pm - 8pm</p>') END AS body1,
CASE WHEN page_id % 24 = 0 THEN NULL WHEN page_id % 24 = 8 THEN 403 ELSE 200 END AS status2, CASE WHEN page_id % 24 = 0 THEN 'Refused' END AS error2"""


def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the fetch of each page went: refused by its host's rules, failed, retried, not a page, or read."""
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("_fetched_pages")
    asked = spark.sql(f"SELECT page_id, url, {_FIRST} FROM _fetched_pages")
    hosts = spark.sql(f"SELECT DISTINCT {_HOSTED} AS host FROM _fetched_pages").selectExpr("host", f"{_STATUS} AS status", f"{_ROBOTS} AS body")
    gated = robots.allowed(asked, hosts, "OfferBot/1.0 (+https://example.com)")
    answer = lambda s, e, t: F.struct(F.col(s).alias("status"), F.col(t).alias("content_type"), F.col(e).alias("error"), F.col("body1").alias("body"))
    told = robots.outcomes(gated.select("page_id", "url", "allowed", "refusal", answer("status1", "error1", "type1").alias("first"), answer("status2", "error2", "type1").alias("second")))
    return told.select("page_id", "allowed", "result", F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("n_chars"))


#: Lines of two time ranges, made of an order's key: how the second follows the first, and whether the line says of itself that it may not hold.
_DAY_NAMES = ("Monday", "Tue", "Wednesday", "Thurs", "Fri", "Sat", "Sun")


def quotes_of_two_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of lines with two ranges: split before a day, unsettled without a mark or with days on both sides of a range, none where the line hedges."""
    k = F.col("k")
    day = lambda n: F.element_at(F.array(*map(F.lit, _DAY_NAMES)), (n % 7 + 1).cast("int"))
    hours = lambda n: F.concat((n % 4 + 1).cast("string"), F.lit("pm - "), (n % 3 + 6).cast("string"), F.lit("pm"))
    one, two = F.concat(day(k), F.lit(" "), hours(k)), F.concat(day(k + 2), F.lit(" "), hours(k + 1))
    quote = (
        F.when(k % 7 == 0, F.concat(one, F.lit(" & "), two)).when(k % 7 == 1, F.concat(one, F.lit(", happy hour "), two)).when(k % 7 == 2, F.concat(one, F.lit(" then "), two)).when(k % 7 == 3, F.concat(one, F.lit(" / "), two))
        .when(k % 7 == 4, F.concat(one, F.lit(" & "), two, F.lit(" at participating locations"))).when(k % 7 == 5, F.concat(one, F.lit(" "), day(k + 1), F.lit(" & "), two)).otherwise(F.concat(hours(k), F.lit(" and "), two))
    )
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k")).select("k", F.explode(schedule.windows_from(quote)).alias("w"))
    return rows.select("k", F.col("w.dow").cast("long").alias("dow"), F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"))


def nearby_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ten places near each licence, the first with its street number."""
    licences = lens(spark, sf_dir, "licence").select("lid", F.concat("street", F.lit(", Norristown")).alias("address"))
    near = licences.select("lid", "address", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("rank")).withColumn("place_id", (F.col("lid") * 7 + F.col("rank") * 13) % 97 + 1)
    places = lens(spark, sf_dir, "place").select("place_id", F.concat("number", F.lit(" "), "street").alias("place_address"))
    return resolve.by_number(near.join(places, "place_id")).select("lid", F.col("rank").cast("long").alias("rank"), "place_id")


def sites_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of sites updated by what was found since: the new row where there is one."""
    rows = lens(spark, sf_dir, "venue")
    site = lambda kept, word: rows.where(kept).select("lid", F.concat(F.lit(f"http://{word}"), "lid").alias("website"), F.lit(word).alias("origin"))
    return resolve.right_wins(site("lid % 3 > 0", "old"), site("lid % 4 = 0", "new"), "lid")


def named_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a page name the venue, by the words of its name that prove anything, and its town? Names are made of the page's host."""
    labels = F.split(pagetext.host_of(F.col("url")), r"\.")
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("The "), F.element_at(labels, -3), F.lit(" of "), F.element_at(labels, -2)).alias("name"), F.element_at(labels, -2).alias("town"), pagetext.visible_text(F.col("html")).alias("text"))
    words = T.proof_words(F.col("name"))
    return rows.select("page_id", F.array_join(words, " ").alias("words"), T.proven(F.col("text"), words, F.array("town")).isNotNull().alias("proven"))


QUERIES = {f.__name__: f for f in (published_dates, sitemap_walk, fetch_outcomes, quotes_of_two_ranges, nearby_places, sites_updated, named_proof)}

_ISO = "try_cast(nullif(regexp_extract({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), '') AS DATE)".format
_HEADS = [
    r'<meta[^>]+property=["'']article:published_time["''][^>]+content=["'']([^"'']+)', r'<meta[^>]+name=["''](?:article:published_time|datePublished|pubdate|date)["''][^>]+content=["'']([^"'']+)',
    r'<meta[^>]+content=["'']([^"'']+)["''][^>]+property=["'']article:published_time["'']', r'<time[^>]+datetime=["'']([^"'']+)',
]
_HEAD_SQL = ", ".join(_ISO("regexp_extract(html, '(?is)" + x.replace("''", "\x00").replace("'", "''").replace("\x00", "''") + "', 1)") for x in _HEADS)
_WALK = """q(host, step, queue, seen, found, n) AS (
SELECT host, 0, [concat('https://', host, '/sitemap.xml')], []::VARCHAR[], []::VARCHAR[], 0 FROM k
UNION ALL SELECT host, step + 1, CASE WHEN u IS NULL THEN [] ELSE list_concat(queue[list_position(queue, u) + 1 :], CASE WHEN is_index THEN CASE WHEN len(maps) > 0 THEN maps[1 : 2] ELSE locs[1 : 1] END ELSE [] END) END,
  CASE WHEN u IS NULL THEN seen ELSE list_concat(seen, [u], fresh) END, list_concat(found, fresh), n + CASE WHEN u IS NULL THEN 0 ELSE 1 END FROM (
  SELECT *, list_filter(locs, lambda x: regexp_matches(x, '(?i)page|post')) AS maps,
    CASE WHEN is_index OR u IS NULL THEN []::VARCHAR[] ELSE list_filter(locs, lambda x, i: regexp_matches(x, '(?i)happy.?hour|special') AND NOT list_contains(seen, x) AND x <> u AND list_position(locs, x) = i) END AS fresh FROM (
    SELECT *, coalesce(list_transform(regexp_extract_all(t, '(?i)<loc>\\s*([^<\\s]+)\\s*</loc>', 1), lambda x: replace(x, '&amp;', '&')), []) AS locs, coalesce(contains(lower(substr(t, 1, 2000)), '<sitemapindex'), false) AS is_index FROM (
      SELECT *, CASE WHEN d[u].status = 200 AND contains(d[u].content_type, 'xml') THEN d[u].body END AS t FROM (
        SELECT q.*, docs.d, list_filter(queue, lambda x: NOT list_contains(seen, x) AND coalesce(docs.d[x].allowed, true))[1] AS u FROM q, docs WHERE q.step < 3)))))"""

ORACLES = {
    "published_dates": f"""WITH RECURSIVE p AS (SELECT page_id, {_DATED} AS html FROM pages),
b AS (SELECT page_id, block, replace(raw[block], '&quot;', '"') AS t FROM (SELECT page_id, raw, unnest(range(1, len(raw) + 1)) AS block FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]+application/ld\\+json[^>]*>(.*?)</script>', 1) AS raw FROM p))),
j AS MATERIALIZED (SELECT page_id, block, e.key, e.type, e.atom, e.id, e.parent FROM b, json_tree(CASE WHEN json_valid(t) THEN t::JSON ELSE 'null'::JSON END) e),
w AS (SELECT page_id, block, id, []::BIGINT[] AS way FROM j WHERE parent IS NULL UNION ALL SELECT j.page_id, j.block, j.id, list_append(w.way, -j.id::BIGINT) FROM w JOIN j ON j.page_id = w.page_id AND j.block = w.block AND j.parent = w.id),
v AS (SELECT j.page_id, j.block, w.way, list_position(['datePublished', 'dateCreated', 'uploadDate'], j.key) AS name, {_ISO("j.atom ->> '$'")} AS day FROM j JOIN w ON w.page_id = j.page_id AND w.block = j.block AND w.id = j.parent
  WHERE j.type = 'VARCHAR' AND j.key IN ('datePublished', 'dateCreated', 'uploadDate')),
first AS (SELECT page_id, day FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY block, way, name) AS r FROM v WHERE day IS NOT NULL) WHERE r = 1),
prose AS (SELECT page_id, regexp_extract(t, '(?i)\\b(january|february|march|april|may|june|july|august|september|october|november|december)\\s+(\\d{{1,2}}),\\s+(\\d{{4}})\\b', ['m', 'd', 'y']) AS x
  FROM (SELECT page_id, CASE WHEN page_id % 14 IN (7, 11) THEN regexp_extract(html, '<p>(Written[^<]*)</p>', 1) ELSE '' END AS t FROM p))
SELECT p.page_id, coalesce(first.day, {_HEAD_SQL}, try_cast(x.y || '-' || lpad(list_position(['january','february','march','april','may','june','july','august','september','october','november','december'], lower(x.m))::VARCHAR, 2, '0') || '-' || lpad(x.d, 2, '0') AS DATE))::VARCHAR AS published
FROM p LEFT JOIN first USING (page_id) LEFT JOIN prose USING (page_id)""",
    "sitemap_walk": f"""WITH RECURSIVE {_sitemap_sql(lambda t: f"string_agg({t}, '' ORDER BY page_id)")},
docs AS MATERIALIZED (SELECT map_from_entries(list((url, struct_pack(allowed := allowed, status := status, content_type := content_type, body := body)))) AS d FROM documents_),
{_WALK}
SELECT host, n::BIGINT AS n_fetched, CASE WHEN len(found) > 0 THEN i END AS pos, CASE WHEN len(found) > 0 THEN found[i + 1] END AS link FROM (SELECT host, n, found, unnest(range(0, greatest(1, len(found)))) AS i FROM q WHERE step = 3)""",
    "fetch_outcomes": f"""WITH a AS (SELECT *, {_STATUS} AS robots, length(host) % 5 AS kind, '/' || coalesce(nullif(ltrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1), '/'), ''), '') AS path FROM ({_ASKED})),
v AS (SELECT *, CASE WHEN robots = 403 THEN 'robots.txt unreadable (403), treated as disallow' WHEN robots = 200 AND (kind = 0 AND (path LIKE '/fr/%' OR path LIKE '/en/1%') OR kind = 1 AND path LIKE '/en%' AND path NOT LIKE '/en/7%') THEN 'robots.txt disallows' END AS refusal FROM a),
f AS (SELECT v.*, {_FIRST} FROM v),
r AS (SELECT *, CASE WHEN status1 = 403 AND status2 IS NOT NULL AND error2 IS NULL THEN status2 ELSE status1 END AS status FROM f),
o AS (SELECT *, CASE WHEN refusal IS NOT NULL OR error1 IS NOT NULL THEN NULL WHEN status = 200 AND type1 = 'application/PDF' AND body1 <> '' THEN concat('<pre>', body1, '</pre>') WHEN status = 200 AND type1 LIKE '%html%' THEN body1 END AS html FROM r)
SELECT page_id, refusal IS NULL AS allowed, CASE WHEN refusal IS NOT NULL THEN refusal WHEN error1 IS NOT NULL THEN concat('error: ', error1) WHEN html IS NOT NULL THEN 'ok, 1 quote(s)' WHEN status = 200 AND type1 = 'application/PDF' THEN 'pdf, no extractable text'
  ELSE concat(status, ' ', coalesce(nullif(string_split(type1, ';')[1], ''), '?')) END AS result, coalesce(length(html), 0)::BIGINT AS n_chars FROM o""",
    "quotes_of_two_ranges": """WITH o AS (SELECT o_orderkey AS k FROM orders), w AS (SELECT k, k AS d, k AS h FROM o WHERE k % 7 IN (0, 1, 3) UNION ALL SELECT k, k + 2, k + 1 FROM o WHERE k % 7 IN (0, 1, 3, 6))
SELECT k, d % 7 + 1 AS dow, (h % 4 + 13) * 60 AS "start", (h % 3 + 18) * 60 AS "end" FROM w""",
    "nearby_places": sql("""WITH n AS (SELECT lid, street, r AS rank, (lid * 7 + r * 13) % 97 + 1 AS place_id FROM licence, range(10) t(r)),
m AS (SELECT n.lid, n.rank, n.place_id FROM n JOIN place p ON n.place_id = p.place_id WHERE regexp_extract(n.street, '^([0-9]+)', 1) = p.number)
SELECT lid, min(rank) AS rank, arg_min(place_id, rank) AS place_id FROM m GROUP BY lid""", "licence", "place"),
    "sites_updated": sql("""SELECT lid, concat('http://', CASE WHEN lid % 4 = 0 THEN 'new' ELSE 'old' END, lid) AS website, CASE WHEN lid % 4 = 0 THEN 'new' ELSE 'old' END AS origin FROM venue WHERE lid % 4 = 0 OR lid % 3 > 0""", "venue"),
    "named_proof": None,
    "named_proof": f"""WITH p AS (SELECT page_id, string_split({_HOST}, '.') AS h, lower({_VISIBLE}) AS t FROM pages),
w AS (SELECT *, list_filter(string_split(replace(concat(lower(h[-3]), ' ', lower(h[-2])), '-', ' '), ' '), lambda x: length(x) > 2) AS w FROM p)
SELECT page_id, array_to_string(w, ' ') AS words, len(list_filter(w, lambda x: regexp_matches(t, concat('\\b', x, '\\b')))) = len(w) AND contains(t, lower(h[-2])) AS proven FROM w""",
}
