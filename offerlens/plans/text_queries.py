"""Queries of the text side and the photo lane."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import grounding, pagetext, schedule
from offerlens.functions import text as T
from offerlens.operators import moderation
from offerlens.plans.lenses import lens, sql
from offerlens.session import spread
from offerlens.streaming import moderation as streams


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html")


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", pagetext.visible_text(F.col("html")).alias("text"))


def candidate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each page's menu, made to speak of menus and some of specials, best first."""
    html = F.replace(F.replace(F.col("html"), F.lit('href="/'), F.lit('href="/menu/')), F.lit('href="/menu/d'), F.lit('href="/special/d'))
    rows = _pages(spark, sf_dir).select("page_id", F.posexplode(pagetext.candidate_links(html, F.col("url"))).alias("pos", "link"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "link")


def registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", pagetext.host_of(F.col("url")).alias("host"), T.registrable(pagetext.host_of(F.col("url"))).alias("site"))


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    """Offer lines made of an order's keys: days, a time range, two priced items."""
    o = spread(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k")))
    day = lambda n: F.element_at(F.array(*[F.lit(x) for x in ("Monday", "Tue", "Wednesday", "Thurs", "Fri", "saturday", "Sunday")]), (n % 7 + 1).cast("int"))
    said = F.when(F.col("k") % 4 == 0, F.concat(day(F.col("k")), F.lit(" - "), day(F.floor(F.col("k") / 7)))).when(F.col("k") % 4 == 1, F.lit("weekdays")).when(F.col("k") % 4 == 2, F.concat(day(F.col("k")), F.lit(" & "), day(F.col("k") + 3))).otherwise(F.lit("every day"))
    hours = F.concat(((F.col("k") % 12) + 1).cast("string"), F.when(F.col("k") % 5 == 0, F.lit(":30")).otherwise(F.lit("")), F.when(F.col("k") % 3 == 0, F.lit("pm")).otherwise(F.lit("")), F.lit(" - "), ((F.floor(F.col("k") / 11) % 12) + 1).cast("string"), F.when(F.col("k") % 9 == 0, F.lit("")).when(F.col("k") % 2 == 0, F.lit(" pm")).otherwise(F.lit(" am")))
    items = F.concat(F.lit("$"), (F.col("k") % 9 + 2).cast("string"), F.when(F.col("k") % 2 == 0, " draft beers and chips").otherwise(" parking spots"), F.lit(", $"), (F.col("k") % 5 + 5).cast("string"), F.lit(".50 house wine"))
    return o.select("k", said.alias("days"), hours.alias("hours"), items.alias("items"), F.concat(F.lit("Happy Hour / "), said, F.lit(" / "), hours, F.lit("; "), items).alias("quote"))


def days_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotes(spark, sf_dir).select("k", F.array_join(F.transform(schedule.days_in(F.col("days")), lambda x: x.cast("string")), ",").alias("days"))


def window_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quotes(spark, sf_dir).withColumn("w", schedule.window_in(F.col("hours")))
    return rows.select("k", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"))


def items_in_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quotes(spark, sf_dir).select("k", F.posexplode(schedule.items_in(F.col("items"))).alias("pos", "i"))
    return rows.select("k", F.col("pos").cast("long").alias("pos"), "i.category", "i.label", "i.price_usd")


def windows_from_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quotes(spark, sf_dir).select("k", F.explode(schedule.windows_from(F.col("quote"))).alias("w"))
    return rows.select("k", F.col("w.dow").cast("long").alias("dow"), F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"))


def offer_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per quote of a page that an order's lines make up, the lines that the rules pick."""
    rows = _quotes(spark, sf_dir).select("k", F.concat_ws("\n", F.lit("Welcome"), F.lit("HAPPY HOUR"), "items", "days", "hours", F.lit("Happy Birthday")).alias("text"))
    return rows.select("k", F.explode(pagetext.offer_quotes(F.col("text"))).alias("quote"))


def transcript_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of a conversation's first turn does a later turn repeat word for word?"""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    heard = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("transcript"))
    lines = turns.select("conv_id", "turn", F.posexplode(F.split("text", r"\. ")).alias("pos", "quote"))
    deal = F.struct(F.array(F.struct("quote", F.lit("x").alias("label"))).alias("items"), F.array(F.lit(1)).alias("windows"))
    kept = grounding.grounded(F.array(deal), F.col("transcript"))
    return lines.join(heard, "conv_id").select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), (F.size(kept[0]["items"]) > 0).alias("grounded"))


def price_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many proposed items each rule refuses."""
    rows = _quotes(spark, sf_dir).select(
        "k", "items", F.when(F.col("k") % 7 == 0, "no").when(F.col("k") % 7 == 1, "not said anywhere").otherwise(F.col("items")).alias("evidence"),
        F.when(F.col("k") % 11 == 0, "novelty").otherwise("wine").alias("category"), F.when(F.col("k") % 13 == 0, "bottomless wine").otherwise("house wine").alias("label"),
        F.when(F.col("k") % 3 > 0, (F.col("k") % 5 + 5).cast("double") + 0.5).alias("price"), F.when(F.col("k") % 3 == 0, F.lit(50.0)).when(F.col("k") % 3 == 1, F.when(F.col("k") % 10 == 1, F.lit(25.0))).alias("pct"),
    )
    why = grounding.refusal(F.col("evidence"), F.col("items"), F.col("category"), F.col("label"), F.col("price"), F.col("pct"))
    return rows.groupBy(F.coalesce(why, F.lit("kept")).alias("verdict")).agg(F.count("*").alias("n"))


def recency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderdate").cast("date")).alias("published"))
    return rows.groupBy(pagetext.fresh_enough(F.col("published"), F.lit("2000-01-01").cast("date")).alias("fresh")).agg(F.count("*").alias("n"))


def roundup_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, the first sentence that opens with a benchmark item's first words, by an equi-join on them: (doc_id, item_id, line)."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", r"\. |\n")).alias("line", "said"))
    openings = lambda c: F.array_join(F.slice(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), 1, 3), " ")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", openings(F.col("text")).alias("opening"))
    found = lines.select("doc_id", "line", openings(F.col("said")).alias("opening")).where("opening <> ''").join(items, "opening")
    return found.groupBy("doc_id", "item_id").agg(F.min("line").cast("long").alias("line"))


def rate_limit_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission at three a day, the limit at which these events meet it."""
    return moderation.rate_limited(lens(spark, sf_dir, "submission"), 3).select("id", "ip_hash", "admitted")


def _status_events(spark: SparkSession, d: str) -> DataFrame:
    event = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "reject").otherwise("extract")
    return lens(spark, d, "submission").select((F.col("id") % 2500).alias("id"), "ts", F.col("id").alias("seq"), event.alias("event"))


def submission_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.final_status(_status_events(spark, sf_dir)).select("id", "status", F.col("n_refused").cast("long").alias("n_refused"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 oldest of a status, a page of the review queue."""
    rows = lens(spark, sf_dir, "submission").withColumn("status", F.when(F.col("event_type") == "view", "extracted").otherwise("pending"))
    return moderation.review_queue(rows).select("id", "ip_hash")


def submission_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens(spark, sf_dir, "submission").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min("k").cast("long").alias("least"), F.max("k").cast("long").alias("most"), F.sum("k").alias("total"))


def domain_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(lens(spark, sf_dir, "venue").select("lid", "zone_id")).select("lid", F.concat(F.when(F.col("lid") % 2 == 0, "THE Old ").otherwise("Old "), "zone_id", F.lit(" Inn, LLC")).alias("name"))
    return rows.select("lid", F.posexplode(T.domain_stems(F.col("name"))).alias("pos", "stem")).select("lid", F.col("pos").cast("long").alias("pos"), "stem")


def proof_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that name their own host's first label and a place of their address."""
    rows = _pages(spark, sf_dir).select("page_id", F.split(pagetext.host_of(F.col("url")), r"\.").alias("h"), pagetext.visible_text(F.col("html")).alias("text"))
    named = F.array(F.element_at("h", -3))
    return rows.select("page_id", T.proven(F.col("text"), named, F.array(F.lit("zzz"), F.element_at("h", -2))).alias("evidence"))


def _stream(spark: SparkSession, d: str, files: str = "events.parquet") -> DataFrame:
    path = f"{d}/{files}"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not path.endswith(".parquet") else os.path.dirname(path) + "/" + files[:-8] + "*.parquet")


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rate_limit_admit as a stream over the same events."""
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("ip_hash"), F.col("ts").cast("date").alias("day"), "ts", F.col("event_id").alias("id"))
    return streams.run_once(streams.rate_limit(rows, 3), "append").select("id", "ip_hash", "admitted")


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """submission_status as a stream over the same events."""
    event = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "reject").otherwise("extract")
    rows = _stream(spark, sf_dir).select((F.col("event_id") % 2500).alias("id"), "ts", F.col("event_id").alias("seq"), event.alias("event"))
    out = streams.run_once(streams.latest_status(rows), "complete")
    return out.select("id", "status", F.col("n_refused").cast("long").alias("n_refused"))


QUERIES = {
    f.__name__: f
    for f in (
        visible_text, candidate_links, registrable_domain, days_in, window_in, items_in_quote, windows_from_quote, offer_quotes, transcript_grounding, price_grounding, recency_gate,
        roundup_mentions, rate_limit_admit, submission_status, review_queue, submission_props, domain_candidates, proof_check, stream_rate_limit, stream_status,
    )
}

def _decoded_sql(x: str) -> str:
    """Character references of x as characters: the rule of pagetext.decoded for DuckDB, with HTML's whole table of names."""
    named, odd, quoted = pagetext._named(), pagetext._odd_codes(), lambda v: "'" + v.replace("'", "''") + "'"
    table = f"MAP([{', '.join(map(quoted, named))}], [{', '.join(map(quoted, named.values()))}])"
    windows = f"MAP([{', '.join(map(str, odd))}], [{', '.join(map(quoted, odd.values()))}])"
    old = "|".join(sorted((n for n in named if not n.endswith(";")), key=len, reverse=True))
    digits = "regexp_replace(regexp_extract(ref, '([0-9a-fA-F]+);?$', 1), '^0+(.)', '\\1')"
    ref, early = "regexp_extract(p, '^(#(?:[xX][0-9a-fA-F]+|[0-9]+);?|[A-Za-z][A-Za-z0-9]*;)', 1)", f"regexp_extract(p, '^({old})', 1)"
    code = "CASE WHEN length(digits) <= 8 THEN TRY_CAST(CASE WHEN lower(ref[2]) = 'x' THEN concat('0x', digits) ELSE digits END AS BIGINT) END".replace("digits", digits)
    char = f"CASE WHEN code IS NULL OR code = 0 OR code > 1114111 OR code BETWEEN 55296 AND 57343 THEN chr(65533) ELSE coalesce({windows}[code], chr(CAST(code AS INTEGER))) END"
    char = f"list_transform([{code}], lambda code: {char})[1]"
    known = f"list_transform([{table}[ref]], lambda name: CASE WHEN name IS NOT NULL THEN concat(name, p[length(ref) + 1:]) WHEN early <> '' THEN concat({table}[early], p[length(early) + 1:]) ELSE concat('&', p) END)[1]"
    bound = f"list_transform([{ref}], lambda ref: CASE WHEN ref[1] = '#' THEN concat({char}, p[length(ref) + 1:]) ELSE list_transform([{early}], lambda early: {known})[1] END)[1]"
    return f"list_aggregate(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {bound} END), 'string_agg', '')"


_VISIBLE = r"""array_to_string(list_filter(list_transform(string_split(decoded, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\x{A0}]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10))""".replace(
    "decoded", _decoded_sql(r"""regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[sS][cC][rR][iI][pP][tT][^>]*>(?s:.*?)</[sS][cC][rR][iI][pP][tT]>|<[sS][tT][yY][lL][eE][^>]*>(?s:.*?)</[sS][tT][yY][lL][eE]>|<[nN][oO][sS][cC][rR][iI][pP][tT][^>]*>(?s:.*?)</[nN][oO][sS][cC][rR][iI][pP][tT]>', ' ', 'g'),
  '<(?:[bB][rR]|/[pP]|/[dD][iI][vV]|/[lL][iI]|/[tT][rR]|/[hH][0-9])[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')""")
)
_HOST = r"regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)"
_STATUS = "CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'reject' ELSE 'extract' END"
_DAYNAME = "['Monday', 'Tue', 'Wednesday', 'Thurs', 'Fri', 'saturday', 'Sunday']"
_K = "(SELECT o_orderkey AS k FROM orders)"
_DAYS_SAID = f"""d AS (SELECT k, k % 7 + 1 AS a, (k // 7) % 7 + 1 AS b, (k + 3) % 7 + 1 AS c FROM {_K}),
said AS (SELECT k, CASE k % 4 WHEN 0 THEN list_transform(range(0, (b - a + 7) % 7 + 1), lambda i: (a - 1 + i) % 7 + 1) WHEN 1 THEN [1, 2, 3, 4, 5] WHEN 2 THEN [a, c] ELSE [1, 2, 3, 4, 5, 6, 7] END AS days FROM d)"""
_WINDOW_SAID = f"""h AS (SELECT k, k % 12 + 1 AS sh, CASE WHEN k % 5 = 0 THEN 30 ELSE 0 END AS sm, CASE WHEN k % 3 = 0 THEN 'p' END AS sp, (k // 11) % 12 + 1 AS eh, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 2 = 0 THEN 'p' ELSE 'a' END AS ep FROM {_K}),
t AS (SELECT *, eh % 12 * 60 + CASE WHEN ep = 'p' THEN 720 ELSE 0 END AS e0, sh % 12 * 60 + sm AS s0 FROM h),
u AS (SELECT k, ep, CASE WHEN e0 = 0 THEN 1440 ELSE e0 END AS e, CASE WHEN sp = 'p' THEN s0 + 720 WHEN s0 + CASE WHEN ep = 'p' THEN 720 ELSE 0 END >= e0 THEN s0 + CASE WHEN ep = 'p' THEN 0 ELSE 720 END ELSE s0 + CASE WHEN ep = 'p' THEN 720 ELSE 0 END END AS s FROM t)"""
_ADMIT = "SELECT id, ip_hash, row_number() OVER (PARTITION BY ip_hash, day ORDER BY ts, id) <= 3 AS admitted FROM submission"
_FINAL = f"""WITH ev AS (SELECT event_id % 2500 AS id, ts, event_id AS seq, {_STATUS} AS event FROM events),
g AS (SELECT id, min_by(event, seq) FILTER (event IN ('approve', 'reject')) AS ruling, min(seq) FILTER (event IN ('approve', 'reject')) AS r, min(seq) FILTER (event = 'extract') AS e, count(*) AS n FROM ev GROUP BY id)
SELECT id, CASE WHEN ruling = 'approve' THEN 'approved' WHEN ruling = 'reject' THEN 'rejected' WHEN e IS NOT NULL THEN 'extracted' ELSE 'pending' END AS status,
  n - CASE WHEN r IS NOT NULL THEN 1 ELSE 0 END - CASE WHEN e IS NOT NULL AND (r IS NULL OR e < r) THEN 1 ELSE 0 END AS n_refused FROM g"""
ORACLES = {
    "visible_text": f"SELECT page_id, {_VISIBLE} AS text FROM pages",
    "candidate_links": r"""WITH h AS (SELECT page_id, url, replace(replace(html, 'href="/', 'href="/menu/'), 'href="/menu/d', 'href="/special/d') AS html FROM pages),
a AS (SELECT DISTINCT page_id, regexp_replace(concat(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1), unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']+)["''][^>]*>.{0,120}?</a>', 1))), '#.*$', '') AS link FROM h)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY NOT contains(link, '/special/'), link) - 1 AS pos, link FROM a""",
    "registrable_domain": f"SELECT page_id, {_HOST} AS host, regexp_extract({_HOST}, '([^.]+[.][^.]+)$', 1) AS site FROM pages",
    "days_in": f"WITH {_DAYS_SAID} SELECT k, array_to_string(list_sort(days), ',') AS days FROM said",
    "window_in": f"WITH {_WINDOW_SAID} SELECT k, CASE WHEN ep IS NOT NULL AND s < e THEN s END AS \"start\", CASE WHEN ep IS NOT NULL AND s < e THEN e END AS \"end\" FROM u",
    "windows_from_quote": f"""WITH {_DAYS_SAID}, {_WINDOW_SAID}, each AS (SELECT k, unnest(days) AS dow FROM said)
SELECT each.k, CAST(dow AS BIGINT) AS dow, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM each JOIN u ON each.k = u.k WHERE ep IS NOT NULL AND s < e""",
    "offer_quotes": f"""WITH l AS (SELECT k, concat('$', k % 9 + 2, CASE WHEN k % 2 = 0 THEN ' draft beers and chips' ELSE ' parking spots' END, ', $', k % 5 + 5, '.50 house wine') AS items,
  concat(k % 12 + 1, CASE WHEN k % 5 = 0 THEN ':30' ELSE '' END, CASE WHEN k % 3 = 0 THEN 'pm' ELSE '' END, ' - ', (k // 11) % 12 + 1, CASE WHEN k % 9 = 0 THEN '' WHEN k % 2 = 0 THEN ' pm' ELSE ' am' END) AS hours FROM {_K})
SELECT k, concat('HAPPY HOUR / ', items, ' / ', hours) AS quote FROM l UNION ALL SELECT k, items FROM l WHERE k % 2 = 0""",
    "items_in_quote": f"""SELECT k, 0::BIGINT AS pos, 'draft' AS category, 'draft beers' AS label, CAST(k % 9 + 2 AS DOUBLE) AS price_usd FROM {_K} WHERE k % 2 = 0
UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END, 'wine', 'house wine', CAST(k % 5 + 5 AS DOUBLE) + 0.5 FROM {_K}""",
    "transcript_grounding": r"""WITH h AS (SELECT conv_id, min_by(text, turn) AS transcript FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS quote, generate_subscripts(string_split(text, '. '), 1) - 1 AS pos FROM conversations),
n AS (SELECT l.conv_id, l.turn, l.pos, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS q, lower(trim(regexp_replace(transcript, '\s+', ' ', 'g'))) AS t FROM l JOIN h USING (conv_id))
SELECT conv_id, turn, pos, q <> '' AND contains(t, q) AS grounded FROM n""",
    "price_grounding": f"""SELECT CASE WHEN k % 7 = 0 THEN 'no evidence' WHEN k % 7 = 1 THEN 'evidence not in the quote' WHEN k % 11 = 0 THEN 'category' WHEN k % 13 = 0 THEN 'unlawful claim'
  WHEN k % 3 = 1 AND k % 10 = 1 THEN 'needs exactly one of price and discount' WHEN k % 3 = 0 THEN 'discount not written in the evidence' ELSE 'kept' END AS verdict, count(*) AS n FROM {_K} GROUP BY 1""",
    "proof_check": f"""WITH p AS (SELECT page_id, string_split({_HOST}, '.') AS h, lower({_VISIBLE}) AS t FROM pages)
SELECT page_id, CASE WHEN regexp_matches(t, concat('\\b', lower(h[-3]))) AND contains(t, lower(h[-2])) THEN concat('name(', h[-3], ') + ', h[-2]) END AS evidence FROM p""",
    "recency_gate": "SELECT coalesce(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') <= 120, false) AND o_orderkey % 10 > 0 AS fresh, count(*) AS n FROM orders GROUP BY 1",
    "roundup_mentions": r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\. |\n')) AS said, generate_subscripts(regexp_split_to_array(text, '\. |\n'), 1) - 1 AS line FROM documents),
o AS (SELECT doc_id, line, array_to_string(regexp_split_to_array(lower(said), '[^\p{L}\p{N}]+')[1:3], ' ') AS opening FROM l),
i AS (SELECT item_id, array_to_string(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')[1:3], ' ') AS opening FROM benchmark)
SELECT doc_id, item_id, min(line) AS line FROM o JOIN i USING (opening) WHERE opening <> '' GROUP BY ALL""",
    "rate_limit_admit": sql(_ADMIT, "submission"),
    "submission_status": _FINAL,
    "review_queue": "SELECT event_id AS id, user_id AS ip_hash FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 200",
    "submission_props": "SELECT event_type, count(*) AS n, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS least, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type",
    "domain_candidates": sql("""WITH c AS (SELECT lid, CASE WHEN lid % 2 = 0 THEN ['theold' || zone_id || 'inn', 'theold' || zone_id, 'old' || zone_id || 'inn', 'old' || zone_id]
    ELSE ['old' || zone_id || 'inn', 'old' || zone_id, 'theold' || zone_id || 'inn', 'theold' || zone_id] END AS s FROM venue), f AS (SELECT lid, list_filter(s, lambda x: length(x) >= 6) AS s FROM c)
SELECT lid, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS stem FROM f""", "venue"),
    "stream_rate_limit": sql(_ADMIT, "submission"),
    "stream_status": _FINAL,
}
