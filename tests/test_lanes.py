"""Dates, walks, robots, resumed work, sources, decay and places over sorted tables, by golden cases."""

import datetime as dt
import html
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from offerlens.functions import ranking as R
from offerlens.operators import build, dates, feed, moderation, publish, ranks, resume, robots, sitemaps
from offerlens.sources import files, services
from offerlens.streaming import decay
from offerlens.streaming import moderation as streams

LD = '<script type="application/ld+json">%s</script>'
DATED = {
    LD % '{"dateModified": "2026-08-01"}': None,
    LD % '{"@graph": [{"dateModified": "2026-08-01"}, {"datePublished": "2026-07-01T10:00"}]}': "2026-07-01",
    LD % '{"uploadDate": "2026-06-01"}': "2026-06-01",
    LD % '{"datePublished": "2026-02-30", "dateCreated": "2026-02-03"}': "2026-02-03",
    LD % '{"datePublished": ' + LD % '{"datePublished": "2026-05-05"}': "2026-05-05",
    LD % "{&quot;datePublished&quot;: &quot;2026-05-06&quot;}": "2026-05-06",
    LD % '{"a": {"datePublished": "2026-01-01"}, "b": [{"datePublished": "2026-01-02"}, {"x": {"dateCreated": "2026-01-03"}}]}': "2026-01-03",
    LD % '{"datePublished": ["2026-01-01"], "dateCreated": {"v": "2026-01-02"}, "uploadDate": 20260103}': None,
    LD % '{"datePublished": "{2026-01-09}"}': "2026-01-09",
    '<meta property="article:published_time" content="on 2026-04-01">': "2026-04-01",
    '<meta content="2026-04-02" property="article:published_time">': "2026-04-02",
    '<meta name="pubdate" content="never"><time datetime="2026-04-03T01:00">': "2026-04-03",
    '<meta name="modified" content="2026-04-03">': None,
    "<p>Posted April 4, 2026</p>": "2026-04-04",
    "<p>Posted April 31, 2026, not April 4, 2026</p>": None,
    LD % "{}": None,
    "": None,
}


def test_published_dates(spark):
    pages = spark.createDataFrame(list(enumerate(DATED)), "page_id long, html string")
    found = {r.page_id: r.published and str(r.published) for r in dates.published(pages).collect()}
    assert [found[k] for k in range(len(DATED))] == list(DATED.values())


def first_date(page):
    """By the rule: a stack of values; a record gives its own dates, then its values are put on the stack in order."""
    for block in re.findall(r'(?s)<script type="application/ld\+json">(.*?)</script>', page):
        try:
            stack = [json.loads(html.unescape(block))]
        except ValueError:
            continue
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                for key in dates.DATE_KEYS:
                    if isinstance(node.get(key), str) and (hit := re.search(r"\d{4}-\d{2}-\d{2}", node[key])):
                        try:
                            return dt.date.fromisoformat(hit[0])
                        except ValueError:
                            pass
                stack.extend(node.values())
            elif isinstance(node, list):
                stack.extend(node)
    return None


def test_dates_of_random_blocks(spark):
    rng = random.Random(9)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.4:
            keys = rng.sample([*dates.DATE_KEYS, "dateModified", "z", "a", "@graph", "b'c"], rng.randint(0, 4))
            return {k: value(depth - 1) for k in keys}
        if depth and kind < 0.55:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([None, True, 20240101, 1.5, "no", "{", "[2024-02-02]", "2024-02-30", "", f"on 20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T00", 'quo"te & <b>'])

    pages = []
    for _ in range(300):
        blocks = [json.dumps(value(4)) for _ in range(rng.randint(1, 3))]
        blocks = [b[:-1] if rng.random() < 0.15 else html.escape(b) if rng.random() < 0.3 else b for b in blocks]
        pages.append("<body>" + "".join(LD % b for b in blocks) + "</body>")
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    found = {r.page_id: r.published for r in dates.published(rows).collect()}
    wrong = [(p, found[k], first_date(p)) for k, p in enumerate(pages) if found[k] != first_date(p)]
    assert not wrong, wrong[:2]


def test_a_walk_over_sitemaps(spark):
    index = lambda *urls: "<sitemapindex>" + "".join(f"<loc>{u}</loc>" for u in urls) + "</sitemapindex>"
    pages = lambda *urls: "<urlset>" + "".join(f"<loc> {u} </loc>" for u in urls) + "</urlset>"
    docs = [
        ("http://a/sitemap.xml", True, 200, "text/xml", index("http://a/img.xml", "http://a/page1.xml", "http://a/post.xml", "http://a/page2.xml")),
        ("http://a/page1.xml", False, 200, "text/xml", pages("http://a/special-no")),
        ("http://a/post.xml", True, 200, "text/xml", pages("http://a/x", "http://a/happy-hour?a=1&amp;b=2", "http://a/specials", "http://a/specials")),
        ("http://b/sitemap.xml", True, 200, "text/xml", index("http://b/1.xml", "http://b/2.xml")), ("http://b/1.xml", True, 200, "text/xml", index("http://b/sitemap.xml", "http://b/page.xml")),
        ("http://b/page.xml", True, 200, "text/html", pages("http://b/special")), ("http://c/sitemap.xml", True, 404, "text/xml", pages("http://c/special")),
    ]
    documents = spark.createDataFrame(docs, "url string, allowed boolean, status int, content_type string, body string")
    hosts = spark.createDataFrame([(h, f"http://{h}") for h in "abcd"], "host string, base string")
    found = {r.host: (r.fetched, r.found) for r in sitemaps.listed(hosts, documents).collect()}
    assert found == {
        "a": (["http://a/sitemap.xml", "http://a/post.xml"], ["http://a/happy-hour?a=1&b=2", "http://a/specials"]), "b": (["http://b/sitemap.xml", "http://b/1.xml", "http://b/page.xml"], []),
        "c": (["http://c/sitemap.xml"], []), "d": (["http://d/sitemap.xml"], []),
    }
    queue = spark.createDataFrame([("a", ["http://a/menu", "http://a/deals"]), ("b", ["http://b/special"])], "host string, links array<string>")
    topped = {r.host: r.links for r in sitemaps.topped_up(queue, sitemaps.listed(hosts, documents), 3).collect()}
    assert topped == {"a": ["http://a/happy-hour?a=1&b=2", "http://a/specials", "http://a/menu"], "b": ["http://b/special"]}


def test_rules_of_robots(spark):
    files_ = {
        "a": (200, "User-agent: *\nDisallow: /private\nAllow: /private/not\n\nUser-agent: OfferBot\nAllow: /private/menu\nDisallow: /private # ours\nDisallow:"), "b": (200, "User-agent: other\nDisallow: /\n"),
        "c": (401, ""), "d": (500, "User-agent: *\nDisallow: /"), "e": (200, "Disallow: /\nUser-agent: *\nDisallow: /x"),
    }
    rows = spark.createDataFrame([(h, s, b) for h, (s, b) in files_.items()], "host string, status int, body string")
    urls = ["http://a/private/menu/1", "http://a/private/x", "http://a/", "http://a", "http://b/x", "http://c/x", "http://d/x", "http://e/x?q", "http://e/y", "http://f/x"]
    found = {r.url: (r.allowed, r.refusal) for r in robots.allowed(spark.createDataFrame([(u,) for u in urls], "url string"), rows, "OfferBot/2.0").collect()}
    no, shut = (False, "robots.txt disallows"), (False, "robots.txt unreadable (401), treated as disallow")
    assert found == {u: no if u in ("http://a/private/x", "http://e/x?q") else shut if u == "http://c/x" else (True, None) for u in urls}


def test_rules_are_those_of_the_standard_parser(spark):
    from urllib.robotparser import RobotFileParser

    rng = random.Random(8)
    lines = ["User-agent: *", "User-agent: OfferBot", "user-AGENT : offer", "User-agent: other", "Disallow: /a", "Disallow: /a/b", "Allow: /a/b/c", "Allow: /", "Disallow:", "Disallow: /", "", "# note", "Disallow: /a # why", "Sitemap: http://x", "nonsense", " "]
    bodies = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    paths = ["", "/", "/a", "/a/b", "/a/b/c?d", "/b"]
    rows = spark.createDataFrame([(f"h{k}", 200, b) for k, b in enumerate(bodies)], "host string, status int, body string")
    urls = spark.createDataFrame([(f"http://h{k}{p}",) for k in range(len(bodies)) for p in paths], "url string")
    found = {r.url: r.allowed for r in robots.allowed(urls, rows, "OfferBot/1.0").collect()}
    for k, body in enumerate(bodies):
        parser = RobotFileParser()
        parser.parse(body.split("\n"))
        for p in paths:
            assert found[f"http://h{k}{p}"] == parser.can_fetch("OfferBot/1.0", f"http://h{k}{p}"), (body, p)


def test_outcomes_of_fetches(spark):
    answer = "struct<status:int,content_type:string,error:string,body:string>"
    page = "<p>Happy hour Mon - Fri 4pm - 6pm</p>"
    rows = [
        (1, True, None, (200, "text/html", None, page), None), (2, False, "robots.txt disallows", None, None), (3, True, None, (403, "text/html", None, ""), (200, "text/html; charset=x", None, page)),
        (4, True, None, (403, "text/html", None, ""), (None, None, "Refused", None)), (5, True, None, (200, "application/pdf", None, "a < b"), None), (6, True, None, (200, "application/pdf", None, ""), None),
        (7, True, None, (None, None, "Timeout", None), None), (8, True, None, (200, "", None, "x"), None), (9, True, None, (404, "text/html", None, page), None),
    ]
    out = robots.outcomes(spark.createDataFrame(rows, f"k int, allowed boolean, refusal string, first {answer}, second {answer}"))
    assert {r.k: r.result for r in out.collect()} == {
        1: "ok, 1 quote(s)", 2: "robots.txt disallows", 3: "ok, 1 quote(s)", 4: "403 text/html", 5: "ok, 0 quote(s)", 6: "pdf, no extractable text", 7: "error: Timeout", 8: "200 ?", 9: "404 text/html",
    }
    assert {r.k: r.html for r in out.collect()}[5] == "<pre>a &lt; b</pre>"


def test_a_card_holds_one_licences_offers(spark):
    kept = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4), ("d", 5), ("d", 6)], "venue string, deal_id long").selectExpr("*", "deal_id AS deal_pos", "'likely' AS confidence", "CAST(NULL AS STRING) AS items_source")
    venues = spark.createDataFrame([("a", 0, 1, "x"), ("b", 1, 2, "x"), ("c", 2, 9, "q"), ("d", 3, 1, "z")], "venue string, pos long, lid long, addr string")
    base = spark.createDataFrame([(1, [2], "x")], "lid long, also_lids array<long>, addr string")
    cards = {r.key: (r.venue, [d.deal_id for d in r.deals]) for r in build.cards(kept, venues, base).collect()}
    assert cards == {"1": ("b", [2, 3]), "orphan:c": ("c", [4])}  # b and d have as many: the first stays


def test_combinations_of_a_day(spark):
    rows = [("a", "food_combo", [(1,)]), ("a", "food_combo", [(1,)]), ("a", "happy_hour", [(1,)]), ("b", "food_combo", [(2,), (2,), (2,)]), ("b", "happy_hour", [(1,)])]
    kept = spark.createDataFrame(rows, "venue string, type string, windows array<struct<dow:int>>")
    assert [r.venue for r in build.capped(kept).collect()] == ["a", "a", "a"]


def test_summaries_keep_the_order_of_appearance(spark):
    rows = [(1, 5, 960, 1080, 0), (1, 1, 840, 900, 1), (1, 1, 840, 900, 2), (1, 3, 840, 900, 3), (2, 1, 960, 1080, 0), (2, 1, 960, 1080, 1), (2, 2, 960, 1080, 2)]
    out = {r.deal_id: r.summary for r in feed.schedule_summary(spark.createDataFrame(rows, "deal_id long, dow int, start int, end int, pos int")).collect()}
    assert out == {1: "Fri 4pm–6pm · Mon, Mon, Wed 2pm–3pm", 2: "Mon, Mon, Tue 4pm–6pm"}
    plan = feed.schedule_summary(spark.createDataFrame(rows, "deal_id long, dow int, start int, end int, pos int"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_places_in_a_sorted_table(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), k, "abc"[k % 3]) for k in range(500)]
    out = ranks.ranked(spark.createDataFrame(rows, "s int, k int, v string").repartition(7), ("s", "k"), "v")
    want = sorted(rows)
    assert [tuple(r) for r in out.orderBy("rank").collect()] == [(*r, n + 1, want[n - 1][2] if n else None) for n, r in enumerate(want)]
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    assert ranks.ranked(spark.createDataFrame([], "s int, v string"), ("s",), "v").collect() == []


def test_tenths_are_pythons(spark):
    rng = random.Random(4)
    xs = [0.25, 0.35, 2.65, 0.05, 0.15, 0.45, 0.55, 0.75, 1.25, 1.75, 2.675, 1e14 + 0.5, -0.25, -2.65, 0.0, 12.3, 99.95] + [rng.uniform(0, 60) for _ in range(300)] + [k / 20 for k in range(200)] + [k / 100 for k in range(300)]
    out = spark.createDataFrame([(x,) for x in xs], "x double").select("x", R.tenths(F.col("x")).alias("t")).collect()
    assert all(r.t == round(r.x, 1) for r in out), [r for r in out if r.t != round(r.x, 1)][:5]


def test_floods_and_equal_times_of_a_sender(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", day, 5, k) for k in range(40)] + [("a", day, 1, 99), ("b", day, 1, 1), ("b", day, 2, 2), ("a", dt.date(2024, 1, 2), 9, 7)]
    out = moderation.rate_limited(spark.createDataFrame(rows, "ip_hash string, day date, ts int, id int"), 3)
    assert sorted((r.ip_hash, r.id) for r in out.where("admitted").collect()) == [("a", 0), ("a", 1), ("a", 7), ("a", 99), ("b", 1), ("b", 2)] and out.count() == len(rows)


def test_upserts_take_a_batchs_latest_row(spark, tmp_path):
    batch = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (1, 7, "mid"), (2, 1, "x")], "key long, at int, v string")
    streams.upsert(str(tmp_path / "t"), "key", 4, "at")(batch, 0)
    assert sorted((r.key, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "new"), (2, "x")]


def test_a_stopped_run_equals_one_run(spark, tmp_path):
    schema = "key long, n int"
    for k in range(5):
        spark.createDataFrame([(10 * k + i, i) for i in range(3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "work"))
    do = lambda b: b.select("key", F.when(F.col("n") > 0, "ok").otherwise("missing").alias("outcome"))
    runs = [("stopped", 2), ("stopped", 1), ("stopped", None), ("whole", None)]
    logs = {name: sorted(map(tuple, resume.run(spark, str(tmp_path / "work"), schema, do, str(tmp_path / name), 1, stop).collect())) for name, stop in runs}
    assert logs["stopped"] == logs["whole"] and len(logs["whole"]) == 15


def test_a_look_up_reaches_the_reader(spark):
    from offerlens.plans import catalogue

    plan = catalogue.queries()["photo_lookup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_id,77)" in plan


def test_what_is_left_to_do(spark):
    work = spark.createDataFrame([(k, f"z{k % 2}", f"http://{'Inn' if k < 6 else 'bar'}{k}") for k in range(10)], "key long, zone_id string, website string")
    log = spark.createDataFrame([(0, 1, "ok"), (2, 1, "missing"), (4, 1, "missing"), (4, 2, "ok"), (6, 1, "ok"), (6, 2, "missing")], "key long, at int, outcome string")
    left = lambda **c: [r.key for r in resume.remaining(work, log, **c).orderBy("key").collect()]
    assert left() == [1, 2, 3, 5, 6, 7, 8, 9] and left(zone="z0") == [2, 6, 8] and left(zone="z0", match="INN") == [2] and left(again=True, key="4") == [4] and left(limit=2) == [1, 2]


def test_landed_answers_with_pushed_predicates(spark, tmp_path):
    for area, answers in {"z1": [{"places": [{"id": "a", "displayName": {"text": "A"}, "location": {"latitude": 40.5, "longitude": -75}}, {"id": "b"}, "junk"]}, {"error": 1}], "z 2": [{"places": [{"id": "c", "location": {"latitude": "x"}}]}]}.items():
        for k, answer in enumerate(answers):
            (tmp_path / f"area={area}").mkdir(exist_ok=True)
            (tmp_path / f"area={area}" / f"{k}.json").write_text(json.dumps(answer))
    (tmp_path / "area=z1" / "bad.json").write_text("{not json")
    rows = services.landed(spark, str(tmp_path), "places")
    assert sorted((r.area, r.place_id, r.place_name, r.lat) for r in rows.collect()) == [("z 2", "c", None, None), ("z1", "a", "A", 40.5), ("z1", "b", None, None)]
    near = rows.where("area = 'z1' AND lat > 40 AND length(place_id) = 1")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert [r.place_id for r in near.collect()] == ["a"] and near.rdd.getNumPartitions() == 3
    assert plan.count("Filter (length(place_id") == 1 and "lat" not in plan.split("Filter (")[1].split(")")[0]
    assert rows.where("area = 'nowhere'").collect() == []


def test_documents_of_zones_come_back(spark, tmp_path):
    deals = "array<struct<id:bigint,verified_by:string,items:array<string>>>"
    rows = [("z1", "2", "B", [(1, "auto_extract", []), (2, "auto_extract", [])]), ("z1", "1", "a", [(3, "staff", [])]), ("z1", "3", "C", []), ("z2", "4", "D", [(5, "auto_extract", ["x"])])]
    publish.write_documents(spark.createDataFrame(rows, f"zone_id string, id string, name string, deals {deals}"), str(tmp_path / "d"))
    assert sorted(p.name for p in (tmp_path / "d").iterdir() if p.suffix == ".json" and p.name[0] not in "._") == ["venues-z1.json", "zone-z1.json", "zone-z2.json"]
    offers = files.published_offers(spark, str(tmp_path / "d"))
    assert sorted((r.zone_id, r.venue, r.deal_id) for r in offers.collect()) == [("z1", "1", 3), ("z1", "2", 1), ("z1", "2", 2), ("z2", "4", 5)]
    assert [tuple(r) for r in files.unpriced(offers).collect()] == [("2", 2)]
    assert [r.venue_pos for r in offers.where("venue = '1'").collect()] == [0]
    many = [("z1", str(k), "N", [(k, "auto_extract", [])]) for k in range(40)]
    publish.write_documents(spark.createDataFrame(many, f"zone_id string, id string, name string, deals {deals}"), str(tmp_path / "e"), most=10)
    assert sorted(r.deal_id for r in files.published_offers(spark, str(tmp_path / "e"), "zone-z1").collect()) == list(range(40)) and (tmp_path / "e" / "zone-z1.3.json").exists()


def test_decay_over_batches_and_late_rows(spark, tmp_path):
    schema = "deal_id long, confidence string, verified_at timestamp"
    day = lambda k: dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=k)
    batches = [
        [(1, "likely", day(0)), (2, "verified", day(0)), (3, "unconfirmed", day(0)), (9, "disputed", day(10))], [(9, "disputed", day(60))], [(1, "likely", day(-1)), (1, "likely", day(70)), (9, "disputed", day(75))],
        [(9, "disputed", day(130)), (1, "likely", day(2))], [(9, "disputed", day(260))],
    ]
    before = {k: spark.conf.get(k) for k in decay.STORE}
    try:
        for name, value in decay.STORE.items():
            spark.conf.set(name, value)
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            changes = streams.run_once(decay.decayed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 day"), "append", str(tmp_path / "out"))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    told = sorted((r.deal_id, str(r["at"])[:10], r.effective) for r in changes.where("deal_id < 9").collect())
    assert told == [
        (1, "2024-01-01", "likely"), (1, "2024-02-16", "unconfirmed"), (1, "2024-03-11", "likely"), (1, "2024-04-26", "unconfirmed"), (1, "2024-07-10", "hidden"), (2, "2024-01-01", "verified"), (3, "2024-01-01", "unconfirmed"), (3, "2024-05-01", "hidden"),
    ]
    assert {r.deal_id: r.effective for r in decay.shown(changes).collect()} == {1: "hidden", 2: "verified", 3: "hidden", 9: "disputed"}


@pytest.mark.parametrize("named", ["", "Own"])
def test_approved_photos_fall_back_on_the_submission(spark, named):
    subs = spark.createDataFrame([(1, 10, 5, "Seen", [1]), (1, 11, 9, "Seen", [2]), (2, 12, 1, "", [3])], "lid long, photo_id long, approved_at int, venue_name string, deals array<int>")
    base = spark.createDataFrame([(1, named, "1 Main", "z1", None)], "lid long, name string, address string, zone_id string, website string")
    rows = {r.lid: (r.name, r.address, r.zone_id, r.photo_id, r.deals) for r in moderation.approved(subs, base).collect()}
    assert rows == {1: (named or "Seen", "1 Main", "z1", 11, [2]), 2: ("2", "", "", 12, [3])}
