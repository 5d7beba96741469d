"""Landed pages, roundups, leads, photo pages and landed answers of services."""

import datetime
import json

from pyspark.sql import functions as F

from offerlens.operators import crawl
from offerlens.sources import landed


def value(spark, expression):
    return spark.range(1).select(expression).head()[0]


def test_roundups_drop_in_order(spark):
    today = datetime.date(2026, 8, 6)
    why = lambda ok, status, day: value(spark, crawl.roundup_verdict(F.lit(ok), F.lit(status), F.lit(day).cast("date"), F.lit(today)))
    assert [why(False, 404, None), why(True, 404, None), why(True, 200, None), why(True, 200, "2024-01-01"), why(True, 200, "2026-08-01")] == ["robots", "http 404", "undated", "older than 120d", None]


def test_mentions_need_two_words_the_zone_and_an_offer(spark):
    venues = spark.createDataFrame([(1, "z", "The Blue Moon"), (2, "z", "Taku"), (3, "y", "Blue Moon"), (4, "z", "Great American Pub")], "lid long, zone_id string, name string")
    text = "Best of town\n1. Blue Moon!\nnice place\nHappy hour Mon-Fri 4pm-6pm\nTaku\nGreat American: no offer here"
    articles = spark.createDataFrame([("u", "z", text)], "url string, zone_id string, text string")
    assert [(r.lid, r.quotes) for r in crawl.mentions(articles, venues).collect()] == [(1, ["Happy hour Mon-Fri 4pm-6pm"])]


def test_the_first_lead_that_proves_itself_wins(spark):
    venues = spark.createDataFrame([(1, "Dawson Street Pub", ["19127"]), (2, "Nobody Knows Inn", ["19000"])], "lid long, name string, places array<string>")
    seeds = spark.createDataFrame([(1, 0, "http://old.example")], "lid long, pos int, url string")
    leads = crawl.leads(venues, seeds)
    assert leads.where("lid = 1").orderBy("rank").head().url == "http://old.example"
    good = "Dawson Street Pub, Philadelphia 19127 " + "beer " * 400
    fetched = spark.createDataFrame([("http://old.example", "buy this domain dawson 19127"), ("https://dawsonstreetpub.com", good), ("https://www.dawsonstreetpub.com", good)], "url string, text string")
    out = crawl.proven_sites(leads, fetched, venues).collect()
    assert [(r.lid, r.website) for r in out] == [(1, "https://dawsonstreetpub.com")] and out[0].matched_by.startswith("guessed guessed domain, proved by name(dawson+street)")


def test_photo_pages_assets_and_paths(spark):
    page = F.lit("http://bar.com/home")
    html = F.lit("<a href='/menu'>m</a><a href='/gallery'>g</a><a href='http://else.com/photos'>x</a><a href='/home/'>about</a><a href='/about'>us</a>")
    assert value(spark, crawl.photo_pages(html, page)) == ["http://bar.com/gallery", "http://bar.com/about"]
    assert value(spark, crawl.pages_to_try(html, page, F.lit(True))) == ["http://bar.com/"]
    allowed = lambda url, ok: value(spark, crawl.asset_allowed(F.lit(url), page, F.lit(ok)))
    assert allowed("http://cdn.com/x", False) and not allowed("http://bar.com/x", False) and allowed("http://bar.com/x", True)
    assert value(spark, crawl.topped_up(F.array(F.lit("a")), F.array(*map(F.lit, "abcd")))) == ["a", "b", "c"] and value(spark, crawl.photo_path(F.lit(7))) == "img/venues/7.jpg"
    assert value(spark, crawl.attribution(F.array(F.lit("A"), F.lit("")))) == "Photo: A / Google" and value(spark, crawl.attribution(F.lit(None).cast("array<string>"))) == "Photo: Google"


def test_quotes_are_joined_in_order(spark):
    hits = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "x" * 3000)], "lid long, pos int, quote string")
    out = {r.lid: r.text for r in crawl.joined_quotes(hits).collect()}
    assert out[1] == "a\nb" and len(out[2]) == 2400


def test_photo_offers_are_unconfirmed(spark):
    rows = spark.createDataFrame([([("x", [(1, "16:00", "18:00")], [("draft", "$5")])],)], "d array<struct<type:string,windows:array<struct<dow:int,start:string,end:string>>,items:array<struct<category:string,quote:string>>>>")
    (offer,) = rows.select(crawl.photo_offers(F.col("d"), F.lit("p"), F.lit("t"), F.lit("2026-01-01").cast("date"))).head()[0]
    assert offer.confidence == "unconfirmed" and offer.source.photo_id == "p" and offer["items"][0].asDict() == {"category": "draft"}


def test_landed_answers(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 40.0, "lon": -75.0, "tags": {"name": "A"}}, {"type": "way", "id": 2, "center": {"lat": 41.0, "lon": -76.0}, "tags": {}}]}))
    assert [(r.osm, r.lat, r.tags.get("name")) for r in landed.elements(spark, str(tmp_path / "o.json")).collect()] == [("n1", 40.0, "A"), ("w2", 41.0, None)]
    (tmp_path / "p.json").write_text(json.dumps({"places": [{"id": "x", "displayName": {"text": "N"}, "location": {"latitude": 1.0, "longitude": 2.0}, "photos": [{"name": "a"}]}]}))
    assert landed.places(spark, str(tmp_path / "p.json")).head().n_photos == 1
    replies = spark.createDataFrame([('Here: [{"id": "v", "items": [{"category": "wine", "label": "w", "price_usd": 5}]}]',), ("none",)], "reply string")
    assert [(r.id, r.price_usd) for r in landed.proposals(replies).collect()] == [("v", 5.0)]
