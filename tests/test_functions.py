"""Column functions on golden cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from offerlens.functions import grounding, pagetext, ranking, schedule
from offerlens.operators import dates
from offerlens.functions import text as T
from offerlens.operators import moderation, validate


def value(spark, expression, **cells):
    """expression over one row of string cells."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()]).select(expression).head()[0]


def many(spark, build, *inputs):
    """build(F.col('x')) for each input, in order."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("x")).alias("v")).collect()]


def windows(spark, *quotes):
    return [[(w.dow, w.start, w.end) for w in ws] for ws in many(spark, schedule.windows_from, *quotes)]


def test_days(spark):
    assert many(spark, schedule.days_in, "Monday - Friday", "Sunday - Friday", "weekdays and Sat", "daily", "nothing", "Tue, Thurs") == [
        [1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 7], [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6, 7], [], [2, 4],
    ]


def test_time_ranges(spark):
    out = many(spark, schedule.window_in, "4 - 6 pm", "11 - 2 pm", "mon - fri 4p - 6p", "11a - 2p", "11pm-12am", "buy 4 - 6 pizzas", "seats 5 - 9 people", "13 - 14 pm")
    assert [x and (x.start, x.end) for x in out] == [(960, 1080), (660, 840), (960, 1080), (660, 840), (1380, 1440), None, None, None]


def test_windows_of_quotes(spark):
    out = windows(
        spark, "Happy Hour Monday - Thursday 4:30 - 6:00", "HAPPY HOUR / Sunday - Friday: / 4:30pm - 6:30pm", "Happy Hour / 04:30 PM - 06:30 PM / Friday August 7th", "hours vary by location, Monday 4-6pm",
        "Monday-Friday 4-6 pm and Sunday-Thursday 10pm-12am", "Tuesday-Friday: 4-7pm | Saturday & Sunday: 3-6pm", "Monday & Friday 4-6pm", "5pm-8pm | Sunday-Thursday, 5pm-7pm Friday",
        "Mon-Fri lunch 11-2pm and dinner 5-9pm / 9pm - 11pm", "Mon–Fri 5–7PM & Sun–Thu 10PM–12PM",
    )
    assert out[0] == [] and out[3] == [] and out[7] == [] and out[8] == []
    assert out[1] == [(d, 990, 1110) for d in (1, 2, 3, 4, 5, 7)] and out[2] == [(5, 990, 1110)]
    assert {(d, s) for d, s, _ in out[4]} == {(d, 960) for d in (1, 2, 3, 4, 5)} | {(d, 1320) for d in (1, 2, 3, 4, 7)}
    assert {d for d, s, _ in out[5] if s == 960} == {2, 3, 4, 5} and 7 in {d for d, s, _ in out[5] if s == 900}
    assert out[6] == [(1, 960, 1080), (5, 960, 1080)] and all(d < 6 for d, s, _ in out[9] if s == 1020)


def test_clauses_and_sides(spark):
    assert many(spark, schedule.clauses, "open 5pm-2am with Happy Hour 10pm-11pm", "Mon-Fri 4-6pm") == [None, ["Mon-Fri 4-6pm"]]
    assert many(spark, schedule.one_sided, "Sunday-Thursday, 5pm-7pm Friday", "Mon-Fri 4-6pm", "4-6pm | Friday") == [False, True, True]


def test_items(spark):
    out = many(spark, schedule.items_in, "Sip $8 wines, enjoy $7 bites, $12 parking validation", "half price pizza and $4 Drafts, $4 drafts")
    assert [(i.category, i.label, i.price_usd, i.discount_pct) for i in out[0]] == [("wine", "wines", 8.0, None), ("food", "bites", 7.0, None)]
    assert [(i.category, i.price_usd, i.discount_pct) for i in out[1]] == [("draft", 4.0, None), ("food", None, 50.0)]


def test_streets_and_names(spark):
    cores = many(spark, T.street_core, "W Lancaster Avenue", "LANCASTER AVE", "Ridge Pike", "W RIDGE PK", "W ST RD", "West Street Road")
    assert cores[0] == cores[1] == "lancaster" and cores[2] == cores[3] == "ridge" and cores[4] == cores[5] != ""
    names = many(spark, T.name_core, "ALEKSANDAR LLC", "Restaurant Aleksandar", "THE GREAT AMERICAN PUB", "Great American Pub")
    assert names[0] == names[1] and names[2] == names[3]
    keys = many(
        spark, T.registry_key, "929-931 MACDADE BLVD, COLLINGDALE PA 19023-3720", "ROXBORO MARKET SQ SHOPPING CENTER STORES 15 & 16  8919 RIDGE AVE, PHILADELPHIA PA 19128",
        "BALTIMORE PIKE, CONCORDVILLE PA 19331",
    )
    assert [k and (k.zip, k.number, k.core) for k in keys] == [("19023", "929", "macdade"), ("19128", "8919", "ridge"), None]


def test_pretty_and_clean_names(spark):
    assert many(spark, T.pretty_name, "OHAGANS BAR & RESTAURANT", "TOMMY'S TAVERN + TAP", "SCREWBALLS LLC", "KOP FONDUE INC", "Peppers By Amedeo's", "LLC", "TOMMY'S BAR-B-Q 'TIL") == [
        "Ohagans Bar & Restaurant", "Tommy's Tavern + Tap", "Screwballs", "KOP Fondue", "Peppers By Amedeo's", "LLC", "Tommy's Bar-B-Q 'Til",
    ]
    assert many(spark, T.clean_name, "SEASONS 52 #4510", "YARD HOUSE 8371", "RED LOBSTER #778", "STABLE 12 BREWING CO", "CATCH 101") == ["seasons 52", "yard house", "red lobster", "stable 12 brewing", "catch 101"]
    assert many(spark, T.pretty_address, "929-931 MACDADE BLVD, COLLINGDALE PA 19023-3720") == ["929-931 Macdade Blvd, Collingdale PA 19023"]


def test_host_stems_and_hosts(spark):
    out = many(spark, T.domain_stems, "4326 MAIN STREET HOLDCO, LLC", "THE PUB", "DAWSON STREET PUB", "CRESSON-INN", "NEW RIDGE BREWING CO.")
    assert out[:2] == [[], []] and "dawsonstreetpub" in out[2] and "cressoninn" in out[3] and "newridgebrewing" in out[4]
    assert many(spark, T.registrable, "locations.pjspub.com", "www.pjspub.com:443", "pjspub.com") == ["pjspub.com"] * 3


def test_numbers_and_places(spark):
    addresses = ["THE COURT UNIT C263A  690 W DEKALB PIKE, KING OF PRUSSIA PA 19406", "KING OF PRUSSIA PLAZA 205 MALL BLVD, KOP PA 19406", "A 640 W. DEKALB PK #1250", "B 160 N GULPH RD STE 233", "12 Nowhere"]
    assert many(spark, T.street_number, *addresses) == ["690", "205", "640", "160", "12"]
    assert many(spark, T.house_number, "30-32 E State St", "7-15 S High St", "324 W Swedesford Rd") == ["30 E State St", "7 S High St", "324 W Swedesford Rd"]
    agree = lambda a, b, x, y: value(spark, T.places_agree(F.col("a"), F.col("b"), F.col("x"), F.col("y")), a=a, b=b, x=x, y=y)
    assert agree("THE CHEESECAKE FACTORY RESTAURANTS INC", "The Cheesecake Factory", "640 W PK 19406", "640 W Pk 19406") and not agree("TOMMY'S", "Tommy Bahama", "1 19406", "1 19406")
    assert not agree("IRON HILL", "Iron Hill Brewery", "1 19406", "1 19382")
    geo = lambda site: value(spark, T.is_geocode(F.col("n"), F.col("w"), F.lit(0), F.col("a")), n="940 Township Line Rd", w=site, a="940 TOWNSHIP LINE RD")
    assert geo("") and not geo("http://x")


def test_proof_of_a_page(spark):
    named, places = F.array(F.lit("creeds"), F.lit("seafood")), F.array(F.lit("norristown"), F.lit("19406"))
    pages = ["Creed's Seafood, King of Prussia 19406 " + "text " * 400, "Creed's Seafood of Elsewhere" + " text" * 400, "A page of 19406" + " text" * 400, "Creeds seafood 19406 buy this domain", "Creeds seafood 19406 coming soon"]
    assert [bool(x) for x in many(spark, lambda x: T.proven(x, named, places), *pages)] == [True, False, False, False, False]


def test_references_are_those_of_html(spark):
    import html

    texts = ["a &amp; b", "&#x2019;&#8217;&#39;", "&amp;lt; &lt;", "&copy2024 &copy; &notin; &notit;", "&#128; &#x80;", "&#0; &#xD800; &#1114112; &#x110000", "&nbsp;&eacute;&Eacute;&hellip;", "& &; &# &#x; &zzz; x&y", "&#65", "&#x1F600; &bigstar;", "none", "&&amp;&"]
    assert many(spark, pagetext.decoded, *texts) == [html.unescape(t) for t in texts]


def test_visible_text_and_offer_lines(spark):
    assert many(spark, pagetext.visible_text, "<div>HAPPY HOUR</div><p>Monday &#8211; Friday 4pm to 6pm</p>", "<style>.happy hour{}</style><p>Open daily</p>") == ["HAPPY HOUR\nMonday – Friday 4pm to 6pm", "Open daily"]
    quotes = many(spark, pagetext.offer_quotes, "HAPPY HOUR\n$5 wine\nfood\n4pm - 6pm", "Happy hour 4pm-6pm\nMon", "Happy Birthday parties")
    assert quotes == [["HAPPY HOUR / $5 wine / 4pm - 6pm", "$5 wine"], ["Happy hour 4pm-6pm"], []]


def test_links_and_images(spark):
    html = "<a href='/happy-hour'>x</a><a href='https://facebook.com/menu'>menu</a><a href='menu.jpg'>Menu</a><a href='menu.pdf#p'>Menu</a><a href='http://locations.bar.com/specials'>s</a>"
    page = F.lit("http://www.bar.com/a/b")
    assert many(spark, lambda h: pagetext.candidate_links(h, page), html) == [["http://locations.bar.com/specials", "http://www.bar.com/happy-hour", "http://www.bar.com/a/menu.pdf"]]
    assert many(spark, lambda h: pagetext.share_image(h, page), "<meta property='og:image' content='/i.jpg?a=1&amp;b=2'>", "<meta property='og:image' content='/i.svg'>") == ["http://www.bar.com/i.jpg?a=1&b=2", None]
    assert many(spark, lambda h: pagetext.inline_images(h, page), "<img src='logo.png'><img src='tacos.jpg'><img src='spacer.gif'>") == [["http://www.bar.com/a/tacos.jpg"]]
    assert many(spark, lambda h: pagetext.css_images(h, page), "a{background:url('/room.jpg')} b{background:url(data:image/png;base64,x)}") == [["http://www.bar.com/room.jpg"]]


def test_publish_dates_and_recency(spark):
    day = datetime.date
    pages = [
        '<script type="application/ld+json">{"@graph":[{"datePublished":"2026-06-01T10:00"}]}</script>', '<meta property="article:published_time" content="2026-05-02T01:00">', "<p>June 3, 2026</p>", "<p>none</p>",
        '<time datetime="2026-13-45">',
    ]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    assert [r.published for r in dates.published(rows).orderBy("page_id").collect()] == [day(2026, 6, 1), day(2026, 5, 2), day(2026, 6, 3), None, None]
    fresh = many(spark, lambda x: pagetext.fresh_enough(x.cast("date"), F.lit(day(2026, 8, 6))), "2024-10-15", "2026-06-01", "2026-04-07", "2026-04-08", None)
    assert fresh == [False, True, False, True, False]


def test_clock_money_and_distance_texts(spark):
    assert many(spark, lambda x: ranking.clock(ranking.minutes(x)), "16:00", "16:30", "09:00", "12:00", "00:00", "24:00") == ["4pm", "4:30pm", "9am", "12pm", "12am", "midnight"]
    assert many(spark, lambda x: ranking.duration(x.cast("int")), "42", "60", "95") == ["42 min", "1h", "1h 35m"]
    part = lambda *a: value(spark, ranking.item_amount(*[F.lit(x).cast("double") for x in a]))
    assert [part(5, None, None), part(7.5, 50, None), part(None, 50, 2), part(None, None, 2), part(None, None, None)] == ["$5", "$7.50", "50% off", "$2 off", ""]
    miles = lambda m, p: value(spark, ranking.miles_text(F.lit(m), F.lit(p)))
    assert [miles(3.24, True), miles(3.24, False), miles(0.05, True), miles(12.4, True)] == ["3.2 mi", "~3 mi", "here", "12 mi"]
    assert 11 < value(spark, ranking.haversine_miles(*[F.lit(x) for x in (40.089, -75.396, 39.91743, -75.38833)])) < 12.5
    assert many(spark, lambda d: ranking.iso_dow(d.cast("date")).cast("int"), "2026-08-02", "2026-08-03", "2026-07-31") == [7, 1, 5]


def test_decay(spark):
    step = lambda c, a: value(spark, ranking.effective_confidence(F.lit(c), F.lit(a).cast("int")))
    assert [step("likely", a) for a in (0, 45, 46, 120, 121, None)] == ["likely", "likely", "unconfirmed", "unconfirmed", "hidden", "likely"]
    assert [step("verified", 300), step("disputed", 300), step("unconfirmed", 121)] == ["verified", "disputed", "hidden"]


@pytest.mark.parametrize(
    "change, error",
    [
        ({}, None), ({"windows": [(1, "14:00", "18:30")]}, "4h/day"), ({"windows": [(d, "14:00", "18:00") for d in range(1, 8)]}, "24h/week"), ({"windows": [(1, "22:00", "24:00")]}, None),
        ({"windows": [(1, "22:00", "25:00")]}, "past midnight"), ({"windows": [(1, "22:00", "02:00")]}, "past midnight"), ({"windows": []}, "no windows"), ({"windows": [(9, "14:00", "15:00")]}, "dow out of range"),
        ({"label": "All you can drink"}, "unlawful"), ({"label": "2 for 1 wells"}, "unlawful"), ({"type": "daily_special", "windows": [(1, "11:00", "23:00")]}, None), ({"price": None}, "neither a price nor a discount"),
        ({"url": None}, "no source"), ({"kind": "hearsay"}, "unknown source kind"), ({"kind": "roundup"}, "must name who said it"), ({"kind": "roundup", "outlet": "Paper"}, "recency cannot be gated"),
        ({"kind": "roundup", "outlet": "Paper", "published": "2026-06-01"}, "caps at unconfirmed"), ({"kind": "roundup", "outlet": "Paper", "published": "2026-06-01", "confidence": "unconfirmed"}, None),
    ],
)
def test_deal_rules(spark, change, error):
    d = {"type": "happy_hour", "confidence": "likely", "windows": [(1, "14:00", "18:00")], "label": "drafts", "price": 5.0, "url": "http://x", "kind": "venue_site", "outlet": None, "published": None} | change
    row = spark.createDataFrame(
        [(d["type"], d["confidence"], d["windows"], [("draft", d["label"], d["price"], None, None)], None, (d["kind"], d["url"], None, d["outlet"], d["published"]))],
        f"type string, confidence string, windows {validate.WINDOWS}, items {validate.ITEMS}, fine string, source struct<kind:string,url:string,photo_id:string,outlet:string,published:string>",
    )
    errors = row.select(validate.deal_errors(*[F.col(c) for c in ("type", "confidence", "windows", "items", "fine", "source")])).head()[0]
    assert errors == [] if error is None else any(error in e for e in errors)


def test_price_grounding(spark):
    def why(evidence, text="Enjoy $5 drafts  and half price apps", category="draft", label="drafts", price=5.0, pct=None):
        number = lambda x: F.lit(x).cast("double")
        return value(spark, grounding.refusal(F.lit(evidence), F.lit(text), F.lit(category), F.lit(label), number(price), number(pct)))

    assert why("$5 drafts and half") is None and why("half price apps", category="food", label="apps", price=None, pct=50.0) is None
    assert why("$6 drafts") == "evidence not in the quote" and why("$5 drafts", price=6.0) == "price not written in the evidence" and why("$5 drafts", pct=50.0).startswith("needs exactly one")
    assert why("$5 drafts", category="novelty") == "category" and why("$5 drafts", label="bottomless drafts") == "unlawful claim" and why("$5 drafts", label="x" * 31) == "label length" and why("") == "no evidence"


def test_transcript_grounding(spark):
    schema = "deals array<struct<type:string,windows:array<struct<dow:int>>,items:array<struct<label:string,quote:string>>>>, transcript string"
    deals = [("a", [], [("kept", "$5  DRAFTS"), ("gone", "$9 wine")]), ("b", [(1,)], [("gone too", "")]), ("c", [], [])]
    row = spark.createDataFrame([(deals, "menu: $5 drafts")], schema)
    kept = row.select(grounding.grounded(F.col("deals"), F.col("transcript"))).head()[0]
    assert [(d.type, [i.label for i in d["items"]]) for d in kept] == [("a", ["kept"]), ("b", [])]
    assert row.select(grounding.ungrounded(F.col("deals"), F.col("transcript"))).head()[0] == ["gone", "gone too"]
    assert value(spark, grounding.name_differs(F.lit("Other Place"), F.lit("The Pub"))) and not value(spark, grounding.name_differs(F.lit("The Pub"), F.lit("the pub on main")))


def test_photo_bytes(spark):
    segment = lambda kind, data: b"\xff" + bytes([kind]) + (len(data) + 2).to_bytes(2, "big") + data
    head, tail = b"\xff\xd8" + segment(0xE0, b"JFIF"), segment(0xDB, b"table") + b"\xff\xda\x00\x02data\xff\xd9"
    jpeg = head + segment(0xE1, b"Exif position") + segment(0xFE, b"comment") + tail
    assert moderation.without_metadata(jpeg) == head + tail and moderation.without_metadata(b"\xff\xd8\xff\xe1\xff") == b"\xff\xd8\xff\xe1\xff" and moderation.without_metadata(None) is None
    rows = spark.createDataFrame([(1, jpeg), (2, b"\x89PNG\r\n\x1a\n0000"), (3, b"RIFF0000WEBPx"), (4, b"GIF89a")], "id int, data binary")
    out = rows.orderBy("id").select(moderation.photo_type(F.col("data")), moderation.stripped()).collect()
    assert [r[0] for r in out] == ["image/jpeg", "image/png", "image/webp", None] and bytes(out[0][1]) == head + tail


def test_admission_codes(spark):
    good = b"\xff\xd8\xff" + b"0" * 2000
    code = lambda over=False, form=True, person=True, data=good, lid="1": value(spark, moderation.refusal_code(F.lit(over), F.lit(form), F.lit(person), F.lit(data), F.lit(lid)))
    assert [code(), code(over=True), code(form=False), code(person=False), code(data=b"x"), code(data=b"0" * 2000), code(lid=" "), code(data=None)] == [None, 429, 400, 403, 400, 415, 400, 400]
