"""Operators on small tables whose answer is known, sources and sinks, and the streams against their batch forms."""

import datetime

import pytest
from pyspark.sql import functions as F

from offerlens.operators import feed, lookup, moderation, publish, registry, resolve, validate
from offerlens.sources import files
from offerlens.streaming import moderation as streams

FRIDAY_5PM = feed.Moment(5, 17 * 60)


def tables(spark, venues, deals, windows, items=()):
    return (
        spark.createDataFrame(venues, "lid long, name string, zone_id string, lat double, lng double"), spark.createDataFrame(deals, "deal_id long, lid long, confidence string, age_days int"),
        spark.createDataFrame(windows, "deal_id long, dow int, start int, end int"), spark.createDataFrame(list(items), "deal_id long, category string, price double, pct double, off double"),
    )


HERE, FAR = (40.089, -75.396), (39.91743, -75.38833)


def test_unreachable_offers_come_last_and_usable_time_counts(spark):
    venues = [(1, "Near", "a", *HERE), (2, "Far", "a", *FAR), (3, "Fleeting", "a", *FAR), (4, "Empty", "a", *HERE)]
    rows = feed.ranked(feed.feed(*tables(spark, venues, [(1, 1, "likely", 0), (2, 2, "likely", 0), (3, 3, "likely", 0)], [(1, 5, 960, 1030), (2, 5, 960, 1260), (3, 5, 960, 1025)]), FRIDAY_5PM)).collect()
    assert [r.name for r in rows] == ["Far", "Near", "Fleeting", "Empty"] and [r.grp for r in rows] == [0, 0, 4, 5]
    assert rows[1].until - rows[1].drive == 7


def test_hidden_disputed_and_filtered_offers_are_absent(spark):
    t = tables(spark, [(1, "A", "a", *HERE)], [(1, 1, "disputed", 0), (2, 1, "unconfirmed", 121), (3, 1, "likely", 1)], [(d, 5, 960, 1080) for d in (1, 2, 3)], [(3, "draft", 4.0, None, None), (3, "food", 1.0, None, None)])
    assert [r.deal_id for r in feed.feed(*t, FRIDAY_5PM).collect()] == [3]
    counts = {f: feed.feed(*t, FRIDAY_5PM, only=f).count() for f in ("all", "food", "cheap", "drinks")}
    assert counts == {"all": 1, "food": 1, "cheap": 1, "drinks": 1} and feed.feed(*t, FRIDAY_5PM, zone="b").count() == 0


@pytest.mark.parametrize("dow, now, ahead, live, wait", [(5, 660, 0, False, 300), (5, 1140, 1, False, 1140), (7, 660, 5, False, 5 * 1440 + 300), (5, 1020, 0, True, 0)])
def test_next_occurrence(spark, dow, now, ahead, live, wait):
    windows = spark.createDataFrame([(1, 5, 960, 1080), (1, 6, 840, 960)], "deal_id long, dow int, start int, end int")
    r = feed.next_occurrences(windows, feed.Moment(dow, now)).head()
    assert (r.day_ahead, r.live, r.starts_in) == (ahead, live, wait)


def test_a_window_that_is_over_runs_again_in_a_week(spark):
    windows = spark.createDataFrame([(1, 5, 960, 1000)], "deal_id long, dow int, start int, end int")
    assert feed.next_occurrences(windows, FRIDAY_5PM).head().day_ahead == 7


def test_schedule_summary(spark):
    rows = [(1, d, 960, 1080) for d in range(1, 6)] + [(1, d, 840, 960) for d in (6, 7)] + [(2, 3, 960, 1080), (3, 1, 960, 1080), (3, 3, 960, 1080)]
    out = {r.deal_id: r.summary for r in feed.schedule_summary(spark.createDataFrame(rows, "deal_id long, dow int, start int, end int")).collect()}
    assert out == {1: "Mon–Fri 4pm–6pm · Sat, Sun 2pm–4pm", 2: "Wed 4pm–6pm", 3: "Mon, Wed 4pm–6pm"}


def test_combo_cap_drops_all_offers_of_a_venue(spark):
    deals = spark.createDataFrame([(i, 1, "food_combo") for i in range(3)] + [(9, 1, "happy_hour"), (10, 2, "food_combo"), (11, 2, "food_combo")], "deal_id long, lid long, type string")
    windows = spark.createDataFrame([(i, 1) for i in (0, 1, 2, 9, 10, 11)], "deal_id long, dow int")
    assert {r.lid for r in validate.combo_cap(deals, windows).collect()} == {2}


def test_tiers_of_a_registry_row(spark):
    types = spark.createDataFrame([("Hotel (Malt)",), ("Winery",), ("Club (Malt)",), ("Distributor",)], "t string")
    assert [r[0] for r in types.select(registry.tier(F.col("t"))).collect()] == ["core", "taproom", "club", None]


def test_shared_elements_keep_agreeing_names(spark):
    licences = spark.createDataFrame([(1, "Shake House"), (2, "KOP HOLDCO"), (3, "Other Inc"), (4, "Lone LLC"), (5, "Blue Moon"), (6, "Moon Blue Inn")], "lid long, name string")
    elements = spark.createDataFrame([(10, "Shake Shack"), (11, "Nothing Alike"), (12, "Blue Moon Cafe")], "place_id long, place_name string")
    matches = spark.createDataFrame([(1, 10, "a"), (2, 10, "a"), (3, 10, "a"), (4, 11, "a"), (5, 12, "a"), (6, 12, "a")], "lid long, place_id long, matched_by string")
    assert {r.lid for r in resolve.collapse_shared(matches, licences, elements).collect()} == {1, 4, 5, 6}


def test_collapsed_premises_keep_the_richest(spark):
    rows = spark.createDataFrame([(3, 1, True, False, False), (1, 1, False, True, True), (2, 1, True, False, False)], "lid long, premises_key long, has_photo boolean, has_site boolean, has_lat boolean")
    r = registry.collapsed(rows).head()
    assert r.lid == 2 and r.also_lids == [1, 3]


def test_display_and_coordinates_never_mix_sources(spark):
    row = spark.range(1)
    named = row.select(lookup.display_name(F.lit(""), F.lit(None).cast("string"), F.lit("SCREWBALLS LLC")).alias("n")).head().n
    assert (named.name, named.named_by) == ("Screwballs", "registry")
    at = row.select(lookup.coordinates((F.lit(None).cast("double"), F.lit(1.0), "a"), (F.lit(2.0), F.lit(3.0), "b")).alias("c")).head().c
    assert (at.lat, at.lng, at.by) == (2.0, 3.0, "b")


def test_status_folds_forward_only(spark):
    t = lambda n: datetime.datetime(2024, 1, 1, 0, n)
    events = [(1, t(1), 1, "extract"), (1, t(2), 2, "approve"), (1, t(3), 3, "extract"), (1, t(4), 4, "reject"), (2, t(1), 1, "error"), (3, t(1), 1, "reject"), (4, t(1), 1, "extract"), (4, t(2), 2, "extract")]
    out = {r.id: (r.status, r.n_refused) for r in moderation.final_status(spark.createDataFrame(events, "id long, ts timestamp, seq int, event string")).collect()}
    assert out == {1: ("approved", 2), 2: ("pending", 1), 3: ("rejected", 0), 4: ("extracted", 1)}


def test_photo_offers_replace_those_of_the_same_photo(spark):
    schema = "lid long, photo_id string, deal string"
    old, new = spark.createDataFrame([(1, "p", "old"), (1, "q", "kept")], schema), spark.createDataFrame([(1, "p", "new")], schema)
    assert {r.deal for r in moderation.replaced(old, new).collect()} == {"new", "kept"}


def test_sources_and_sinks_round_trip(spark, tmp_path):
    (tmp_path / "reg.csv").write_text("LID,License Number,License Type,Status,Premises,Licensee,Premises Address,County,Municipality,Expiration Date\n1,R-1,Brewery,Active,,X LLC,\"1 Main St, Town PA 19001\",C,M,2027\n")
    assert files.registry_csv(spark, str(tmp_path / "reg.csv")).head()["Premises Address"] == "1 Main St, Town PA 19001"
    line = lambda z, lat: "\t".join(["x", z, *"2345678", str(lat), "-75"])
    (tmp_path / "zips.tsv").write_text("\n".join([line("19001", 40.0), "short\tline", "", line("19001", 41.0)]))
    rows = files.gazetteer_tsv(spark, str(tmp_path / "zips.tsv"))
    licences = spark.createDataFrame([(1, "19001"), (2, "19999")], "lid long, zip string")
    assert {r.lid: r.zip_lat for r in registry.located(licences, rows, (40.0, -75.0)).collect()} == {1: 41.0, 2: None}
    (tmp_path / "seeds.json").write_text('{"1": ["http://a", {"url": "http://b", "name": "B"}]}')
    assert [(r.url, r.name) for r in files.seeds(spark, str(tmp_path / "seeds.json")).orderBy("pos").collect()] == [("http://a", None), ("http://b", "B")]
    (tmp_path / "k.json").write_text('{"a": {"n": 1}, "b": {"n": 2}}')
    assert {r.key: r.n for r in files.keyed_json(spark, str(tmp_path / "k.json"), "struct<n:int>").collect()} == {"a": 1, "b": 2}
    assert files.json_document(spark, str(tmp_path / "none.json"), "a int").count() == 0
    board = spark.createDataFrame([("1", "z1", "B", 0), ("2", "z1", "A", 2), ("3", "z2", "C", 1)], "key string, zone_id string, name string, n_deals long")
    publish.write_bundles(board, str(tmp_path / "bundles"))
    back = files.bundles(spark, str(tmp_path / "bundles"), "z1")
    assert {r.key for r in back.collect()} == {"1", "2"} and "PartitionFilters: [isnotnull(zone_id" in back._jdf.queryExecution().toString()
    files.write_csv(board, str(tmp_path / "csv"))
    files.write_sorted_json(board, str(tmp_path / "json"), "key")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 3
    assert [r.key for r in files.not_done(board, board.where("zone_id = 'z1'"), "key").collect()] == ["3"]
    try:
        import pypdf  # noqa: F401

        assert files.pdf_pages(spark, str(tmp_path / "k.json")).head().text == ""
    except ImportError:  # says so, rather than to find every file blank
        with pytest.raises(Exception, match="pypdf"):
            files.pdf_pages(spark, str(tmp_path / "k.json")).collect()


def test_streams_over_several_batches_equal_their_batch_forms(spark, tmp_path):
    t = lambda d, m: datetime.datetime(2024, 1, d, 0, m)
    rows = [(i, 7 if i % 3 else 8, t(1 + i // 20, i % 20)) for i in range(40)]
    schema = "id long, ip_hash long, ts timestamp"
    for k in range(4):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = streams.run_once(streams.rate_limit(source.withColumn("day", F.to_date("ts")), 3), "append", str(tmp_path / "cp"))
    admitted = seen.groupBy("ip_hash", "day").agg(F.count_if("admitted").alias("n"), F.count("*").alias("all"))
    assert all(r.n == min(3, r["all"]) for r in admitted.collect()) and seen.count() == 40
    out = spark.read.schema(schema).parquet(str(tmp_path / "in")).selectExpr("ip_hash AS id", "ts")
    writer = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")).selectExpr("ip_hash AS key", "ts").groupBy("key").agg(F.max("ts").alias("ts"))
    query = writer.writeStream.outputMode("update").foreachBatch(streams.upsert(str(tmp_path / "table"), "key")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination()
    newest = {(r.id, r.ts) for r in out.groupBy("id").agg(F.max("ts").alias("ts")).collect()}
    assert {(r.key, r.ts) for r in streams.upserted(spark, str(tmp_path / "table")).collect()} == newest
    streams.upsert(str(tmp_path / "table"), "key")(spark.createDataFrame([(8, t(9, 0))], "key long, ts timestamp"), 99)  # a batch that touches one bucket
    assert {(r.key, r.ts) for r in streams.upserted(spark, str(tmp_path / "table")).collect()} == {(k, t(9, 0) if k == 8 else x) for k, x in newest}


def test_rows_behind_the_watermark_are_refused_by_the_stream_alone(spark, tmp_path):
    t = lambda d, h: datetime.datetime(2024, 1, d, h)
    schema = "id long, ip_hash long, ts timestamp"
    for part in ([(1, 7, t(1, 0))], [(2, 7, t(8, 0))], [(3, 7, t(9, 0)), (4, 7, t(1, 5))]):  # the last row is a week late
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        seen = streams.run_once(streams.rate_limit(source.withColumn("day", F.to_date("ts")), 3), "append", str(tmp_path / "cp"))
    assert sorted(r.id for r in seen.collect()) == [1, 2, 3]
    batch = moderation.rate_limited(spark.read.schema(schema).parquet(str(tmp_path / "in")).withColumn("day", F.to_date("ts")), 3)
    assert batch.where("admitted").count() == 4


def test_counts_grow_expire_and_survive_a_replay(spark, tmp_path):
    day = lambda d: datetime.date(2024, 1, d)
    batch = lambda *rows: spark.createDataFrame([(i, day(d)) for i, d in rows], "ip_hash long, day date")
    write, path = streams.counted(str(tmp_path / "rate")), str(tmp_path / "rate")
    found = lambda: {(r.ip_hash, r.day.day, r.n) for r in streams.counts(spark, path).collect()}
    assert found() == set()
    write(batch((1, 1), (1, 1), (2, 1)), 0)
    assert found() == {(1, 1, 2), (2, 1, 1)}
    for _ in range(2):  # the same batch again counts once
        write(batch((1, 1), (3, 1)), 1)
        assert found() == {(1, 1, 3), (2, 1, 1), (3, 1, 1)}
    write(batch(), 2)
    assert found() == {(1, 1, 3), (2, 1, 1), (3, 1, 1)}
    write(batch((1, 2), (2, 1)), 3)  # a new day: what is older goes, late requests too
    assert found() == {(1, 2, 1)}
    assert sorted(p.name for p in (tmp_path / "rate").iterdir()) == ["batch=2", "batch=3"]


def test_one_licence_of_an_element(spark):
    hits = spark.createDataFrame([(9, 0), (10, 2), (11, 3), (5, 0), (6, 0), (7, 0)], "lid long, n_hits int")
    sites = spark.createDataFrame([(9, "n1"), (10, "n1"), (11, "n1"), (5, "n2"), (6, "n2"), (7, ""), (99, "n1")], "lid long, osm string")
    assert {tuple(r) for r in resolve.one_per_element(hits, sites).collect()} == {(10, 2, "10"), (5, 0, "5"), (7, 0, "7")}
    assert resolve.one_per_element(hits.limit(0), sites).count() == 0


def test_index_is_one_sorted_file(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 0), ("a", 3)], "zone_id string, n_deals long")
    publish.write_index(rows, str(tmp_path / "index"))
    assert len(list((tmp_path / "index").glob("part-*"))) == 1
    assert [tuple(r) for r in spark.read.schema("zone_id string, venues long, with_deals long, deals long").json(str(tmp_path / "index")).collect()] == [("a", 2, 1, 3), ("b", 1, 1, 2)]
