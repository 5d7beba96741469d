"""What a task of the feed holds: a venue's offers don't meet the venues one by one, and windows lie in more tasks as the table grows."""

from offerlens.operators import feed


def _tables(spark, n=400):
    venues = spark.range(20).selectExpr("id AS lid", "concat('v', id) AS name", "concat('z', id % 2) AS zone_id", "40.0D AS lat", "-75.0D AS lng")
    deals = spark.range(n).selectExpr("id AS deal_id", "id % 5 * 2 AS lid", "'happy_hour' AS type", "'verified' AS confidence", "CAST(1 AS INT) AS age_days")
    windows = spark.range(n).selectExpr("id AS deal_id", "5 AS dow", "960 AS start", "1080 AS end")
    items = spark.range(n).selectExpr("id AS deal_id", "'food' AS category", "9.0D AS price", "CAST(NULL AS DOUBLE) AS pct", "CAST(NULL AS DOUBLE) AS off")
    return venues, deals, windows, items


def test_venues_without_offers_meet_each_venue_with_offers_once(spark):
    for zone in ("z0", None):
        rows = feed.feed(*_tables(spark), zone=zone)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        anti = plan[plan.index("Join LeftAnti") :].split("\n")
        prefix = anti[1][: anti[1].index(":- ")]
        right = next(x for x in anti[1:] if x.startswith(prefix + "+- "))
        assert "Aggregate [lid" in right
        assert rows.where("deal_id IS NULL").count() == (5 if zone else 15)


def test_windows_of_the_feed_are_dealt_to_more_tasks_than_splits(spark):
    windows = spark.range(0, 4000, 1, 64).selectExpr("id % 1000 AS deal_id", "CAST(id % 7 + 1 AS INT) AS dow", "960 AS start", "1080 AS end")
    out = feed.next_occurrences(windows, feed.Moment())
    assert out.rdd.getNumPartitions() > 64 and out.count() == 1000
