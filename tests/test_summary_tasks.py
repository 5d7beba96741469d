"""Tasks of a summary grow with the table, so that what one of them holds doesn't."""

from offerlens.operators import feed


def test_windows_are_dealt_to_more_tasks_than_splits(spark):
    rows = spark.range(0, 4000, 1, 64).selectExpr("id % 1000 AS deal_id", "CAST(id % 7 + 1 AS INT) AS dow", "960 AS start", "1080 AS end", "CAST(id AS INT) AS pos")
    out = feed.schedule_summary(rows)
    assert out.rdd.getNumPartitions() > 64 and out.count() == 1000
