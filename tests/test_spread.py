"""Costly rows lie in more tasks than a file's splits."""

from offerlens.session import spread


def test_rows_are_spread_over_more_tasks_than_splits(spark):
    rows = spark.range(0, 1000, 1, 64)  # 64 splits, which a file of one row group may have as well
    assert spread(rows).rdd.getNumPartitions() > 64
