"""Clocks of windows are read once each."""

from pyspark.sql import functions as F

from offerlens.operators import validate


def test_clocks_are_read_once(spark):
    rows = spark.createDataFrame([("x",)], "t string").select("t", F.lit(None).cast(validate.WINDOWS).alias("w"), F.lit(None).cast(validate.ITEMS).alias("i"), F.struct(*[F.col("t").alias(c) for c in ("kind", "url", "photo_id", "outlet", "published")]).alias("s"))
    pattern = r"^\d{2}:\d{2}$"
    text = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert text(validate.deal_errors(F.col("t"), F.col("t"), F.col("w"), F.col("i"), F.col("t"), F.col("s"))).count(pattern) <= 2
    assert text(validate.one_a_day(F.col("w"))).count(pattern) <= 2
