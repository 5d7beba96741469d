"""Places in a sorted table, however large: numbers and neighbours by ranges, never all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.session import written


def ranked(rows: DataFrame, order: Sequence[str], before: str) -> DataFrame:
    """rows with rank, from 1 in that order, and before: that column's value in the row before, null for the first.

    Rows are dealt out by ranges of the order and written; each range is numbered by itself. What a range must know of those before it is
    how many rows they hold and the last value of the nearest: two values for each range, which are all that the driver sees.
    order must tell rows apart, or equal ones stand in any order.
    """
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    kept = written(dealt, "ranges")
    parts = kept.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("low"), F.max_by(F.struct(F.col(before).alias("v")), "__at").alias("last")).collect()
    parts.sort(key=lambda r: r["__part"])
    begins = list(accumulate((r.n for r in parts), initial=0))
    schema = f"__part int, __begin long, __low long, __last {rows.schema[before].dataType.simpleString()}"
    table = spark.createDataFrame([(r["__part"], begins[k], r.low, parts[k - 1].last.v if k else None) for k, r in enumerate(parts)], schema)
    inner = Window.partitionBy("__part").orderBy("__at")
    met = kept.join(table, "__part")  # a row for each range
    value = F.when(F.col("__at") == F.col("__low"), F.col("__last")).otherwise(F.lag(before).over(inner))
    return met.select(*rows.columns, (F.col("__begin") + F.col("__at") - F.col("__low") + 1).alias("rank"), value.alias("before"))
