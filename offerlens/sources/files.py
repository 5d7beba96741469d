"""Sources and sinks: registry CSV, gazetteer TSV, JSON documents and bundles, pages, photos, PDF text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens import schemas


def registry_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(schemas.LICENCE).csv(path)


def gazetteer_tsv(spark: SparkSession, path: str, zip_at: int = 1, lat_at: int = 9, lng_at: int = 10) -> DataFrame:
    """(zip, zip_lat, zip_lng, ordinal): rows that are short or blank go; ordinal tells later rows of one ZIP from earlier ones: by file, then place in it."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(F.split("value", "\t").alias("c"), place.alias("ordinal"))
    rows = lines.where(F.size("c") > max(zip_at, lat_at, lng_at)).select(
        F.trim(F.col("c")[zip_at]).alias("zip"), F.col("c")[lat_at].try_cast("double").alias("zip_lat"), F.col("c")[lng_at].try_cast("double").alias("zip_lng"), "ordinal"
    )
    return rows.where("zip <> '' AND zip_lat IS NOT NULL AND zip_lng IS NOT NULL")


def json_document(spark: SparkSession, path: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """A JSON document or a folder of them; an empty table where there is none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if missing_ok and not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.option("multiLine", True).schema(schema).json(path)


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value...) of a document that is one object of records."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "v")).select("key", "v.*")


def bundles(spark: SparkSession, path: str, zone: str | None = None) -> DataFrame:
    """The published board; a zone's read opens its folder alone."""
    rows = spark.read.json(path)
    return rows.where(F.col("zone_id") == zone) if zone else rows


def published_offers(spark: SparkSession, path: str, prefix: str = "zone-") -> DataFrame:
    """(zone_id, venue, offer...) of published documents whose names begin so; the others in the folder aren't opened.

    A document is {zone_id, venues: [{id, deals: [...]}]}; a row is an offer, with the place of its venue and its own in the document.
    """
    schema = "zone_id string, venues array<struct<id:string,name:string,deals:array<struct<id:bigint,verified_by:string,items:array<string>>>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).where(F.startswith("_metadata.file_name", F.lit(prefix)))
    venues = rows.select("zone_id", F.posexplode("venues").alias("venue_pos", "v"))
    offers = venues.select("zone_id", "venue_pos", F.col("v.id").alias("venue"), F.posexplode("v.deals").alias("deal_pos", "d"))
    return offers.select("zone_id", "venue", "venue_pos", "deal_pos", F.col("d.id").alias("deal_id"), "d.verified_by", "d.items")


def unpriced(offers: DataFrame) -> DataFrame:
    """(venue, deal_id): of each venue the last offer that a machine read and that has no items; a person's reading isn't added to."""
    bare = offers.where("verified_by = 'auto_extract'").where(F.coalesce(F.size("items"), F.lit(0)) <= 0)
    return bare.groupBy("venue").agg(F.max_by("deal_id", F.struct("zone_id", "venue_pos", "deal_pos")).alias("deal_id"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(lid, url, name) of a document whose lists hold plain addresses and {url, name} records side by side."""
    text = spark.read.option("wholetext", True).text(path)
    lists = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("lid", "raw"))
    entries = lists.select("lid", F.posexplode(F.from_json("raw", "array<string>")).alias("pos", "entry"))
    record = F.from_json("entry", "struct<url:string,name:string>")
    return entries.select("lid", "pos", F.coalesce(record["url"], F.col("entry")).alias("url"), record["name"].alias("name"))


def photos(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))


def pdf_pages(spark: SparkSession, path: str, pages: int = 6) -> DataFrame:
    """(path, text) of PDF files, their first pages; a file that can't be read has an empty text. Needs pypdf."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import io

        from pypdf import PdfReader  # without it the read fails, rather than to find all files blank

        def one(data: bytes) -> str:
            try:
                return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages[:pages])
            except Exception:  # a broken file is an empty one
                return ""

        for batch in batches:
            yield batch.map(one)

    return photos(spark, path).select("path", text("data").alias("text"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_sorted_json(rows: DataFrame, path: str, *keys: str) -> None:
    """JSON in the order of keys, so that two builds of the same rows are the same text."""
    rows.orderBy(*keys).write.mode("overwrite").json(path)


def not_done(work: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Resume: the work whose keys are not recorded yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")
