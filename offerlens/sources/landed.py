"""Answers of outside services, landed as JSON: map elements, places, geocodes, model proposals.

The services themselves are called elsewhere; what they said is a table here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Map elements of landed extracts, with the place of an area's centre where it has no point of its own."""
    schema = "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    one = rows.select(F.explode("elements").alias("e")).select("e.*")
    return one.select(
        F.concat(F.left("type", F.lit(1)), F.col("id").cast("string")).alias("osm"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lng"), "tags"
    )


def places(spark: SparkSession, path: str) -> DataFrame:
    schema = "places array<struct<id:string,displayName:struct<text:string>,formattedAddress:string,location:struct<latitude:double,longitude:double>,websiteUri:string,primaryType:string,photos:array<struct<name:string>>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    one = rows.select(F.posexplode("places").alias("rank", "p"))
    return one.select(
        "rank", F.col("p.id").alias("place_id"), F.col("p.displayName.text").alias("place_name"), F.col("p.formattedAddress").alias("place_address"), F.col("p.location.latitude").alias("lat"),
        F.col("p.location.longitude").alias("lng"), F.col("p.websiteUri").alias("website"), F.col("p.primaryType").alias("primary_type"), F.size(F.coalesce("p.photos", F.array())).alias("n_photos"),
    )


def proposals(texts: DataFrame, column: str = "reply") -> DataFrame:
    """A model's replies as rows of items; a reply that is no list of proposals gives none."""
    listed = F.from_json(F.regexp_extract(column, r"(?s)(\[.*\])", 1), "array<struct<id:string,items:array<struct<category:string,label:string,price_usd:double,discount_pct:double,evidence:string>>>>")
    return texts.select(F.explode(listed).alias("p")).select("p.id", F.explode("p.items").alias("item")).select("id", "item.*")
