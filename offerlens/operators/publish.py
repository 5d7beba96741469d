"""From offers of several sources to one board: priority union, canonical venue, every venue once, roll-ups and partitioned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import text as T
from offerlens.operators import lookup, registry


def priority_union(*sources: DataFrame) -> DataFrame:
    """Rows of earlier sources win: a later row comes in only if neither its id nor its address is there.

    Two anti joins for each source; an OR of both keys would be a nested loop.
    """
    out = sources[0]
    for more in sources[1:]:
        new = more.join(out.select("id").distinct(), "id", "left_anti").join(out.select("addr").distinct(), "addr", "left_anti")
        out = out.unionByName(new, allowMissingColumns=True)
    return out


def canonical(deals: DataFrame, base: DataFrame) -> DataFrame:
    """deals with the lid of their board row: base(lid, also_lids, addr) by any of its lids, else by address (the least lid)."""
    own = base.select(F.col("lid").alias("canonical"), F.explode(F.concat(F.array("lid"), F.coalesce("also_lids", F.array().cast("array<bigint>")))).alias("lid")).groupBy("lid").agg(F.min("canonical").alias("_by_lid"))
    by_addr = base.groupBy("addr").agg(F.min("lid").alias("_by_addr"))
    joined = deals.join(own, "lid", "left").join(by_addr, "addr", "left")
    return joined.withColumn("canonical", F.coalesce("_by_lid", "_by_addr")).drop("_by_lid", "_by_addr")


def board(base: DataFrame, deals: DataFrame) -> DataFrame:
    """A row for every venue of base, with its offers counted, and for offers without a venue a row under `orphan:<id>`.

    Of several licences on one row the one with the most offers counts alone.
    """
    key = F.coalesce(F.col("canonical").cast("string"), F.concat(F.lit("orphan:"), F.col("id").cast("string")))
    counted = deals.groupBy(key.alias("key"), "lid").agg(F.count("*").alias("n")).groupBy("key").agg(F.max("n").alias("n_deals"))
    rows = base.select(F.col("lid").cast("string").alias("key"), "zone_id", "name")
    return rows.join(counted, "key", "full_outer").withColumn("n_deals", F.coalesce("n_deals", F.lit(0)).cast("long"))


def zone_index(rows: DataFrame) -> DataFrame:
    return rows.groupBy("zone_id").agg(F.count("*").alias("venues"), F.count_if(F.col("n_deals") > 0).alias("with_deals"), F.sum("n_deals").alias("deals"))


def bundle_order(rows: DataFrame) -> DataFrame:
    """Venues with offers first, then by name."""
    return rows.orderBy(F.col("zone_id"), F.col("n_deals") == 0, F.lower("name"), "key")


def write_bundles(rows: DataFrame, path: str) -> None:
    """JSON per zone, venues with and without offers apart; a zone's reader opens its folder alone. Dealt out by ranges, so a large zone is written by many tasks."""
    rows.withColumn("has_deals", F.col("n_deals") > 0).repartitionByRange("zone_id", F.lower("name"), "key").sortWithinPartitions("zone_id", F.lower("name"), "key").write.mode("overwrite").partitionBy("zone_id", "has_deals").json(path)


#: Cards of a document; a zone with more has several.
DOCUMENT_CARDS = 5_000


def write_documents(rows: DataFrame, path: str, most: int = DOCUMENT_CARDS) -> None:
    """Documents for each zone and kind of card: `zone-<id>` has those with offers, `venues-<id>` the others, in the order of names.

    rows(zone_id, id, name, deals). Where a zone has over `most` cards of a kind they are dealt into documents `<kind><id>.<k>` by their ids, so that no task holds
    a whole zone however large; whoever reads by the beginning of the name has them all.
    """
    kind = F.when(F.size("deals") > 0, "zone-").otherwise("venues-")
    cards = rows.select("zone_id", F.concat(kind, "zone_id").alias("document"), "id", "name", "deals")
    parts = cards.groupBy("document").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("string")
    dealt = cards.join(parts, "document").withColumn("document", F.when(F.col("parts") > 1, F.concat("document", F.lit("."), part)).otherwise(F.col("document")))
    order = F.struct(F.lower("name").alias("n"), "id", F.struct("id", "name", "deals").alias("v"))
    documents = dealt.groupBy("zone_id", "document").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["v"]).alias("venues"))
    documents.select("document", F.to_json(F.struct("zone_id", "venues")).alias("value")).repartition("document").write.mode("overwrite").partitionBy("document").text(path)
    _named_files(rows.sparkSession, path)


def _named_files(spark, path: str) -> None:
    """Each folder document=<name> becomes a file <name>.json: renames alone, a document's text is one file."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    store = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.globStatus(jpath(f"{path}/document=*/part-*")) or []:
        folder = status.getPath().getParent()
        store.rename(status.getPath(), jpath(f"{path}/{folder.getName().removeprefix('document=')}.json"))
        store.delete(folder, True)


def write_index(rows: DataFrame, path: str) -> None:
    """zone_index as JSON, a line a zone in the order of zones, in one file as there are few zones."""
    zone_index(rows).coalesce(1).sortWithinPartitions("zone_id").write.mode("overwrite").json(path)


def venue_rows(licences: DataFrame, places: DataFrame, sites: DataFrame, photos: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each licence(lid, name, zone_id) of a place to go to, with what the other sources know of it.

    places(lid, place_name, website, lat, lng) come before sites(lid, osm_name, website, lat, lng), each with a row a lid at most; a
    photo(lid, file, attribution) counts if files(file) lists it. Left joins on the one key, so that they share a shuffle.
    """
    there = photos.join(files.select("file"), "file", "left_semi").select("lid", F.struct("file", "attribution").alias("photo"))
    own = licences.select("lid", "name", "zone_id", "licence_type")
    joined = registry.walk_in(own).alias("l").join(places.alias("p"), "lid", "left").join(sites.alias("s"), "lid", "left").join(there, "lid", "left")
    chosen = lookup.display_name(F.col("p.place_name"), F.col("s.osm_name"), F.col("l.name"))
    at = lookup.coordinates((F.col("p.lat"), F.col("p.lng"), "place"), (F.col("s.lat"), F.col("s.lng"), "place"))
    website = F.coalesce(T.blank_to_null(F.col("p.website")), T.blank_to_null(F.col("s.website")))
    rows = joined.select("lid", "zone_id", "licence_type", F.col("l.name").alias("registry_name"), chosen.alias("c"), at.alias("at"), website.alias("website"), "photo")
    return rows.select("lid", "zone_id", "licence_type", "registry_name", "c.name", "c.named_by", "website", "at.lat", "at.lng", F.col("at.by").alias("geo_precision"), "photo")


def cache_name(built: Column, n_dealful: Column, shell: Column) -> Column:
    return F.concat_ws("-", F.lit("board"), built, n_dealful.cast("string"), F.left(F.sha2(shell, 256), F.lit(8)))


def with_prices(deals: DataFrame, prices: DataFrame) -> DataFrame:
    """Prices read later fill in where an automatic reading found none."""
    joined = deals.join(prices.select("slug", F.col("items").alias("_items")), "slug", "left")
    fill = (F.col("verified_by") == "auto_extract") & (F.size(F.coalesce("items", F.array())) == 0) & F.col("_items").isNotNull()
    return joined.withColumns({"items": F.when(fill, F.col("_items")).otherwise(F.col("items")), "items_source": F.when(fill, "llm_extract")}).drop("_items")


def refreshed(cache: DataFrame, current: DataFrame) -> DataFrame:
    """Coordinates by venue: kept by hand always, ours replaced when the address asked for has changed, new ones added, gone ones dropped."""
    joined = current.alias("n").join(cache.alias("o"), "id", "left")
    take = F.col("o.queried").isNull() | ((F.col("o.matched_by") == "auto") & (F.col("o.queried") != F.col("n.queried")))
    return joined.select("id", *[F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("queried", "lat", "lng", "matched_by")])
