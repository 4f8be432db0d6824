"""Venue JSON of both sources, read into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.functions.geo import point
from tavola.functions.text import filled, first_filled
from tavola.operators.tables import last_wins

_ITEM = "struct<name:string,description:string,price:double>"
_SECTION = f"struct<name:string,items:array<{_ITEM}>>"
_VENUE = "struct<id:string,name:string,url:string,address:struct<firstLine:string,city:string,postalCode:string,location:struct<type:string,coordinates:array<double>>>,menus:string>"
VENUES = f"map<string,{_VENUE}>"
GROUPED_MENUS = f"map<string,struct<sections:array<{_SECTION}>>>"
LISTED_MENUS = f"array<{_SECTION}>"


def read_venue_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """venue_id, ordinal, venue of JSON objects keyed by id; a later file (by name) wins, unreadable files are skipped.

    ``ordinal`` follows the place of an id's first occurrence.  A whole file is one value here; keep large sets as JSON lines.
    """
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", VENUES).alias("venues"))
    rows = files.where(F.col("venues").isNotNull()).select("file", F.posexplode("venues").alias("at", "venue_id", "venue"))
    first = rows.groupBy("venue_id").agg(F.min(F.struct("file", "at")).alias("_first"))
    latest = last_wins(rows, ["venue_id"], "file")
    return latest.join(first, "venue_id").select("venue_id", F.concat_ws(":", "_first.file", F.lpad(F.col("_first.at").cast("string"), 10, "0")).alias("ordinal"), "venue")


def load_venues(spark: SparkSession, primary: str | None, split_glob: str) -> DataFrame:
    """The primary file if it can be read and holds venues, else the split files ``part_*.json``."""
    if primary:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(primary)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            found = read_venue_files(spark, primary)
            if not found.isEmpty():
                return found
    return read_venue_files(spark, split_glob)


def merge_venue_files(spark: SparkSession, glob: str) -> DataFrame:
    """venue_id and json of one-venue files: the id inside, else the file's name; later files win, broken ones are skipped."""
    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    ok = files.withColumn("_v", F.expr("try_parse_json(value)")).where(F.col("_v").isNotNull())
    stem = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    rows = ok.select("file", first_filled(F.expr("try_variant_get(_v, '$.id', 'string')"), stem).alias("venue_id"), F.col("value").alias("json"))
    return last_wins(rows, ["venue_id"], "file").select("venue_id", "json")


def venue_rows(venues: DataFrame) -> DataFrame:
    """id, ordinal, name, address, lat, lon, url; venues without a name go."""
    v = venues.where(filled(F.col("venue.name")).isNotNull())
    place = point(F.col("venue.address.location.coordinates"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return v.select(F.col("venue_id").alias("id"), "ordinal", F.col("venue.name").alias("name"), text("venue.address.firstLine").alias("address"), place["lat"].alias("lat"), place["lon"].alias("lon"), text("venue.url").alias("url"))


def address_line(first: Column, city: Column, postal: Column) -> Column:
    """Parts of an address that are there, with commas."""
    return F.concat_ws(", ", filled(first), filled(city), filled(postal))


def menu_item_rows(venues: DataFrame) -> DataFrame:
    """venue_id, name, description, price, section of all menus, whether groups of sections or a list of sections.

    Items without a name go; a section without a name is ``general``.
    """
    grouped = F.flatten(F.transform(F.map_values(F.from_json("venue.menus", GROUPED_MENUS)), lambda g: F.coalesce(g["sections"], F.from_json(F.lit("[]"), LISTED_MENUS))))
    listed = F.from_json("venue.menus", LISTED_MENUS)
    sections = F.when(F.ltrim(F.col("venue.menus")).startswith("["), listed).otherwise(grouped)
    rows = venues.where(filled(F.col("venue.name")).isNotNull()).select("venue_id", F.explode(sections).alias("s"))
    rows = rows.select("venue_id", F.coalesce("s.name", F.lit("general")).alias("section"), F.inline("s.items"))
    return rows.where(filled(F.col("name")).isNotNull()).select("venue_id", "name", F.coalesce("description", F.lit("")).alias("description"), "price", "section")


def read_place_list(spark: SparkSession, path: str) -> DataFrame:
    """id, name, address, lat, lon, maps_url of a JSON array of places; those without a name go.

    A place without an id gets one from its name and address, the same on every run.
    """
    schema = "id string, googlePlaceId string, name string, rawAddress string, address string, latitude string, longitude string, googleMapsUrl string"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    address = F.coalesce(first_filled("rawAddress", "address"), F.lit(""))
    made = F.sha2(F.concat_ws("\x00", "name", address), 256)
    return raw.where(filled(F.col("name")).isNotNull()).select(
        F.coalesce(first_filled("id", "googlePlaceId"), made).alias("id"), "name", address.alias("address"),
        F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), F.col("googleMapsUrl").alias("maps_url"),
    )


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """A taxonomy as CSV or Parquet; headers are trimmed, lower-cased and joined by underscores, the last row of an id wins."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True)
    names = ["_".join(c.strip().lower().split()) for c in raw.columns]
    rows = raw.toDF(*names).withColumn("ordinal", F.monotonically_increasing_id())
    return last_wins(rows, ["category_uidentifier"], "ordinal")


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """id, url of a JSON object (id to URL) or array (the place is the id)."""
    files = spark.read.text(path, wholetext=True)
    is_list = F.ltrim("value").startswith("[")
    named = files.where(~is_list).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "url"))
    listed = files.where(is_list).select(F.posexplode(F.from_json("value", "array<string>")).alias("id", "url"))
    return named.unionByName(listed.select(F.col("id").cast("string").alias("id"), "url"))


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """menu_id and its sorted image paths: one folder for each menu_id with jpg, jpeg or png files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    images = files.where(F.col("path").rlike(r"(?i)\.(jpe?g|png)$")).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("menu_id"), "path")
    return images.groupBy("menu_id").agg(F.array_sort(F.collect_list("path")).alias("images"))
