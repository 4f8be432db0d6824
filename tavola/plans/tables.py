"""Venues, menus and their like as projections of the test tables, whole tables each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.config import CITIES

#: (taxonomy_id, name, ordinal): some misspelt, plural, of two words, or the target of aliases.
TAXONOMY = (
    ("T01", "anvil", 1), ("T02", "Bolts", 2), ("T03", "gear", 3), ("T04", "gizmos", 4), ("T05", "plates.", 5), ("T06", "ring", 6),
    ("T07", "old rod", 7), ("T08", "widgit", 8), ("T09", "red-hot widget", 9), ("T10", "Chicken", 10), ("T11", "Soft drinks", 11), ("T12", "Fruit", 12),
)
#: Words that item texts end with, in turn.
TAILS = ("Pollo!", "Coca Cola", "(limón)", "", "fresh")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side (0 or 1), id, ordinal, name, address, lat, lon of every document as a venue of one of two sources.

    A venue has a name and a street only, so of a document's words five make a venue; this is how fixtures are made.
    """
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.split("text", r"\s+", 7).alias("w"))
    return d.select(
        (F.col("doc_id") % 2).cast("int").alias("side"),
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").alias("ordinal"),
        F.array_join(F.slice("w", 1, 3), " ").alias("name"),
        F.concat_ws(" ", F.array_join(F.slice("w", 4, 2), " "), (F.col("n_chars") % 200).cast("string")).alias("address"),
        F.when(F.col("doc_id") % 97 != 0, F.lit(41.3) + (F.col("n_chars") % 500) / F.lit(2500.0)).alias("lat"),
        (F.lit(2.0) + (F.col("n_chars") % 400) / F.lit(2000.0)).alias("lon"),
    )


def side(spark: SparkSession, sf_dir: str, which: int) -> DataFrame:
    return venues(spark, sf_dir).where(F.col("side") == which).drop("side")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("item_id"), (F.col("p_partkey") % 10).alias("venue_id"), F.col("p_name").alias("name"), F.lower("p_type").alias("description"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("section"), "p_size")


def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), (F.col("item_id") % len(TAILS) + 1).cast("int"))
    return items(spark, sf_dir).select("item_id", F.trim(F.concat_ws(" ", "name", tail)).alias("text"))


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TAXONOMY), "taxonomy_id string, name string, ordinal long")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, taxonomy_id, confidence: a stored classification of the parts that have been ordered."""
    l = read(spark, sf_dir, "lineitem")
    got = l.groupBy(F.col("l_partkey").alias("item_id")).agg(F.round(F.max("l_discount"), 2).alias("confidence"))
    number = (F.col("item_id") % len(TAXONOMY) + 1).cast("string")
    return got.select("item_id", F.concat(F.lit("T"), F.lpad(number, 2, "0")).alias("taxonomy_id"), "confidence")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("venue_id"), F.col("o_orderkey").alias("match_id"))


def known_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select(F.col("section").alias("menu_id"), "item_id", F.col("name").alias("db_name"), F.col("price").alias("db_price"), F.col("description").alias("db_description"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A menu's items as an image might give them: shouted or renamed, with other prices and descriptions."""
    i = items(spark, sf_dir)
    name = F.when(F.col("p_size") % 4 == 0, F.upper("name")).when(F.col("p_size") % 4 == 1, F.concat(F.lit("7. "), F.col("name"))).when(F.col("p_size") % 4 == 2, F.concat("name", F.lit(" xl"))).otherwise(F.lit("zzz qq"))
    described = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 == 1, "something else").otherwise(F.col("description"))
    price = F.when(F.col("p_size") % 3 == 0, F.col("price") + 1).otherwise(F.col("price"))
    return i.select(F.col("section").alias("menu_id"), F.col("item_id").alias("at"), name.alias("name"), price.alias("price"), described.alias("description"), F.lit("").alias("section"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return d


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    euros = F.concat(F.floor(F.col("p_size") / 2).cast("string"), F.lit(","), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))
    return p.select("p_partkey", F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(euros, F.lit(" €"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("EUR "), euros)).otherwise(F.col("p_type"))).alias("line"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    city = F.element_at(F.array(*[F.lit(c.upper()) for c in (*CITIES, "Nowhere", "Londonderry")]), (F.col("c_custkey") % (len(CITIES) + 2) + 1).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(", ", F.concat(F.lit("calle "), F.col("c_nationkey")), city, F.lit("x")).alias("address"))


def price_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey and its price as text in US and European style, and in mixed styles."""
    p = read(spark, sf_dir, "part")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    whole, rest = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    thousands = F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("string"), F.lit("#"), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    us = F.concat(F.lit("$"), F.replace(thousands, F.lit("#"), F.lit(",")), F.lit("."), rest)
    eu = F.concat(F.replace(thousands, F.lit("#"), F.lit(".")), F.lit(","), rest, F.lit(" €"))
    k = F.col("p_partkey") % 6
    auto = F.when(k == 0, us).when(k == 1, eu).when(k == 2, whole.cast("string")).when(k == 3, F.concat(whole.cast("string"), F.lit(","), rest)).when(k == 4, F.concat(F.lit("1.000."), rest)).otherwise("Free")
    return p.select("p_partkey", us.alias("us"), eu.alias("eu"), auto.alias("auto"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = read(spark, sf_dir, "pages").select("page_id", "url")
    made = [F.col("url"), F.concat(F.lit("https://a.b/restaurants-"), F.col("page_id"), F.lit("/menu")), F.concat(F.lit("https://a.b/menu/"), F.col("page_id"), F.lit("/x")), F.concat(F.lit("https://a.b/?cid="), F.col("page_id")), F.lit(" not a url")]
    return u.select("page_id", F.posexplode(F.array(*made)).alias("at", "url"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber") + F.col("l_partkey") * 10).alias("ordinal"), F.lit(100.0).alias("width"), ((F.col("l_quantity") * 7) % 100).alias("cx"), F.floor(F.col("l_extendedprice")).cast("double").alias("cy"), F.concat_ws("-", "l_returnflag", F.col("l_partkey").cast("string")).alias("text"), (F.col("l_discount") * 8).alias("conf"))


def venue_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venue_id, venue as read from files; the menus of every other supplier are a list instead of groups."""
    s = read(spark, sf_dir, "supplier")
    section = F.concat(F.lit('{"name":"S'), F.col("s_nationkey"), F.lit('","items":[{"name":"'), F.col("s_name"), F.lit('","description":"d","price":'), F.col("s_suppkey"), F.lit('.5},{"name":"","price":1},{"name":"second"}]}'))
    menus = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("["), section, F.lit("]"))).otherwise(F.concat(F.lit('{"a":{"sections":['), section, F.lit(']},"b":{"sections":['), section, F.lit("]}}")))
    coordinates = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit(2.5), F.lit(41.5))).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit(2.5), F.lit(None).cast("double")))
    address = F.struct(F.col("s_name").alias("firstLine"), F.lit("Barcelona").alias("city"), F.lit("").alias("postalCode"), F.struct(F.lit("Point").alias("type"), coordinates.alias("coordinates")).alias("location"))
    name = F.when(F.col("s_suppkey") % 10 == 9, "").otherwise(F.col("s_name"))
    return s.select(F.col("s_suppkey").cast("string").alias("venue_id"), F.col("s_suppkey").alias("ordinal"), F.struct(F.lit(None).cast("string").alias("id"), name.alias("name"), F.lit("u").alias("url"), address.alias("address"), menus.alias("menus")).alias("venue"))
