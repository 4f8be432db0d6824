"""Questions about matches, categories, venues and menus, each as one DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.functions.text import filled
from tavola.functions.urls import query_digits
from tavola.operators.menu import diff_aggregates


def percent(part: Column, whole: Column) -> Column:
    """Share in per cent with two decimals; 0 of nothing is 0."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(F.lit(0.0))


def match_rate(venues: DataFrame, matches: DataFrame) -> DataFrame:
    """total_venues, matched_venues, match_rate; venues (id), matches (venue_id)."""
    counts = venues.agg(F.count("id").alias("total_venues")).join(matches.agg(F.count_distinct("venue_id").alias("matched_venues")))
    return counts.withColumn("match_rate", percent(F.col("matched_venues"), F.col("total_venues")))


def top_categories(classifications: DataFrame, taxonomy: DataFrame, limit: int = 10) -> DataFrame:
    """name, n of the most frequent categories; ties by name."""
    counts = classifications.groupBy("taxonomy_id").agg(F.count("*").alias("_n"))
    named = counts.join(taxonomy.select("taxonomy_id", "name"), "taxonomy_id")
    return named.groupBy("name").agg(F.sum("_n").alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def venue_density(left: DataFrame, right: DataFrame, matches: DataFrame) -> DataFrame:
    """left_venues, right_venues, matched_venues."""
    counts = left.agg(F.count("id").alias("left_venues")).join(right.agg(F.count("id").alias("right_venues")))
    return counts.join(matches.agg(F.count_distinct("venue_id").alias("matched_venues")))


def classification_coverage(items: DataFrame, classifications: DataFrame) -> DataFrame:
    """total_items, classified_items, coverage; items (item_id)."""
    counts = items.agg(F.count("item_id").alias("total_items")).join(classifications.agg(F.count_distinct("item_id").alias("classified_items")))
    return counts.withColumn("coverage", percent(F.col("classified_items"), F.col("total_items")))


def health(spark) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"))


def venue_flags(venues: DataFrame, matches: DataFrame) -> DataFrame:
    """venues with is_matched."""
    known = matches.select(F.col("venue_id").alias("_v")).distinct()
    return venues.join(known, venues["id"] == known["_v"], "left").withColumn("is_matched", F.col("_v").isNotNull()).drop("_v")


def place_keys(places: DataFrame) -> DataFrame:
    """place_id, menu_id, name of places (id, name, maps_url) whose maps URL has a cid; of repeated ids one stays."""
    rows = places.where(filled(F.col("id")).isNotNull()).select(F.col("id").alias("place_id"), query_digits(F.col("maps_url")).alias("menu_id"), "name")
    return rows.where(F.col("menu_id").isNotNull()).groupBy("place_id").agg(F.max("menu_id").alias("menu_id"), F.max("name").alias("name"))


def first_match_by_menu(matches: DataFrame, places: DataFrame) -> DataFrame:
    """menu_id, venue_id, place_id: the first match (by match_id) of each menu_id."""
    joined = matches.join(place_keys(places), "place_id")
    first = joined.groupBy("menu_id").agg(F.min_by(F.struct("venue_id", "place_id", "name"), "match_id").alias("_m"))
    return first.select("menu_id", "_m.*")


def venue_images(matches: DataFrame, places: DataFrame, images: DataFrame, detections: DataFrame, venues: DataFrame) -> DataFrame:
    """menu_id, venue_id, venue_name, images, has_detections of matched places with images."""
    seen = detections.select("menu_id").distinct().withColumn("_d", F.lit(True))
    names = venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name"))
    out = first_match_by_menu(matches, places).drop("name").join(images, "menu_id").join(seen, "menu_id", "left").join(names, "venue_id", "left")
    return out.select("menu_id", "venue_id", F.coalesce("venue_name", F.lit("Unknown")).alias("venue_name"), "images", F.coalesce("_d", F.lit(False)).alias("has_detections"))


def menu_extractions(diffs: DataFrame, items: DataFrame, venues: DataFrame, venue_of: DataFrame) -> DataFrame:
    """A row a menu_id with differences: its venue, counts by kind and how many items the known menu has.

    diffs (menu_id, diff_type), items (venue_id), venues (id, name), venue_of (menu_id, venue_id).
    """
    known = items.groupBy("venue_id").agg(F.count("*").alias("db_items"))
    counts = diffs.groupBy("menu_id").agg(*diff_aggregates(F.col("diff_type")))
    names = venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name"))
    out = counts.join(venue_of, "menu_id", "left").join(names, "venue_id", "left").join(known, "venue_id", "left")
    return out.select("menu_id", "venue_id", F.coalesce("venue_name", F.lit("Unknown")).alias("venue_name"), "matches", "new_items", "removed", "price_changes", "total_extracted", F.coalesce("db_items", F.lit(0)).alias("db_items"))


def menu_extraction(diffs: DataFrame, menu_id: str) -> DataFrame:
    """All differences of one menu; a section without a name is ``general``."""
    own = diffs.where(F.col("menu_id") == menu_id)
    return own.withColumn("section", F.coalesce(filled(F.col("section")), F.lit("general")))
