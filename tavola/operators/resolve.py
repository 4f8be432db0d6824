"""Entity resolution of venues from two sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tavola.config import Settings
from tavola.functions.geo import geo_score
from tavola.functions.similarity import address_score, address_tokens, letter_bits, name_bound, name_score, total_score
from tavola.functions.text import clean_name, filled, words
from tavola.operators import nearest
from tavola.operators.spatial import cell_rank, join_cell, unlocated_pairs

#: Left rows of one cell that meet one copy of its right rows, about; and the most copies.
CELL_ROWS, MAX_SALTS = 20_000, 256


def prepared(venues: DataFrame, side: str) -> DataFrame:
    """id, ordinal, name, address, lat, lon with prefix ``side``_, the cleaned name, its words and letters and the address's tokens, once a venue."""
    named = venues.where(F.coalesce(F.col("name"), F.lit("")) != "")
    cleaned = named.select(
        *[F.col(c).alias(f"{side}_{c}") for c in ("id", "ordinal", "lat", "lon")],
        clean_name(F.col("name")).alias(f"{side}_name"),
        filled(F.col("address")).alias(f"{side}_address"),
        address_tokens(F.col("address")).alias(f"{side}_tokens"),
    )
    worded = cleaned.withColumn(f"{side}_words", words(F.col(f"{side}_name")))
    return worded.withColumn(f"{side}_letters", letter_bits(F.col(f"{side}_name"), F.col(f"{side}_words")))


def placed(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Pairs with geo_score and address_score."""
    geo = geo_score(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"), settings.lambda_geo)
    both = F.col("l_address").isNotNull() & F.col("r_address").isNotNull()
    return pairs.withColumns({"geo_score": geo, "address_score": F.when(both, address_score(F.col("l_tokens"), F.col("r_tokens")))})


def able(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Pairs that can reach the threshold, by what their places, house numbers and letters allow; names are not compared yet."""
    name = name_bound(F.col("l_letters"), F.col("r_letters"), F.col("l_words"), F.col("r_words"))
    geo = geo_score(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"), settings.lambda_geo)
    # Without a common number an address scores 0.3 at most.
    least = settings.weak_boost if settings.weak_address < 0.3 else 0.0
    boost = F.when(F.arrays_overlap("l_tokens.numbers", "r_tokens.numbers"), max(settings.strong_boost, settings.weak_boost)).otherwise(least)
    return pairs.where(settings.weight_name * name + settings.weight_geo * geo + boost >= settings.match_threshold - 1e-9)


def scored(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of placed() with name_score and score."""
    out = pairs.withColumn("name_score", name_score(F.col("l_name"), F.col("r_name"), settings.name_shortcut))
    return out.withColumn("score", total_score(F.col("name_score"), F.col("geo_score"), F.col("address_score"), settings))


def salts_for(left: DataFrame, settings: Settings, rows: int = CELL_ROWS) -> int:
    """How many parts the most common cell of the prepared() left side is cut into, so that none has more than about ``rows`` rows."""
    cells = left.groupBy(join_cell(F.col("l_lat"), settings).alias("i"), join_cell(F.col("l_lon"), settings).alias("j")).count()
    most = cells.where("i IS NOT NULL AND j IS NOT NULL").agg(F.max("count")).first()[0] or 0
    return max(1, min(MAX_SALTS, -(-int(most) // rows)))


def unlocated_candidates(left: DataFrame, right: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of left venues without coordinates that can reach the threshold, of prepared() sides, with cell_rank.

    Such a venue has no geo score.  If the threshold is above what a name and a weak address boost give, only pairs with a
    strong address can match; these share a number and a street word, so they come from an equi-join instead of all right venues.
    """
    if settings.match_threshold <= settings.weight_name + settings.weak_boost:
        return unlocated_pairs(left, right)
    lost = left.where("l_lat IS NULL OR l_lon IS NULL").withColumn("cell_rank", F.lit(0))

    def keyed(df: DataFrame, side: str) -> DataFrame:
        by_number = df.withColumn("_number", F.explode(f"{side}_tokens.numbers"))
        return by_number.withColumn("_street", F.explode(f"{side}_tokens.streets"))

    found = keyed(lost, "l").select("l_id", "_number", "_street").join(keyed(right, "r").select("r_id", "_number", "_street"), ["_number", "_street"])
    found = found.select("l_id", "r_id").distinct()
    return lost.join(found, "l_id").join(right, "r_id")


def band_scores(left: DataFrame, right: DataFrame, settings: Settings | None = None) -> DataFrame:
    """l_id, r_id, name_score and score of every pair of prepared() sides in the band."""
    s = settings or Settings()
    return nearest.all_pairs(left, right, s, salts_for(left, s), nearest.parts_for(right, s))


def best_matches(pairs: DataFrame, threshold: float) -> DataFrame:
    """The best right venue of each left one, if it reaches the threshold; ties to the first looked at; 0 never wins."""
    order = [F.desc("score"), F.asc("cell_rank"), F.asc("r_ordinal")]
    rank = F.row_number().over(Window.partitionBy("l_id").orderBy(*order))
    return pairs.withColumn("_rank", rank).where(f"_rank = 1 AND score > 0 AND score >= {threshold!r}D").drop("_rank")


def one_to_one(best: DataFrame) -> DataFrame:
    """Of the left venues with the same best right one, the highest score stays; ties to the first left one."""
    rank = F.row_number().over(Window.partitionBy("r_id").orderBy(F.desc("score"), F.asc("l_ordinal")))
    return best.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def recheck(left: DataFrame, right: DataFrame, old: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Old matches (l_id, r_id) that still reach the threshold, without a look at others; and the left venues to search."""
    known = old.groupBy("l_id").agg(F.min("r_id").alias("r_id"))
    kept = scored(placed(left.join(known, "l_id").join(right, "r_id").withColumn("cell_rank", F.lit(0)), settings), settings)
    kept = kept.where(F.col("score") >= settings.match_threshold)
    return kept, left.join(kept.select("l_id"), "l_id", "left_anti")


@dataclass
class Resolution:
    best: DataFrame
    matches: DataFrame
    unmatched: DataFrame
    stats: DataFrame


def resolve(left: DataFrame, right: DataFrame, settings: Settings | None = None, old: DataFrame | None = None, salts: int | None = None) -> Resolution:
    """Match venues (id, ordinal, name, address, lat, lon) of two sources.

    ``old`` matches are checked first.  Names are compared only in pairs whose places, addresses and letters let them
    be the best.  ``salts`` spreads common cells; without it the cells' counts choose.  Statistics are of best
    matches, before they are made one to one.
    """
    s = settings or Settings()
    a, b = prepared(left, "l"), prepared(right, "r")
    kept, todo = recheck(a, b, old, s) if old is not None else (None, a)
    near = nearest.best_pairs(todo, b, s, salts or salts_for(a, s), nearest.parts_for(b, s)).withColumn("cell_rank", cell_rank(s))
    # What has no place is dealt by left venue before it is scored: ranking needs that anyway, and it evens out common addresses.
    far = able(unlocated_candidates(todo, b, s), s).select(near.columns).repartition("l_id")
    best = best_matches(scored(placed(near.unionByName(far), s), s), s.match_threshold)
    if kept is not None:
        best = kept.select(best.columns).unionByName(best)
    matches = one_to_one(best)
    unmatched = a.select("l_id").join(matches.select("l_id"), "l_id", "left_anti")
    stats = best.agg(F.count("*").alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("avg_score"))
    return Resolution(best, matches, unmatched, stats)
