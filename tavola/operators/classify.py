"""Classification of menu items into a taxonomy by words, aliases and fuzzy words."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.config import ALIASES, Settings
from tavola.functions.similarity import indel_ratio
from tavola.functions.text import ascii_fold, item_words, words

log = logging.getLogger(__name__)
_STRIP = ".,!?()[]{}'\"-"
#: Distinct taxonomy words up to which they are sent to all executors; more are met through shared bigrams.
BROADCAST_WORDS = 20_000


def _bigrams(word: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substring(word, i, 2))
    return F.filter(pairs, lambda p: F.length(p) == 2)


def _pairs(items: DataFrame, entries: DataFrame, settings: Settings, limit: int) -> DataFrame:
    """Word pairs that can match.

    Few taxonomy words are compared with all.  Beyond ``limit`` words meet through a bigram: of two words with a
    ratio of 80 or more and over five letters together, the common letters outnumber their runs, so two are
    adjacent in both; equal and contained words of two letters or more share one, too.  Shorter ones
    meet by their letters.
    """
    if entries.limit(limit + 1).count() <= limit:
        return items.crossJoin(F.broadcast(entries))
    if settings.fuzzy_word < 80:
        raise ValueError(f"more than {limit} taxonomy words need a fuzzy_word of 80 or more")
    both = lambda word, folded: F.array_union(_bigrams(F.col(word)), _bigrams(F.col(folded)))
    short = F.when(F.length("_t") < 2, F.array(F.col("_t"))).otherwise(F.expr("cast(array() as array<string>)"))
    letters = F.array_distinct(F.concat(F.split("_i", ""), F.array(F.lit(""))))
    t = entries.withColumn("_key", F.explode(F.array_union(both("tax_word", "_t"), short)))
    i = items.withColumn("_key", F.explode(F.array_union(both("item_word", "_i"), letters)))
    return i.join(t, "_key").drop("_key").distinct()


def matching_words(item_words_: DataFrame, taxonomy_words: DataFrame, settings: Settings, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(tax_word, item_word) of two distinct vocabularies that match.

    Words match if they are equal, equal in ASCII, or, from four letters on, if the item's word contains
    the taxonomy's in ASCII or is nearly the same.  The cheap tests come first.
    """
    t = taxonomy_words.select("tax_word", ascii_fold(F.col("tax_word")).alias("_t"))
    i = item_words_.select("item_word", ascii_fold(F.col("item_word")).alias("_i"))
    pairs = _pairs(i, t, settings, broadcast_words)
    long = F.length("tax_word") >= settings.fuzzy_word_length
    sure = (F.col("_t") == F.col("_i")) | (long & F.contains("_i", F.col("_t")))
    # Twice the shorter length bounds the common letters, so most pairs need no comparison.
    la, lb = F.length("tax_word"), F.length("item_word")
    close = long & (200.0 * F.least(la, lb) >= settings.fuzzy_word * (la + lb))
    exact = pairs.where(sure).select("tax_word", "item_word")
    fuzzy = pairs.where(~sure & close).withColumn("_r", indel_ratio(F.col("tax_word"), F.col("item_word")))
    return exact.unionByName(fuzzy.where(F.col("_r") >= settings.fuzzy_word).select("tax_word", "item_word"))


def classify(items: DataFrame, taxonomy: DataFrame, settings: Settings | None = None) -> DataFrame:
    """item_id, taxonomy_id, confidence for items (item_id, text) and a taxonomy (taxonomy_id, name, ordinal).

    An entry's score is the share of its words, with repeats, that match a word of the item; the first best entry wins.
    Below 1, the earliest word of the item that is an alias of an existing category decides, with confidence 1.
    Items without any match are ``unknown`` with 0.
    """
    s = settings or Settings()
    item_tokens = items.select("item_id", F.posexplode(item_words(F.col("text"))).alias("at", "item_word"))
    clean = F.filter(F.transform(words(F.lower("name")), lambda w: F.btrim(w, F.lit(_STRIP))), lambda w: w != "")
    entries = taxonomy.select("taxonomy_id", "ordinal", clean.alias("_words")).where(F.size("_words") > 0)
    entry_words = entries.select("taxonomy_id", "ordinal", F.size("_words").alias("_n"), F.explode("_words").alias("tax_word"))
    entry_words = entry_words.groupBy("taxonomy_id", "ordinal", "_n", "tax_word").agg(F.count("*").alias("_times"))
    pairs = matching_words(item_tokens.select("item_word").distinct(), entry_words.select("tax_word").distinct(), s)
    hits = item_tokens.select("item_id", "item_word").distinct().join(pairs, "item_word").select("item_id", "tax_word").distinct()
    scores = hits.join(entry_words, "tax_word").groupBy("item_id", "taxonomy_id", "ordinal", "_n").agg((F.sum("_times") / F.col("_n")).alias("score"))
    first = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("ordinal"))
    best = scores.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select("item_id", "taxonomy_id", "score")
    by_alias = aliased(item_tokens, taxonomy)
    out = items.select("item_id").join(best, "item_id", "left").join(by_alias, "item_id", "left")
    use = (F.coalesce("score", F.lit(0.0)) < 1.0) & F.col("alias_id").isNotNull()
    return out.select(
        "item_id",
        F.when(use, F.col("alias_id")).otherwise(F.coalesce("taxonomy_id", F.lit("unknown"))).alias("taxonomy_id"),
        F.when(use, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("confidence"),
    )


def alias_map(taxonomy: DataFrame) -> DataFrame:
    """(alias, alias_id) of the aliases whose category the taxonomy has."""
    spark = taxonomy.sparkSession
    rows = spark.createDataFrame([(k, v) for k, v in ALIASES.items()], "alias string, category string")
    names = taxonomy.groupBy(F.lower("name").alias("category")).agg(F.max_by("taxonomy_id", "ordinal").alias("alias_id"))
    return rows.join(names, "category").groupBy(ascii_fold(F.col("alias")).alias("alias")).agg(F.min("alias_id").alias("alias_id"))


def aliased(item_tokens: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(item_id, alias_id) by the earliest word that is an alias."""
    found = item_tokens.withColumn("alias", ascii_fold(F.col("item_word"))).join(alias_map(taxonomy), "alias")
    return found.groupBy("item_id").agg(F.min_by("alias_id", "at").alias("alias_id"))


def unclassified(items: DataFrame, classifications: DataFrame) -> DataFrame:
    return items.join(classifications.select("item_id"), "item_id", "left_anti")


def run(items: DataFrame, taxonomy: DataFrame, done: DataFrame | None = None, settings: Settings | None = None, force: bool = False, clear: Callable[[], None] | None = None) -> DataFrame:
    """New classifications at or above the cut-off, of the items not ``done`` yet; of all items on ``force``.

    ``clear`` deletes the stored classifications on ``force``; where it fails, the run goes on with the items not done.
    """
    s = settings or Settings()
    if force and clear is not None:
        try:
            clear()
        except Exception as error:  # whatever a store raises
            log.warning("classifications were not cleared, only new items are classified: %s", error)
            force = False
    todo = unclassified(items, done) if done is not None and not force else items
    return classify(todo, taxonomy, s).where(F.col("confidence") >= s.classify_cutoff)


def predictions(classified: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """item_id and predicted, the category's name in lower case; of several the greatest by id stays."""
    named = classified.join(taxonomy.select("taxonomy_id", F.lower("name").alias("_name")), "taxonomy_id")
    return named.groupBy("item_id").agg(F.max_by("_name", "taxonomy_id").alias("predicted"))


def evaluate(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: total, correct, incorrect and unclassified items of ``truth`` (item_id, label), accuracy, all predicted items."""
    joined = truth.join(predicted, "item_id", "left")
    right = F.col("predicted") == F.lower("label")
    counts = joined.agg(
        F.count("*").alias("total_items"),
        F.count_if(F.coalesce(right, F.lit(False))).alias("correct"),
        F.count_if(F.col("predicted").isNotNull() & ~right).alias("incorrect"),
        F.count_if(F.col("predicted").isNull()).alias("unclassified"),
    )
    counts = counts.withColumn("accuracy", F.when(F.col("total_items") > 0, F.round(F.col("correct") / F.col("total_items"), 4)).otherwise(0.0))
    return counts.join(predicted.agg(F.count_distinct("item_id").alias("classified_items")))


def confusion(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """label, predicted, n; labels in lower case."""
    return truth.join(predicted, "item_id").groupBy(F.lower("label").alias("label"), "predicted").agg(F.count("*").alias("n"))
