"""Menu text: reading order, parsing into items, and the difference to a known menu."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.config import MENU_HINTS, SECTION_TITLES, Settings
from tavola.functions.prices import MENU_PRICE
from tavola.functions.similarity import token_set_ratio
from tavola.functions.text import is_garbage, normalize_item

ITEM_TYPE = "array<struct<name:string,price:double,description:string,section:string>>"
_PRICE = re.compile(MENU_PRICE)
_NUMBER = re.compile(r"^\d+[\s.-]+")
_TITLE = re.compile(rf"^(?:{'|'.join(SECTION_TITLES)})$", re.IGNORECASE)
NAME_LENGTH, SHORT_HEADER, LONG_TITLE = 15, 30, 40


def reading_order(boxes: DataFrame, settings: Settings | None = None) -> DataFrame:
    """image, text: boxes (image, ordinal, width, cx, cy, text, conf) as lines, the left column first, each from the top.

    Boxes of low confidence or without text go.  A column starts at half the width.
    """
    s = settings or Settings()
    seen = boxes.where((F.col("conf") >= s.ocr_confidence) & (F.trim("text") != ""))
    column = (F.col("cx") >= F.col("width") / 2).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct(column.alias("column"), "cy", "ordinal", "text")))
    return seen.groupBy("image").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def orientation(words_: DataFrame) -> DataFrame:
    """image, rotation: the rotation (image, rotation, ordinal, text) that reads most like a menu; ties to the first.

    A text of three characters or more that isn't only symbols counts 1, and 2 more if it holds a hint of a menu.
    """
    low = F.trim(F.lower("text"))
    hint = F.exists(F.array(*[F.lit(h) for h in MENU_HINTS]), lambda h: F.contains(low, h))
    points = F.when((F.length(low) >= 3) & low.rlike("[a-zA-Z0-9]"), F.lit(1) + F.when(hint, 2).otherwise(0)).otherwise(0)
    scores = words_.groupBy("image", "rotation").agg(F.sum(points).alias("score"), F.min("ordinal").alias("first"))
    rank = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("score"), "first"))
    return scores.withColumn("_rank", rank).where("_rank = 1").select("image", "rotation", "score")


def _price(line: str) -> float | None:
    found = _PRICE.search(line)
    return round(float(found[1].replace(",", ".")), 2) if found else None


def menu_items_of(text: str | None) -> list[dict]:
    """Items of one menu, in order, before the garbage test.

    Titles open a section and close the item under way, unless that has no name.  Numbered or upper-case lines
    open an item; other lines fill its price, then its short name, then its description.
    """
    done: list[dict] = []
    section, item = "general", None
    for line in filter(None, map(str.strip, (text or "").split("\n"))):
        price = _price(line)
        if _TITLE.match(line) or line.isupper() and len(line) < SHORT_HEADER and price is None:
            if item and item["name"]:
                done.append(item)
                item = None
            section = line.lower()
            continue
        rest = _PRICE.sub("", line).strip().rstrip(".,-–— \t")
        bare = _NUMBER.sub("", rest).strip() if _NUMBER.match(rest) else None
        opens = bare is not None or item is None or rest.isupper() and 3 < len(rest) < LONG_TITLE
        rest = rest if bare is None else bare
        if opens:
            if item and item["name"]:
                done.append(item)
            item = {"name": rest, "price": price, "description": "", "section": section}
            continue
        item["price"] = item["price"] or price or item["price"]
        if not rest:
            continue
        if item["description"]:
            item["description"] += " " + rest
        elif len(item["name"]) < NAME_LENGTH:
            item["name"] += " " + rest
        else:
            item["description"] = rest
    if item and item["name"]:
        done.append(item)
    return done


def _parsed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(menu_items_of)


def parse_menus(menus: DataFrame) -> DataFrame:
    """menu_id, at, name, price, description, section of the items in menus (menu_id, text).

    A menu is a state machine over its lines, so it is one Arrow function; garbage goes by built-in expressions.
    """
    items = menus.select("menu_id", F.posexplode(F.pandas_udf(_parsed, ITEM_TYPE)("text")).alias("at", "_item")).select("menu_id", "at", "_item.*")
    name = F.col("name")
    return items.where((F.length(name) >= 3) & ~name.rlike(r"^\p{Nd}+$") & ~is_garbage(name))


def match_items(candidates: DataFrame, known: DataFrame, settings: Settings | None = None, by_section: bool = False) -> DataFrame:
    """Each candidate (menu_id, at, ...) with its best known item (menu_id, item_id, db_...), or nulls.

    Names are compared within a menu; ties go to the first item by item_id.  A known item may match many candidates.
    """
    s = settings or Settings()
    keys = ["menu_id", "_section"] if by_section else ["menu_id"]
    section = lambda name: F.coalesce(F.col(name), F.lit("")) if by_section else F.lit("")
    a = candidates.withColumns({"_name": normalize_item(F.col("name")), "_section": section("section")})
    b = known.withColumns({"_db_name": normalize_item(F.col("db_name")), "_section": section("db_section")})
    # Equal names have equal scores, so each is compared once a menu, for its first item.
    fields = F.struct("item_id", "db_name", "db_price", "db_description")
    names = b.groupBy(*keys, "_db_name").agg(F.min_by(fields, "item_id").alias("_item"))
    pairs = a.select(*keys, "_name").distinct().join(names, keys)
    pairs = pairs.withColumn("match_score", token_set_ratio(F.col("_name"), F.col("_db_name")) / 100)
    rank = F.row_number().over(Window.partitionBy(*keys, "_name").orderBy(F.desc("match_score"), F.col("_item.item_id")))
    best = pairs.where(F.col("match_score") >= s.menu_cutoff).withColumn("_rank", rank).where("_rank = 1")
    best = best.select(*keys, "_name", "_item.*", "match_score")
    return a.join(best, [*keys, "_name"], "left").select(*candidates.columns, "item_id", "db_name", "db_price", "db_description", "match_score")


def menu_diff(candidates: DataFrame, known: DataFrame, settings: Settings | None = None, include_removed: bool = False, by_section: bool = False) -> DataFrame:
    """match_items() with diff_type: match, price_changed, desc_changed or new, and removed on demand.

    A price change hides a changed description.  ``match_score`` is rounded to two decimals.
    """
    s = settings or Settings()
    matched = match_items(candidates, known, s, by_section)
    own, other = F.trim(F.coalesce("description", F.lit(""))), F.trim(F.coalesce("db_description", F.lit("")))
    price = F.abs(F.col("price") - F.col("db_price")) > s.price_tolerance
    described = (own != "") & (other != "")
    alike = token_set_ratio(normalize_item(own), normalize_item(other))
    matched = matched.withColumn("_alike", alike)
    kind = (
        F.when(F.col("item_id").isNull(), "new")
        .when(F.coalesce(price, F.lit(False)), "price_changed")
        .when(described & (F.col("_alike") < s.description_cutoff), "desc_changed")
        .otherwise("match")
    )
    out = matched.select("menu_id", "at", kind.alias("diff_type"), "name", "db_name", "price", "db_price", "description", "db_description", "item_id", F.round("match_score", 2).alias("match_score"), F.coalesce(F.nullif("section", F.lit("")), F.lit("general")).alias("section"))
    if include_removed:
        gone = known.join(matched.select("menu_id", "item_id").where("item_id IS NOT NULL"), ["menu_id", "item_id"], "left_anti")
        gone = gone.join(candidates.select("menu_id").distinct(), "menu_id", "left_semi")
        out = out.unionByName(gone.select("menu_id", F.lit("removed").alias("diff_type"), "db_name", "db_price", "db_description", "item_id"), allowMissingColumns=True)
    return out


def diff_counts(diffs: DataFrame) -> DataFrame:
    """menu_id and counts of its differences; total_extracted leaves out removed items."""
    kind = F.col("diff_type")
    return diffs.groupBy("menu_id").agg(*diff_aggregates(kind))


def diff_aggregates(kind: Column) -> list[Column]:
    return [
        F.count_if(kind == "match").alias("matches"),
        F.count_if(kind == "new").alias("new_items"),
        F.count_if(kind == "removed").alias("removed"),
        F.count_if(kind.isin("price_changed", "desc_changed")).alias("price_changes"),
        F.count_if(kind.isin("match", "new", "price_changed", "desc_changed")).alias("total_extracted"),
    ]


def process_images(boxes: DataFrame, venues: DataFrame, known: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """Extractions and differences of all images at once.

    boxes as in reading_order(), with menu_id; venues (menu_id, venue_id); known items (venue_id, item_id, db_...).
    """
    s = settings or Settings()
    owner = boxes.select("image", "menu_id").distinct()
    text = reading_order(boxes, s).join(owner, "image")
    whole = text.groupBy("menu_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image", "text"))), lambda x: x["text"]), "\n").alias("text"))
    items = parse_menus(whole)
    by_menu = known.join(venues, "venue_id").drop("venue_id")
    return items.withColumn("confidence", F.lit(1.0)), menu_diff(items, by_menu, s)
