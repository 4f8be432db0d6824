"""Prices in shop pages and menus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One or two digits, a separator, one or two digits, with or without a currency.
MENU_PRICE = r"(?i)(\d{1,2}[.,]\d{1,2})\s*(?:€|EUR|euro)?"


def _drop(text: Column, c: str) -> Column:
    return F.replace(text, F.lit(c), F.lit(""))


def parse_price(text: Column, locale: str = "auto") -> Column:
    """A price in text; ``eu`` has decimal commas, ``us`` decimal dots, ``auto`` decides by the separators.

    0 where there is no number.
    """
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[€$£]", ""))
    eu, us = F.replace(_drop(clean, "."), F.lit(","), F.lit(".")), _drop(clean, ",")
    if locale == "auto":
        dots, commas = F.regexp_count(clean, F.lit(r"\.")), F.regexp_count(clean, F.lit(","))
        comma_last = F.length(F.substring_index(clean, ",", -1)) < F.length(F.substring_index(clean, ".", -1))
        plain = F.when((dots > 0) & (commas > 0), F.when(comma_last, eu).otherwise(us))
        plain = plain.when(commas == 1, F.replace(clean, F.lit(","), F.lit("."))).when(commas > 1, us).when(dots > 1, _drop(clean, ".")).otherwise(clean)
    elif locale in ("eu", "us"):
        plain = eu if locale == "eu" else us
    else:
        raise ValueError(f"unknown locale {locale!r}")
    return F.coalesce(F.regexp_extract(plain, r"(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))


def menu_price(line: Column) -> Column:
    """The first price in a menu line, rounded to cents; null without one."""
    found = F.regexp_extract(line, MENU_PRICE, 1)
    return F.round(F.replace(found, F.lit(","), F.lit(".")).try_cast("double"), 2)


def normalize_price(text: Column) -> Column:
    """Digits and separators of a text as a number: with both separators commas part thousands, alone they are decimal."""
    kept = F.regexp_replace(text, r"[^\d.,]", "")
    both = F.contains(kept, F.lit(",")) & F.contains(kept, F.lit("."))
    return F.round(F.when(both, _drop(kept, ",")).otherwise(F.replace(kept, F.lit(","), F.lit("."))).try_cast("double"), 2)


def without_price(line: Column) -> Column:
    """A menu line without prices and what trails them."""
    return F.rtrim(F.trim(F.regexp_replace(line, MENU_PRICE, "")), F.lit(".,-–— \t"))
