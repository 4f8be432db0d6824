"""URLs and ids in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tavola.functions.text import filled

VALID_URL = r"(?i)^https?://[^\s/$.?#].[^\s]*$"


def is_valid_url(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(VALID_URL), F.lit(False))


def venue_id(url: Column) -> Column:
    """The venue in a page's URL: after /restaurants, else after /menu/, else the last segment, else the URL."""
    segments = F.filter(F.split(url, "/"), lambda s: s != "")
    return F.coalesce(
        filled(F.regexp_extract(url, r"/restaurants[-/]?(.+?)(?:/menu|/|$)", 1)),
        filled(F.regexp_extract(url, r"/menu/(.+?)(?:/|$)", 1)),
        F.try_element_at(segments, F.lit(-1)),
        url,
    )


def query_digits(url: Column, parameter: str = "cid") -> Column:
    """Digits of a query parameter; null without them."""
    return filled(F.regexp_extract(url, rf"{parameter}=(\d+)", 1))
