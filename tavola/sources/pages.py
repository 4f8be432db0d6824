"""Venues and menus from fetched pages: JSON-LD first, then the page's elements.

Pages come as a table (url, html); fetching is not part of the engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.functions.prices import parse_price
from tavola.functions.text import first_filled
from tavola.functions.urls import venue_id
from tavola.sources import jsonld

#: What elements say of a page: prices as they are written.
ELEMENTS_TYPE = "struct<name:string,first_line:string,menus:array<struct<name:string,items:array<struct<name:string,description:string,price:string>>>>>"


# --- elements --------------------------------------------------------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Element:
    """A page's element: tag, attributes, children (elements and strings)."""

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def walk(self) -> Iterator[Element]:
        """Descendants in page order, without recursion, so deep pages do no harm."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]

    def text(self) -> str:
        parts: list[str] = []
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in ("script", "style"):
                todo += reversed(x.children)
        return " ".join("".join(parts).split())

    def inside(self, name: str, value: str) -> bool:
        e = self
        while e is not None:
            if e.attributes.get(name) == value:
                return True
            e = e.parent
        return False


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_endtag(self, tag):
        e = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse_html(html: str | None) -> Element:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _where(name: str, value: str, how: str = "="):
    """A test of an attribute: equal (=), containing (*) or starting with (^) a value."""
    tests = {"=": lambda x: x == value, "*": lambda x: value in x, "^": lambda x: x.startswith(value)}
    return lambda e: name in e.attributes and tests[how](e.attributes[name])


def _tag(name: str):
    return lambda e: e.tag == name


def _class(name: str):
    return lambda e: name in e.attributes.get("class", "").split()


# The attributes by which pages mark menus, in order of preference.
SECTION_MARKS = [_where("data-testid", "menu-section", "*"), _where("class", "menu-section", "*"), _where("class", "category", "*"), _where("class", "menu", "*")]
ITEM_MARKS = [_where("data-testid", "menu-item", "*"), _where("data-qa", "menu-item", "*"), _where("class", "menu-item", "*"), _where("class", "product", "*"), _where("itemprop", "menuItem")]
NAME_MARKS = [_class("name"), _class("title"), _where("data-testid", "item-name", "*"), _where("data-qa", "item-name", "*"), _tag("h3"), _tag("h4"), _where("itemprop", "name")]
TEXT_MARKS = [_class("description"), _class("desc"), _where("data-testid", "description", "*"), _where("data-qa", "description", "*"), _where("itemprop", "description"), _tag("p")]
PRICE_MARKS = [_class("price"), _where("class", "price", "*"), _where("data-testid", "price", "*"), _where("data-qa", "price", "*"), _where("itemprop", "price")]
VENUE_MARKS = [_tag("h1"), _tag("h2"), _where("data-testid", "restaurant-name"), _where("class", "restaurant-name", "*")]
ADDRESS_MARKS = [_where("data-testid", "address"), _where("class", "address", "*"), _where("class", "location", "*"), _where("itemprop", "address")]
TITLE_MARKS = [_tag("h2"), _tag("h3"), _class("name"), _class("title"), _where("data-testid", "section-name", "*"), _where("data-qa", "section-name", "*")]


def _first(e: Element, marks: list) -> Element | None:
    """The first element of the first mark that has one."""
    return next((x for mark in marks for x in e.walk() if mark(x)), None)


def _all(e: Element, marks: list) -> list[Element]:
    return [x for x in e.walk() if any(mark(x) for mark in marks)]


def _item(e: Element, names: list, texts: list, prices: list) -> dict | None:
    name, text, price = (_first(e, m) for m in (names, texts, prices))
    if name is None:
        return None
    return {"name": name.text(), "description": text.text() if text else "", "price": price.text() if price else ""}


def element_menu(root: Element) -> list[dict]:
    """Sections with items by the page's marks: a menu list with a popular carousel and categories, else generic marks."""
    qa = lambda v: _where("data-qa", v)
    out: list[dict] = []

    def add(name: str, items: list[dict | None]) -> None:
        if kept := [i for i in items if i]:
            out.append({"name": name, "items": kept})

    container = _first(root, [qa("menu-list")])
    if container is not None:
        popular = _first(container, [qa("popular-items")])
        if popular is not None:
            add("Popular", [_item(e, [_where("id", "name-", "^"), qa("item-name")], [qa("popular-item-category")], [_where("id", "price-", "^"), qa("item-price")]) for e in _all(popular, [qa("popular-item")])])
        for category in _all(container, [qa("item-category")]):
            heading = _first(category, [qa("heading")])
            listed = _first(category, [lambda e: e.tag == "ul" and e.attributes.get("data-qa") == "item-category-list", _tag("ul")])
            items = []
            for e in _all(listed, [lambda e: e.tag == "li" and "data-item-id" in e.attributes]) if listed is not None else []:
                item = _item(e, [qa("item-name")], [], [qa("item-price")])
                if item:
                    texts = [t.text() for t in _all(e, [qa("text")]) if not t.inside("data-qa", "item-price") and not t.inside("data-qa", "item-name")]
                    items.append(item | {"description": "\n".join(filter(None, texts))})
            add(heading.text() if heading is not None else "Menu", items)
    if out:
        return out
    sections = _all(root, SECTION_MARKS)
    if not sections:
        add("Menu", [_item(e, NAME_MARKS, TEXT_MARKS, PRICE_MARKS) for e in _all(root, ITEM_MARKS)])
    for section in sections:
        own = [c for c in section.children if isinstance(c, Element)]
        title = next((c for c in own if any(mark(c) for mark in TITLE_MARKS)), None)
        add(title.text() if title is not None else "Menu", [_item(e, [*NAME_MARKS, lambda x: True], TEXT_MARKS, PRICE_MARKS) for e in _all(section, ITEM_MARKS)])
    return out


def page_elements(html: str) -> dict:
    """What a page's elements say of its venue and menus."""
    root = parse_html(html)

    def said(marks: list) -> str | None:
        return next((e.text() for mark in marks for e in [_first(root, [mark])] if e is not None and e.text()), None)

    return {"name": said(VENUE_MARKS), "first_line": said(ADDRESS_MARKS), "menus": element_menu(root)}


def _elements(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in html:
        yield pd.DataFrame([page_elements(x) if x is not None else {"name": None, "first_line": None, "menus": []} for x in batch], columns=["name", "first_line", "menus"])


def scrape_pages(pages: DataFrame) -> DataFrame:
    """venue_id, url and what each page (url, html) says of its venue and menus.

    JSON-LD is read by expressions; elements are looked at only in pages whose JSON-LD lacks a name, an address or menus.
    """
    read = pages.select("url", F.coalesce("html", F.lit("")).alias("html"), jsonld.page_objects(F.col("html")).alias("_objects"))
    fields = jsonld.venue_fields(F.col("_objects"))
    read = read.select("url", "html", F.size("_objects").cast("long").alias("objects"), *[c.alias(k) for k, c in fields.items()], jsonld.menu_sections(F.col("_objects")).alias("menus"))
    lacking = first_filled("name").isNull() | first_filled("first_line").isNull() | (F.size("menus") == 0)
    read = read.withColumn("_e", F.pandas_udf(_elements, ELEMENTS_TYPE)(F.when(lacking, F.col("html"))))

    def priced(section: Column) -> Column:
        items = F.transform(section["items"], lambda i: F.struct(i["name"].alias("name"), i["description"].alias("description"), parse_price(i["price"]).alias("price")))
        return F.struct(section["name"].alias("name"), items.alias("items"))

    menus = F.when(F.size("menus") > 0, F.col("menus")).otherwise(F.transform("_e.menus", priced))
    return read.select(
        venue_id(F.col("url")).alias("venue_id"), "url", F.coalesce(first_filled("name"), "_e.name", F.lit("Unknown Restaurant")).alias("name"), F.coalesce(first_filled("first_line"), "_e.first_line", F.lit("")).alias("first_line"),
        *[F.coalesce(k, F.lit("")).alias(k) for k in ("city", "postal_code")], F.coalesce("coordinates", F.array(F.lit(0.0), F.lit(0.0))).alias("coordinates"), F.coalesce("star_rating", F.lit(0.0)).alias("star_rating"),
        F.coalesce("rating_count", F.lit(0)).cast("long").alias("rating_count"), F.coalesce("cuisines", F.expr("cast(array() as array<string>)")).alias("cuisines"), "logo_url", "objects", menus.alias("menus"),
    )


def scraped_items(venues: DataFrame) -> DataFrame:
    """venue_id, section, name, description, price of all menus."""
    rows = venues.select("venue_id", F.explode("menus").alias("s"))
    return rows.select("venue_id", F.col("s.name").alias("section"), F.inline("s.items"))


def crawl_stats(pages: DataFrame) -> DataFrame:
    """How many pages there are and how many hold a page's text; the share, 0 without pages."""
    n = pages.agg(F.count("*").alias("pages"), F.count_if(F.coalesce("html", F.lit("")) != "").alias("fetched"))
    return n.withColumn("success_rate", F.when(F.col("pages") > 0, F.col("fetched") / F.col("pages")).otherwise(0.0))


def mock_venues(urls: DataFrame) -> DataFrame:
    """The fixed mock venue of each URL (id, url): two sections of two items."""
    # Fixed values of the mock.
    menu = [("Starters", [("Burger", "Delicious beef burger", 9.99), ("Fries", "Crispy fries", 3.49)]), ("Desserts", [("Ice Cream", "Vanilla ice cream", 4.99), ("Brownie", "Chocolate brownie", 5.49)])]

    def item(name: str, description: str, price: float):
        return F.struct(F.lit(name).alias("name"), F.lit(description).alias("description"), F.lit(price).alias("price"))

    menus = F.array(*[F.struct(F.lit(s).alias("name"), F.array(*[item(*i) for i in items]).alias("items")) for s, items in menu])
    key = F.coalesce(F.nullif("id", F.lit("")), venue_id(F.col("url")))
    return urls.select(
        key.alias("venue_id"), "url", F.concat(F.lit("Mock Restaurant "), key).alias("name"), F.lit("123 Carrer de Example").alias("first_line"), F.lit("Barcelona").alias("city"),
        F.lit("08001").alias("postal_code"), F.array(F.lit(2.1686), F.lit(41.3874)).alias("coordinates"), F.lit(4.0).alias("star_rating"), F.lit(100).cast("long").alias("rating_count"),
        F.array(F.lit("example-cuisine")).alias("cuisines"), F.lit(None).cast("string").alias("logo_url"), menus.alias("menus"),
    )
