"""Venues and menus in the JSON-LD scripts of pages, as expressions over Variant values.

What a page says is looked up by paths in an array of its objects; lists and single objects count alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCRIPT = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"
VENUE_TYPES, MENU_TYPES = ("Restaurant", "FoodEstablishment"), ("Menu",)
#: Values that count as missing where another key is looked at instead.
_EMPTY = ("null", '""', "0", "0.0", "false", "[]", "{}")
_NONE = "cast(array() as array<variant>)"


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _is_object(value: Column) -> Column:
    return _is(value, "OBJECT")


def _there(value: Column) -> Column:
    return F.coalesce(~F.to_json(value).isin(*_EMPTY), F.lit(False))


def _first_there(*values: Column) -> Column:
    return F.coalesce(*[F.when(_there(v), v) for v in values])


def _elements(value: Column) -> Column:
    return F.coalesce(F.when(_is(value, "ARRAY"), value.cast("array<variant>")), F.expr(_NONE))


def _objects_in(value: Column) -> Column:
    """The objects of a list, or an object alone."""
    return F.when(_is_object(value), F.array(value)).otherwise(F.filter(_elements(value), _is_object))


def _text(value: Column) -> Column:
    """A value as text; of objects and lists their JSON."""
    return F.coalesce(value.try_cast("string"), F.to_json(value))


def _number(value: Column) -> Column:
    return F.coalesce(F.trim(value.try_cast("string")).try_cast("double"), F.lit(0.0))


def _has_type(entry: Column, names: tuple[str, ...]) -> Column:
    kind = _at(entry, "$['@type']")
    listed = F.transform(_elements(kind), lambda k: k.try_cast("string"))
    return F.coalesce(F.when(_is(kind, "ARRAY"), F.arrays_overlap(listed, F.array(*map(F.lit, names)))).otherwise(kind.try_cast("string").isin(*names)), F.lit(False))


def page_objects(html: Column) -> Column:
    """array<variant>: all objects in a page's scripts, the members of a @graph before their container.

    A script that can't be parsed ends the search; what came before it stays.
    """
    parsed = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(SCRIPT), F.lit(1)), lambda s: F.try_parse_json(s))
    broken = F.array_position(F.transform(parsed, lambda v: v.isNull()), F.lit(True)).cast("int")
    good = F.when(broken > 0, F.slice(parsed, 1, F.greatest(broken - 1, F.lit(0)))).otherwise(parsed)
    graph = lambda v: F.filter(_elements(_at(v, "$['@graph']")), _is_object)
    return F.flatten(F.transform(good, lambda v: F.when(_is_object(v), F.concat(graph(v), F.array(v))).otherwise(F.filter(_elements(v), _is_object))))


def menu_sections(objects: Column) -> Column:
    """array of (name, items of (name, description, price)); items without a name and sections without items go."""

    def menus(entry: Column) -> Column:
        below = F.concat(_objects_in(_at(entry, "$.hasMenu")), F.filter(_elements(_at(entry, "$.subMenus")), _is_object))
        return F.when(_has_type(entry, MENU_TYPES), F.array(entry)).otherwise(below)

    def price(item: Column) -> Column:
        offers = _at(item, "$.offers")
        return _number(_at(F.when(_is(offers, "ARRAY"), F.get(_elements(offers), F.lit(0))).otherwise(offers), "$.price"))

    def item(value: Column) -> Column:
        return F.struct(_text(_at(value, "$.name")).alias("name"), F.coalesce(_text(_at(value, "$.description")), F.lit("")).alias("description"), price(value).alias("price"))

    def section(value: Column) -> Column:
        listed = F.filter(_objects_in(_first_there(_at(value, "$.hasMenuItem"), _at(value, "$.menuItem"))), lambda i: _there(_at(i, "$.name")))
        return F.struct(F.coalesce(_text(_at(value, "$.name")), F.lit("Menu")).alias("name"), F.transform(listed, item).alias("items"))

    found = F.flatten(F.transform(F.flatten(F.transform(objects, menus)), lambda m: _objects_in(_first_there(_at(m, "$.hasMenuSection"), _at(m, "$.menuSection")))))
    return F.filter(F.transform(found, section), lambda s: F.size(s["items"]) > 0)


def venue_fields(objects: Column) -> dict[str, Column]:
    """Fields of the restaurants among the objects, each from the first that has it; null where none has."""
    venues = F.filter(objects, lambda o: _has_type(o, VENUE_TYPES))

    def first(of: Column) -> Column:
        return F.get(F.filter(of, lambda x: x.isNotNull()), F.lit(0))

    placed = F.get(F.filter(venues, lambda v: _is_object(_at(v, "$.address"))), F.lit(0))
    rated = F.get(F.filter(venues, lambda v: _is_object(_at(v, "$.aggregateRating"))), F.lit(0))
    geo = _first_there(_at(placed, "$.geo"), _at(placed, "$.address.geo"))
    both = [F.when(_at(geo, f"$.{k}").isNull(), 0.0).otherwise(F.trim(_at(geo, f"$.{k}", "string")).try_cast("double")) for k in ("longitude", "latitude")]
    known = _is_object(geo) & both[0].isNotNull() & both[1].isNotNull()
    cuisines = first(F.transform(venues, lambda v: _first_there(_at(v, "$.servesCuisine"))))
    strings = F.transform(F.filter(_elements(cuisines), lambda c: _is(c, "STRING")), lambda c: c.cast("string"))
    logo = first(F.transform(venues, lambda v: _first_there(_at(v, "$.logo"), _at(v, "$.image"))))
    address = lambda key: F.when(placed.isNotNull(), F.coalesce(_text(_at(placed, f"$.address.{key}")), F.lit("")))
    return {
        "name": first(F.transform(venues, lambda v: _text(_at(v, "$.name")))),
        "first_line": address("streetAddress"),
        "city": address("addressLocality"),
        "postal_code": address("postalCode"),
        "coordinates": F.when(known, F.array(*both)).when(placed.isNotNull(), F.array(F.lit(0.0), F.lit(0.0))),
        "star_rating": F.when(rated.isNotNull(), _number(_at(rated, "$.aggregateRating.ratingValue"))),
        "rating_count": F.when(rated.isNotNull(), _number(_first_there(_at(rated, "$.aggregateRating.reviewCount"), _at(rated, "$.aggregateRating.ratingCount"))).cast("long")),
        "cuisines": F.when(cuisines.isNotNull(), F.when(_is(cuisines, "STRING"), F.array(cuisines.cast("string"))).otherwise(strings)),
        "logo_url": _text(logo),
    }
