import random

import pytest
from pyspark.sql import functions as F

from tavola.config import Settings
from tavola.functions import geo, prices, similarity, text, urls

PRICES = [
    ("1.050,50", "auto", 1050.50), ("10.500", "eu", 10500.0), ("10.500", "auto", 10.5), (None, "auto", 0.0), ("", "auto", 0.0), ("Free", "auto", 0.0),
    ("€12,50", "auto", 12.5), ("$1,234.56", "auto", 1234.56), ("1,234.56", "us", 1234.56), ("1.234,56 €", "eu", 1234.56), ("£9.99", "us", 9.99),
    ("1,2,3", "auto", 123.0), ("1.2.3", "auto", 123.0), ("12", "auto", 12.0), ("from 7,5 to 9", "auto", 7.5),
]


@pytest.mark.parametrize("value,locale,expected", PRICES)
def test_parse_price(one, value, locale, expected):
    assert one(lambda x: prices.parse_price(x, locale), x=value) == expected


@pytest.mark.parametrize("line,expected", [("Pizza 9,50 €", 9.5), ("EUR 3.20", 3.2), ("125.50", 25.5), ("no price", None), ("7,5", 7.5)])
def test_menu_price(one, line, expected):
    assert one(prices.menu_price, x=line) == expected


@pytest.mark.parametrize("value,expected", [("1,234.50 €", 1234.5), ("12,5", 12.5), ("abc", None), ("1.2.3", None)])
def test_normalize_price(one, value, expected):
    assert one(prices.normalize_price, x=value) == expected


@pytest.mark.parametrize(
    "url,expected",
    [("https://x.es/restaurants-boston-alfonsxii/menu", "boston-alfonsxii"), ("https://example.com/place/42", "42"), ("https://x.y/restaurants/abc", "abc"), ("https://x.y/menu/abc/d", "abc"), ("", "")],
)
def test_venue_id(one, url, expected):
    assert one(urls.venue_id, x=url) == expected


@pytest.mark.parametrize("url,ok", [(None, False), ("", False), ("  ", False), ("example.com", False), ("https://example.com/a", True), ("HTTP://x.y", True), ("http://abc d", False)])
def test_valid_url(one, url, ok):
    assert one(urls.is_valid_url, x=url) is ok


@pytest.mark.parametrize(
    "name,expected",
    [("José", "jose"), ("Restaurante Kaede", "kaede"), ("Burger King", "king"), ("The Bar", "the bar"), ("Müller GmbH", "muller"), ("Co Co", "co"), ("", ""), (None, ""), ("ﬁne Ægir!", "fine ægir")],
)
def test_clean_name(one, name, expected):
    assert one(text.clean_name, x=name) == expected


def test_detect_city(one):
    assert one(text.detect_city, x="calle examples, barcelona, spain") == "Barcelona"
    assert one(text.detect_city, x="Londonderry") == "unknown"
    assert one(text.detect_city, x=None) == "unknown"


@pytest.mark.parametrize(
    "line,bad",
    [("Margherita", False), ("ab", True), (None, True), ("12345 67", True), ("www.pizza.es", True), ("horario 12", True), ("aaa bcd", True), ("foo foo", True), ("a1b2", True), ("Kirschtorte", True), ("Salad Caesar", False)],
)
def test_garbage(one, line, bad):
    assert one(text.is_garbage, x=line) is bad


def test_section_header(one):
    assert one(text.is_section_header, x="pizzas") is True
    assert one(text.is_section_header, x="PLATO 9,50") is False
    assert one(text.is_section_header, x="Plato") is False


def _slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_kernels_agree(spark):
    rng = random.Random(5)
    pairs = [("", ""), ("", "a"), *(("".join(rng.choices("abcé ", k=rng.randint(0, 12))), "".join(rng.choices("abcé ", k=rng.randint(0, 12)))) for _ in range(300))]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", similarity.lcs_native(F.col("a"), F.col("b")).alias("n"), similarity.indel_ratio(F.col("a"), F.col("b")).alias("r"), similarity.indel_ratio_native(F.col("a"), F.col("b")).alias("q")).collect()
    for r in rows:
        slow = _slow_lcs(r.a, r.b)
        assert (r.n if r.a and r.b else 0) == slow == similarity.lcs_length(r.a, r.b)
        assert r.r == pytest.approx(r.q) == pytest.approx(200 * slow / (len(r.a) + len(r.b)) if r.a or r.b else 100)


def test_token_ratios():
    assert similarity.token_sort("b a", "a b") == 100
    assert similarity.token_set("king burger", "burger king london") == 100
    assert similarity.token_set("", "a") == 0
    assert similarity.name_score_of("", "burger king") == 0
    assert similarity.name_score_of("jose", "jose") == 1


def test_geo(one):
    score = one(lambda a: geo.geo_score(F.lit(41.39), F.lit(2.17), F.lit(41.40), F.lit(2.18)), a="")
    assert 0.5 < score < 0.8
    assert one(lambda a: geo.geo_score(F.lit(None).cast("double"), F.lit(2.17), F.lit(41.40), F.lit(2.18)), a="") == 0
    assert one(lambda a: geo.cell(F.lit(0.125), 0.05), a="") == 2  # half to even


def test_total_score(one):
    s = Settings()
    score = lambda name, place, address: one(lambda a: similarity.total_score(F.lit(name), F.lit(place), F.lit(address).cast("double"), s), a="")
    assert score(1.0, 0.0, None) == pytest.approx(0.6)
    assert score(1.0, 0.0, 0.5) == pytest.approx(0.68)
    assert score(1.0, 1.0, 1.0) == 1.0
    assert score(0.2, 0.0, 0.3) == pytest.approx(0.12)


def test_address_score(spark):
    rows = [("Calle Mayor 5", "Carrer Mayor 5", 1.0), ("Calle Mayor 5", "Gran Via 5", 0.5), ("Calle Mayor 5", "Mayor Alta", 0.15), ("Calle Mayor 5", "Luna 6", 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    for r in df.select("want", similarity.address_score(similarity.address_tokens(F.col("a")), similarity.address_tokens(F.col("b"))).cast("double").alias("x")).collect():
        assert r.x == pytest.approx(r.want)


def test_settings_are_checked(monkeypatch):
    for bad in ({"weight_name": 1.2}, {"weight_name": 0.6, "weight_geo": 0.3}, {"match_threshold": -1}):
        with pytest.raises(ValueError):
            Settings(**bad)
    monkeypatch.setenv("ER_LAMBDA_GEO", "0.5")
    monkeypatch.setenv("ER_DEFAULT_THRESHOLD", "oops")
    monkeypatch.setenv("KNOWN_CITIES", "A, B")
    s = Settings.from_env()
    assert (s.lambda_geo, s.match_threshold, s.cities) == (0.5, 0.70, ("A", "B"))
