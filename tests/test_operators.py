import json

import pytest
from pyspark.sql import functions as F

from tavola.config import Settings
from tavola.operators import classify, menu, resolve, spatial, tables
from tavola.plans import kpi
from tavola.sources import pages, venues

VENUE = "id string, ordinal long, name string, address string, lat double, lon double"


def _venues(spark, rows):
    return spark.createDataFrame([(i, k, n, a, la, lo) for k, (i, n, a, la, lo) in enumerate(rows)], VENUE)


def test_near_identical_pair(spark):
    left = _venues(spark, [("a", "Burger King London", "", 51.5, -0.12)])
    right = _venues(spark, [("b", "Burger King", "", 51.5001, -0.1201), ("c", "Taco Bell", "", 51.51, -0.13)])
    got = resolve.resolve(left, right).matches.collect()
    assert [(r.l_id, r.r_id) for r in got] == [("a", "b")] and got[0].score >= 0.84


def test_null_coordinates_need_a_strong_address(spark):
    left = _venues(spark, [("a", "Kaede", "Mayor 5", None, 2.0), ("x", "Kaede", "", None, 2.0)])
    right = _venues(spark, [("b", "Kaede", "Calle Mayor 5", 41.0, 2.0)])
    got = {r.l_id: r.score for r in resolve.resolve(left, right).best.collect()}
    assert got == {"a": pytest.approx(0.75)}
    loose = resolve.resolve(left, right, Settings(match_threshold=0.5)).best.collect()
    assert {r.l_id: round(r.score, 6) for r in loose} == {"a": 0.75, "x": 0.6}


def test_one_to_one_gives_no_second_choice(spark):
    left = _venues(spark, [("a", "Kaede Roma", "", 41.0, 2.0), ("b", "Kaede", "", 41.0, 2.0)])
    right = _venues(spark, [("r", "Kaede", "", 41.0, 2.0), ("s", "Kaede Romana", "", 41.019, 2.0)])
    found = resolve.resolve(left, right)
    assert len({r.r_id for r in found.matches.collect()}) == found.matches.count()
    assert {r.l_id for r in found.matches.collect()} | {r.l_id for r in found.unmatched.collect()} == {"a", "b"}


def test_ties_go_to_the_first(spark):
    left = _venues(spark, [("a", "Kaede", "", 41.0, 2.0)])
    right = _venues(spark, [("r1", "Kaede", "", 41.0, 2.0), ("r2", "Kaede", "", 41.0, 2.0)])
    assert resolve.resolve(left, right).best.first().r_id == "r1"


def test_recheck_keeps_old_matches(spark):
    left = _venues(spark, [("a", "Kaede", "", 41.0, 2.0)])
    right = _venues(spark, [("r1", "Kaede", "", 41.0, 2.0), ("r2", "Kaede", "", 41.0005, 2.0)])
    old = spark.createDataFrame([("a", "r2")], "l_id string, r_id string")
    assert resolve.resolve(left, right, old=old).matches.first().r_id == "r2"


@pytest.mark.parametrize("salts", [1, 5])
def test_band_join_is_lossless(spark, salts):
    left = spark.range(150).selectExpr("cast(id as string) l_id", "41 + (id * 37 % 101) / 997.0D l_lat", "2 + (id * 53 % 97) / 991.0D l_lon")
    right = spark.range(150).selectExpr("cast(id as string) r_id", "41 + (id * 41 % 103) / 983.0D r_lat", "2 + (id * 59 % 89) / 977.0D r_lon")
    got = {(r.l_id, r.r_id) for r in spatial.band_join(left, right, salts=salts).collect()}
    plain = {(r.l_id, r.r_id) for r in left.crossJoin(right).where("abs(l_lat - r_lat) <= 0.02D and abs(l_lon - r_lon) <= 0.02D").collect()}
    assert got == plain and plain


TAX = [("pizza-001", "Pizza", 1), ("drink-001", "Soft Drinks", 2), ("salad-001", "Green salads", 3)]


def test_classify(spark):
    tax = spark.createDataFrame(TAX, "taxonomy_id string, name string, ordinal long")
    items = spark.createDataFrame([(1, "Pepperoni Pizza with cheese"), (2, "Coca Cola drink"), (3, "xyz123 nothing matches"), (4, "Salad"), (5, "")], "item_id long, text string")
    got = {r.item_id: (r.taxonomy_id, r.confidence) for r in classify.classify(items, tax).collect()}
    assert got == {1: ("pizza-001", 1.0), 2: ("drink-001", 1.0), 3: ("unknown", 0.0), 4: ("salad-001", 0.5), 5: ("unknown", 0.0)}
    done = spark.createDataFrame([(1, "pizza-001", 1.0)], "item_id long, taxonomy_id string, confidence double")
    assert [r.item_id for r in classify.run(items, tax, done).collect()] == [2]
    assert sorted(r.item_id for r in classify.run(items, tax, done, force=True).collect()) == [1, 2]


def test_words_meet_through_bigrams(spark):
    import random

    rng = random.Random(9)
    make = lambda n: "".join(rng.choices("abcé漢", k=n))
    tax = [make(rng.randint(1, 9)) for _ in range(120)] + ["漢漢漢漢", "é", "a", ""]
    near = [w[:k] + rng.choice("abcx") + w[k + 1 :] for w in tax for k in range(0, len(w), 2)]
    items = spark.createDataFrame([(w,) for w in {*tax, *near, *(make(rng.randint(0, 9)) for _ in range(200))}], "item_word string")
    entries = spark.createDataFrame([(w,) for w in set(tax) if w], "tax_word string")
    all_, met = ({tuple(r) for r in classify.matching_words(items, entries, Settings(), n).collect()} for n in (20_000, 0))
    assert all_ == met and len(all_) > len(set(tax))


def test_evaluate(spark):
    truth = spark.createDataFrame([(1, "Pizza"), (2, "Beer"), (3, "Tea")], "item_id long, label string")
    predicted = spark.createDataFrame([(1, "pizza"), (2, "wine"), (9, "tea")], "item_id long, predicted string")
    r = classify.evaluate(truth, predicted).first()
    assert (r.total_items, r.correct, r.incorrect, r.unclassified, r.accuracy, r.classified_items) == (3, 1, 1, 1, 0.3333, 3)
    assert sorted(map(tuple, classify.confusion(truth, predicted).collect())) == [("beer", "wine", 1), ("pizza", "pizza", 1)]


MENU = "PIZZAS\n1. Margherita 9,50 €\ntomato and cheese\nfresh basil\nQuattro Formaggi\nBEBIDAS\nAgua 1,20\nHORARIO 12"


def test_parse_menu(spark):
    got = menu.parse_menus(spark.createDataFrame([(1, MENU), (2, None), (3, "")], "menu_id long, text string")).orderBy("at").collect()
    assert [(r.name, r.price, r.section) for r in got] == [("Margherita tomato and cheese", 9.5, "pizzas"), ("Agua", 1.2, "bebidas")]
    assert got[0].description == "fresh basil Quattro Formaggi"


def test_menu_diff(spark):
    cand = spark.createDataFrame([(1, 0, "MARGHERITA", 9.5, "", ""), (1, 1, "Agua", 1.5, "", "drinks"), (1, 2, "Zzz", None, "", ""), (1, 3, "Carbonara", 5.0, "eggs and bacon", "")], "menu_id long, at long, name string, price double, description string, section string")
    known = spark.createDataFrame([(1, 10, "Margherita", 9.5, ""), (1, 11, "agua", 1.2, ""), (1, 12, "Carbonara", 5.0, "xy"), (1, 13, "Tiramisu", 4.0, "")], "menu_id long, item_id long, db_name string, db_price double, db_description string")
    got = {r["at"]: (r.diff_type, r.item_id, r.section) for r in menu.menu_diff(cand, known).collect()}
    assert got == {0: ("match", 10, "general"), 1: ("price_changed", 11, "drinks"), 2: ("new", None, "general"), 3: ("desc_changed", 12, "general")}
    removed = menu.menu_diff(cand, known, include_removed=True).where("diff_type = 'removed'").collect()
    assert [r.item_id for r in removed] == [13]
    counts = menu.diff_counts(menu.menu_diff(cand, known, include_removed=True)).first()
    assert (counts.matches, counts.new_items, counts.removed, counts.price_changes, counts.total_extracted) == (1, 1, 1, 2, 4)


def test_reading_order(spark):
    rows = [("i", 0, 100.0, 80.0, 1.0, "right", 0.9), ("i", 1, 100.0, 10.0, 9.0, "low", 0.9), ("i", 2, 100.0, 10.0, 2.0, "top", 0.9), ("i", 3, 100.0, 10.0, 1.0, "unsure", 0.3), ("i", 4, 100.0, 10.0, 1.0, "  ", 0.9)]
    df = spark.createDataFrame(rows, "image string, ordinal long, width double, cx double, cy double, text string, conf double")
    assert menu.reading_order(df).first().text == "top\nlow\nright"


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.upsert(old, new.where("v <> 'e'"), ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(tables.insert_or_ignore(old, new, ["k"], "v")) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(tables.replace_children(old, new, "k")) == [(1, "a"), (2, "c"), (3, "d"), (3, "e")]
    assert rows(tables.stale(old, new, "k")) == [(1,)]
    assert rows(tables.delete_parents(old, new, "k")) == [(1, "a")]
    assert tables.save_matches(old, new.limit(0)).count() == 2 and tables.save_matches(old, new.limit(0), True).count() == 0
    parts = tables.chunks(spark.range(10).withColumnRenamed("id", "k"), "k", 3).collect()
    assert {r.k: r.part for r in parts} == {k: k // 4 for k in range(10)}
    assert tables.migrate(old.select(F.col("v").alias("name")), "menu_items").columns == tables.SCHEMAS["menu_items"].names


def test_files(spark, tmp_path):
    one = {"a": {"name": "A", "address": {"firstLine": "x 1", "location": {"type": "Point", "coordinates": [2.1, 41.3]}}, "menus": {"g": {"sections": [{"name": "S", "items": [{"name": "I", "price": 2.5}]}]}}}, "b": {"name": ""}}
    two = {"a": {"name": "A2", "menus": [{"items": [{"name": "L", "description": "d", "price": 1}]}]}}
    for name, data in (("part_1.json", one), ("part_2.json", two)):
        (tmp_path / name).write_text(json.dumps(data))
    (tmp_path / "part_3.json").write_text("{broken")
    loaded = venues.load_venues(spark, str(tmp_path / "none.json"), str(tmp_path / "part_*.json"))
    assert [(r.id, r.name, r.lat) for r in venues.venue_rows(loaded).collect()] == [("a", "A2", None)]
    first = venues.read_venue_files(spark, str(tmp_path / "part_1.json"))
    assert [(r.id, r.lat, r.lon) for r in venues.venue_rows(first).collect()] == [("a", 41.3, 2.1)]
    assert [tuple(r) for r in venues.menu_item_rows(first).collect()] == [("a", "I", "", 2.5, "S")]
    assert [tuple(r) for r in venues.menu_item_rows(loaded).collect()] == [("a", "L", "d", 1.0, "general")]
    (tmp_path / "g.json").write_text(json.dumps([{"googlePlaceId": "p", "name": "P", "rawAddress": "r", "latitude": 1, "longitude": "x", "googleMapsUrl": "https://m/?cid=77"}, {"name": ""}]))
    got = venues.read_place_list(spark, str(tmp_path / "g.json")).collect()
    assert [(r.id, r.address, r.lat, r.lon) for r in got] == [("p", "r", 1.0, None)]
    (tmp_path / "u.json").write_text('["http://a", "http://b"]')
    assert sorted(map(tuple, venues.read_urls(spark, str(tmp_path / "u.json")).collect())) == [("0", "http://a"), ("1", "http://b")]
    tables.write_json_array(spark.range(2), str(tmp_path / "out.json"))
    assert json.loads((tmp_path / "out.json").read_text()) == [{"id": 0}, {"id": 1}]
    (tmp_path / "t.csv").write_text("Category UIdentifier,Name\nx,One\nx,Two\n")
    assert [(r.category_uidentifier, r.name) for r in venues.read_taxonomy(spark, str(tmp_path / "t.csv")).collect()] == [("x", "Two")]


def test_merge_skips_broken_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"id": "", "name": "G"}')
    (tmp_path / "zbad.json").write_text("{oops")
    assert [r.venue_id for r in venues.merge_venue_files(spark, str(tmp_path / "*.json")).collect()] == ["good"]


LD = {
    "@graph": [
        {"@type": "Restaurant", "name": "Sushi", "address": {"streetAddress": "S 1", "addressLocality": "B"}, "geo": {"latitude": "41.4", "longitude": 2.1}, "aggregateRating": {"ratingValue": "4.5", "reviewCount": 1596}, "servesCuisine": "Japanese"},
        {"@type": ["Menu"], "hasMenuSection": [{"name": "Rolls", "hasMenuItem": [{"name": "California Roll", "offers": {"price": "12.50"}}, {"name": ""}]}, {"name": "Sides", "hasMenuItem": {"name": "Edamame", "offers": [{"price": 4.5}]}}, {"name": "Empty"}]},
    ]
}


def test_pages(spark):
    html = f'<html><script type="application/ld+json">{json.dumps(LD)}</script></html>'
    plain = '<h1>Casa</h1><div class="menu-section"><h2>Tapas</h2><div class="menu-item"><h3>Bravas</h3><p>hot</p><span class="price">4,50 €</span></div></div>'
    listed = '<div data-qa="menu-list"><div data-qa="item-category"><h2 data-qa="heading">Mains</h2><ul data-qa="item-category-list"><li data-item-id="1"><b data-qa="item-name">Paella</b><i data-qa="text">rice</i><b data-qa="item-price">12</b></li></ul></div></div>'
    df = spark.createDataFrame([("https://x/restaurants-sushi/menu", html), ("https://x/b", plain), ("https://x/c", listed), ("https://x/d", None)], "url string, html string")
    got = {r.venue_id: r for r in pages.scrape_pages(df).collect()}
    s = got["sushi"]
    assert (s.name, s.first_line, s.coordinates, s.star_rating, s.rating_count, s.cuisines, s.objects) == ("Sushi", "S 1", [2.1, 41.4], 4.5, 1596, ["Japanese"], 3)
    assert [(m.name, [(i.name, i.price) for i in m["items"]]) for m in s.menus] == [("Rolls", [("California Roll", 12.5)]), ("Sides", [("Edamame", 4.5)])]
    assert got["b"].name == "Casa" and [(m.name, [tuple(i) for i in m["items"]]) for m in got["b"].menus] == [("Tapas", [("Bravas", "hot", 4.5)])]
    assert [tuple(i) for i in got["c"].menus[0]["items"]] == [("Paella", "rice", 12.0)]
    assert got["d"].name == "Unknown Restaurant" and got["d"].menus == []
    items = pages.scraped_items(pages.mock_venues(df.limit(2).selectExpr("'' as id", "url")))
    assert items.count() == 8


def test_flags_and_shares(spark):
    v = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    m = spark.createDataFrame([(1, 1), (1, 2)], "venue_id long, match_id long")
    assert sorted((r.id, r.is_matched) for r in kpi.venue_flags(v, m).collect()) == [(1, True), (2, False), (3, False)]
    assert kpi.match_rate(v, m).first().match_rate == 33.33
    assert kpi.match_rate(v.limit(0), m.limit(0)).first().match_rate == 0.0


def test_stream_runs_each_row_once(spark, tmp_path):
    from tavola.streaming.incremental import classify_new

    tax = spark.createDataFrame(TAX, "taxonomy_id string, name string, ordinal long")
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for k, name in enumerate(("pizza", "green salads")):
        spark.createDataFrame([(k, name)], "item_id long, text string").write.mode("append").parquet(src)
        classify_new(spark, src, "item_id long, text string", tax, out, mark).awaitTermination()
    assert sorted(r.item_id for r in spark.read.parquet(out).collect()) == [0, 1]
