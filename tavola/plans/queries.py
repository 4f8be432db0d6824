"""The venue and menu operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.config import Settings
from tavola.functions import geo, prices, similarity, text, urls
from tavola.operators import classify, menu, resolve, spatial, tables
from tavola.plans import files, kpi
from tavola.plans import tables as t
from tavola.sources import pages, venues

_FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SETTINGS = Settings()


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _FOUND[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_FOUND, **files.queries()}


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return resolve.prepared(t.side(spark, d, 0), "l"), resolve.prepared(t.side(spark, d, 1), "r")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- counts and shares --------------------------------------------------------------------------------------


@query
def kpi_match_rate(spark, d):
    return kpi.match_rate(t.customers(spark, d), t.matched(spark, d))


@query
def kpi_density(spark, d):
    right = t.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return kpi.venue_density(t.customers(spark, d), right, t.matched(spark, d))


@query
def kpi_coverage(spark, d):
    return kpi.classification_coverage(t.items(spark, d), t.classified(spark, d))


@query
def kpi_health(spark, d):
    return kpi.health(spark)


@query
def top_categories(spark, d):
    return kpi.top_categories(t.classified(spark, d), t.taxonomy(spark))


@query
def venue_flags(spark, d):
    return kpi.venue_flags(t.customers(spark, d), t.matched(spark, d))


@query
def venue_images(spark, d):
    matches = t.matched(spark, d).withColumn("place_id", (F.col("venue_id") % 50).cast("string"))
    places = t.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("https://m.x/?cid="), F.col("s_suppkey") * 7).alias("maps_url"))
    images = places.select(urls.query_digits(F.col("maps_url")).alias("menu_id"), F.array(F.concat("id", F.lit("/a.jpg"))).alias("images"))
    seen = places.where(F.col("name") < "Supplier#000000020").select(urls.query_digits(F.col("maps_url")).alias("menu_id"))
    got = kpi.venue_images(matches, places, images, seen, t.customers(spark, d))
    return got.select("menu_id", "venue_id", "venue_name", F.array_join("images", ",").alias("images"), "has_detections")


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("match", "new", "price_changed", "desc_changed", "removed")])
    return t.read(spark, d, "events").select(F.col("user_id").alias("menu_id"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("diff_type"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("section"), "event_id")


@query
def diff_counts(spark, d):
    return menu.diff_counts(_diffs(spark, d))


@query
def menu_extractions(spark, d):
    owner = t.read(spark, d, "events").select(F.col("user_id").alias("menu_id"), (F.col("user_id") % 13).alias("venue_id")).distinct()
    return kpi.menu_extractions(_diffs(spark, d), t.items(spark, d), t.customers(spark, d), owner)


@query
def menu_extraction_one(spark, d):
    return kpi.menu_extraction(_diffs(spark, d), 7).select("event_id", "diff_type", "section")


# --- joins, sets and changes --------------------------------------------------------------------------------


@query
def unclassified_anti(spark, d):
    return classify.unclassified(t.items(spark, d).select("item_id", "name"), t.classified(spark, d))


@query
def matched_semi(spark, d):
    m = t.matched(spark, d)
    return t.customers(spark, d).join(m, F.col("id") == m["venue_id"], "left_semi")


@query
def stale_ids(spark, d):
    return tables.stale(t.read(spark, d, "orders").select(F.col("o_custkey").alias("venue_id")), t.matched(spark, d), "venue_id")


@query
def export_join3(spark, d):
    got = t.items(spark, d).join(t.classified(spark, d), "item_id").join(t.taxonomy(spark).withColumnRenamed("name", "category"), "taxonomy_id")
    return got.select("item_id", "name", "category", "confidence").orderBy(F.desc("confidence"), "item_id")


@query
def upsert_merge(spark, d):
    old = t.customers(spark, d)
    new = t.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("name"))
    return tables.upsert(old, new, ["id"])


@query
def insert_or_ignore(spark, d):
    old = t.matched(spark, d).groupBy("venue_id").agg(F.min("match_id").alias("match_id"))
    new = t.read(spark, d, "orders").select(F.col("o_custkey").alias("venue_id"), F.col("o_orderkey").alias("match_id"))
    return tables.insert_or_ignore(old, new, ["venue_id"], "match_id")


@query
def replace_children(spark, d):
    old = t.items(spark, d).select("venue_id", "name", "price")
    new = old.where("venue_id < 3").groupBy("venue_id", "name").agg(F.max("price").alias("price"))
    return tables.replace_children(old, new, "venue_id")


@query
def last_wins_merge(spark, d):
    return tables.last_wins(t.read(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query
def split_chunks(spark, d):
    # Rows of one key stay as they are stored, as a stable sort leaves them.
    rows = t.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return tables.chunks(rows, "id", 3, ties=("file", "row")).drop("file", "row")


@query
def first_match(spark, d):
    matches = t.matched(spark, d).withColumn("place_id", (F.col("venue_id") % 50).cast("string"))
    places = t.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("https://m.x/?cid="), F.col("s_suppkey") % 20).alias("maps_url"))
    return kpi.first_match_by_menu(matches, places).select("menu_id", "venue_id", "place_id")


@query
def save_matches(spark, d):
    old = t.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("venue_id")).agg(F.max("o_orderkey").alias("match_id"))
    new = t.matched(spark, d).groupBy("venue_id").agg(F.max("match_id").alias("match_id"))
    return tables.save_matches(old, new)


@query
def flatten_json(spark, d):
    return venues.menu_item_rows(t.venue_json(spark, d))


@query
def venue_rows(spark, d):
    return venues.venue_rows(t.venue_json(spark, d))


# --- scalars ------------------------------------------------------------------------------------------------


@query
def parse_price_us(spark, d):
    return t.price_texts(spark, d).select("p_partkey", prices.parse_price(F.col("us"), "us").alias("price"))


@query
def parse_price_eu(spark, d):
    return t.price_texts(spark, d).select("p_partkey", prices.parse_price(F.col("eu"), "eu").alias("price"))


@query
def parse_price_auto(spark, d):
    return t.price_texts(spark, d).select("p_partkey", prices.parse_price(F.col("auto")).alias("price"))


@query
def menu_price(spark, d):
    return t.priced_lines(spark, d).select("p_partkey", prices.menu_price(F.col("line")).alias("price"), prices.without_price(F.col("line")).alias("rest"))


@query
def url_venue_id(spark, d):
    return t.urls(spark, d).select("page_id", "at", urls.venue_id(F.col("url")).alias("venue_id"), urls.is_valid_url(F.col("url")).alias("valid"))


@query
def url_param(spark, d):
    return t.urls(spark, d).select("page_id", "at", urls.query_digits(F.col("url")).alias("cid"), urls.query_digits(F.col("url"), "page").alias("page"))


@query
def fold_text(spark, d):
    return t.read(spark, d, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query
def clean_name(spark, d):
    return t.venues(spark, d).select("id", text.base_name(F.col("name")).alias("base"), text.clean_name(F.col("name")).alias("clean"))


@query
def normalize_match(spark, d):
    return t.lines(spark, d).select("doc_id", "at", text.normalize_item(F.col("line")).alias("normal"))


@query
def detect_city(spark, d):
    return t.addresses(spark, d).select("c_custkey", text.detect_city(F.col("address")).alias("city"))


@query
def garbage_flag(spark, d):
    return t.lines(spark, d).select("doc_id", "at", text.is_garbage(F.col("line")).alias("garbage"))


@query
def section_header(spark, d):
    return t.lines(spark, d).select("doc_id", "at", text.is_section_header(F.col("line")).alias("header"))


@query
def item_text(spark, d):
    i = t.items(spark, d).select("item_id", "name", F.when(F.col("item_id") % 4 != 0, F.col("description")).alias("description"))
    return i.select("item_id", text.item_text(F.col("name"), F.col("description")).alias("text"))


@query
def normalize_price(spark, d):
    return t.price_texts(spark, d).select("p_partkey", prices.normalize_price(F.col("us")).alias("us"), prices.normalize_price(F.regexp_replace("eu", r"\.", "")).alias("eu"))


@query
def address_line(spark, d):
    c = t.read(spark, d, "customer")
    return c.select("c_custkey", venues.address_line(F.col("c_name"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.when(F.col("c_nationkey") % 3 == 0, F.col("c_nationkey").cast("string"))).alias("address"))


@query
def stop_words(spark, d):
    return t.venues(spark, d).select("id", text.drop_stop_words(text.base_name(F.col("name"))).alias("rest"))


# --- similarity and places ----------------------------------------------------------------------------------


def _name_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = t.items(spark, d).select(F.col("name").alias("a")).distinct()
    b = t.read(spark, d, "nation").select(F.lower("n_name").alias("b")).unionByName(a.select(F.concat(F.lit("the "), F.col("a")).alias("b"))).distinct()
    return a.join(b, F.length("a") <= F.length("b"))


@query
def indel_ratio(spark, d):
    return _rounded(_name_pairs(spark, d).withColumn("ratio", similarity.indel_ratio(F.col("a"), F.col("b"))), "ratio")


@query
def indel_ratio_native(spark, d):
    return _rounded(_name_pairs(spark, d).withColumn("ratio", similarity.indel_ratio_native(F.col("a"), F.col("b"))), "ratio")


@query
def token_sort(spark, d):
    return _rounded(_name_pairs(spark, d).withColumn("ratio", similarity.token_sort_ratio(F.col("a"), F.col("b"))), "ratio")


@query
def token_set(spark, d):
    return _rounded(_name_pairs(spark, d).withColumn("ratio", similarity.token_set_ratio(F.col("a"), F.col("b"))), "ratio")


@query
def geo_score(spark, d):
    v = t.venues(spark, d)
    place = (F.col("lat"), F.col("lon"), F.lit(41.4), F.lit(2.1))
    return _rounded(v.select("id", geo.haversine(*place).alias("metres"), geo.geo_score(*place).alias("score")), "metres", "score")


@query
def grid_cells(spark, d):
    return t.venues(spark, d).select("id", geo.cell(F.col("lat")).alias("ci"), geo.cell(F.col("lon")).alias("cj"), geo.grid_key(F.col("lat"), F.col("lon")).alias("grid"))


@query
def band_join(spark, d):
    return spatial.band_join(*_sides(spark, d), SETTINGS).select("l_id", "r_id")


@query
def null_coord_scan(spark, d):
    return spatial.unlocated_pairs(*_sides(spark, d)).select("l_id", "r_id")


@query
def address_sim(spark, d):
    pairs = spatial.band_join(*_sides(spark, d), SETTINGS)
    return _rounded(pairs.select("l_id", "r_id", similarity.address_score(F.col("l_tokens"), F.col("r_tokens")).cast("double").alias("score")), "score")


@query
def total_score(spark, d):
    left, right = _sides(spark, d)
    return _rounded(resolve.band_scores(left, right, SETTINGS), "name_score", "score")


def _resolved(spark: SparkSession, d: str, old: DataFrame | None = None) -> resolve.Resolution:
    return resolve.resolve(t.side(spark, d, 0), t.side(spark, d, 1), SETTINGS, old)


@query
def er_best(spark, d):
    return _rounded(_resolved(spark, d).best.select("l_id", "r_id", "score"), "score")


@query
def er_one_to_one(spark, d):
    return _rounded(_resolved(spark, d).matches.select("l_id", "r_id", "score"), "score")


@query
def er_unmatched(spark, d):
    return _resolved(spark, d).unmatched


@query
def score_stats(spark, d):
    return _rounded(_resolved(spark, d).stats, "min_score", "max_score", "avg_score")


@query
def er_recheck(spark, d):
    old = t.side(spark, d, 0).select(F.col("id").alias("l_id"), (F.col("ordinal") + 1).cast("string").alias("r_id"))
    return _rounded(_resolved(spark, d, old).matches.select("l_id", "r_id", "score"), "score")


# --- classification and menus -------------------------------------------------------------------------------


@query
def classify_items(spark, d):
    return _rounded(classify.classify(t.item_texts(spark, d), t.taxonomy(spark)), "confidence")


@query
def alias_fallback(spark, d):
    tokens = t.item_texts(spark, d).select("item_id", F.posexplode(text.item_words(F.col("text"))).alias("at", "item_word"))
    return classify.aliased(tokens, t.taxonomy(spark))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return t.items(spark, d).select("item_id", F.initcap(F.element_at(F.split("name", " "), 2)).alias("label"))


@query
def accuracy(spark, d):
    return classify.evaluate(_truth(spark, d), classify.predictions(t.classified(spark, d), t.taxonomy(spark)))


@query
def confusion(spark, d):
    return classify.confusion(_truth(spark, d), classify.predictions(t.classified(spark, d), t.taxonomy(spark)))


@query
def parse_menu(spark, d):
    return menu.parse_menus(t.read(spark, d, "documents").select(F.col("doc_id").alias("menu_id"), "text"))


@query
def menu_diff(spark, d):
    return menu.menu_diff(t.candidates(spark, d), t.known_menu(spark, d)).select("menu_id", "at", "diff_type", "item_id", "match_score", "section")


@query
def reading_order(spark, d):
    return menu.reading_order(t.boxes(spark, d))


@query
def orientation(spark, d):
    e = t.read(spark, d, "events")
    words = e.select(F.col("user_id").alias("image"), F.col("event_type").alias("rotation"), F.col("event_id").alias("ordinal"), F.col("props").alias("text"))
    words = words.withColumn("text", F.when(F.col("ordinal") % 3 == 0, F.lit("--- ")).when(F.col("ordinal") % 3 == 1, F.lit("Pizza x")).otherwise(F.col("text")))
    return menu.orientation(words)


# --- pages --------------------------------------------------------------------------------------------------


@query
def scrape_pages(spark, d):
    got = pages.scrape_pages(t.read(spark, d, "pages").select("url", "html"))
    return got.select("venue_id", "url", "name", "first_line", "objects", F.size("menus").alias("sections"))


@query
def crawl_stats(spark, d):
    return pages.crawl_stats(t.read(spark, d, "pages"))


@query
def mock_menu(spark, d):
    u = t.read(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), "url")
    return pages.scraped_items(pages.mock_venues(u))
