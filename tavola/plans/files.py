"""Queries over files and stored tables: fixtures are written to the shared folder and read through the sources."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.functions.text import first_filled
from tavola.operators import classify, menu, tables
from tavola.plans import tables as t
from tavola.shared import shared_dir
from tavola.sources import jsonld, pages, venues

_numbers = itertools.count()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tavola-files-{spark.sparkContext.applicationId}/{next(_numbers)}-{name}"


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "supplier").withColumn("key", F.col("s_suppkey").cast("string"))


def _venue_file(rows: DataFrame, path: str, name: Column, place: Column) -> None:
    """One JSON object, id to venue."""
    location = F.struct(F.lit("Point").alias("type"), place.alias("coordinates"))
    address = F.struct(F.col("s_name").alias("firstLine"), F.lit("B").alias("city"), F.lit("").alias("postalCode"), location.alias("location"))
    entry = F.struct("key", F.struct(name.alias("name"), F.concat(F.lit("u"), "key").alias("url"), address.alias("address")).alias("venue"))
    whole = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry))))
    rows.agg(whole.alias("value")).coalesce(1).write.text(path)


def _split_files(spark: SparkSession, d: str) -> str:
    """Two parts, of which the second has newer venues for every third id, and a broken one."""
    s, out = _suppliers(spark, d), _folder(spark, "split")
    _venue_file(s, f"{out}/part_1.json", F.col("s_name"), F.array(F.lit(2.5), F.lit(41.0) + F.col("s_suppkey") / 1000))
    _venue_file(s.where("s_suppkey % 3 = 0"), f"{out}/part_2.json", F.concat(F.lit("New "), "s_name"), F.array(F.lit(2.5), F.lit(None).cast("double")))
    tables.write_text(spark, f"{out}/part_3.json", "{broken")
    return out


def venue_files(spark, d):
    found = venues.read_venue_files(spark, f"{_split_files(spark, d)}/part_*.json")
    return venues.venue_rows(found).drop("ordinal")


def venue_split(spark, d):
    """The primary file is there but broken, so the parts are read."""
    out = _split_files(spark, d)
    return venues.venue_rows(venues.load_venues(spark, f"{out}/part_3.json", f"{out}/part_*.json")).select("id", "name")


def place_list(spark, d):
    s, path = _suppliers(spark, d), _folder(spark, "places.json")
    known = F.when(F.col("s_suppkey") % 3 == 0, F.col("key")).otherwise("")
    rows = s.select(
        known.alias("id"), F.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("g"), "key")).alias("googlePlaceId"), F.when(F.col("s_suppkey") % 10 != 9, F.col("s_name")).otherwise("").alias("name"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("raw "), "key")).otherwise("").alias("rawAddress"), F.concat(F.lit("plain "), "key").alias("address"),
        F.when(F.col("s_suppkey") % 4 == 0, "north").otherwise("41.5").alias("latitude"), (F.col("s_suppkey") / 100).alias("longitude"),
    )
    tables.write_json_array(rows, path)
    got = venues.read_place_list(spark, path)
    return got.select("name", F.when(F.length("id") < 64, F.col("id")).otherwise("made").alias("id"), "address", "lat", "lon")


def taxonomy_file(spark, d):
    """A file with untidy headers, in which every second category comes twice."""
    path = _folder(spark, "taxonomy")
    p = t.read(spark, d, "part")
    rows = p.groupBy(F.col("p_brand").alias("Category  UIdentifier")).agg(F.min("p_name").alias("old"), F.max("p_name").alias("new"))
    again = F.when(F.pmod(F.length("old"), F.lit(2)) == 0, F.array("old", "new")).otherwise(F.array("old"))
    spread = rows.select("Category  UIdentifier", F.posexplode(again).alias("nth", " Name ")).orderBy("nth", "Category  UIdentifier").drop("nth")
    spread.coalesce(1).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return venues.read_taxonomy(spark, path).select("category_uidentifier", "name")


def url_file(spark, d):
    """An object and an array of URLs; the place in the array is the id."""
    p, out = t.read(spark, d, "pages"), _folder(spark, "urls")
    p.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("p"), "page_id"), "url")))).alias("value")).coalesce(1).write.text(f"{out}/object")
    p.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"])).alias("value")).coalesce(1).write.text(f"{out}/array")
    return venues.read_urls(spark, f"{out}/object").unionByName(venues.read_urls(spark, f"{out}/array"))


def image_list(spark, d):
    """A folder for each nation, with images and a note."""
    out = _folder(spark, "images")
    for r in t.read(spark, d, "nation").select("n_nationkey", "n_regionkey").collect():  # a fixture of 25 folders
        for name in [f"{k}.{end}" for k, end in enumerate(("png", "JPG", "jpeg")[: r.n_regionkey % 3 + 1])] + ["note.txt"]:
            tables.write_text(spark, f"{out}/{r.n_nationkey}/{name}", name)
    return venues.list_images(spark, out).select("menu_id", F.array_join(F.transform("images", lambda p: F.element_at(F.split(p, "/"), -1)), ",").alias("names"))


def matches_json(spark, d):
    path = _folder(spark, "matches.json")
    tables.write_json_array(t.matched(spark, d).select("venue_id", "match_id"), path)
    return spark.read.schema("venue_id long, match_id long").json(path, multiLine=True)


def unmatched_json(spark, d):
    path = _folder(spark, "unmatched.json")
    tables.write_unmatched(tables.stale(t.read(spark, d, "orders").select(F.col("o_custkey").alias("venue_id")), t.matched(spark, d), "venue_id"), path)
    return spark.read.schema("ids array<long>, count long").json(path, multiLine=True).select("count", F.explode("ids").alias("venue_id"))


def _known_diffs(spark: SparkSession, d: str) -> DataFrame:
    return menu.menu_diff(t.candidates(spark, d), t.known_menu(spark, d))


def diffs_json(spark, d):
    path = _folder(spark, "diffs")
    tables.write_by_menu(_known_diffs(spark, d).select("menu_id", "at", "diff_type", "item_id"), path)
    return spark.read.schema("`at` long, diff_type string, item_id long, menu_id string").json(path).select("menu_id", "at", "diff_type", "item_id")


def diffs_csv(spark, d):
    path = _folder(spark, "diffs-csv")
    tables.write_diffs(_known_diffs(spark, d), path)
    got = spark.read.option("header", True).schema(", ".join(f"{c} string" for c in [*tables.DIFF_COLUMNS, "menu_id"])).csv(path)
    return got.groupBy("menu_id", "diff_type").agg(F.count("*").alias("n"), F.count_if(F.coalesce("db_name", F.lit("")) != "").alias("known"), F.count_if(F.coalesce("extracted_price", F.lit("")) != "").alias("priced"))


def venue_json_files(spark, d):
    path = _folder(spark, "venues")
    tables.write_by_menu(_suppliers(spark, d).select("key", "s_name", "s_acctbal"), path, key="key")
    return spark.read.schema("s_name string, s_acctbal double, key string").json(path).select("key", "s_name", "s_acctbal")


def delete_by_menu(spark, d):
    old = t.items(spark, d).select("item_id", F.col("section").alias("menu_id"))
    gone = old.where("item_id % 7 = 0").select("menu_id")
    return tables.delete_parents(old, gone.where("menu_id < 'Brand#3'"), "menu_id")


def merge_files(spark, d):
    """A file for each nation; some name another id, some none, one is broken."""
    out = _folder(spark, "merge")
    for r in t.read(spark, d, "nation").collect():  # a fixture of 25 files
        body = f'{{"id": "{"" if r.n_nationkey % 3 else r.n_nationkey % 2}", "name": "{r.n_name}"}}'
        tables.write_text(spark, f"{out}/n{r.n_nationkey:02d}.json", "{broken" if r.n_nationkey == 7 else body)
    got = venues.merge_venue_files(spark, f"{out}/*.json")
    return got.select("venue_id", F.get_json_object("json", "$.name").alias("name"))


def created_tables(spark, d):
    """Every table's columns as the catalogue tells them after two runs of create_tables()."""
    database = f"tavola_{next(_numbers)}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{_folder(spark, 'database')}'")
    for _ in range(2):
        tables.create_tables(spark, database)
    found = [(name, f.name, f.dataType.simpleString()) for name in tables.SCHEMAS for f in spark.table(f"{database}.{name}").schema]
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return spark.createDataFrame(found, "table_name string, column_name string, column_type string")


def migrated_table(spark, d):
    """Items stored before they had a section."""
    old = t.items(spark, d).select(F.col("item_id").alias("id"), F.col("venue_id").cast("string"), "name", "description", "price")
    return tables.migrate(old, "menu_items").select("id", "venue_id", "name", F.col("section").isNull().alias("no_section"))


def _half_done(spark: SparkSession, d: str) -> DataFrame:
    return t.item_texts(spark, d).where("item_id % 2 = 0").select("item_id")


def classify_incremental(spark, d):
    return classify.run(t.item_texts(spark, d), t.taxonomy(spark), _half_done(spark, d)).select("item_id", "taxonomy_id")


def classify_force(spark, d):
    return classify.run(t.item_texts(spark, d), t.taxonomy(spark), _half_done(spark, d), force=True, clear=lambda: None).select("item_id", "taxonomy_id")


def classify_force_failed(spark, d):
    """Clearing fails, so only new items are classified."""

    def clear() -> None:
        raise OSError("read-only store")

    return classify.run(t.item_texts(spark, d), t.taxonomy(spark), _half_done(spark, d), force=True, clear=clear).select("item_id", "taxonomy_id")


def save_extractions(spark, d):
    """Two appends to one table."""
    path = _folder(spark, "extractions")
    items = t.candidates(spark, d).select("menu_id", F.concat(F.lit("i"), F.col("at") % 3).alias("image_file"), "name", "price", "description")
    for k in (0, 1):
        tables.append(tables.extractions(items.where(F.length("name") % 2 == k)), path, "menu_image_extractions")
    return spark.read.parquet(path).groupBy("menu_id", "image_file").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"), F.round(F.sum("item_price"), 4).alias("price"))


def save_diffs(spark, d):
    path = _folder(spark, "saved-diffs")
    diffs = _known_diffs(spark, d).withColumn("venue_id", F.lit("v"))
    tables.append(diffs, path, "menu_diffs")
    return spark.read.parquet(path).groupBy("menu_id", "venue_id", "diff_type").agg(F.count("*").alias("n"), F.count("item_id").alias("known"))


def _scraped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u = t.read(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), "url")
    mock = pages.mock_venues(u)
    return mock.select(F.col("venue_id").alias("id"), "name"), pages.scraped_items(mock).select("venue_id", "name", "price")


def save_batch_venues(spark, d):
    new, items = _scraped(spark, d)
    old = new.where("cast(id as long) % 2 = 0").withColumn("name", F.lit("old")).unionByName(spark.createDataFrame([("x", "kept")], "id string, name string"))
    return tables.save_venues(old, items, new, items)[0]


def save_batch_items(spark, d):
    """Every second venue is scraped again."""
    new, items = _scraped(spark, d)
    again = items.where("cast(venue_id as long) % 2 = 0")
    saved = tables.save_venues(new, items, new, again)[1]
    return saved.groupBy("venue_id", "name").agg(F.count("*").alias("n"))


def save_matches_empty(spark, d):
    """A run without matches leaves the old ones, unless stale ones must go."""
    old = t.matched(spark, d).groupBy("venue_id").agg(F.max("match_id").alias("match_id"))
    none = old.limit(0)
    kept = tables.save_matches(old, none).withColumn("strict", F.lit(False))
    return kept.unionByName(tables.save_matches(old, none, strict_stale=True).withColumn("strict", F.lit(True)))


def falsy_coalesce(spark, d):
    s = _suppliers(spark, d)
    first = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).when(F.col("s_suppkey") % 3 == 1, "")
    return s.select("s_suppkey", first_filled(first, F.lit("other")).alias("value"))


def default_if_absent(spark, d):
    """A section without a name is general; an empty name stays."""
    s = _suppliers(spark, d)
    name = F.when(F.col("s_suppkey") % 3 == 0, '"name":"S",').when(F.col("s_suppkey") % 3 == 1, '"name":"",').otherwise("")
    listed = F.concat(F.lit("[{"), name, F.lit('"items":[{"name":"i","price":1.0}]}]'))
    v = s.select(F.col("key").alias("venue_id"), F.struct(F.col("s_name").alias("name"), listed.alias("menus")).alias("venue"))
    return venues.menu_item_rows(v).select("venue_id", "section")


def safe_cast(spark, d):
    p = t.price_texts(spark, d)
    return p.select("p_partkey", F.col("auto").try_cast("double").alias("value"))


def item_number(spark, d):
    """Item lines with and without a number before the name."""
    p = t.read(spark, d, "part")
    line = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.concat("p_partkey", F.lit(". "))).when(F.col("p_partkey") % 3 == 1, F.concat("p_partkey", F.lit("-"))).otherwise(""), "p_name")
    parsed = menu.parse_menus(p.select(F.col("p_partkey").alias("menu_id"), line.alias("text")))
    return parsed.select("menu_id", "name")


def log_slice(spark, d):
    return tables.first_rows(t.customers(spark, d), "id")


def column_names(spark, d):
    return tables.column_names(t.read(spark, d, "part"))


def _ld_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each supplier, in four shapes: a graph, a list, a menu inside the restaurant, and a broken script after a good one."""
    s = _suppliers(spark, d)
    rated = F.when(F.col("s_suppkey") % 5 == 0, ',"aggregateRating":{"ratingValue":"4.5","reviewCount":12}').otherwise("")
    item = lambda n, price: F.concat(F.lit(f'{{"name":"{n} '), "key", F.lit(f'","offers":{price}}}'))
    sections = F.concat(F.lit('[{"name":"Rolls","hasMenuItem":['), item("a", '{"price":"12.50"}'), F.lit(',{"name":""}]},{"hasMenuItem":'), item("b", '[{"price":4.5}]'), F.lit('},{"name":"Empty"}]'))
    body = F.concat(F.lit('"@type":"Restaurant","name":"'), "s_name", F.lit('","address":{"streetAddress":"S '), "key", F.lit('"},"geo":{"latitude":"41.4","longitude":2.1}'), rated)
    venue, carte = F.concat(F.lit("{"), body, F.lit("}")), F.concat(F.lit('{"@type":["Menu"],"hasMenuSection":'), sections, F.lit("}"))
    both = F.concat(venue, F.lit(","), carte)
    k = F.col("s_suppkey") % 4
    script = F.when(k == 0, F.concat(F.lit('{"@graph":['), both, F.lit("]}"))).when(k == 1, F.concat(F.lit("["), both, F.lit("]")))
    script = script.when(k == 2, F.concat(F.lit("{"), body, F.lit(',"hasMenu":'), carte, F.lit("}"))).otherwise(venue)
    tag = lambda x: F.concat(F.lit('<script type="application/ld+json">'), x, F.lit("</script>"))
    html = F.concat(F.lit("<html><h1>Heading</h1>"), tag(script), F.when(k == 3, F.concat(tag(F.lit("{oops")), tag(carte))).otherwise(""), F.lit("</html>"))
    return s.select(F.concat(F.lit("https://x/restaurants-"), "key", F.lit("/menu")).alias("url"), html.alias("html"))


def jsonld_venues(spark, d):
    got = pages.scrape_pages(_ld_pages(spark, d))
    return got.select("venue_id", "name", "first_line", F.array_join(F.transform("coordinates", lambda c: c.cast("string")), ",").alias("coordinates"), "star_rating", "rating_count", "objects", F.size("menus").alias("sections"))


def jsonld_items(spark, d):
    return pages.scraped_items(pages.scrape_pages(_ld_pages(spark, d)))


def jsonld_objects(spark, d):
    return _ld_pages(spark, d).select("url", F.size(jsonld.page_objects(F.col("html"))).alias("objects"))


def queries() -> dict:
    own = (venue_files, venue_split, place_list, taxonomy_file, url_file, image_list, matches_json, unmatched_json, diffs_json, diffs_csv, venue_json_files, delete_by_menu, merge_files, created_tables, migrated_table)
    own += (classify_incremental, classify_force, classify_force_failed, save_extractions, save_diffs, save_batch_venues, save_batch_items, save_matches_empty, falsy_coalesce, default_if_absent, safe_cast, item_number, log_slice, column_names)
    return {f.__name__: f for f in (*own, jsonld_venues, jsonld_items, jsonld_objects)}
