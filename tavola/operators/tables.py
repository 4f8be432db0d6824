"""Changes to tables as DataFrames, and exports.

Each change returns the whole new table; write it to a new path, then swap.  Spark doesn't overwrite what it reads.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


SCHEMAS = {
    "food_taxonomy": _schema(category_uidentifier=_S, name=_S, parent=_S, family=_S, ordinal=_L),
    "venues_left": _schema(id=_S, name=_S, address=_S, latitude=_D, longitude=_D, url=_S, ordinal=_L),
    "venues_right": _schema(id=_S, name=_S, address=_S, latitude=_D, longitude=_D, ordinal=_L),
    "matches": _schema(left_id=_S, right_id=_S, similarity_score=_D),
    "menu_items": _schema(id=_L, venue_id=_S, name=_S, description=_S, price=_D, section=_S),
    "classifications": _schema(menu_item_id=_L, taxonomy_id=_S, confidence=_D),
    "image_detections": _schema(menu_id=_S, concept=_S, confidence=_D, created_at=T.TimestampType()),
    "menu_image_extractions": _schema(menu_id=_S, image_file=_S, item_name=_S, item_price=_D, item_description=_S, confidence=_D, created_at=T.TimestampType()),
    "menu_diffs": _schema(menu_id=_S, venue_id=_S, diff_type=_S, name=_S, db_name=_S, price=_D, db_price=_D, description=_S, db_description=_S, item_id=_L, match_score=_D, section=_S, created_at=T.TimestampType()),
}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Create the tables that don't exist yet; columns that an old one lacks are added on read, by migrate()."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in SCHEMAS.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def migrate(table: DataFrame, name: str) -> DataFrame:
    """A table with all columns of its schema; those it lacks are null."""
    empty = table.sparkSession.createDataFrame([], SCHEMAS[name])
    return empty.unionByName(table, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones with the same key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each key, the last by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc(order)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows with an unknown key are added, of several the first."""
    fresh = first_wins(new, keys, order).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents in ``new`` are replaced."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_parents(old: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    return old.join(parents.select(parent).distinct(), parent, "left_anti")


def stale(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of ``old`` that ``new`` lacks."""
    return old.select(key).distinct().join(new.select(key), key, "left_anti")


def save_matches(old: DataFrame, new: DataFrame, strict_stale: bool = False) -> DataFrame:
    """Matches after a run: new ones replace those of their left venue and stale ones go.

    Without any new match the old table stays, unless ``strict_stale``.
    """
    if strict_stale or not new.isEmpty():
        return new
    return old


#: Ranges of keys that chunks() numbers one by one, about; and the keys that their bounds are chosen from.
RANGES, DRAWN = 64, 4000


def chunks(rows: DataFrame, key: str, parts: int, ties: Sequence[str] = ()) -> DataFrame:
    """Rows with ``part``: key-sorted chunks of ceil(n / parts) rows, null keys first, equal keys by the columns ``ties``.

    Row numbers come from counts of key ranges, so no task sorts all rows.  The ranges' bounds are fixed values drawn from
    the keys: ranges that Spark chooses itself may differ between the count and the rows.
    """
    n = rows.count()
    size = max(1, -(-n // parts))
    drawn = rows.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(max(1, n // DRAWN))) == 0)).select(key).distinct()
    found = [r[0] for r in drawn.orderBy(key).limit(10 * DRAWN).collect()]
    bounds = found[:: max(1, len(found) // RANGES)]
    at = sum([(F.col(key) >= F.lit(b)).cast("int") for b in bounds], F.lit(0))
    ranged = rows.withColumn("_range", F.coalesce(at, F.lit(0)))
    starts = ranged.groupBy("_range").count()
    starts = starts.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # one row a range
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(key, *ties)) - 1).join(starts, "_range")
    return placed.withColumn("part", F.floor((F.col("_start") + F.col("_at")) / size).cast("int")).drop("_range", "_at", "_start")


def stable_ids(rows: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """A long id from the row's own key, the same on every run."""
    return rows.withColumn(name, F.shiftrightunsigned(F.xxhash64(*order), 1))


def write_json_array(rows: DataFrame, path: str, limit: int = 1_000_000, part: int = 100_000) -> None:
    """One indented JSON array; more than ``limit`` rows become a folder of such arrays, each of at most ``part`` rows.

    Both are read by ``spark.read.json(path, multiLine=True)``.  A folder is written by the tasks, so neither the driver
    nor a reading task holds more than one array of bounded rows.
    """
    texts = rows.select(F.to_json(F.struct(*rows.columns)).alias("text"))
    if rows.limit(limit + 1).count() > limit:
        indented = texts.mapInArrow(lambda batches: _arrays(batches, part), "value string")
        indented.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
        return
    write_text(rows.sparkSession, path, next(_indented([r[0] for r in texts.collect()], max(1, limit)), "[]"))


def _indented(texts: list[str], part: int) -> Iterator[str]:
    for at in range(0, len(texts), part):
        yield json.dumps([json.loads(x) for x in texts[at : at + part]], indent=4, ensure_ascii=False)


def _arrays(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """One row for each array of at most ``part`` of a task's rows."""
    held: list[str] = []
    for batch in batches:
        held.extend(batch.column(0).to_pylist())
        while len(held) >= part:
            yield pa.RecordBatch.from_arrays([pa.array(_indented(held[:part], part), pa.string())], ["value"])
            held = held[part:]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(_indented(held, part), pa.string())], ["value"])


def write_unmatched(ids: DataFrame, path: str, limit: int = 1_000_000) -> None:
    """{ids, count} of unmatched venues; nothing if there are none."""
    got = [r[0] for r in ids.limit(limit + 1).collect()]
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows")
    if got:
        write_text(ids.sparkSession, path, json.dumps({"ids": got, "count": len(got)}, indent=4))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """By Hadoop's file system, so any path that Spark can write will do."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_by_menu(rows: DataFrame, path: str, kind: str = "json", key: str = "menu_id") -> None:
    """One folder for each value of ``key``, as JSON or CSV with a header."""
    writer = rows.write.mode("overwrite").partitionBy(key)
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


#: The columns of a menu's differences as CSV, and what they are called in menu_diff().
DIFF_COLUMNS = {
    "extracted_name": "name", "extracted_price": "price", "extracted_description": "description", "db_name": "db_name", "db_price": "db_price",
    "db_description": "db_description", "diff_type": "diff_type", "section": "section",
}


def write_diffs(diffs: DataFrame, path: str) -> None:
    """The differences of each menu as CSV with eight columns; what is missing is empty."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in DIFF_COLUMNS.items()]
    write_by_menu(diffs.select("menu_id", *texts), path, "csv")


def append(rows: DataFrame, path: str, name: str) -> None:
    """Append rows to a stored table of SCHEMAS, in one commit: all rows of the call or none."""
    known = migrate(rows.select(*[c for c in rows.columns if c in SCHEMAS[name].names]), name)
    known.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]]).write.mode("append").parquet(path)


def extractions(items: DataFrame) -> DataFrame:
    """Rows of ``menu_image_extractions`` for parsed items (menu_id, image_file, name, price, description); confidence is 1."""
    return items.select("menu_id", "image_file", F.col("name").alias("item_name"), F.col("price").alias("item_price"), F.col("description").alias("item_description"), F.lit(1.0).alias("confidence"))


def save_venues(old: DataFrame, old_items: DataFrame, venues: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after a batch of scraped venues: venues replace those of their id, items are added to what is there.

    Items of a venue scraped again are there twice, as the batch only adds; replace_children() does not.
    """
    return upsert(old, venues, ["id"]), old_items.unionByName(items, allowMissingColumns=True)


def first_rows(rows: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first rows by a column, for a log."""
    return rows.orderBy(order).limit(n)


def column_names(rows: DataFrame) -> DataFrame:
    """place and name of each column."""
    return rows.sparkSession.createDataFrame(list(enumerate(rows.columns)), "place int, name string")
