"""Changes and exports of more rows than one task or file takes."""

import json

import pytest
from pyspark.sql import functions as F

from tavola.operators import tables


def test_chunks_of_many_partitions(spark):
    """Wide rows beside narrow counts: the ranges must be the same for both."""
    rows = spark.range(0, 60_000, 1, 12).select(F.pmod(F.col("id") * 7919, F.lit(60_000)).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    rows = rows.select("k", F.repeat("wide", 4).alias("wide"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        got = tables.chunks(rows, "k", 3).select("k", "part").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.k, r.part) for r in got) == [(k, k // 20_000) for k in range(60_000)]


@pytest.mark.parametrize("keys", [[], [None, "b", "a", "c", None, "é"], ["x"] * 7])
def test_chunks_of_odd_keys(spark, keys):
    got = tables.chunks(spark.createDataFrame([(k,) for k in keys], "k string"), "k", 3).collect()
    size = max(1, -(-len(keys) // 3))
    assert sorted((r.part, r.k or "") for r in got) == [(i // size, k) for i, k in enumerate(sorted(k or "" for k in keys))]


def test_chunks_of_equal_keys(spark):
    got = tables.chunks(spark.range(30).select(F.lit(1).alias("k"), "id"), "k", 3, ties=("id",)).collect()
    assert sorted((r.id, r.part) for r in got) == [(i, i // 10) for i in range(30)]


def test_json_arrays_beyond_one_file(spark, tmp_path):
    rows = spark.range(0, 2_500, 1, 3).select(F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, "é").alias("b"))
    tables.write_json_array(rows, str(tmp_path / "many"), limit=1_000, part=200)
    files = list((tmp_path / "many").glob("part-*"))
    assert sum(len(json.loads(f.read_text())) for f in files) == 2_500 and max(len(json.loads(f.read_text())) for f in files) <= 200
    got = spark.read.schema("a long, b string").json(str(tmp_path / "many"), multiLine=True).collect()
    assert sorted(map(tuple, got), key=lambda x: x[0]) == [(i, None if i % 2 else "é") for i in range(2_500)]
    tables.write_json_array(rows, str(tmp_path / "one.json"), limit=2_500)
    assert len(json.loads((tmp_path / "one.json").read_text())) == 2_500
    tables.write_json_array(rows.limit(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == []
