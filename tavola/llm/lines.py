"""Line dedup over levelled sorted runs of line hashes; DataFrame functions only.

``LineRuns`` holds each line hash once, in sorted runs, as an LSM tree does.  Runs are tables bucketed and sorted by hash,
one file a bucket, so a new batch is merge-anti-joined with them without moving or sorting them again: hashes
that no run has become a run of their own, the others are kept as increments.  When a level has ``fanout`` runs they
are merged into one of the next level, which takes in the increments of its hashes.  A manifest in the same folder names
the runs, so a later application opens the state and adds its batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_path, table_name

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 3
#: Line hashes that a bucket holds, about, where the number of buckets is chosen; 32 bytes each.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 2_000_000, 8, 100_000
#: ASCII white space, as the contract strips it.
SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


@contextmanager
def _merging(spark: SparkSession) -> Iterator[None]:
    """Bucketed scans tell their order, so that merge joins don't sort again; the session is left as it was."""
    wanted = {"spark.sql.sources.bucketing.enabled": "true", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, last_doc) in a folder; every hash is in one run only.

    What batches after the first say of a hash is in increments until a compaction folds it in.  The folder's manifest
    is replaced after all tables of a change are written, so a job that fails leaves the state as it was.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = LEAST_BUCKETS, fanout: int = FANOUT):
        """Open the state in ``path``, or start an empty one there; an existing state keeps its buckets and fanout."""
        self._spark, self._path = spark, path.rstrip("/")
        jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self._path).getFileSystem(hadoop)
        self._state = {"buckets": buckets, "fanout": fanout, "tables": 0, "levels": [], "increments": []}
        if self._fs.exists(self._at(f"{self._path}/manifest.json")):
            self._state = json.loads(spark.read.text(f"{self._path}/manifest.json", wholetext=True).first()[0])

    @property
    def levels(self) -> list[list[DataFrame]]:
        return [[self._read(t) for t in level] for level in self._state["levels"]]

    def _read(self, table: str) -> DataFrame:
        name, n = table_name(self._spark, "run"), self._state["buckets"]
        self._spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, n_docs BIGINT, last_doc BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {n} BUCKETS LOCATION '{self._path}/{table}'")
        got = self._spark.table(name)
        self._spark.sql(f"DROP TABLE {name}")  # the files stay
        return got

    def _write(self, df: DataFrame, state: dict) -> str:
        table, name = f"table-{state['tables']}", table_name(self._spark, "run")
        state["tables"] += 1
        writer = df.select("h1", "h2", "n_docs", "last_doc").write.mode("overwrite").bucketBy(state["buckets"], "h1", "h2").sortBy("h1", "h2")
        writer.option("path", f"{self._path}/{table}").saveAsTable(name)
        self._spark.sql(f"DROP TABLE {name}")
        return table

    def _replace(self, state: dict) -> None:
        tables = lambda s: {*s["increments"], *(t for level in s["levels"] for t in level)}
        old, self._state = tables(self._state), state
        new = self._fs.create(self._at(f"{self._path}/manifest.new"), True)
        new.write(bytearray(json.dumps(state).encode()))
        new.close()
        self._fs.delete(self._at(f"{self._path}/manifest.json"), False)
        self._fs.rename(self._at(f"{self._path}/manifest.new"), self._at(f"{self._path}/manifest.json"))
        for t in old - tables(state):
            self._fs.delete(self._at(f"{self._path}/{t}"), True)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose hash no run has: a merge-anti-join with one run after the other."""
        return reduce(lambda left, run: left.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"), (r for level in self.levels for r in level), batch)

    def _with_increments(self, run: DataFrame) -> DataFrame:
        """A run's counts with what the increments add to them, by one merge join each."""
        for t in self._state["increments"]:
            more = self._read(t).select("h1", "h2", F.col("n_docs").alias("more_docs"), F.col("last_doc").alias("later_doc"))
            run = run.join(more.hint("merge"), ["h1", "h2"], "left")
            run = run.select("h1", "h2", (F.col("n_docs") + F.coalesce("more_docs", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later_doc").alias("last_doc"))
        return run

    def add(self, batch: DataFrame) -> None:
        """Add a batch (h1, h2, n_docs, last_doc) of one row a hash; no document may be in two batches."""
        with _merging(self._spark):
            state = json.loads(json.dumps(self._state))
            known = self._write(batch.repartition(state["buckets"], "h1", "h2"), state)
            new = self._write(self.fresh(self._read(known)), state)
            if any(state["levels"]):
                seen = self._read(known).join(self._read(new).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
                state["increments"].append(self._write(seen, state))
            state["levels"] = state["levels"] or [[]]
            state["levels"][0].append(new)
            self._replace(state)
            self._fs.delete(self._at(f"{self._path}/{known}"), True)
            for level in range(2**31):
                if level == len(self._state["levels"]) or len(self._state["levels"][level]) < self._state["fanout"]:
                    break
                self._compact(level)

    def _compact(self, level: int) -> None:
        """Merge a level's runs, which share no hash, into one of the next level, with the increments of its hashes."""
        state = json.loads(json.dumps(self._state))
        parts, state["levels"][level] = state["levels"][level], []
        if level + 1 == len(state["levels"]):
            state["levels"].append([])
        merged = self._write(reduce(DataFrame.union, (self._with_increments(self._read(t)) for t in parts)), state)
        state["levels"][level + 1].append(merged)
        if self._state["increments"]:
            others = [t for own in state["levels"] for t in own if t != merged]
            rest = reduce(DataFrame.union, (self._read(t) for t in self._state["increments"])).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
            state["increments"] = [self._write(rest.join(self._read(merged).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"), state)] if others else []
        self._replace(state)

    def totals(self, min_docs: int = 1) -> DataFrame:
        """h1, h2, n_docs and last_doc over all batches of the hashes in at least ``min_docs`` documents, written."""
        with _merging(self._spark):
            runs = [self._with_increments(r).where(F.col("n_docs") >= min_docs) for level in self.levels for r in level]
            none = self._spark.createDataFrame([], "h1 long, h2 long, n_docs long, last_doc long")
            return materialize(reduce(DataFrame.union, runs) if runs else none, "line-totals")


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, pos, h1, h2 for every line whose key has at least ``min_chars`` code points."""
    lines = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.posexplode(text_lines(F.col("text"))).alias("pos", "_line"))
    stripped = lines.select("doc_id", "text_hash", "pos", F.btrim("_line", F.lit(SPACE)).alias("_line")).where(F.length("_line") >= min_chars)
    keyed = stripped.select("doc_id", "text_hash", "pos", ascii_lower(F.col("_line")).alias("_key"))
    return keyed.select("doc_id", "text_hash", "pos", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit("line"), "_key").alias("h2"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` (doc_id, text and any others) with text's repeated lines gone, and n_lines, n_dropped.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased.  Keys of at least
    ``min_chars`` code points in at least ``min_docs`` documents lose all their lines except in the largest
    doc_id that holds them.  Documents are told apart by doc_id (null: one document, below all others); rows
    that share it all keep the lines that their doc_id keeps.  A null or empty text is one empty line.  Added
    columns are named ``kept_text``, ``n_lines`` and ``n_dropped`` and replace any of those names; no rows give no rows.
    """
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    keys = materialize(line_keys(docs, min_chars).withColumn("batch", batch), "line-keys", ("batch",))
    spark = docs.sparkSession
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, keys.count() // BUCKET_ROWS))
    runs = LineRuns(spark, shared_path(spark, "line-runs"), buckets, fanout)
    for k in range(batches):
        held = keys.where(F.col("batch") == k).select("h1", "h2", "doc_id").distinct()
        runs.add(held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max(F.col("doc_id").cast("long")).alias("last_doc")))
    repeated = runs.totals(min_docs)
    drops = keys.join(repeated, ["h1", "h2"]).where(F.coalesce(F.col("doc_id") < F.col("last_doc"), F.col("last_doc").isNotNull()))
    drops = drops.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "pos").distinct()
    drops = drops.groupBy("_doc", "_hash").agg(F.array_sort(F.collect_list("pos")).alias("_drops"))  # lines of one document
    text = F.col("text").cast("string")
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_hash")), "left").drop("_doc", "_hash")
    # The kept lines are the slices between drops, so the work is in proportion to the lines.
    bounds = F.expr("concat(array(-1), _drops, array(size(_lines)))")
    kept = F.expr("flatten(transform(sequence(0, size(_drops)), i -> slice(_lines, _bounds[i] + 2, _bounds[i + 1] - _bounds[i] - 1)))")
    out = joined.withColumn("_lines", text_lines(F.col("text"))).withColumn("_bounds", bounds)
    out = out.withColumn("kept_text", F.when(F.col("_drops").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n")))
    out = out.withColumns({"n_lines": F.size("_lines").cast("long"), "n_dropped": F.coalesce(F.size("_drops"), F.lit(0)).cast("long")})
    added = ("kept_text", "n_lines", "n_dropped")
    return out.select(*[c for c in docs.columns if c not in added], *added)
