"""What the operators of this subpackage share: tables in the shared folder, Arrow batches, hashes."""

from __future__ import annotations

import ctypes
import itertools
import re
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.shared import shared_dir

_numbers = itertools.count()
#: Paths that are written and not yet deleted, oldest first.
_paths: list[str] = []

#: Rows that a function gets at once; Spark itself bounds a batch's bytes (arrow.maxBytesPerBatch, 64 MB).
ARROW_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Modules whose functions share a worker's tokenizers.
_TOKENIZING = ("tavola.llm.packing", "tavola.llm.sequences")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which release() deletes."""
    _paths.append(f"{shared_dir(spark)}/tavola-{spark.sparkContext.applicationId}/{next(_numbers)}-{name}")
    return _paths[-1]


def table_name(spark: SparkSession, name: str) -> str:
    """A new name for a table of the session's catalogue."""
    return f"tavola_{re.sub('[^A-Za-z0-9]', '_', spark.sparkContext.applicationId)}_{next(_numbers)}_{name}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there.

    A lost executor costs the tasks under way, not what was written.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with setting(spark, _BATCH, str(ARROW_ROWS)):  # larger batches would be made only to be cut by map_batches()
        df.write.mode("overwrite").parquet(path, partitionBy=list(partition_by) or None)
    got = spark.read.schema(df.schema).parquet(path)
    got._written = path
    return got


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*written: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more."""
    for df in written:
        _delete(df.sparkSession, df._written)
        _paths.remove(df._written)


def written() -> int:
    """A mark for release(): how much has been written so far."""
    return len(_paths)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what was written to the shared folder since a mark, but for ``keep``; results that still read it become unusable."""
    kept = getattr(keep, "_written", None)
    for path in [p for p in _paths[since:] if p != kept]:
        _delete(spark, path)
        _paths.remove(path)


def _turn_to(module: str) -> None:
    """A worker that turns to another operator drops its tokenizers and the words they have cached."""
    tokens = sys.modules.get("tavola.llm.tokens")
    if tokens and module not in _TOKENIZING:
        tokens.shared_tokenizer.cache_clear()


def _give_back() -> None:
    """Let go of memory that this worker holds and doesn't use: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches that are bounded in rows as well as in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _turn_to(fn.__module__)
        try:
            yield from fn(b.slice(at, ARROW_ROWS) for b in batches for at in range(0, b.num_rows, ARROW_ROWS))
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def arrow_batches(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that an extra column of the input can never clash with a computed one."""
    return df.select(*names)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves remainder 1 on division by 3 (a null id: of the empty text)."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def unit_hash(*columns: Column) -> Column:
    """A seeded, reproducible non-negative long below 2**62."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)
