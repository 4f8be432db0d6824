"""Incremental runs over arriving files: each micro-batch goes through a batch operator once.

These wrappers run batch operators as ``availableNow`` streams with a checkpoint, so that a restart goes on
where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tavola.config import Settings
from tavola.operators import classify


def process_new(source: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run ``work`` on all rows that have arrived since the last run and append its rows to ``out``.

    A repeated batch overwrites its own folder, so a retry adds nothing twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def classify_new(spark: SparkSession, items_path: str, schema: str, taxonomy: DataFrame, out: str, checkpoint: str, settings: Settings | None = None) -> StreamingQuery:
    """Classify items (item_id, text) from new Parquet files."""
    items = spark.readStream.schema(schema).parquet(items_path)
    return process_new(items, lambda batch: classify.run(batch, taxonomy, settings=settings), out, checkpoint)
