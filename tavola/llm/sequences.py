"""Packed token-id matrices: best-fit-decreasing packing with a segment tree over free capacities.

Each task packs what it reads, in windows of bounded size, so nothing is shuffled and a lost executor costs
only its tasks.  A window leaves at most a few sequences partly filled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .packing import CAPACITY, END_ID
from .tokens import default_tokenizer_path, shared_tokenizer

#: Ids that a task gathers before it packs them: 16 MB.
WINDOW_IDS = 4 << 20
#: Words that a worker keeps: more than elsewhere, as nothing else stays in its memory.
CACHE_ENTRIES = 800_000

SCHEMA = "sequence_id long, n_ids int, doc_ids array<long>, pieces array<int>, starts array<long>, cu_seqlens array<int>, ids binary, position_ids binary"
_ARROW = pa.schema([("sequence_id", pa.int64()), ("n_ids", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("position_ids", pa.binary())])


class CapacityTree:
    """Open sequences by free capacity; finds the smallest free capacity that is large enough in O(log capacity)."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._counts = [0] * (2 * self._leaves)
        self._open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, sequence: int) -> None:
        self._open[free].append(sequence)
        node = self._leaves + free
        while node:
            self._counts[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (free, sequence) of the tightest open sequence with room for ``need``."""
        node, counts = self._leaves + need, self._counts
        if not counts[node]:
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        free = node - self._leaves
        while node:
            counts[node] -= 1
            node >>= 1
        return free, self._open[free].pop()


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: the numbers of the items in each sequence.  Ties go to the earlier item."""
    tree, sequences = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            found = capacity, len(sequences)
            sequences.append([])
        free, k = found
        sequences[k].append(i)
        if free > lengths[i]:
            tree.add(free - lengths[i], k)
    return sequences


def _fixed(data: bytes, rows: int, width: int) -> pa.Array:
    """A binary column of ``rows`` values of ``width`` bytes each, end to end in ``data``, which is not copied."""
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def packed_sequences(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, window_ids: int = WINDOW_IDS, pad_id: int = END_ID) -> DataFrame:
    """Rows of a packed id matrix with their segments.

    ``ids`` and ``position_ids`` hold ``capacity`` little-endian unsigned 32-bit numbers each; places past
    ``n_ids`` hold ``pad_id`` and position 0.  ``cu_seqlens`` are the segments' bounds (0 first, n_ids last);
    positions restart at 0 with each segment.  Segment j is piece pieces[j] of document doc_ids[j], whose
    ids from starts[j] it holds.  A document is its text's ids and END_ID; a null text counts as empty.
    Longer documents are cut without loss into pieces of ``capacity`` ids and a rest.  Repeated rows are
    packed repeatedly, an empty table gives no rows, and only doc_id and text are read.
    """
    path = tokenizer_path or default_tokenizer_path()

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end, width = shared_tokenizer(path, CACHE_ENTRIES), END_ID.to_bytes(4, "little"), 4 * capacity
        ramp = memoryview(np.arange(capacity, dtype="<u4").tobytes())
        pad, zeros = memoryview(pad_id.to_bytes(4, "little") * capacity), memoryview(bytes(width))
        made, base = 0, TaskContext.get().partitionId() << 40
        window: list[tuple[int, int, int, bytes]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            packed = best_fit([len(x[3]) // 4 for x in window], capacity)
            for at in range(0, len(packed), 512):
                some = packed[at : at + 512]
                rows: list[list] = [[] for _ in range(6)]
                ids, positions = [], []
                for items in some:
                    parts = [window[i] for i in items]
                    sizes = [len(p[3]) for p in parts]
                    bounds = [0, *accumulate(n // 4 for n in sizes)]
                    free = width - 4 * bounds[-1]
                    ids += [*(p[3] for p in parts), pad[:free]]
                    positions += [*(ramp[:n] for n in sizes), zeros[:free]]
                    for to, x in zip(rows, (base + made, bounds[-1], [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], bounds)):
                        to.append(x)
                    made += 1
                arrays = [pa.array(x, f.type) for x, f in zip(rows, _ARROW)] + [_fixed(b"".join(x), len(some), width) for x in (ids, positions)]
                yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)
            window.clear()

        for batch in batches:
            texts = (text or "" for text in batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode_all(texts)):
                data = ids + end
                for k, at in enumerate(range(0, len(data), width)):
                    window.append((doc_id, k, at // 4, data[at : at + width]))
                    held += len(window[-1][3]) // 4
                    if held >= window_ids:
                        yield from flush()
                        held = 0
        if window:
            yield from flush()

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), sequences, SCHEMA)


def write_sequences(sequences: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet: one file a task, each row a fixed-width row of the id matrix with its segments."""
    sequences.write.mode("overwrite").parquet(path)


def read_matrix(rows: list, capacity: int = CAPACITY) -> np.ndarray:
    """The id matrix of collected rows, one sequence a row."""
    return np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), "<u4").reshape(-1, capacity)
