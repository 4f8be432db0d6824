"""Best-fit packing of token sequences into fixed-length training sequences.

``configuration_plan`` solves the configuration linear program over the length histogram by multiplicative
weights, with a knapsack dynamic programme as the pricing step, and rounds the solution.  Only the histogram
(one count for each length up to the capacity) reaches the driver, so its size does not depend on the data.
``pack`` gives each piece its place by rank within its length; ranks are made in shards of a length, so no
task ever holds all pieces of one length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .tokens import default_tokenizer_path, shared_tokenizer

CAPACITY = 2048
END_ID = 0
#: Pieces of one length and shard, about, where a length is very common; and the most shards of a length.
SHARD_ROWS, MAX_SHARDS = 1024, 1 << 20


# --- pieces ------------------------------------------------------------------------------------------------


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32 and, on demand, ids.

    A document is its whole text's ids and END_ID; a null text counts as empty, so it is one piece of one id.
    Only documents longer than ``capacity`` are cut, into pieces of ``capacity`` ids and a last, shorter one.
    Repeated rows give repeated pieces.  ``ids`` are little-endian unsigned 32-bit.
    """
    path = tokenizer_path or default_tokenizer_path()
    columns = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * keep_ids
    schema = pa.schema(columns)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end, width = shared_tokenizer(path), END_ID.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            texts = (text or "" for text in batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode_all(texts)):
                data = ids + end
                for k, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    for to, x in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), pieces, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


# --- the configuration linear program ----------------------------------------------------------------------


@dataclass
class Plan:
    """Configurations as (lengths in descending order, how many sequences have them)."""

    configs: list[tuple[tuple[int, ...], int]]
    capacity: int
    #: Sequences that any packing needs, by the linear program's best dual prices.
    bound: int = 0

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configs)

    def places(self) -> tuple[np.ndarray, ...]:
        """For each length and configuration: where the ranks of that length start, and their places.

        Sorted by key = length << 48 | first rank; sequence and offset of the first, items a sequence.
        """
        taken: dict[int, int] = {}
        rows, base = [], 0
        for items, n in self.configs:
            at = 0
            for length, k in _runs(items):
                rank = taken.get(length, 0)
                rows.append((length << 48 | rank, base, at, k))
                taken[length] = rank + n * k
                at += length * k
            base += n
        rows.sort()
        return tuple(np.array(rows, np.int64).reshape(-1, 4).T)


def _runs(items: tuple[int, ...]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in items:
        if out and out[-1][0] == x:
            out[-1][1] += 1
        else:
            out.append([x, 1])
    return [(a, b) for a, b in out]


def _price(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for each room, and the item that it takes last (-1: none)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(int(lengths[0]), capacity + 1):
        m = upto[room]
        got = best[room - lengths[:m]] + values[:m]
        k = m - 1 - int(got[::-1].argmax())  # of equals the longest, short ones fit elsewhere
        best[room], choice[room] = got[k], k
        if best[room - 1] > got[k]:
            best[room], choice[room] = best[room - 1], -2  # leave one place free
    return best, choice


def _configs_by_seed(lengths: np.ndarray, choice: np.ndarray, capacity: int) -> np.ndarray:
    """For each length, a sequence that holds it and the best fill of the rest; rows of item numbers, -1 after."""
    room, picked = capacity - lengths, [np.arange(len(lengths))]
    while True:
        take = choice[room]
        if (take == -1).all():
            return np.sort(np.stack(picked, 1), 1)[:, ::-1]
        room = np.where(take >= 0, room - lengths[take], np.where(take == -2, room - 1, room))
        picked.append(np.where(take >= 0, take, -1))


def configuration_plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 24, step: float = 0.3, eta: float = 1.0, slack: float = 0.02) -> Plan:
    """Sequences for all pieces of a length histogram, as few as the method finds.

    The linear program has one variable for each configuration (a multiset of lengths that fits) and one
    constraint for each length.  Every round prices lengths by their multiplicative weights, solves the
    knapsack and moves along all configurations whose value is within ``slack`` of the best, by at most
    the share ``step`` of what is still open of any length.  Weights of lengths that lag behind rise.
    The solution is rounded down, then by largest fractions while pieces are left; what remains is placed by
    best fit decreasing, on the histogram, too.  Where best fit decreasing over all pieces needs fewer sequences, it is
    the plan.  Each round's prices, divided by the knapsack's value, are a solution of the dual program, so they bound
    what any packing needs.  Time and memory depend on ``capacity`` only.
    """
    full = histogram.get(capacity, 0)
    lengths = np.array(sorted(x for x, n in histogram.items() if 0 < x < capacity and n), np.int64)
    left = np.array([histogram[int(x)] for x in lengths], np.int64)
    solution: dict[tuple[int, ...], float] = {}
    open_, weight, total = left.astype(float), np.ones(len(lengths)), left.copy()
    bound = -(-int(lengths @ left) // capacity)
    for _ in range(rounds if len(lengths) else 0):
        alive = np.flatnonzero(open_ >= 0.5)
        if not len(alive):
            break
        some = lengths[alive]
        values = some / capacity * weight[alive]
        best, choice = _price(some, values, capacity)
        bound = max(bound, math.ceil(float(values @ total[alive]) / best[capacity] - 1e-6))
        picked = _configs_by_seed(some, choice, capacity)
        worth = np.where(picked >= 0, values[picked], 0).sum(1)
        picked = np.unique(picked[worth >= (1 - slack) * worth.max()], axis=0)
        rows, slots = np.nonzero(picked >= 0)
        item = picked[rows, slots]
        load = np.bincount(item, minlength=len(some)).astype(float)
        room = step * open_[alive] / np.maximum(load, 1)
        amount = np.full(len(picked), np.inf)
        np.minimum.at(amount, rows, room[item])
        open_[alive] -= np.bincount(item, weights=amount[rows], minlength=len(some))
        for config, x in zip(picked.tolist(), amount.tolist()):
            key = tuple(int(alive[i]) for i in config if i >= 0)
            solution[key] = solution.get(key, 0.0) + x
        behind = open_ / left
        weight *= np.exp(eta * (behind - np.average(behind, weights=lengths * left)))
    counts: dict[tuple[int, ...], int] = {}
    for key, x in solution.items():
        if n := int(x):
            counts[key] = n
            for i in key:
                left[i] -= n
    for key, x in sorted(solution.items(), key=lambda y: (int(y[1]) - y[1], y[0])):
        need = np.bincount(key, minlength=0)
        used = np.flatnonzero(need)
        if x % 1 >= 0.25 and (left[used] >= need[used]).all():
            counts[key] = counts.get(key, 0) + 1
            left[used] -= need[used]
    configs = [((capacity,), full)] if full else []
    configs += [(tuple(sorted((int(lengths[i]) for i in key), reverse=True)), n) for key, n in sorted(counts.items())]
    configs += best_fit_decreasing({int(x): int(n) for x, n in zip(lengths, left) if n}, capacity)
    found = Plan(configs, capacity, full + bound)
    if found.sequences > found.bound:
        plain = Plan(best_fit_decreasing({x: n for x, n in histogram.items() if n}, capacity), capacity, found.bound)
        found = min(found, plain, key=lambda plan: plan.sequences)
    return found


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over counts: equal sequences are kept as one group, so time doesn't grow with counts."""
    groups: dict[int, list[list]] = {}  # by room: [items, how many]
    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            room = next((r for r in range(length, capacity + 1) if groups.get(r)), None)
            if room is None:
                each = capacity // length
                if n := todo // each:
                    groups.setdefault(capacity - each * length, []).append([(length,) * each, n])
                if rest := todo % each:
                    groups.setdefault(capacity - rest * length, []).append([(length,) * rest, 1])
                break
            items, n = groups[room].pop()
            each = min(room // length, todo)
            use = min(n, todo // each)
            if use < n:
                groups[room].append([items, n - use])
            groups.setdefault(room - each * length, []).append([(*items, *(length,) * each), use])
            todo -= use * each
    return [(items, n) for _, found in sorted(groups.items()) for items, n in found]


# --- places ------------------------------------------------------------------------------------------------


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, ids_crc32, length and any others) with sequence_id and offset.

    ``pieces`` should be a written table: it is read twice, once for the histogram.  Pieces in one sequence
    follow each other without gaps.  Lengths above ``capacity`` or below 1 are refused.  An empty table gives
    an empty table.
    """
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if histogram and not (1 <= min(histogram) and max(histogram) <= capacity):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    places = pieces.sparkSession.sparkContext.broadcast(configuration_plan(histogram, capacity).places())
    shards = max(1, min(MAX_SHARDS, sum(histogram.values()) // SHARD_ROWS))
    sharded = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sharded.groupBy("length", "_shard").count().select("length", "_shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sharded.withColumn("_in_shard", F.row_number().over(within)).join(firsts, ["length", "_shard"])
    ranked = ranked.select(*pieces.columns, (F.col("_first") + F.col("_in_shard") - 1).alias("_rank"))
    at = pieces.columns.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bases, offsets, each = places.value
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, length << 48 | rank, "right") - 1
            nth = rank - (keys[i] & ((1 << 48) - 1))
            sequence, offset = bases[i] + nth // each[i], offsets[i] + nth % each[i] * length
            arrays = [batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return map_batches(ranked, place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Cut, tokenise and pack whole documents: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return pack(materialize(token_pieces(docs, tokenizer_path, capacity, keep_ids), "pieces"), capacity)
