"""Near duplicates by the Jaccard similarity of word shingles, exact: no pair that reaches the threshold is left out.

Two sets link if at least 0.8 of their union is common.  Under any one order of all shingles such sets share one among
their first few (the prefix: a fifth of a set), so sets meet at the shingles of their prefixes; rare shingles come first.
Those that meet, whose sizes and places in the prefix allow a link, are compared as whole sets.

What a component needs is that its sets are connected, not all its links.  So of the sets that meet at one shingle, by
size, neighbours are compared first.  Then pairs further apart, of sets that aren't in one component yet, in rounds of
ever wider distance, until no such pair is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, setting
from .components import component_labels
from .simhash import HASH_SEED, keyed_rows, rows_of

#: Words a shingle, and the similarity at which sets link: SHARED of OF.
WORDS, SHARED, OF = 5, 4, 5
#: Sets that one set is compared with at a shingle in the first round, and how many times as far the next round looks.
FIRST, WIDER = 4, 8
#: Documents from which common shingles are learnt, about; they order shingles and decide nothing else.
SAMPLE, COMMON, LEAST = 8192, 1 << 16, 4
#: Rows that a task looks at together (a run of one shingle is never cut), and texts whose sets it holds at once.
RUN_ROWS, TEXTS = 1 << 16, 250
#: Bits of a sketch at least; that of a larger set has one to two for each of its shingles.
SKETCH = 512
_NODE = ("fp", "fp2")
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_NO_SHINGLES = np.empty(0, np.uint64)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """materialize(); the shuffle files that made the table go with the end of its query."""
    with setting(df.sparkSession, _CLEANUP, "true"):
        return materialize(df, name)


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted, distinct XXH64 hashes of the word shingles; of all words if there are fewer, none of a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return _NO_SHINGLES
    shingles = map(b" ".join, zip(*(w[i:] for i in range(n)))) if len(w) >= n else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED)), np.uint64))


def _node(found: np.ndarray) -> tuple[int, int]:
    """What stands for a set: the XXH3 of its hashes; 0 for the empty one."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes(), HASH_SEED), np.int64).tolist()) if len(found) else (0, 0)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS))


def prefix_length(n: int) -> int:
    return n - -(-SHARED * n // OF) + 1 if n else 0


def _enough(n: np.ndarray, m: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether sets of n and m with so many in common link: common / (n + m - common) is SHARED / OF or more."""
    return (OF + SHARED) * common >= SHARED * (n + m)


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of a sample, sorted, and their ranks, rarest first."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("_key"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            found = [shingle_set(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_NO_SHINGLES, *found]).view(np.int64))], ["shingle"])

    counts = map_batches(some, run, "shingle long").groupBy("shingle").count().where(F.col("count") >= LEAST)
    top = [r[0] for r in counts.orderBy(F.desc("count"), "shingle").limit(COMMON).collect()]
    known, rank = np.array(top, np.int64).view(np.uint64), np.arange(len(top), 0, -1)
    order = np.argsort(known)
    return known[order], rank[order]


def _prefix(found: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, ranks = common
    at = np.searchsorted(known, found)
    rank = np.where(np.append(known, 0)[at] == found, np.append(ranks, 0)[at], 0) if len(known) else np.zeros(len(found), np.int64)
    return found[np.lexsort((found, rank))[: prefix_length(len(found))]]


def prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, _key, the set's node (fp, fp2) and size n, its sketch, and its prefix in order; of rows of keyed_rows()."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "_key", F.col("text").cast("string").alias("text"))
    common = _common(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("_key", pa.binary()), *((c, pa.int64()) for c in (*_NODE, "n")), ("sketch", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            nodes = np.array([_node(s) for s in sets], np.int64).reshape(-1, 2)
            starts = [_prefix(s, common).view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, starts)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([_NO_SHINGLES.view(np.int64), *starts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in nodes.T.copy()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_sketch(s) for s in sets], pa.binary()), lists], schema=schema)

    return map_batches(docs, run, "doc_id long, _key binary, fp long, fp2 long, n long, sketch binary, prefix array<long>")


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Sorted rows of longs as (rows, columns), about RUN_ROWS at a time; a run of equal first values is never cut."""
    parts: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        parts.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
        rows += batch.num_rows
        if rows >= RUN_ROWS:
            all_ = np.concatenate(parts)
            last = int(np.searchsorted(all_[:, 0], all_[-1, 0]))
            if last:
                yield all_[:last]
            parts, rows = [all_[last:]], 0
    if parts and sum(map(len, parts)):
        yield np.concatenate(parts)


def _able(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows (shingle, n, at, ...) can link if the shingle is the first that they share: as pairs are at one of those."""
    n, at = rows[:, 1], rows[:, 2]
    return _enough(n[i], n[j], np.minimum(n[i] - at[i], n[j] - at[j]))


def _near(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Places (i, j) of the pairs of one shingle that are at most FIRST apart."""
    for step in range(1, FIRST + 1):
        i = np.flatnonzero(rows[:-step, 0] == rows[step:, 0])
        yield np.stack([i, i + step], 1)


def _far(label: np.ndarray, over: int, to: int) -> Iterator[np.ndarray]:
    """Places (i, j), i < j, of the rows of one run that have different labels and are more than ``over`` and at most ``to`` apart."""
    most = np.bincount(label).argmax()
    few = label != most
    for i in np.flatnonzero(few).tolist():
        # A pair of two rows of lesser components is looked at from its first row.
        after = np.arange(i + over + 1, min(len(label), i + to + 1))
        before = np.arange(max(0, i - to), max(0, i - over))
        after, before = after[label[after] != label[i]], before[~few[before]]
        yield np.concatenate([np.stack([np.full(len(after), i), after], 1), np.stack([before, np.full(len(before), i)], 1)])


_MEETING = "shingle long, n long, at long, fp long, fp2 long"
_FOUND = "shingle long, n long, at long, a0 long, a1 long, b0 long, b1 long"


def _found(pairs: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Candidates (a0, a1, b0, b1), the smaller node first, without a shingle; and rows that the next round needs, without b."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    if len(pairs):
        pairs = np.unique(pairs, axis=0)
        none = pa.nulls(len(pairs), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, *(pa.array(c) for c in pairs.T.copy())], names)
    if len(more):
        none = pa.nulls(len(more), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in more[:, :5].T.copy()), none, none], names)


def _ends(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    places = places[_able(rows, places[:, 0], places[:, 1])]
    a, b = rows[places[:, 0], 3:5], rows[places[:, 1], 3:5]
    swap = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
    return np.concatenate([np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)], 1)


def _first_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole_runs(batches):
        pairs = np.concatenate([_ends(rows, some) for some in _near(rows)])
        starts = np.flatnonzero(np.diff(rows[:, 0], prepend=~rows[0, 0]))
        sizes = np.diff(starts, append=len(rows))
        yield from _found(pairs, rows[np.repeat(sizes > FIRST + 1, sizes)])


def _next_candidates(batches: Iterator[pa.RecordBatch], over: int, to: int) -> Iterator[pa.RecordBatch]:
    """Of rows with the labels of their components; a run stays while it has rows further apart, of different components."""
    none = np.empty((0, 4), np.int64)
    for rows in _whole_runs(batches):
        for run in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
            label = np.unique(run[:, 5:7], axis=0, return_inverse=True)[1].reshape(-1)
            if label.any():
                held, size = [], 0
                for places in _far(label, over, to):
                    held.append(_ends(run, places))
                    size += len(held[-1])
                    if size >= RUN_ROWS:
                        yield from _found(np.concatenate(held), run[:0])
                        held, size = [], 0
                yield from _found(np.concatenate(held or [none]), run if len(run) > to + 1 else run[:0])


def _sketch(found: np.ndarray) -> bytes:
    """Bits of which each is set if it is that of an odd number of shingles: two sets differ in as many shingles as bits, or more.

    Their number is a power of two and grows with the set, since half the bits of unlike sets differ at most.
    """
    bits = max(SKETCH, 1 << len(found).bit_length())
    return np.packbits(np.bincount((found >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).tobytes()


def _differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits sketches differ, pair by pair; the longer one is folded, which gives the set's sketch of the shorter length."""
    sizes, out = np.array([[len(x), len(y)] for x, y in zip(a, b)], np.int64).reshape(-1, 2), np.zeros(len(a), np.int64)
    for size in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == size).all(1))
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join(of[i] for i in at), np.uint64).reshape(len(at), -1, size.min() // 8), 1) for of in (a, b))
        out[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of candidates with their sizes and sketches (n, m, sketch_a, sketch_b, ...) those whose sketches allow a link."""
    for batch in _few(batches):
        n = batch.column(0).to_numpy() + batch.column(1).to_numpy()
        differ = _differing(*(c.to_pylist() for c in batch.columns[2:4]))
        yield batch.select(batch.schema.names[4:]).filter(pa.array((OF + SHARED) * differ <= (OF - SHARED) * n))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (a0, a1, b0, b1, text) that are sorted by a: first a's own text, without b, then those of its partners."""
    held, own = None, _NO_SHINGLES
    for batch in _few(batches):
        keep = []
        for k, (a0, a1, b0, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)))):
            got = shingle_set(text)
            if b0 is None:
                held, own = (a0, a1), got
            elif held != (a0, a1):
                raise ValueError("a candidate's text is missing")
            else:
                at = np.minimum(np.searchsorted(own, got), len(own) - 1)
                if _enough(len(own), len(got), np.count_nonzero(own[at] == got)):
                    keep.append(k)
        yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in batch.columns[:4]], ["a0", "a1", "b0", "b1"])


def _linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the candidates whose whole sets link; sketches leave out most others before texts are read again."""
    ends = pairs.select(F.col("a0").alias("fp"), F.col("a1").alias("fp2")).union(pairs.select("b0", "b1")).distinct()
    nodes = _stored(sets.join(ends, list(_NODE)).select(*_NODE, "n", "sketch", F.col("first_doc._key").alias("_key")), "nodes")
    both = pairs.join(nodes.toDF("a0", "a1", "n", "sketch_a", "key_a"), ["a0", "a1"]).join(nodes.toDF("b0", "b1", "m", "sketch_b", "key_b"), ["b0", "b1"])
    names = ["key_a", "key_b", "a0", "a1", "b0", "b1"]
    close = _stored(map_batches(both.select("n", "m", "sketch_a", "sketch_b", *names), _close, "key_a binary, key_b binary, a0 long, a1 long, b0 long, b1 long"), "close-pairs")
    none = F.lit(None).cast("long")
    of = close.select(F.col("key_b").alias("_key"), "a0", "a1", "b0", "b1").union(close.select("key_a", "a0", "a1", none, none).distinct())
    texts = docs.select("_key", F.col("text").cast("string").alias("text")).join(of.select("_key").distinct(), "_key", "left_semi").dropDuplicates(["_key"])
    rows = texts.join(of, "_key").select("a0", "a1", "b0", "b1", "text").repartition("a0", "a1").sortWithinPartitions("a0", "a1", F.col("b0").asc_nulls_first())
    links = map_batches(rows, _compared, "a0 long, a1 long, b0 long, b1 long")
    out = _stored(links.select(*[F.struct(F.col(e + "0").alias("fp"), F.col(e + "1").alias("fp2")).alias(e) for e in "ab"]), "links")
    discard(nodes, close)
    return out


def labels(docs: DataFrame, sets: DataFrame) -> DataFrame | None:
    """node and label, the smallest node reachable, of the sets (of keyed_rows()) that link with any; None if none does."""
    rows = sets.select(F.posexplode("prefix").alias("at", "shingle"), "n", *_NODE).select("shingle", "n", F.col("at").cast("long").alias("at"), *_NODE)
    order = ["shingle", "n", *_NODE]
    found = _stored(map_batches(rows.repartition("shingle").sortWithinPartitions(*order), _first_candidates, _FOUND), "candidates")
    edges: list[DataFrame] = []
    label, over = None, FIRST
    while True:
        pairs = _stored(found.where("shingle IS NULL").select("a0", "a1", "b0", "b1").distinct(), "pairs")
        if not pairs.isEmpty():
            edges.append(_linked(pairs, docs, sets))
            every = edges[0]
            for more in edges[1:]:
                every = every.union(more)
            label = component_labels(every)
        discard(pairs)
        left = found.where("shingle IS NOT NULL").select("shingle", "n", "at", F.col("a0").alias("fp"), F.col("a1").alias("fp2"))
        if left.isEmpty():
            discard(found)
            return label
        if label is not None:
            of = label.select(F.col("node.fp").alias("fp"), F.col("node.fp2").alias("fp2"), F.col("label.fp").alias("l0"), F.col("label.fp2").alias("l1"))
            left = left.join(of, list(_NODE), "left").withColumns({"l0": F.coalesce("l0", "fp"), "l1": F.coalesce("l1", "fp2")})
        else:
            left = left.withColumns({"l0": F.col("fp"), "l1": F.col("fp2")})
        left = left.select("shingle", "n", "at", *_NODE, "l0", "l1").repartition("shingle").sortWithinPartitions(*order)
        to = over * WIDER
        next_ = _stored(map_batches(left, lambda batches, over=over, to=to: _next_candidates(batches, over, to), _FOUND), "candidates")
        discard(found)
        found, over = next_, to


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one row, that of the smallest doc_id.

    Documents link whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; rows of null, reused
    or wordless ids and texts are dealt with as in simhash.distinct_documents().
    """
    keyed = keyed_rows(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("first_doc")
    sets = _stored(prefixes(keyed).groupBy(*_NODE).agg(first, *[F.any_value(c).alias(c) for c in ("n", "sketch", "prefix")]), "shingle-sets")
    of, node = labels(keyed, sets), F.struct(*_NODE)
    nodes = sets.select(node.alias("node"), "first_doc")
    if of is None:
        return rows_of(keyed, nodes.select("first_doc"), docs.columns)
    rooted = nodes.join(of.withColumnRenamed("node", "_node"), nodes["node"] == F.col("_node"), "left")
    kept = rooted.groupBy(F.coalesce("label", "node").alias("root")).agg(F.min("first_doc").alias("first_doc"))
    return rows_of(keyed, kept, docs.columns)
