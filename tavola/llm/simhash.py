"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two schemes serve.  EXACT: fingerprints of 64 bits link at 3 or fewer differing bits.  Such a pair leaves, for one of
three blocks, at most 2 of its differing bits outside it, so each distinct fingerprint emits, with each block
masked, itself and every variant of one flipped bit (half of 2) in the other bits: 131 rows, and no link is missed.
SIMILAR: fingerprints of 128 bits link at the distance that a shingle similarity of 0.8 gives on average, if they are
within 2 bits in one of four blocks of 32; each block emits itself and its variants of one flipped bit: 132 rows.

Fingerprints that link meet at a variant; those that meet are compared in full.  Distinct fingerprints only are
compared, and each meeting point gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .components import component_labels

HASH_SEED = 42
#: Rows that a task looks at together; a run of equal keys is never cut.
BUFFER_ROWS = 1 << 18
#: Fingerprints of one meeting point that are compared all with all at once.
DENSE_ROWS = 512
_BLOCKS = ((0, 22), (22, 43), (43, 64))


@dataclass(frozen=True)
class Scheme:
    """Words a shingle, differing bits at which fingerprints link, and whether they have 128 bits or 64."""

    words: int
    radius: int
    wide: bool

    def __post_init__(self) -> None:
        if not self.wide and not 0 <= self.radius <= 3:
            raise ValueError("three blocks serve a radius of at most 3")

    @property
    def names(self) -> tuple[str, ...]:
        return ("fp", "fp2") if self.wide else ("fp",)

    def node(self, of: str = "") -> Column:
        columns = [F.col(of + n).alias(n) for n in self.names]
        return F.struct(*columns) if self.wide else F.col(of + "fp")


#: Three words and 3 of 64 bits.
EXACT = Scheme(3, 3, False)
#: Five words; sets of shingles with a Jaccard similarity of 0.8 differ in 0.152 of the bits on average: 19 of 128.
SIMILAR = Scheme(5, 19, True)


def fingerprint(text: str | None, scheme: Scheme = EXACT) -> tuple[int, ...]:
    """Words of 64 bits; a bit is 1 if it is set in over half of the hashes of the text's word shingles, repeats included.

    64 bits come from XXH64, 128 from XXH3.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return (0,) * len(scheme.names)
    n = scheme.words
    shingles = map(b" ".join, zip(*(w[i:] for i in range(n)))) if len(w) >= n else [b" ".join(w)]
    count = max(1, len(w) - n + 1)
    if scheme.wide:
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, shingles, repeat(HASH_SEED))), np.uint8).reshape(count, 16)
    else:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED)), np.uint64, count).view(np.uint8).reshape(count, 8)
    set_ = np.zeros(8 * hashes.shape[1], np.int64)
    for at in range(0, count, 1 << 16):
        set_ += np.unpackbits(hashes[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return tuple(np.packbits(2 * set_ > count, bitorder="little").view("<u8").tolist())


def fingerprints(docs: DataFrame, scheme: Scheme = EXACT, key: str | None = None) -> DataFrame:
    """doc_id, the fingerprint as signed longs, and the binary column ``key`` if named; null and wordless texts have 0."""
    more = [key] if key else []
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in scheme.names), *((k, pa.binary()) for k in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, scheme) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, len(scheme.names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in fps.T.copy()), *batch.columns[2:]], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more), run, ", ".join(["doc_id long", *(f"{n} long" for n in scheme.names), *(f"{k} binary" for k in more)]))


def _variant_masks() -> list[tuple[int, int, int]]:
    """(and-mask, flip, mark) of each variant; the mark, in the masked block, tells the blocks apart."""
    out = []
    for k, (lo, hi) in enumerate(_BLOCKS):
        block = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        keep = (1 << 64) - 1 ^ block
        for flip in [0, *(1 << b for b in range(64) if not block >> b & 1)]:
            out.append((keep, flip, k << lo))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fps: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """key and the fingerprint: every variant of every fingerprint."""
    if scheme.wide:
        half = "4294967295L"
        blocks = [f"({k}L << 32) | ({n} & {half})" if not k % 2 else f"({k}L << 32) | shiftrightunsigned({n}, 32)" for k, n in enumerate(("fp", "fp", "fp2", "fp2"))]
        flips = ", ".join(["0L", *(f"{1 << b}L" for b in range(32))])
        rows = fps.select(*scheme.names, F.explode(F.expr(f"array({', '.join(blocks)})")).alias("_block"))
        return rows.select(F.explode(F.expr(f"transform(array({flips}), f -> _block ^ f)")).alias("key"), *scheme.names)
    parts = [f"array({_signed(keep)}L, {_signed(flip | mark)}L)" for keep, flip, mark in _variant_masks()]
    masks = f"array({', '.join(parts)})".replace("-9223372036854775808L", "cast(-9223372036854775808 as bigint)")
    return fps.select("fp", F.explode(F.expr(masks)).alias("_m")).selectExpr("(fp & _m[0]) ^ _m[1] AS key", "fp")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _spread(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the first of its component, by search from one to those not reached yet."""
    label, rest = np.arange(len(fps)), np.arange(len(fps))
    while len(rest):
        first, rest = rest[0], rest[1:]
        front = [first]
        while front and len(rest):
            near = _distance(fps[rest], fps[front.pop()]) <= radius
            label[rest[near]] = first
            front.extend(rest[near].tolist())
            rest = rest[~near]
    return label


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the edges of a spanning forest of the links within ``radius``, for rows (n, words of 64 bits).

    Where many meet, 64-bit fingerprints within 3 bits share one of four quarters, so only those that do are compared.
    Dense groups are reached in few steps, so time is quadratic only in what is far apart and shares a quarter.
    """
    n = len(fps)
    if n <= DENSE_ROWS:
        linked = _distance(fps[:, None], fps[None, :]) <= radius
        label = linked.argmax(1)
        while True:
            new = np.where(linked, label[None, :], n).min(1)
            if (new == label).all():
                break
            label = new
    elif fps.shape[1] == 1 and radius <= 3:
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for quarter in range(4):
            part = fps[:, 0] >> np.uint64(16 * quarter) & np.uint64(0xFFFF)
            order = np.argsort(part, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                label = _spread(fps[some], radius)
                moved = np.flatnonzero(label != np.arange(len(some)))
                ends.append((some[moved], some[label[moved]]))
        return np.concatenate([x for x, _ in ends]), np.concatenate([y for _, y in ends])
    else:
        label = _spread(fps, radius)
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the runs of equal keys in sorted rows (key, the fingerprint's words); a run may span batches."""

    def run(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.diff(key, prepend=key[0] ^ 1)) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(starts, append=len(key))
        two = starts[sizes == 2]
        two = two[_distance(fp[two], fp[two + 1]) <= radius]
        a, b = [two], [two + 1]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            x, y = _forest(fp[s : s + n], radius)
            a.append(s + x)
            b.append(s + y)
        if sum(map(len, a)):
            ends = np.concatenate([fp[np.concatenate(a)], fp[np.concatenate(b)]], axis=1).view(np.int64)
            pairs = np.unique(ends, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs.T.copy()], [e + str(i) for e in "ab" for i in range(fp.shape[1])])

    held: tuple[np.ndarray, np.ndarray] | None = None
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def gathered() -> tuple[np.ndarray, np.ndarray]:
        some = ([held] if held else []) + parts
        return np.concatenate([p[0] for p in some]), np.concatenate([p[1] for p in some])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        parts.append((columns[0], np.stack([c.view(np.uint64) for c in columns[1:]], 1)))
        rows += batch.num_rows
        if rows < BUFFER_ROWS:
            continue
        key, fp = gathered()
        parts, rows = [], 0
        last = int(np.searchsorted(key, key[-1]))  # the last run may go on
        yield from run(key[:last], fp[:last])
        held = key[last:], fp[last:]
    if held or parts:
        yield from run(*gathered())


def links(fps: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """a, b: a spanning forest of the links at each meeting point of distinct fingerprints; nodes as Scheme.node() makes them."""
    meeting = variants(fps.select(*scheme.names), scheme).repartition("key").sortWithinPartitions("key", *scheme.names)
    ends = [e + str(i) for e in "ab" for i in range(len(scheme.names))]
    radius = scheme.radius
    found = map_batches(meeting, lambda batches: _links(batches, radius), ", ".join(f"{e} long" for e in ends))
    if not scheme.wide:
        return found.toDF("a", "b")
    return found.select(*[F.struct(F.col(e + "0").alias("fp"), F.col(e + "1").alias("fp2")).alias(e) for e in "ab"])


def _labelled(first: DataFrame, scheme: Scheme) -> DataFrame:
    """node, first_doc and root, the smallest fingerprint reachable, of distinct fingerprints with what is first among their rows."""
    first = materialize(first, "distinct-fingerprints")
    labels = component_labels(links(first, scheme)).withColumnRenamed("node", "_node")
    nodes = first.select(scheme.node().alias("node"), "first_doc")
    labelled = nodes.join(labels, nodes["node"] == labels["_node"], "left").select("node", "first_doc", F.coalesce("label", "node").alias("root"))
    return materialize(labelled, "labelled")


def near_duplicates(docs: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """doc_id, the fingerprint (fp[, fp2]) and component_id, the smallest doc_id reachable over links of the scheme.

    Rows with equal fingerprints link, and so do all texts without words (fingerprint 0).  Repeated rows
    stay, each with the component of its fingerprint; a null doc_id counts only where a component has no
    other.  Whole texts count, however long.  Only doc_id and text are read.  No rows give no rows.
    """
    rows = materialize(fingerprints(docs, scheme), "fingerprints")
    labelled = _labelled(rows.groupBy(*scheme.names).agg(F.min("doc_id").alias("first_doc")), scheme)
    roots = labelled.groupBy(F.col("root").alias("_root")).agg(F.min("first_doc").alias("component_id"))
    of = materialize(labelled.join(roots, labelled["root"] == roots["_root"]).select(F.col("node").alias("_node"), "component_id"), "components")
    return rows.join(of, scheme.node() == of["_node"]).select("doc_id", *scheme.names, "component_id")


def distinct_documents(docs: DataFrame, scheme: Scheme = SIMILAR) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one row, that of the smallest doc_id.

    A null doc_id comes after all others; among different texts of one doc_id in a component the smallest
    hash decides.  Rows are told apart by doc_id and text, so null or reused ids lose no component.  Whole
    texts count, however long; texts without words are one component.  No rows give no rows.
    """
    keyed = keyed_rows(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("first_doc")
    labelled = _labelled(fingerprints(keyed, scheme, "_key").groupBy(*scheme.names).agg(first), scheme)
    return rows_of(keyed, labelled.groupBy("root").agg(F.min("first_doc").alias("first_doc")), docs.columns)


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with _key, which tells rows apart by doc_id and text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.when(text.isNull(), "-").otherwise("+"), F.coalesce(text, F.lit("")))
    return docs.withColumn("_key", F.unhex(F.sha2(key.cast("binary"), 256)))


def rows_of(keyed: DataFrame, kept: DataFrame, columns: list[str]) -> DataFrame:
    """Of the rows of keyed_rows() one of each key in ``kept``'s first_doc."""
    return keyed.dropDuplicates(["_key"]).join(kept.select(F.col("first_doc._key").alias("_key")), "_key", "left_semi").select(*columns)


def fingerprint_hex(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
