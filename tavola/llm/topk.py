"""Exact top-k inner-product search with norm buckets and local cosine thresholds.

Vectors are grouped by length (Euclidean norm) into bands and, within a band, by the nearest of a few pivot directions:
a bucket has a range of norms and a range of angles to its pivot, so the best product that a query can have there is
known before anything is sent.  A query goes first to its most promising bucket, whose products give its bound, then
to those buckets only that can reach it.  In a bucket, the bound over |q| and the bucket's norm is the local
cosine threshold: below COORDINATE_COSINE vectors are cut by length, from it on by their feasible range in the query's
strongest coordinate.  What is left is verified by exact integer products.

Buckets are dealt in chunks and their queries in blocks, both of bounded rows, so no group grows with the data.
Equal query vectors are searched once, and zero queries, whose answer needs no product, not at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize

K, EVERY = 20, 20
SCALE = 64.0
#: Rows of a bucket, about; and the most norm bands and buckets, which bound the driver's table of buckets.
BUCKET_ROWS, MAX_BANDS, MAX_BUCKETS = 4096, 16, 4096
#: Rows from which bands and pivots come, drawn by hash; every row is indexed.
SAMPLE_ROWS = 2048
#: Bytes of vectors, and rows, that one group holds of a bucket and of its queries, about.
GROUP_BYTES, MAX_GROUP_ROWS = 16 << 20, 1 << 16
COORDINATE_COSINE = 0.5
#: Query rows that are compared with a chunk at once.
QUERY_BLOCK = 256
_LONG = 2**63
#: Allowance for rounding in bounds.
_SLACK = 1e-9


def _floored(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, saturated at their bounds."""
    x = np.floor(scale * values.astype(np.float64))
    out = np.clip(x, -float(_LONG), float(_LONG - 1024)).astype(np.int64)
    out[x >= float(_LONG)] = _LONG - 1
    return out


def packed_vectors(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, row, v, size, norm: floor(scale * x) of each component as little-endian integers of ``size`` bytes.

    ``size`` is the least of 2, 4 and 8 that holds a vector's components; ``row`` tells repeated rows apart once written.
    Vectors that are null or hold null or non-finite components, or whose vec_id is null, go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            null = flat.is_null().to_numpy(zero_copy_only=False)
            x = flat.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            bad = np.concatenate([[0], np.cumsum(null | ~np.isfinite(x))])
            with np.errstate(over="ignore"):
                whole = _floored(np.where(np.isfinite(x), x, 0.0), scale)
            ids, rows, vs, sizes, norms = [], [], [], [], []
            for i, (vec_id, row) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                a, b = int(ends[i] - lengths[i]), int(ends[i])
                if bad[b] > bad[a]:
                    continue
                v = whole[a:b]
                size = 2 if not len(v) or -(2**15) <= v.min() and v.max() < 2**15 else 4 if -(2**31) <= v.min() and v.max() < 2**31 else 8
                ids.append(vec_id)
                rows.append(row)
                vs.append(v.astype(f"<i{size}").tobytes())
                sizes.append(size)
                norms.append(math.sqrt(float(np.square(v.astype(np.float64)).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(vs, pa.binary()), pa.array(sizes, pa.int32()), pa.array(norms, pa.float64())], ["vec_id", "row", "v", "size", "norm"])

    usable = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
    rows = usable.select(F.col("vec_id").cast("long"), F.monotonically_increasing_id(), F.col("embedding").cast("array<double>"))
    return map_batches(rows, run, "vec_id long, row long, v binary, size int, norm double")


def _matrix(vs: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows padded with zeros: a missing component adds nothing to a product."""
    out = np.zeros((len(vs), width), np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        some = [vs[i] for i in at.tolist()]
        lengths = {len(v) for v in some}
        if len(lengths) == 1:
            n = lengths.pop() // size
            out[at, :n] = np.frombuffer(b"".join(some), f"<i{size}").reshape(len(some), n)
        else:
            for i, v in zip(at.tolist(), some):
                out[i, : len(v) // size] = np.frombuffer(v, f"<i{size}")
    return out


def _rows(table: pa.Table | pa.RecordBatch, width: int) -> np.ndarray:
    return _matrix(table.column("v").to_pylist(), table.column("size").to_numpy(), width)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats where no sum can leave their integers, else in wide integers, saturated at 64 bits."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(p.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < 2**24:
        return (q.astype(np.float32) @ p.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q @ p.T
    exact = q.astype(object) @ p.astype(object).T
    return np.clip(exact, -_LONG, _LONG - 1).astype(np.int64)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int, distinct: bool) -> np.ndarray:
    """Places of the highest scores, ties to the smaller id: at most ``k`` of an id, and of the ``k + 1`` first ids.

    So whichever one id is taken away, the k best of the rest are there.  ``distinct``: no id repeats.
    """
    if distinct:
        if len(scores) > k + 1:
            bound = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            some = np.flatnonzero(scores >= bound)
            return some[np.lexsort((ids[some], ~scores[some]))[: k + 1]]
        return np.lexsort((ids, ~scores))
    seen: dict[int, int] = {}
    out = []
    for i in np.lexsort((ids, ~scores)).tolist():
        x = int(ids[i])
        if x not in seen and len(seen) == k + 1:
            break
        seen[x] = seen.get(x, 0) + 1
        if seen[x] <= k:
            out.append(i)
    return np.array(out, np.int64)


def search_chunk(ids: np.ndarray, p: np.ndarray, norms: np.ndarray, q: np.ndarray, qnorm: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate's id, score) of best_rows() for each query; candidates are sorted by norm, longest first."""
    distinct = len(np.unique(ids)) == len(ids)
    found: list[tuple[int, np.ndarray, np.ndarray]] = []

    def keep(query: int, at: np.ndarray, scores: np.ndarray) -> None:
        ok = np.flatnonzero(scores >= bound[query])
        best = ok[best_rows(scores[ok], ids[at[ok]], k, distinct)]
        found.append((query, ids[at[best]], scores[best]))

    for start in range(0, len(q), QUERY_BLOCK):
        part = np.arange(start, min(len(q), start + QUERY_BLOCK))
        least = bound[part] / qnorm[part]  # norms below it can't reach the bound
        reach = np.searchsorted(-norms, -(least - _SLACK * np.abs(least)), "right")
        # A chunk of norm 0 has no angle: it goes by length.
        cosine = least / max(norms[0], 1e-300) if norms[0] > 0 else np.full(len(part), -np.inf)
        by_length = np.flatnonzero(~(cosine >= COORDINATE_COSINE) & (reach > 0))
        if len(by_length):  # one block of products up to the longest prefix
            most = int(reach[by_length].max())
            for i, row in zip(by_length.tolist(), products(q[part[by_length]], p[:most])):
                keep(int(part[i]), np.arange(reach[i]), row[: reach[i]])
        for i in np.flatnonzero((cosine >= COORDINATE_COSINE) & (reach > 0)).tolist():
            # The feasible range in the strongest coordinate f: with c the least cosine that a vector of
            # norm n needs, p_f / n lies within c*q_f/|q| -+ sqrt((1-c^2)(1-(q_f/|q|)^2)) or nearer to q.
            at, m = int(part[i]), int(reach[i])
            f = int(np.abs(q[at]).argmax())
            qf = q[at, f] / qnorm[at]
            n = np.maximum(norms[:m], 1e-300)
            c = np.minimum(1.0, least[i] / n)
            pf = p[:m, f] / n
            spread = np.sqrt(np.maximum(0, (1 - c * c) * (1 - qf * qf)))
            low, high = np.where(qf < -c, -1, c * qf - spread), np.where(qf > c, 1, c * qf + spread)
            maybe = np.flatnonzero((pf >= low - 1e-7) & (pf <= high + 1e-7))
            if len(maybe):
                keep(at, maybe, products(q[at : at + 1], p[maybe])[0])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.repeat([x for x, _, _ in found], [len(y) for _, y, _ in found]), np.concatenate([y for _, y, _ in found]), np.concatenate([z for _, _, z in found])


# --- buckets ---------------------------------------------------------------------------------------------------


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.square(x).sum(1, keepdims=True))
    return x / np.where(norms > 0, norms, 1)


def pivots_of(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """``n`` directions at most, by spherical k-means from the first distinct rows of the sample."""
    u = _unit(np.unique(sample, axis=0).astype(np.float64))
    u = u[np.square(u).sum(1) > 0]
    if not len(u):
        return np.zeros((1, sample.shape[1]))
    at = u[np.random.default_rng(0).permutation(len(u))[:n]]
    for _ in range(rounds):
        near = (u @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, u)
        empty = np.square(sums).sum(1) < 1e-18
        at = np.where(empty[:, None], at, _unit(sums))
    return at


def _cosines(x: np.ndarray, norm: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.clip(x.astype(np.float64) @ pivots.T / np.maximum(norm, 1e-300)[:, None], -1, 1)


class Buckets:
    """What is known of each bucket: norms, angles to its pivot, chunks.  At most MAX_BUCKETS + MAX_BANDS rows."""

    def __init__(self, rows: list, pivots: np.ndarray, chunk_rows: int):
        self.pivots = pivots
        self.number = np.array([r["bucket"] for r in rows], np.int64)
        self.pivot = self.number % (len(pivots) + 1)  # the last stands for zero vectors
        self.low, self.high = np.array([r["low"] for r in rows], float), np.array([r["high"] for r in rows], float)
        self.near, self.far = np.array([r["near"] for r in rows], float), np.array([r["far"] for r in rows], float)
        self.chunks = np.array([-(-r["n"] // chunk_rows) for r in rows], np.int64)

    def best(self, q: np.ndarray, qnorm: np.ndarray) -> np.ndarray:
        """An upper bound of the products of each query (not zero) with each bucket."""
        angles = np.arccos(_cosines(q, qnorm, np.vstack([self.pivots, np.zeros((1, self.pivots.shape[1]))])))[:, self.pivot]
        gap = np.maximum(0, np.maximum(angles - self.far, self.near - angles) - 1e-7)
        cosine = np.cos(np.minimum(gap, np.pi))
        best = qnorm[:, None] * cosine * np.where(cosine > 0, self.high, self.low)
        return np.where(self.pivot == len(self.pivots), 0.0, best)


def _placed(whole: DataFrame, pivots: np.ndarray, edges: np.ndarray, width: int) -> DataFrame:
    """``whole`` with bucket (its norm band and nearest pivot) and angle to the pivot."""
    shared = whole.sparkSession.sparkContext.broadcast((pivots, edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, edges = shared.value
        for batch in batches:
            norm = batch.column("norm").to_numpy()
            cosine = _cosines(_rows(batch, width), norm, pivots)
            near = cosine.argmax(1)
            angle = np.arccos(cosine[np.arange(len(near)), near])
            pivot = np.where(norm > 0, near, len(pivots))
            bucket = np.searchsorted(edges, norm, "right") * (len(pivots) + 1) + pivot
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int64()), pa.array(angle)], [*batch.schema.names, "bucket", "angle"])

    return map_batches(whole, run, "vec_id long, row long, v binary, size int, norm double, bucket long, angle double")


_QUERY = "k1 long, k2 long, v binary, size int, norm double, bound double, bucket long, chunk int"
_FOUND = "k1 long, k2 long, vec_id long, score long"


def _merged(found: DataFrame, k: int) -> DataFrame:
    """What best_rows() keeps of each query's rows over all chunks, with ``place``, the id's place among its ids (from 1)."""
    same, all_ = Window.partitionBy("k1", "k2", "vec_id"), Window.partitionBy("k1", "k2")
    rows = found.repartition("k1", "k2").withColumns({"_nth": F.row_number().over(same.orderBy(F.desc("score"))), "_best": F.max("score").over(same)})
    rows = rows.where(F.col("_nth") <= k).withColumn("place", F.dense_rank().over(all_.orderBy(F.desc("_best"), "vec_id")))
    return rows.where(F.col("place") <= k + 1).select("k1", "k2", "vec_id", "score", "place", F.col("_best").alias("best"))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE, bucket_rows: int = BUCKET_ROWS, group_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows with another vec_id.
    Vectors null or with null or non-finite components, or with a null vec_id, take no part; of a shorter vector
    missing components count as 0.  Components beyond 64 bits saturate there, as do scores.  Repeated rows are
    candidates of their own; different vectors of one query_id are queries of their own, and give rows each.  With no rows, no rows.
    """
    spark = vectors.sparkSession
    whole = materialize(packed_vectors(vectors, scale), "vectors")
    stats = whole.agg(F.max(F.floor(F.octet_length("v") / F.col("size"))).alias("width"), F.count("*").alias("n"), F.max("size").alias("size")).first()
    width, n = max(1, int(stats["width"] or 0)), int(stats["n"])
    chunk_rows = group_rows or max(256, min(MAX_GROUP_ROWS, GROUP_BYTES // (width * int(stats["size"] or 2))))
    sample = whole.select("v", "size", "norm").orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).collect()
    cells = max(1, min(MAX_BUCKETS, n // bucket_rows))
    bands = min(MAX_BANDS, max(1, round(cells ** (1 / 3))))
    norms = np.sort(np.array([r["norm"] for r in sample]))
    edges = np.unique(norms[[len(norms) * i // bands for i in range(1, bands)]]) if len(norms) else norms
    pivots = pivots_of(_matrix([bytes(r["v"]) for r in sample], np.array([r["size"] for r in sample], int), width), -(-cells // bands))
    placed = materialize(_placed(whole, pivots, edges, width), "placed")
    known = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.min("angle").alias("near"), F.max("angle").alias("far")).collect()
    buckets = Buckets(known, pivots, chunk_rows)
    shared = spark.sparkContext.broadcast(buckets)
    chunks = spark.createDataFrame([(int(b), int(c)) for b, c in zip(buckets.number, buckets.chunks)], "_bucket long, _chunks long")
    dealt = placed.join(F.broadcast(chunks), F.col("bucket") == F.col("_bucket")).withColumn("chunk", F.pmod(F.xxhash64("row"), "_chunks").cast("int"))
    dealt = dealt.select("vec_id", "v", "size", "norm", "bucket", "chunk")

    asked = placed.where(F.col("vec_id") % every == 0).select("vec_id", "v", "size", "norm", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("query"), "v").alias("k2"))
    ids = asked.where("norm > 0").select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct()
    queries = materialize(asked.where("norm > 0").groupBy("k1", "k2").agg(F.first("v").alias("v"), F.first("size").alias("size"), F.first("norm").alias("norm")), "queries")

    def routed(rows: DataFrame, first: bool) -> DataFrame:
        """A row for each chunk that a query goes to: of its most promising bucket, or of the others that can reach its bound."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in batches:
                qnorm, bound = batch.column("norm").to_numpy(), batch.column("bound").to_numpy()
                best = b.best(_rows(batch, width), qnorm)
                top = best.argmax(1)
                if first:
                    go = np.zeros(best.shape, bool)
                else:
                    go = best + _SLACK * np.abs(best) + 1e-6 >= bound[:, None] - _SLACK * np.abs(bound[:, None])
                go[np.arange(len(top)), top] = first
                for start in range(0, len(top), 64):
                    query, place = np.nonzero(go[start : start + 64])
                    if not len(query):
                        continue
                    times = b.chunks[place]
                    part = batch.take(pa.array(np.repeat(query + start, times)))
                    chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.repeat(b.number[place], times)), pa.array(chunk.astype(np.int32))], ["k1", "k2", "v", "size", "norm", "bound", "bucket", "chunk"])

        return map_batches(rows, run, _QUERY)

    def searched(sent: DataFrame, name: str) -> DataFrame:
        """Rows of best_rows() of each sent query and chunk; queries of a chunk in blocks, for each of which the chunk is read."""
        sent = materialize(sent, f"sent-{name}")
        counts = sent.groupBy("bucket", "chunk").count()
        blocks = counts.select(F.col("bucket").alias("_bucket"), F.col("chunk").alias("_chunk"), F.ceil(F.col("count") / chunk_rows).cast("int").alias("_blocks"))
        on = lambda df: (df["bucket"] == blocks["_bucket"]) & (df["chunk"] == blocks["_chunk"])
        left = dealt.join(blocks, on(dealt)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(*dealt.columns, "block")
        right = sent.join(blocks, on(sent)).withColumn("block", F.pmod(F.col("k2"), "_blocks").cast("int")).select(*sent.columns, "block")
        key = ["bucket", "chunk", "block"]

        def search(cand: pa.Table, some: pa.Table) -> pa.Table:
            schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
            if not cand.num_rows or not some.num_rows:
                return schema.empty_table()
            norm = cand.column("norm").to_numpy()
            order = np.lexsort((cand.column("vec_id").to_numpy(), -norm))
            at, found, scores = search_chunk(cand.column("vec_id").to_numpy()[order], _rows(cand, width)[order], norm[order], _rows(some, width), some.column("norm").to_numpy(), some.column("bound").to_numpy(), k)
            return pa.table([pa.array(some.column("k1").to_numpy()[at]), pa.array(some.column("k2").to_numpy()[at]), pa.array(found), pa.array(scores)], schema=schema)

        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, _FOUND)

    unbound = queries.select("k1", "k2", "v", "size", "norm", F.lit(float("-inf")).alias("bound"))
    first = materialize(_merged(searched(routed(unbound, True), "first"), k), "first")
    # With k + 1 ids found, k rows stay whichever id is the query's own.
    low = first.groupBy("k1", "k2").agg(F.when(F.max("place") > k, F.min("best").cast("double") - F.abs(F.min("best").cast("double")) * 1e-12).alias("_low"))
    bound = queries.join(low, ["k1", "k2"], "left").select("k1", "k2", "v", "size", "norm", F.coalesce("_low", F.lit(float("-inf"))).alias("bound"))
    rest = searched(routed(bound, False), "rest")
    merged = _merged(first.select("k1", "k2", "vec_id", "score").unionByName(rest), k)
    answers = ids.join(merged, ["k1", "k2"]).select("query_id", "k1", "k2", "vec_id", "score")
    zero = asked.where("norm = 0").select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct()
    if not zero.isEmpty():
        # Every product with a zero query is 0, so the smallest ids answer; k + 1 of them serve each query.
        smallest = placed.groupBy("vec_id").count().orderBy("vec_id").limit(k + 1).collect()
        each = [F.lit(int(r["vec_id"])).cast("long") for r in smallest for _ in range(min(k, r["count"]))]  # k * (k + 1) at most
        answers = answers.unionByName(zero.select("query_id", "k1", "k2", F.explode(F.array(*each)).alias("vec_id"), F.lit(0).cast("long").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id", "k1", "k2").orderBy(F.desc("score"), "vec_id"))
    ranked = answers.where(F.col("vec_id") != F.col("query_id")).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
