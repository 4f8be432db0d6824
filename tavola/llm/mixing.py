"""Mixing sources to target weights by subset-sum budget fitting over exact document sizes."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unit_hash

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
SEED = 20
#: Words that the dynamic programme fits exactly; what exceeds it is spread over the lengths first.
DP_WORDS = 1 << 16
#: Where that misses: bits of a knapsack of the whole budget, lots whose subsets meet from two halves, lots of
#: the longest documents that are tried in and out, and how many choices are tried.
EXACT_BITS, MEET_LOTS, HEAD_LOTS, TRIES = 1 << 31, 40, 16, 16
#: Sources are a mixture's configuration; more than this is refused rather than gathered.
MAX_SOURCES = 100_000
SHARD_ROWS, MAX_SHARDS = 1024, 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float = MOST) -> list[float]:
    """Share ``budget`` by weight; no target exceeds ``most`` times its size, the excess is shared again by weight."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _lots(counts: dict[int, int], limit: int) -> list[tuple[int, int]]:
    """(size, how many) from the largest size down: powers of two and a remainder that make up any count."""
    out = []
    for s in sorted(counts, reverse=True):
        free, lot = min(counts[s], limit // s), 1
        while free > 0:
            lot = min(lot, free)
            out.append((s, lot))
            free -= lot
            lot *= 2
    return out


def _knapsack(counts: dict[int, int], limit: int) -> dict[int, int]:
    """Counts whose sizes add up to ``limit`` or as near below as can be; memory grows with lots x ``limit`` bits."""
    # Bit w of `reach` says whether w words can be made.
    mask, reach, history = (1 << (limit + 1)) - 1, 1, []
    for s, lot in _lots(counts, limit):
        if reach >> limit & 1:
            break
        history.append((s, lot, reach))
        reach |= reach << (s * lot) & mask
    out: dict[int, int] = {}
    at = reach.bit_length() - 1
    for s, lot, before in reversed(history):
        if not before >> at & 1:
            out[s] = out.get(s, 0) + lot
            at -= s * lot
    return out


def _sums(lots: list[tuple[int, int]]) -> np.ndarray:
    """Words of every subset; bit i of its place stands for lot i."""
    out = np.zeros(1, np.int64)
    for s, lot in lots:
        out = np.concatenate([out, out + s * lot])
    return out


def _two_halves(lots: list[tuple[int, int]], limit: int) -> dict[int, int]:
    """As _knapsack() over at most MEET_LOTS lots, whatever their words: the subsets of two halves meet."""
    half = len(lots) // 2
    a, b = _sums(lots[:half]), _sums(lots[half:])
    order = np.argsort(b, kind="stable")
    fit = np.searchsorted(b[order], limit - a, "right") - 1
    total = np.where(fit >= 0, a + b[order[np.maximum(fit, 0)]], -1)
    best = int(total.argmax())
    places = best | int(order[fit[best]]) << half
    out: dict[int, int] = {}
    for i, (s, lot) in enumerate(lots):
        if places >> i & 1:
            out[s] = out.get(s, 0) + lot
    return out


def _words(take: dict[int, int]) -> int:
    return sum(s * n for s, n in take.items())


def _fit_in_proportion(counts: dict[int, int], budget: int, dp_words: int) -> dict[int, int]:
    """Sizes in proportion, then one more of each from the largest down while it fits, then a knapsack of the rest."""
    total = _words(counts)
    if budget >= total:
        return dict(counts)
    take = {s: n * budget // total for s, n in counts.items()}
    rest = budget - _words(take)
    order = sorted(counts, reverse=True)
    while rest > dp_words:
        before = rest
        for s in order:
            if rest <= dp_words:
                break
            if take[s] < counts[s] and s <= rest:
                take[s] += 1
                rest -= s
        if rest == before:
            break
    for s, n in _knapsack({s: counts[s] - take[s] for s in order}, min(rest, dp_words)).items():
        take[s] += n
    return take


def fit_budget(counts: dict[int, int], budget: int, dp_words: int = DP_WORDS) -> dict[int, int]:
    """How many documents of each size to take, so that their sizes add up to ``budget`` or as near below as can be.

    Sizes are first taken in proportion, see _fit_in_proportion().  Where that misses the budget by more than
    the sizes' common divisor explains and its rest was above ``dp_words``, all documents are chosen anew: by
    a knapsack of the whole budget within EXACT_BITS, or for at most MEET_LOTS lots from two halves, both
    exact.  Beyond both, the longest documents are tried in and out before the rest is shared, and some are
    exchanged, until the budget is met; only there a fit that misses it isn't proved the nearest.
    """
    total = _words(counts)
    if budget >= total:
        return dict(counts)
    best = _fit_in_proportion(counts, budget, dp_words)
    g = math.gcd(*counts)
    aim = budget - budget % g
    start = sum(s * (n * budget // total) for s, n in counts.items())
    if _words(best) == aim or budget - start <= dp_words:
        return best
    lots = _lots(counts, budget)
    if len(lots) <= MEET_LOTS:
        found = _two_halves(lots, budget)
    elif len(lots) * (budget // g) <= EXACT_BITS:
        found = {s * g: n for s, n in _knapsack({s // g: n for s, n in counts.items()}, budget // g).items()}
    else:
        return _exchange(counts, budget, aim, _with_longest(counts, budget, aim, best, dp_words))
    return {s: found.get(s, 0) for s in counts}


def _with_longest(counts: dict[int, int], budget: int, aim: int, best: dict[int, int], dp_words: int) -> dict[int, int]:
    """The best of ``best`` and of some choices of the longest documents with the others in proportion."""
    heads: list[tuple[int, int]] = []
    for s in sorted(counts, reverse=True):
        lots = _lots({s: counts[s]}, budget)
        if s <= dp_words or len(heads) + len(lots) > HEAD_LOTS:
            break
        heads += lots
    tail = {s: n for s, n in counts.items() if not heads or s < heads[-1][0]}
    if not heads or not tail:
        return best
    sums = _sums(heads)
    able = np.flatnonzero((sums <= budget) & (sums >= budget - _words(tail)))
    if not len(able):
        able = np.array([np.where(sums <= budget, sums, -1).argmax()])
    share = budget / _words(counts) * int(sums[-1])
    for place in able[np.argsort(np.abs(sums[able] - share), kind="stable")][:TRIES].tolist():
        take = {**dict.fromkeys(counts, 0), **_fit_in_proportion(tail, budget - int(sums[place]), dp_words)}
        for i, (s, lot) in enumerate(heads):
            take[s] += lot * (place >> i & 1)
        best = max(best, take, key=_words)
        if _words(best) == aim:
            break
    return best


def _exchange(counts: dict[int, int], budget: int, aim: int, take: dict[int, int]) -> dict[int, int]:
    """Lots of some sizes are taken out and the nearest of all their subsets goes in, some times over."""
    for seed in range(TRIES):
        if _words(take) == aim:
            break
        rng = random.Random(seed)
        held, free = _lots(take, budget), _lots({s: n - take[s] for s, n in counts.items()}, budget)
        inside = rng.sample(held, min(len(held), MEET_LOTS // 2))
        outside = rng.sample(free, min(len(free), MEET_LOTS - len(inside)))
        base = dict(take)
        for s, lot in inside:
            base[s] -= lot
        for s, n in _two_halves(inside + outside, budget - _words(base)).items():
            base[s] += n
        take = max(take, base, key=_words)
    return take


def fit_nearest(counts: dict[int, int], budget: int) -> dict[int, int]:
    """As fit_budget(), but above the budget where that is nearer: what is left out then fits the rest of all words."""
    below = fit_budget(counts, budget)
    if _words(below) >= min(budget, _words(counts)):
        return below
    left_out = fit_budget(counts, _words(counts) - budget)
    above = {s: n - left_out.get(s, 0) for s, n in counts.items()}
    return above if _words(above) - budget < budget - _words(below) else below


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, payload: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, taken and the ``payload`` columns of ``docs``.

    A document's size is its count of words (a null text: 0).  Sources in code-point order, null last, get
    ``weights`` in turn and share ``share`` of all words; see targets().  A source gives all its documents as
    often as its target holds them whole, and once more as many as fit_budget() says of each size, which
    are those with the smallest seeded hash of their doc_id.  ``taken`` is a whole multiple of ``size``.
    Ranks are taken within shards of a source and size, so no task holds all documents of one size.
    Documents of no words take part with 0.  Whole texts count, however long.  Repeated rows are documents of their own.  Payload columns
    with the name of a result column are left out.  No rows give no rows.
    """
    spark = docs.sparkSession
    payload = [c for c in payload if c not in ("doc_id", "source", "size", "source_size", "target", "taken")]
    base = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), *payload)
    narrow = materialize(base.select("doc_id", "source", "size"), "sizes")
    found = narrow.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.words) for r in found]
    each = [float(weights[i % len(weights)]) for i in range(len(found))]
    aims = targets(sizes, each, share * sum(sizes), most)
    rows = []
    for i, (r, size, aim) in enumerate(zip(found, sizes, aims)):
        whole = int(aim // size) if size else 0
        rows.append((i, r.source, size, aim, whole, round(aim - whole * size)))
    sources = F.broadcast(spark.createDataFrame(rows, "_source int, _name string, source_size long, target double, _whole long, _rest long"))  # MAX_SOURCES rows at most
    shards = max(1, min(MAX_SHARDS, sum(int(r.n) for r in found) // SHARD_ROWS))
    order = unit_hash(F.lit(seed), F.col("doc_id"))

    def keyed(df: DataFrame) -> DataFrame:
        df = df.join(sources, F.col("source").eqNullSafe(F.col("_name"))).drop("_name").withColumn("_order", order)
        return df.withColumn("_shard", F.expr(f"cast(shiftright(shiftright(_order, 40) * {shards}L, 22) as int)"))

    counts = keyed(narrow).groupBy("_source", "size", "_shard").agg(F.count("*").alias("_n"), F.first("_rest").alias("_rest"))
    counts = materialize(counts, "counts")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        take = fit_nearest({int(s): int(n) for s, n in zip(pdf["size"], pdf["_n"]) if s > 0}, int(pdf["_rest"].iloc[0]))
        return pd.DataFrame({"_source": pdf["_source"].iloc[0], "size": list(take), "_take": list(take.values())})

    histogram = counts.groupBy("_source", "size").agg(F.sum("_n").alias("_n"), F.first("_rest").alias("_rest"))
    take = histogram.groupBy("_source").applyInPandas(fit, "_source int, size long, _take long")
    before = Window.partitionBy("_source", "size").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_source", "size", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")).join(take, ["_source", "size"], "left")
    firsts = firsts.select("_source", "size", "_shard", (F.coalesce("_take", F.lit(0)) - F.col("_first")).alias("_quota"))
    ranked = keyed(base if payload else narrow).join(firsts, ["_source", "size", "_shard"])
    rank = F.row_number().over(Window.partitionBy("_source", "size", "_shard").orderBy("_order", "doc_id"))
    ranked = ranked.withColumn("_rank", rank)
    taken = F.col("size") * (F.col("_whole") + F.when(F.col("_rank") <= F.col("_quota"), 1).otherwise(0))
    return ranked.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), *payload)
