"""Scores of many pairs of places within the band, by cells: the best right places of each left one, or all pairs.

Rows of both sides are dealt to the join's cells and sorted, right ones first; a task holds the right rows of one part
of a cell's surroundings and reads the left rows one after another, so that no pair is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavola.config import Settings
from tavola.functions.geo import EARTH_RADIUS_M
from tavola.functions.similarity import Names
from tavola.operators.spatial import join_cell

#: Rows around a cell that a task holds, about; and the most parts that they are cut into.
HELD_ROWS, MAX_PARTS = 60_000, 256
#: How far two ways to compute one score may differ.
SLACK = 1e-9
#: Pairs that are scored first, in the order of their bounds; four times as many follow each time.
FIRST_PAIRS = 128
_COLUMNS = ("id", "ordinal", "lat", "lon", "name", "address", "tokens")


def parts_for(right: DataFrame, settings: Settings, rows: int = HELD_ROWS) -> int:
    """How many parts the right rows around the most common cell are cut into, so that none has more than about ``rows`` rows."""
    cells = right.groupBy(join_cell(F.col("r_lat"), settings).alias("i"), join_cell(F.col("r_lon"), settings).alias("j")).count()
    most = cells.where("i IS NOT NULL AND j IS NOT NULL").agg(F.max("count")).first()[0] or 0
    return max(1, min(MAX_PARTS, -(-int(most) * 9 // rows)))


def _dealt(left: DataFrame, right: DataFrame, settings: Settings, salts: int, parts: int) -> DataFrame:
    """_i, _j, _part, _left and the columns of a place: left rows once a part in their own cell, right rows in the 3 x 3 around theirs."""

    def rows(df: DataFrame, side: str) -> DataFrame:
        named = df.where(f"{side}_lat IS NOT NULL AND {side}_lon IS NOT NULL").select(*[F.col(f"{side}_{c}").alias(c) for c in _COLUMNS])
        return named.select("*", join_cell(F.col("lat"), settings).alias("_ci"), join_cell(F.col("lon"), settings).alias("_cj"), F.lit(side == "l").alias("_left"))

    def own(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = rows(left, "l").select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"))
    a = a.select(F.col("_ci").alias("_i"), F.col("_cj").alias("_j"), (own(salts) * parts + F.col("_p")).alias("_part"), "_left", *_COLUMNS)
    b = rows(right, "r").select("*", F.explode(around).alias("_n")).select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    b = b.select((F.col("_ci") + F.col("_n.i")).alias("_i"), (F.col("_cj") + F.col("_n.j")).alias("_j"), (F.col("_s") * parts + own(parts)).alias("_part"), "_left", *_COLUMNS)
    keys = ["_i", "_j", "_part"]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.unionByName(b).repartition(tasks, *keys).sortWithinPartitions(*keys, "_left", "lat", "lon")


def _postings(lists: list) -> dict[str, np.ndarray]:
    """Places of the lists that hold each word."""
    at: dict[str, list[int]] = {}
    for i, words in enumerate(lists):
        for w in words or ():
            at.setdefault(w, []).append(i)
    return {w: np.array(rows) for w, rows in at.items()}


def _geo(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray, decay: float) -> np.ndarray:
    half_lat, half_lon = np.radians(lats - lat) / 2, np.radians(lons - lon) / 2
    a = np.sin(half_lat) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(lats)) * np.sin(half_lon) ** 2
    return np.exp(-decay * (EARTH_RADIUS_M * 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))))


class Around:
    """The right rows of one part of a cell's surroundings."""

    def __init__(self, rows: pa.Table, settings: Settings):
        self.rows, self.settings = rows.combine_chunks(), settings
        self.lat, self.lon = (self.rows[c].to_numpy() for c in ("lat", "lon"))  # sorted by lat
        self.ordinal = self.rows["ordinal"].to_numpy()
        named = self.rows["name"].combine_chunks().dictionary_encode()
        named = named.combine_chunks() if isinstance(named, pa.ChunkedArray) else named
        self.name, self.names = named.indices.to_numpy(), Names(named.dictionary.to_pylist())
        tokens = self.rows["tokens"].to_pylist()
        self.numbers, self.streets = (_postings([t[k] for t in tokens]) for k in ("numbers", "streets"))
        self.n_streets = np.array([t["n"] for t in tokens], np.int64)
        self.addressed = self.rows["address"].is_valid().to_numpy()
        self.place: tuple[float, float] | None = None

    def look(self, lat: float, lon: float) -> None:
        """The rows in the band around a place, their names and what their places give."""
        if self.place == (lat, lon):
            return
        s, self.place = self.settings, (lat, lon)
        lo, hi = np.searchsorted(self.lat, [lat - 2 * s.band, lat + 2 * s.band])
        near = (np.abs(lat - self.lat[lo:hi]) <= s.band) & (np.abs(lon - self.lon[lo:hi]) <= s.band)
        self.near = lo + np.flatnonzero(near)
        self.near_name = self.name[self.near]
        self.near_geo = s.weight_geo * _geo(lat, lon, self.lat[self.near], self.lon[self.near], s.lambda_geo)
        self.near_letters = self.names.letters(self.near_name)
        self.near_names, self.near_at = np.unique(self.near_name, return_inverse=True)

    def boosts(self, address: str | None, tokens: dict) -> np.ndarray:
        """What the addresses of the rows in the band add."""
        s = self.settings
        if address is None:
            return np.zeros(len(self.near))
        number, common = np.zeros(len(self.name), bool), np.zeros(len(self.name), np.int64)
        for w in tokens["numbers"]:
            number[self.numbers.get(w, [])] = True
        for w in tokens["streets"]:
            common[self.streets.get(w, [])] += 1
        number, common = number[self.near], common[self.near]
        most = np.maximum(np.maximum(self.n_streets[self.near], tokens["n"]), 1)
        score = np.where(number & (common > 0), 1.0, np.where(number, 0.5, 0.3 * common / most))
        boost = np.where(score > s.strong_address, s.strong_boost, np.where(score > s.weak_address, s.weak_boost, 0.0))
        return np.where(self.addressed[self.near], boost, 0.0)

    def totals(self, names: np.ndarray, geo: np.ndarray, boosts: np.ndarray) -> np.ndarray:
        base = self.settings.weight_name * names + geo
        return np.where(boosts == 0, base, np.minimum(1.0, base + boosts))

    def best(self, name: str, address: str | None, tokens: dict) -> np.ndarray:
        """The rows whose scores reach the threshold and are the highest but for SLACK; of those of one name and place the first."""
        s, probe = self.settings, self.names.probe(name)
        boosts = self.boosts(address, tokens)
        least = s.match_threshold - SLACK
        bounds = s.weight_name * probe.bounds(self.near_name, self.near_letters) + self.near_geo + boosts
        able = np.flatnonzero(bounds >= least)
        able = able[np.argsort(-bounds[able])]
        found, scores, step = [np.empty(0, np.int64)], [np.empty(0)], FIRST_PAIRS
        while len(able):
            some, able, step = able[:step], able[step:], 4 * step
            got = self.totals(probe.scores(self.near_name[some], s.name_shortcut), self.near_geo[some], boosts[some])
            least = max(least, float(got.max()) - SLACK)
            found.append(some)
            scores.append(got)
            able = able[bounds[able] >= least - SLACK]
        rows, score = np.concatenate(found), np.concatenate(scores)
        rows = rows[score >= least]
        at = self.near[rows]
        first: dict[tuple, int] = {}
        for key, row in sorted(zip(zip(self.near_name[rows].tolist(), self.lat[at].tolist(), self.lon[at].tolist(), boosts[rows].tolist()), at.tolist()), key=lambda x: self.ordinal[x[1]]):
            first.setdefault(key, row)
        return np.array(list(first.values()), np.int64)


def _read(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[tuple[Around, pa.RecordBatch]]:
    """Left rows, in batches of one group each, with what is around them."""
    key, held, around = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], 1)
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(keys, axis=0) != 0).any(1)])).tolist() if len(keys) else []
        for at, end in zip(starts, [*starts[1:], len(keys)]):
            group, is_left = tuple(keys[at, :3].tolist()), bool(keys[at, 3])
            if group != key:
                key, held, around = group, [], None
            rows = pa.RecordBatch.from_arrays(batch.columns[4:], names=list(_COLUMNS)).slice(at, end - at)
            if not is_left:
                held.append(rows)
            elif held:
                around = around or Around(pa.Table.from_batches(held), settings)
                yield around, rows


def best_pairs(left: DataFrame, right: DataFrame, settings: Settings, salts: int = 1, parts: int = 1) -> DataFrame:
    """Of each left row the pairs in the band with the highest score, once a part, if that reaches the threshold.

    Both sides are as resolve.prepared() makes them.  A right row that equals another but for id and ordinal counts once,
    by the smallest ordinal.  Every other row may be paired; pairs are left out only where a bound or their score is below
    the best one's.  Left rows that are alike are compared once while they follow each other.
    """
    alike = [f"r_{c}" for c in ("lat", "lon", "name", "address")]
    first = F.min(F.struct("r_ordinal", "r_id")).alias("_first")
    right = right.groupBy(*alike).agg(first, F.any_value("r_tokens").alias("r_tokens")).select("*", F.col("_first.r_ordinal").alias("r_ordinal"), F.col("_first.r_id").alias("r_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, np.ndarray] = {}
        of = None
        for around, rows in _read(batches, settings):
            a, b = [], []
            for i, r in enumerate(rows.to_pylist()):
                place = (around, r["lat"], r["lon"])
                if place != of:
                    of, known = place, {}
                    around.look(r["lat"], r["lon"])
                if (r["name"], r["address"]) not in known:
                    known[r["name"], r["address"]] = around.best(r["name"], r["address"], r["tokens"])
                got = known[r["name"], r["address"]]
                a.extend([i] * len(got))
                b.extend(got.tolist())
            if a:
                right_rows = around.rows.take(pa.array(b)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*rows.take(pa.array(a)).columns, *right_rows.columns], names=[f"{s}_{c}" for s in "lr" for c in _COLUMNS])

    dealt = _dealt(left, right, settings, salts, parts)
    return dealt.mapInArrow(run, T.StructType([T.StructField(f"{side}_{c}", dealt.schema[c].dataType) for side in "lr" for c in _COLUMNS]))


def all_pairs(left: DataFrame, right: DataFrame, settings: Settings, salts: int = 1, parts: int = 1) -> DataFrame:
    """l_id, r_id, name_score and score of every pair in the band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for around, rows in _read(batches, settings):
            ids = around.rows["id"].combine_chunks()
            for r in rows.to_pylist():
                around.look(r["lat"], r["lon"])
                if len(around.near):
                    names = around.names.probe(r["name"]).scores(around.near_names, settings.name_shortcut)[around.near_at]
                    score = around.totals(names, around.near_geo, around.boosts(r["address"], r["tokens"]))
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(r["id"], ids.type), len(score)), ids.take(pa.array(around.near)), pa.array(names), pa.array(score)], names=["l_id", "r_id", "name_score", "score"])

    dealt = _dealt(left, right, settings, salts, parts)
    kinds = {"l_id": dealt.schema["id"].dataType, "r_id": dealt.schema["id"].dataType, "name_score": T.DoubleType(), "score": T.DoubleType()}
    return dealt.mapInArrow(run, T.StructType([T.StructField(k, v) for k, v in kinds.items()]))
