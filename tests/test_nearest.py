"""Best pairs and all pairs of a dense neighbourhood against a plain version, and what they pass on."""

import math
import random

import numpy as np
import pytest

from tavola.config import Settings
from tavola.functions.similarity import Names, name_score_of
from tavola.operators import nearest, resolve

VENUE = "id string, ordinal long, name string, address string, lat double, lon double"
S = Settings()
WORDS = ["of", "in", "été", "kaede", "roma", "mar", "sol", "luna", "verde", "ab", "abc", "nord"]


def _venues(rng, side, n):
    rows = []
    for k in range(n):
        name = " ".join(rng.choices(WORDS, k=rng.randint(1, 4))) if k % 23 else "kaede " + "x" * 70
        place = (None, 2.0) if k % 17 == 0 else (41.0 + rng.randint(0, 8) / 200, 2.0 + rng.randint(0, 8) / 200)
        rows.append((f"{side}{k}", k, name, rng.choice([None, "", f"{rng.choice(WORDS)} {rng.randint(1, 4)}"]), *place))
    return rows + [(f"{side}{n + k}", n + k, "kaede roma", "mar 3", 41.0, 2.0) for k in range(40)]


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(8)
    left, right = _venues(rng, "l", 120), _venues(rng, "r", 150)
    return spark.createDataFrame(left, VENUE), spark.createDataFrame(right, VENUE)


@pytest.fixture(scope="module")
def plain(sides):
    """(l_id, r_id) to (name score, score) of every pair in the band, and of left venues without a place with all."""
    a, b = (resolve.prepared(df, side).collect() for df, side in zip(sides, "lr"))
    out = {}
    for x in a:
        for y in b:
            if x.l_lat is not None and (y.r_lat is None or abs(x.l_lat - y.r_lat) > S.band or abs(x.l_lon - y.r_lon) > S.band):
                continue
            name, geo = name_score_of(x.l_name, y.r_name), 0.0
            if x.l_lat is not None:
                p, q = math.radians(x.l_lat), math.radians(y.r_lat)
                h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(y.r_lon - x.l_lon) / 2) ** 2
                geo = math.exp(-S.lambda_geo * 6_371_000.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h)))
            number, street = (set(x.l_tokens[k]) & set(y.r_tokens[k]) for k in ("numbers", "streets"))
            boost = 0 if not number or None in (x.l_address, y.r_address) else S.strong_boost if street else S.weak_boost
            score = S.weight_name * name + S.weight_geo * geo
            out[x.l_id, y.r_id] = name, min(1.0, score + boost) if boost else score
    return out


def _best(plain):
    best = {}
    for (l, _), (_, score) in plain.items():
        if score >= S.match_threshold - 1e-12:
            best[l] = max(best.get(l, 0), score)
    return best


@pytest.mark.parametrize("salts, parts", [(1, 1), (3, 4)])
def test_all_pairs(sides, plain, salts, parts):
    left, right = resolve.prepared(sides[0], "l"), resolve.prepared(sides[1], "r")
    got = {(r.l_id, r.r_id): (r.name_score, r.score) for r in nearest.all_pairs(left, right, S, salts, parts).collect()}
    want = {k: v for k, v in plain.items() if int(k[0][1:]) % 17 or int(k[0][1:]) >= 120}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_best(sides, plain):
    got = {r.l_id: (r.r_id, r.score) for r in resolve.resolve(*sides).best.collect()}
    best = _best(plain)
    assert got.keys() == best.keys()
    assert all(s == pytest.approx(best[k], abs=1e-9) and plain[k, r][1] == pytest.approx(s, abs=1e-9) for k, (r, s) in got.items())


def test_copies_pass_on_one_pair_each(sides):
    """80 alike venues make 1600 pairs, of which one for each left venue is passed on."""
    left, right = resolve.prepared(sides[0].where("ordinal >= 120"), "l"), resolve.prepared(sides[1].where("ordinal >= 150"), "r")
    got = nearest.best_pairs(left, right, S).collect()
    assert len(got) == 40 and {r.r_id for r in got} == {"r150"}


def test_stats(sides, plain):
    got, best = resolve.resolve(*sides).stats.first(), list(_best(plain).values())
    assert (got.n, got.min_score, got.max_score, got.avg_score) == pytest.approx((len(best), min(best), max(best), sum(best) / len(best)))


def test_one_to_one_and_unmatched(sides, plain):
    found = resolve.resolve(*sides)
    best, matches = found.best.collect(), found.matches.collect()
    top = {}
    for r in sorted(best, key=lambda r: (-r.score, r.l_ordinal)):
        top.setdefault(r.r_id, r.l_id)
    assert {r.r_id: r.l_id for r in matches} == top
    assert {r.l_id for r in found.unmatched.collect()} == {f"l{k}" for k in range(160)} - set(top.values())


def test_recheck(spark, sides, plain):
    old = [(f"l{k}", f"r{k + 1}") for k in range(150)]
    found = resolve.resolve(*sides, old=spark.createDataFrame(old, "l_id string, r_id string"))
    got = {r.l_id: (r.r_id, r.score) for r in found.best.collect()}
    best = _best(plain)
    for k, (r, s) in got.items():
        if (k, r) not in old:
            assert s == pytest.approx(best[k], abs=1e-9)
    assert best.keys() <= got.keys()


def test_names():
    rng = random.Random(4)
    names = sorted({" ".join(rng.choices([*WORDS, "ouwhea", "é"], k=rng.randint(0, 5))) for _ in range(300)} | {"a" * 70, "of  in", "of in"})
    known, rows = Names(names), np.arange(len(names))
    for name in names[::5] + ["", "sol z"]:
        probe, want = known.probe(name), [name_score_of(name, x) for x in names]
        assert probe.scores(rows).tolist() == want
        assert (probe.bounds(rows, known.letters(rows)) >= np.array(want) - 1e-12).all()
