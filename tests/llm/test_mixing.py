import random

import pytest

from tavola.llm import mixing


def test_targets_share_the_excess():
    assert mixing.targets([10, 10], [1, 1], 30) == [15, 15]
    assert mixing.targets([10, 100, 100], [3, 1, 2], 315) == pytest.approx([20, 295 / 3, 590 / 3])
    got = mixing.targets([100, 10, 50], [3, 1, 2], 240)
    assert sum(got) == pytest.approx(240) and all(g <= 2 * s for g, s in zip(got, [100, 10, 50]))
    assert mixing.targets([0, 5], [3, 1], 7.5) == [0, 7.5]
    assert mixing.targets([], [], 0) == []


def _best(counts, budget):
    reach = {0}
    for s, n in counts.items():
        reach = {r + k * s for r in reach for k in range(n + 1)}
    return max(r for r in reach if r <= budget)


def test_fit_is_as_near_as_can_be():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        budget = rng.randint(0, sum(s * n for s, n in counts.items()))
        take = mixing.fit_budget(counts, budget)
        assert all(0 <= take[s] <= counts[s] for s in counts)
        got = sum(s * n for s, n in take.items())
        assert got <= budget
        first = {s: n * budget // sum(a * b for a, b in counts.items()) for s, n in counts.items()}
        rest = {s: counts[s] - first[s] for s in counts}
        assert got - sum(s * n for s, n in first.items()) == _best(rest, budget - sum(s * n for s, n in first.items()))


def test_nearest_may_be_above():
    assert mixing.fit_nearest({100: 1, 60: 1}, 95) == {100: 1, 60: 0}
    assert mixing.fit_nearest({100: 1, 60: 1}, 75) == {100: 0, 60: 1}
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randint(1, 60): rng.randint(1, 2) for _ in range(rng.randint(1, 5))}
        total = sum(s * n for s, n in counts.items())
        budget = rng.randint(0, total)
        take, below = mixing.fit_nearest(counts, budget), mixing.fit_budget(counts, budget)
        assert all(0 <= take[s] <= counts[s] for s in counts)
        assert abs(sum(s * n for s, n in take.items()) - budget) <= budget - sum(s * n for s, n in below.items())


def test_greedy_part_leaves_little():
    counts = {s: 50 for s in range(1, 400)}
    for budget in (0, 1, 999_999, 3_000_001):
        assert sum(s * n for s, n in mixing.fit_budget(counts, budget, dp_words=500).items()) == budget


@pytest.mark.parametrize("way", ["as it is", "knapsack", "exchange"])
def test_few_long_documents(monkeypatch, way):
    """Long documents must go in or out as the budget needs; the second and third way are forced."""
    if way != "as it is":
        monkeypatch.setattr(mixing, "MEET_LOTS", 0 if way == "knapsack" else 2)
    if way == "exchange":
        monkeypatch.setattr(mixing, "EXACT_BITS", 0)
    cases = [({60_000: 1, 50_000: 1, 40_000: 1}, 90_000), ({100_000: 1, 90_000: 1, 80_000: 1}, 170_000), ({1_000_000: 1, 500: 2000}, 1_900_000)]
    for counts, budget in cases:
        take = mixing.fit_budget(counts, budget)
        assert all(0 <= take[s] <= counts[s] for s in counts)
        assert way == "exchange" and len(counts) == 3 or sum(s * n for s, n in take.items()) == budget
    rng = random.Random(6)
    for _ in range(10):
        counts = {rng.randint(70_000, 300_000): rng.randint(1, 2) for _ in range(7)}
        budget = rng.randint(0, sum(s * n for s, n in counts.items()))
        take = mixing.fit_budget(counts, budget)
        got = sum(s * n for s, n in take.items())
        assert all(0 <= take[s] <= counts[s] for s in counts) and got <= budget
        assert way == "exchange" or got == _best(counts, budget)


def test_many_long_documents_meet_a_large_budget():
    rng = random.Random(7)
    counts = {rng.randint(10**6, 10**8): 1 for _ in range(300)} | {10**10: 1}
    budget = 10**10 + sum(counts) // 7
    assert sum(s * n for s, n in mixing.fit_budget(counts, budget).items()) == budget


ROWS = "doc_id long, text string, source string, size string, taken string"


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 40)), f"s{i % 4}", "x", "y") for i in range(400)]
    rows += [(1000 + i, "a b c d", "hot", None, None) for i in range(300)]
    rows += [(2000, None, None, None, None), (2001, "", "", None, None), (2002, "a b c\x0bd", None, None, None), (5, rows[5][1], "s1", "x", "y"), (None, "a b", "s0", None, None)]
    docs = spark.createDataFrame(rows, ROWS)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in mixing.mix(docs.repartition(7)).collect())
    by = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by.setdefault(r.source, []).append(r)
    assert {r.doc_id: r.size for r in by[None]} == {2000: 0, 2002: 3}
    for own in by.values():
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(1.5 * sum(r.size for r in got))


def test_very_long_texts(spark):
    rows = [(0, "w " * 300_000, "a"), (1, "w" * 400_000, "a"), (2, "w " * 100_000, "a")] + [(10 + i, "x y", "b") for i in range(50)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[i].size for i in range(3)] == [300_000, 1, 100_000] and all(r.taken <= 2 * r.size for r in got.values())
    # Target 599,951: each once, and of the rest of 199,950 words 100,001 are nearer than 300,000.
    assert got[0].target == pytest.approx(599_951.5) and sum(got[i].taken for i in range(3)) == 500_002


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], ROWS)).collect() == []
