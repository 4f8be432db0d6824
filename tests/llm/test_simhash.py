import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tavola.llm import components, simhash
from tavola.llm.components import component_labels


def _exact(a, b):
    return (a ^ b).bit_count() <= 3


def _similar(a, b):
    """Within 19 of 128 bits, and within 2 of one block of 32."""
    x = a ^ b
    return x.bit_count() <= 19 and min((x >> 32 * k & 0xFFFFFFFF).bit_count() for k in range(4)) <= 2


def _brute(fps, linked=_exact):
    """Smallest index reachable."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if linked(a, fps[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def _plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _wide(text):
    low, high = simhash.fingerprint(text, simhash.SIMILAR)
    return low | high << 64


def _plain_wide(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    hashes = [int.from_bytes(xxhash.xxh3_128_digest(s, 42), "little") for s in shingles]
    return sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 3000):
        text = " ".join(rng.choices(["A", "é", "Ünd", "b c", "x"], k=n))
        assert simhash.fingerprint(text) == (_plain_fingerprint(text),)
        assert _wide(text) == _plain_wide(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t\x0b") == (0,) and _wide("") == 0


def test_spark_hashes_shingles_alike(spark):
    got = spark.createDataFrame([("a b c",), ("é",)], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] % 2**64 for r in got] == [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c", "é")]


def test_every_link_meets(spark):
    """Chains, dense balls, and bits at the blocks' edges."""
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(30)] + [0, 1 << 63, 7, 2**64 - 1]
    for _ in range(400):
        base = rng.choice(fps)
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            base ^= 1 << bit
        fps.append(base)
    for bits in ((21, 22, 23), (42, 43, 44), (0, 22, 43), (61, 62, 63)):
        fps.append(fps[0] ^ sum(1 << b for b in bits))
    rows = [(i, f"{x}", int(np.uint64(x).view(np.int64))) for i, x in enumerate(fps)]
    df = spark.createDataFrame(rows, "doc_id long, t string, fp long")
    edges = simhash.links(df.select("fp").distinct())
    label = {r.node: r.label for r in component_labels(edges).collect()}
    groups = {}
    for i, _, fp in rows:
        groups.setdefault(label.get(fp, fp), []).append(i)
    got = {i: min(g) for g in groups.values() for i in g}
    assert [got[i] for i in range(len(fps))] == _brute(fps)


@pytest.mark.parametrize("buffer", [1, 10, 1 << 18])
def test_runs_go_on_over_batches(monkeypatch, buffer):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "BUFFER_ROWS", buffer)
    ball = [5 ^ (1 << b) ^ (1 << c) for b in range(40) for c in range(b)] + [5]
    rows = [(0, 2**63), (1, 2**50), (1, 2**50 + 1), *((2, x) for x in ball), (3, 1), (4, 31 << 55), (4, 2**51), (4, 2**51 + 1), (5, 7)]
    keys, fps = np.array([k for k, _ in rows]), np.array([x for _, x in rows], np.uint64)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[s : s + 7]), pa.array(fps[s : s + 7].view(np.int64))], ["key", "fp"]) for s in range(0, len(fps), 7)]
    edges = [e for b in simhash._links(iter(batches), 3) for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    reached, todo = {5}, True
    while todo:
        new = {x for e in edges for x in e if set(e) & reached} - reached
        reached, todo = reached | new, bool(new)
    assert set(ball) <= reached and {frozenset(e) for e in edges if not set(e) & set(ball)} == {frozenset((2**50, 2**50 + 1)), frozenset((2**51, 2**51 + 1))}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in component_labels(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 501: 500}


def _paths(n):
    rng = random.Random(4)
    shuffled = list(range(n))
    rng.shuffle(shuffled)
    half = n // 2
    return {
        "shuffled": list(zip(shuffled, shuffled[1:])),
        "descending": [(i + 1, i) for i in range(n - 1)],
        "zigzag": [(x, y) for i in range(half - 1) for x, y in ((i, n - 1 - i), (n - 1 - i, i + 1))],
        "far": [(0, 2 * n)] + [(2 * n - i, 2 * n - i - 1) for i in range(n - 1)],
        "star": [(n, i) for i in range(1, n)],
        "grid": [(shuffled[i], shuffled[j]) for i in range(n) for j in (i + 1, i + 70) if j < n],
    }


@pytest.mark.parametrize("shape", ["shuffled", "descending", "zigzag", "far", "star", "grid"])
def test_components_take_logarithmic_rounds(spark, monkeypatch, shape):
    """Whatever the order of names along a path, rounds grow as the logarithm; old rounds' tables are deleted."""
    rounds, real, gone = [], components.materialize, []
    monkeypatch.setattr(components, "materialize", lambda df, name, *more: rounds.append(name) or real(df, name, *more))
    drop = components.discard
    monkeypatch.setattr(components, "discard", lambda *dfs: gone.extend(df._written for df in dfs) or drop(*dfs))
    edges = _paths(5000)[shape]
    got = {r.node: r.label for r in component_labels(spark.createDataFrame([*edges, (10**6, 10**6 + 1)], "a long, b long")).collect()}
    least = min(x for e in edges for x in e)
    assert got == {**{x: least for e in edges for x in e}, 10**6: 10**6, 10**6 + 1: 10**6}
    assert rounds.count("moved") <= 25
    assert len(gone) == len(set(gone)) == len(rounds) - 1 and not any(os.path.exists(p.removeprefix("file://")) for p in gone)


def test_long_chain_of_fingerprints(spark):
    """Each of 500 fingerprints differs from the one before in 3 bits."""
    rng = random.Random(9)
    chain = [rng.getrandbits(64)]
    while len(chain) < 500:
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 3)))
    fps = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in set(chain)], "fp long")
    assert {r.label for r in component_labels(simhash.links(fps)).collect()} == {min(int(np.uint64(x).view(np.int64)) for x in chain)}


def test_many_at_one_meeting_point():
    """More than DENSE_ROWS fingerprints: a ball, a chain through it and strangers."""
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = [base] + [base ^ 1 << b ^ 1 << c for b in range(40) for c in range(b)] + [rng.getrandbits(22) | 1 << 63 for _ in range(900)]
    fps = np.array(sorted(set(fps)), np.uint64)
    a, b = simhash._forest(fps[:, None], 3)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        assert (int(fps[x]) ^ int(fps[y])).bit_count() <= 64
        parent[max(find(x), find(y))] = min(find(x), find(y))
    assert [find(i) for i in range(len(fps))] == _brute([int(x) for x in fps])


def test_similar_scheme(spark):
    """Near copies of many grades, against all pairs; and long chains of revisions."""
    rng = random.Random(8)
    texts = []
    for k in range(25):
        words = [rng.choice("abcdefgh") + str(rng.randint(0, 9999)) for _ in range(rng.choice([8, 40, 300]))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 8)):
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = "new" + str(rng.random())
            texts.append(" ".join(words))
    texts += [None, "", "one", "one two", "same text of more than five words here"] + ["same text of more than five words here"] * 20 + ["very long " * 20_000]
    docs = spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp2 string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, simhash.SIMILAR).collect()}
    want = _brute([_plain_wide(t) for t in texts], _similar)
    assert [got[100 + i].component_id for i in range(len(texts))] == [100 + w for w in want]
    assert sorted(r.doc_id for r in simhash.distinct_documents(docs).collect()) == sorted({100 + w for w in want})
    assert len(set(want)) < len(texts) - 60


def test_recall_by_similarity():
    """Pairs of 400 words by the similarity of their five-word shingles: the README states these shares."""
    rng = random.Random(7)
    linked = {}
    for low, changes in ((0.95, 2), (0.9, 4), (0.85, 6), (0.8, 8), (0.0, 80)):
        hits = 0
        for _ in range(60):
            words = [str(rng.random()) for _ in range(400)]
            other = list(words)
            for at in rng.sample(range(400), changes):
                other[at] = "x" + str(rng.random())
            hits += _similar(_wide(" ".join(words)), _wide(" ".join(other)))
        linked[low] = hits / 60
    print(linked)
    assert linked[0.95] > 0.85 and linked[0.9] > 0.55 and linked[0.0] == 0


def _near(rng, words):
    out = list(words)
    out[rng.randrange(len(out))] = "changed"
    return " ".join(out)


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(400)] for _ in range(12)]
    texts = [" ".join(b) for b in base] + [_near(rng, b) for b in base for _ in range(4)] + ["copy me now please"] * 60 + [None, "", " ", "one", "one two"]
    docs = spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [_plain_fingerprint(t) for t in texts]
    want = _brute(fps)
    assert all(got[100 + i].component_id == 100 + want[i] and got[100 + i].fp % 2**64 == fps[i] for i in range(len(texts)))
    kept = simhash.distinct_documents(docs, simhash.EXACT).collect()
    assert sorted(r.doc_id for r in kept) == sorted({100 + w for w in want})


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "only here")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect()) == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert sorted(str(r.doc_id) for r in simhash.distinct_documents(docs).collect()) == ["4", "None"]


def test_each_component_keeps_one_row(spark):
    """Null and reused doc_ids: texts, not ids, are what must stay."""
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "only here"), (None, "and this too"), (4, "another text of four"), (5, "another text of four"), (6, "six has this"), (7, "six has this"), (7, "seven has that"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.distinct_documents(docs).collect()), key=str)
    texts = [t or "" for _, t in kept]
    assert sorted(texts) == sorted({t or "" for _, t in rows})
    assert {(4, "a b c"), (4, "another text of four"), (6, "six has this"), (7, "seven has that"), (None, "only here"), (None, "and this too")} <= set(kept)
