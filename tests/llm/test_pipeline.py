"""The pipeline against a plain version of each stage, on its own input."""

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from tavola.llm import mixing
from tavola.llm.common import materialize
from tavola.llm.tokens import WordTokenizer

from .test_lines import _brute as plain_lines
from .test_simhash import _brute as plain_groups
from .test_simhash import _similar, _wide

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    vocabulary = {"en": ["onth", "ander", "ingle", "thewh"], "fr": ["éau", "êtreé", "oiçu", "leaux"]}
    words = {k: ["".join(rng.choices(v, k=rng.randint(1, 3))) for _ in range(300)] for k, v in vocabulary.items()}
    shared = "This passage of more than forty characters is in many of the documents"
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "fr"
        body = [" ".join(rng.choices(words[lang], k=30)) for _ in range(rng.randint(1, 6))] + [shared] * (i % 4 == 0)
        rows.append((i, "\n".join(body), lang, f"s{i % 5}"))
    rows += [(200 + i, rows[1][1], "en", "hot") for i in range(40)] + [(300, "12 345", "en", "s1"), (301, None, "en", "s1"), (302, rows[2][1] + " end", "en", "s2")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], ROWS)


def test_stages(spark, docs):
    got = {"documents": docs}
    before = docs
    for name, stage in pipeline.STAGES:
        before = got[name] = materialize(stage(spark, before, ""), f"test-{name}")
        if name != "pack":
            assert before.columns == docs.columns
    rows = {k: v.collect() for k, v in got.items()}
    spoken = {r.doc_id for r in rows["language"]}
    assert {300, 301}.isdisjoint(spoken) and len(spoken) >= len(rows["documents"]) - 4
    lines = plain_lines([(r.doc_id, r.text) for r in rows["language"]])
    assert sorted((r.doc_id, r.text) for r in rows["line_dedup"]) == sorted((i, t) for i, _, _, t in lines)
    assert all(r.n_chars == len(r.text) for r in rows["line_dedup"])
    ordered = sorted(rows["line_dedup"], key=lambda r: r.doc_id)
    first = plain_groups([_wide(r.text) for r in ordered], _similar)
    assert sorted(r.doc_id for r in rows["near_dedup"]) == sorted({ordered[k].doc_id for k in first})
    size = {r.doc_id: len((r.text or "").encode().split()) for r in rows["near_dedup"]}
    sources = sorted({r.source for r in rows["near_dedup"]})
    own = [sum(size[r.doc_id] for r in rows["near_dedup"] if r.source == s) for s in sources]
    aims = dict(zip(sources, mixing.targets(own, [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5 * sum(own))))
    for s in sources:
        assert abs(sum(size[r.doc_id] for r in rows["mix"] if r.source == s) - aims[s]) <= 30
    assert max(Counter(r.doc_id for r in rows["mix"]).values()) <= 2
    tokens = WordTokenizer()
    want = Counter()
    for r in rows["mix"]:
        data = tokens.whole(r.text or "") + bytes(4)
        for k, at in enumerate(range(0, len(data), 8192)):
            want[r.doc_id, k, at // 4, len(data[at : at + 8192]) // 4, zlib.crc32(data[at : at + 8192])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows["pack"]) == want
    held = Counter()
    for r in rows["pack"]:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048 and len(held) <= sum(held.values()) / 2048 * 1.05 + 2


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() > 0


def test_run_on_odd_rows(spark, docs, tmp_path):
    """Null and reused doc_ids, null and very long texts, nulls in all other columns: each clean text comes through once or as the mix takes it."""
    rng = random.Random(13)
    long = " ".join("".join(rng.choices(["onth", "ander", "ingle", "thewh"], k=rng.randint(1, 3))) for _ in range(40_000))
    odd = [(None, "onth ander ingle thewh " * 30, "en", "s1", None), (None, None, None, None, None), (None, "ander thewh onth " * 25, None, None, None), (7, "ingle onth thewhander " * 40, "en", "s2", 1), (900, long, "en", "s3", 5)]
    rows = docs.unionByName(spark.createDataFrame(odd, ROWS))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    kept = rows
    for name, stage in pipeline.STAGES[:3]:
        kept = materialize(stage(spark, kept, ""), f"odd-{name}")
    texts = {r.text for r in kept.collect()}
    assert {odd[0][1], odd[2][1], odd[3][1], odd[4][1]} <= texts and None not in texts
    packed = pipeline.run(spark, str(tmp_path)).groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in packed) <= 2048


def test_run_on_an_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []
