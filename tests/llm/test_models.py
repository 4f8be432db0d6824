import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tavola.llm import language, toxicity

held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
BAD = ["vilexx", "scumyy", "rotzz"]


def _toxic_docs(spark, n=900):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(20, 80))
        bad = i % 6 == 0
        for _ in range(3 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        docs.append((i, " ".join(text), "en", "y"))
        labels.append((i, int(bad), 0))
    docs += [(n, None, None, "y"), (n + 1, "", "en", "y"), (None, "vilexx scumyy rotzz", "en", "y"), (0, docs[0][1], "en", "y"), (n + 2, "word " * 100_000, "en", "y")]
    labels += [(0, 0, 1), (n + 9, 1, 1), (None, 1, 1), (3, None, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, y int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = _toxic_docs(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    truth = {r.doc_id: r.toxic for r in labels.where("y = 0 and doc_id is not null").collect()}
    mine = [i for i in truth if held(i)]
    assert all(by[i].held_out == held(i) for i in truth)
    right = sum(by[i].predicted == truth[i] for i in mine) / len(mine)
    assert right > 0.97 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert by[900].score == by[901].score and by[None].predicted == 1
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(5), labels).collect()}
    assert again == {i: r.score for i, r in by.items()}


def _plain_features(text):
    """Hashed words, stems, bigrams and skip-grams in whole numbers, each once."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    h = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    stems = [xxhash.xxh64_intdigest((w[:6] + "*").encode()) for w in words]
    one, two, skip, top = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 2**64
    out = {x * one % top >> 44 for x in h + stems}
    out |= {(a * two + b) % top * one % top >> 44 for a, b in zip(h, h[1:])}
    return out | {(a * skip + b) % top * two % top >> 44 for a, b in zip(h, h[2:])}


def test_toxicity_equals_a_plain_learner(spark):
    """FTRL-proximal on dictionaries, the same rows in the same order; equal scores for all documents."""
    docs, labels = _toxic_docs(spark, 240)
    alpha, beta, l1, l2 = 2.0, 1.0, 6.0, 0.1
    truth = {}
    for r in labels.collect():
        if r.doc_id is not None and r.toxic is not None and not held(r.doc_id):
            truth[r.doc_id] = max(truth.get(r.doc_id, 0), r.toxic)
    rows = [r for r in docs.collect() if r.doc_id in truth]
    orders = {r.doc_id: r.o for r in docs.where("doc_id is not null").select("doc_id", F.array(*[F.xxhash64(F.lit(e), "doc_id") for e in range(4)]).alias("o")).collect()}
    z, n, bias, bias_n = {}, {}, 0.0, 0.0

    def weight(i):
        x = z.get(i, 0.0)
        return 0.0 if abs(x) <= l1 else -(x - math.copysign(l1, x)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    def share(at):
        return 1 / (1 + math.exp(-sum(weight(i) for i in at) - bias))

    for e in range(4):
        for r in sorted(rows, key=lambda r: (orders[r.doc_id][e], r.doc_id)):
            at = _plain_features(r.text)
            gap = share(at) - truth[r.doc_id]
            for i in at:
                w, before = weight(i), n.get(i, 0.0)
                n[i] = before + gap * gap
                z[i] = z.get(i, 0.0) + gap - (math.sqrt(n[i]) - math.sqrt(before)) / alpha * w
            bias_n += gap * gap
            bias -= alpha * gap / (beta + math.sqrt(bias_n))
    seen, known = [0, 0], [0, 0]
    for r in rows:
        seen[truth[r.doc_id]] += 4
    for y in truth.values():
        known[y] += 1
    bias += math.log(known[1] / known[0]) - math.log(seen[1] / seen[0])
    got = toxicity.toxicity(docs, labels).collect()
    plain = {}
    for r in docs.collect():
        plain.setdefault(r.doc_id, set()).add(round(share(_plain_features(r.text)), 5))
    assert len(got) == docs.count() and sum(weight(i) != 0 for i in z) >= 6
    assert all(min(abs(r.score - s) for s in plain[r.doc_id]) < 1e-4 for r in got)
    assert {r.held_out for r in got if r.doc_id is not None and held(r.doc_id)} == {True}


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = _toxic_docs(spark, 300)
    flipped = labels.selectExpr("doc_id", "case when crc32(encode(cast(doc_id as string), 'UTF-8')) % 3 = 1 then 1 - toxic else toxic end AS toxic")
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels(spark):
    docs, labels = _toxic_docs(spark, 30)
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_ftrl_is_sparse():
    rng = np.random.default_rng(1)
    m = toxicity.Ftrl(1000, alpha=1.0, l1=2.0)
    for _ in range(400):
        y = int(rng.random() < 0.5)
        m.learn(np.unique(np.append(rng.integers(10, 1000, 20), y)), y)
    w = m.weights(slice(None))
    assert w[1] > 0 > w[0] and (w != 0).mean() < 0.2


LANGS = {"aa": "abcde", "bb": "defgh", "cc": "ñéüßa"}


def _language_docs(spark, n=600):
    rng = random.Random(2)
    docs = []
    for i in range(n):
        lang = sorted(LANGS)[i % 3]
        docs.append((i, " ".join("".join(rng.choices(LANGS[lang], k=rng.randint(2, 7))) for _ in range(rng.randint(3, 60))), lang, "s"))
    docs += [(n, None, "aa", "s"), (n + 1, "123 --- !!", "aa", "s"), (n + 2, "", None, "s"), (n + 3, "abc abc eda", None, "s"), (None, "abc", "aa", "s"), (1, docs[1][1], "bb", "s"), (n + 4, "abcde " * 50_000, None, "s")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, lang_pred string")


def test_language_on_held_out_rows(spark):
    docs = _language_docs(spark)
    rows = language.identify(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    mine = [i for i in range(600) if held(i)]
    assert sum(by[i].lang_pred == sorted(LANGS)[i % 3] for i in mine) / len(mine) > 0.97
    assert all(by[i].held_out == held(i) and 0 <= by[i].score <= 1 for i in range(600))
    assert [by[i].lang_pred for i in (600, 601, 602)] == ["und"] * 3 and by[603].lang_pred == by[604].lang_pred == "aa"
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and {600, 601, 602}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() >= docs.count() - 10


def _plain_counts(text):
    """Hashed n-grams of 1 to 3 characters in whole numbers."""
    out = ""
    for c in (text or "").lower():
        if c.isalpha():
            out += c
        elif out and out[-1] != " ":
            out += " "
    body = (text or "").lower()
    if not any(c.isalpha() for c in body):
        return None
    if body and not body[0].isalpha():
        out = out.lstrip(" ")
    c = [ord(x) * 0x9E3779B1 % 2**32 for x in out]
    two = [(a ^ b * 0x85EBCA6B % 2**32) * 0xC2B2AE35 % 2**32 for a, b in zip(c, c[1:])]
    three = [(a ^ b * 0x27D4EB2F % 2**32) * 0x165667B1 % 2**32 for a, b in zip(two, c[2:])]
    counts = {}
    for x in c + two + three:
        counts[x >> 17] = counts.get(x >> 17, 0) + 1
    return counts


def test_language_equals_a_plain_learner(spark):
    """Multinomial FTRL on dictionaries over the same rows in the same order; equal answers and scores."""
    docs = _language_docs(spark, 150)
    rows = docs.collect()
    known = [r for r in rows if r.lang is not None and not held(r.doc_id if r.doc_id is not None else "")]
    counts = [(r, _plain_counts(r.text)) for r in known]
    n, df = 0, {}
    for _, c in counts:
        if c is not None:
            n += 1
            for i in c:
                df[i] = df.get(i, 0) + 1
    names = sorted({r.lang for r in known})

    def vector(c):
        x = {i: math.log1p(k) * (math.log((1 + n) / (1 + df.get(i, 0))) + 1) for i, k in c.items()}
        size = max(math.sqrt(sum(v * v for v in x.values())), 1e-12)
        return {i: v / size for i, v in x.items()}

    order = docs.select("doc_id", F.array(*[F.xxhash64(F.lit(e), "doc_id") for e in range(3)]).alias("o"), (F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5)) == 0).alias("late")).distinct().collect()
    order = {r.doc_id: (r.o, r.late) for r in order}
    z, g2, bias, bias_g2 = {}, {}, [0.0] * len(names), [0.0] * len(names)

    def weight(i, k):
        v = z.get((i, k), 0.0)
        return 0.0 if abs(v) <= 0.02 else -(v - math.copysign(0.02, v)) / ((1 + math.sqrt(g2.get((i, k), 0.0))) / 1.0 + 0.01)

    def raw(x):
        return [sum(v * weight(i, k) for i, v in x.items()) + bias[k] for k in range(len(names))]

    def shares(y, t=1.0):
        e = [math.exp((v - max(y)) / t) for v in y]
        return [v / sum(e) for v in e]

    some = [(r, vector(c)) for r, c in counts if c is not None]
    for e in range(2):
        for r, x in sorted((s for s in some if not order[s[0].doc_id][1]), key=lambda s: (order[s[0].doc_id][0][e], s[0].doc_id is not None, s[0].doc_id or 0, s[0].text)):
            gaps = shares(raw(x))
            gaps[names.index(r.lang)] -= 1
            for i, v in x.items():
                for k, gap in enumerate(gaps):
                    w, before = weight(i, k), g2.get((i, k), 0.0)
                    g2[i, k] = before + (v * gap) ** 2
                    z[i, k] = z.get((i, k), 0.0) + v * gap - (math.sqrt(g2[i, k]) - math.sqrt(before)) * w
            for k, gap in enumerate(gaps):
                bias_g2[k] += gap * gap
                bias[k] -= gap / (1 + math.sqrt(bias_g2[k]))
    late = [(raw(x), names.index(r.lang)) for r, x in some if order[r.doc_id][1]]
    loss = lambda t: -sum(math.log(shares(y, t)[k]) for y, k in late) / len(late)
    t = min((2.0 ** (e / 8) for e in range(-24, 25)), key=loss)
    plain = {}
    for r in rows:
        c = _plain_counts(r.text)
        p = shares(raw(vector(c)), t) if c is not None else [0.0]
        plain.setdefault(r.doc_id, []).append((names[p.index(max(p))] if c is not None else "und", max(p)))
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert any(r.lang_pred == a and abs(r.score - b) < 1e-4 for a, b in plain[r.doc_id]), (r, plain[r.doc_id])


def test_nothing_learnt_rejects_only_texts_without_letters(spark):
    docs = _language_docs(spark, 30).selectExpr("doc_id", "text", "cast(null as string) AS lang", "lang_pred")
    kept = language.accepted(docs).collect()
    assert len(kept) == docs.count() - 3 and {30, 31, 32}.isdisjoint(r.doc_id for r in kept)


def test_language_without_labels(spark):
    docs = _language_docs(spark, 12)
    assert {r.lang_pred for r in language.identify(docs.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()} == {"und"}
    assert language.identify(docs.limit(0)).collect() == []


def test_document_frequencies_cover_all_rows(spark):
    docs = _language_docs(spark, 90)
    df, n = language.document_frequencies(docs)
    want = sum((language.ngram_counts(r.text) > 0).astype(int) for r in docs.collect() if language.ngram_counts(r.text) is not None)
    assert (df == want).all() and n == 90 + 4


def test_temperature():
    rng = np.random.default_rng(3)
    logits = rng.normal(0, 1, (500, 3))
    truths = [int(rng.choice(3, p=language.softmax(x))) for x in logits]
    assert language.fit_temperature(list(4 * logits), truths) == pytest.approx(4, rel=0.35)
    assert language.fit_temperature([], []) == 1
