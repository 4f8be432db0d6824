import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tavola.llm import pii
from tavola.llm.queries import op3_pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and _luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def _check(spark, tmp_path, texts):
    path = str(tmp_path / str(random.random()))
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, extra string").write.parquet(f"{path}/documents.parquet")
    rows = {r.doc_id: r for r in op3_pii(spark, path).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), repr(t)
        assert [rows[i][f"n_{k}"] for k in RULES] == [sum(w.startswith(k + ":") for w in want) for k in RULES]
        assert set(want) <= set(rows[i].spans.split(",")) if want else True
    return rows


def test_matches_the_rules(spark, tmp_path):
    rng = random.Random(1)
    bits = ["a@b.c", "@", ".", "x.y@z-1.com", "1.2.3.4", "255", "256", ".1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", " ", "-", "+", "+1 (555) 555-0100", "(", ")", "é", "😀", "_", "%", "a", "Z9", "0", "00000000000000000000012.1.1.1", "\n", "\t", "12", "+49", "--", "..", "a@b.c._x@d.e"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(600)]
    texts += [None, "", " ", "😀 a@b.c 😀 1.2.3.4 4111111111111111 +1 555 555 0100", "1.2.3.4.5.6.7.8", "999.1.1.1.1", "+1+2 3 4 5 6 7 8 9 0"]
    _check(spark, tmp_path, texts)


def test_very_long_texts(spark, tmp_path):
    """The plain rules take quadratic time on the longest runs, so what these hold is stated."""
    texts = ["1" * 3000, "a" * 3000 + "@b.c", "1." * 20_000, "+1" * 20_000, "a.b@" * 10_000, "A1_" * 2000, "x a@b.cd 10.0.0.1\n" * 3000]
    _check(spark, tmp_path, texts)
    long = ["1" * 200_000, "1 " * 100_000, "a" * 200_000, "a" * 100_000 + "@b.c", "+1 (" + "(" * 100_000, "A1_" * 60_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r.doc_id: [r[k] for k in pii.KINDS] for r in pii.find_pii(docs).collect()}
    assert {i for i, found in got.items() if any(found)} == {3} and [tuple(x) for x in got[3][0]] == [(0, 100_004)]


def _digits(rng, n):
    return "".join(rng.choices("0123456789", k=n))


def _card(rng, n=15, prefix="34"):
    body = prefix + _digits(rng, n - len(prefix) - 1)
    return next(body + c for c in "0123456789" if _luhn(body + c))


def _planted(rng, kind):
    """A text with one span of a kind, whether it is personal data, and the span."""
    word = lambda: rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "quis"])
    user, host = rng.choice(["ann.lee", "j_doe42", "info", "bob.k"]), rng.choice(["mail", "example", "corp-x"])
    true = {
        "email": [f"{user} at {host} dot {rng.choice(['com', 'org', 'net'])}", f"{user}(at){host}.de", f"{user} [at] {host} [dot] org"],
        "phone": [f"({_digits(rng, 3)}) 555-{_digits(rng, 4)}", f"212-555-{_digits(rng, 4)}", f"030 {_digits(rng, 4)} {_digits(rng, 4)}"],
        "card": [_card(rng), _card(rng, 14, "36")],
        "secret": ["ghp_" + rng.randbytes(14).hex() + "aZ", rng.randbytes(20).hex(), "sk-" + rng.randbytes(15).hex() + "Q"],
        "name": [f"{rng.choice(['Maria', 'John', 'José', 'René'])} {rng.choice(['García', 'Miller', 'Ødegaard'])}"],
    }[kind]
    false = {
        "email": [f"{word()} at {word()}.{word()}"],
        "phone": [f"{_digits(rng, 4)}.{_digits(rng, 4)}.{_digits(rng, 4)}"],
        "card": [_digits(rng, 13) + "1"],
        "secret": ["a-very-long-hyphenated-word-of-1-kind", "version-2-of-the-module-name"],
        "name": [f"{rng.choice(['Quite', 'Very', 'Other'])} {rng.choice(['Different', 'Words', 'Things'])}"],
    }[kind]
    lead = {"email": ["mail: ", "write to ", "and "], "phone": ["phone: ", "call ", "and "], "card": ["card no ", "amex ", "and "], "secret": ['token = "', "api_key=", "and "], "name": ["Dear ", "contact: ", "name is ", "and "]}[kind]
    good = rng.random() < 0.5
    value = rng.choice(true if good else false)
    if kind == "card" and not good and _luhn(value):
        value = value[:-1] + str((int(value[-1]) + 1) % 10)
    before = f"{word()} {word()} " + (rng.choice(lead) if good else "ver " if kind == "phone" else "and ")
    return before + value + ('" ' if before.endswith('"') else " ") + word(), good, f"{kind}:{len(before)}:{len(before) + len(value)}"


def test_planted_spans_of_held_out_documents(spark):
    """Learnt without labels from half of the documents, precision and recall by kind on the other half."""
    rng = random.Random(11)
    docs, truth = [], {}
    kinds = ("email", "phone", "card", "secret", "name")
    for i in range(1500):
        kind = kinds[i % 5]
        text, good, span = _planted(rng, kind)
        docs.append((i, text))
        truth[i] = kind, good, span
    df = spark.createDataFrame(docs, "doc_id long, text string")
    counts = pii.pattern_counts(pii.candidates(df.where("doc_id % 2 = 0")))
    weights = pii.span_classifiers(counts)
    got = {r.doc_id: r.s.split(",") for r in pii.find_pii(df.where("doc_id % 2 = 1"), weights).select("doc_id", pii.span_text(True).alias("s")).collect()}
    figures = {}
    for kind in kinds:
        mine = [i for i in got if truth[i][0] == kind]
        hit = sum(truth[i][1] and truth[i][2] in got[i] for i in mine)
        wrong = sum(x.startswith(kind) and not (truth[i][1] and x == truth[i][2]) for i in mine for x in got[i])
        figures[kind] = hit / max(1, hit + wrong), hit / max(1, sum(truth[i][1] for i in mine))
    print(figures)
    assert all(p >= 0.9 and r >= 0.8 for p, r in figures.values()), figures
    for kind in kinds:  # several vote patterns each, and reliabilities that the data have moved
        votes = {}
        for (k, v, _), n in counts.items():
            if k == kind:
                votes[v] = votes.get(v, 0) + n
        share, hits, false, post = pii.reliabilities(votes, kind)
        assert len(votes) >= 3 and max(post.values()) > 0.8 and min(post.values()) < 0.4
        assert max(abs(hits - pii.FIRST_HITS.get(kind, pii.FIRST_HITS[""]))) > 0.02 and all(hits + 1e-9 >= false - 0.2)


def test_one_vote_pattern_is_enough(spark):
    """Where all candidates of a kind look alike there is nothing to compare them with, and what is taken of the labelers decides."""
    rng = random.Random(12)
    docs = [(i, f'words and token = "{rng.randbytes(20).hex()}" end') for i in range(160)] + [(500 + i, "Quite Different words follow") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: [x.kind for x in r.accepted] for r in pii.find_pii(df).collect()}
    assert all(got[i] == (["secret"] if i < 500 else []) for i in got)


def test_names_after_capitalised_words(spark):
    texts = ["Yesterday Maria García called", "My name is José García and", "Dear Mr Miller, hello", "Quite Different words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][x.s : x.e] for x in r.extra if x.kind == "name"] for r in pii.candidates(docs).collect()}
    assert found == {0: ["Maria García"], 1: ["José García"], 2: ["Miller"], 3: ["Quite Different"]}


def test_em_tells_reliable_labelers():
    """Drawn from known reliabilities, which EM comes near to."""
    rng = random.Random(3)
    hits, false = (0.95, 0.7, 0.4, 0.6, 0.9), (0.3, 0.2, 0.02, 0.01, 0.5)
    counts, true = {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.4
        votes = sum((rng.random() < p) << i for i, p in enumerate(hits if y else false))
        counts[votes] = counts.get(votes, 0) + 1
        true[votes] = true.get(votes, 0) + y
    share, hit, wrong, post = pii.reliabilities(counts, "secret")
    assert abs(share - 0.4) < 0.15 and max(abs(hit - np.array(hits))) < 0.15 and max(abs(wrong - np.array(false))) < 0.15
    right = sum(n for v, n in counts.items() if (post[v] >= 0.5) == (true[v] / n >= 0.5))
    assert right / 20_000 > 0.9
    assert pii.span_classifiers({}) == {}


def test_luhn_and_empty_tables(spark):
    got = spark.createDataFrame([("4111111111111111",), ("4111111111111112",), ("0",)], "d string").select(pii.luhn(F.col("d"))).collect()
    assert [r[0] for r in got] == [True, False, True]
    docs = spark.createDataFrame([(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c")], "doc_id long, text string")
    assert pii.find_pii(docs).count() == 3 and pii.find_pii(docs.limit(0)).collect() == []


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = pii.find_pii(docs)._jdf.queryExecution().toString() + pii.candidates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
