import hashlib
import random

from tavola.llm import lines

ROWS = "doc_id long, text string, n_lines string"


def _brute(rows, min_chars=40, min_docs=5):
    space = " \t\n\x0b\x0c\r"
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(space))
    docs = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                docs.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        order = lambda d: (d is not None, d or 0)
        kept = [x for x in parts if not (len(docs.get(key(x), ())) >= min_docs and i != max(docs[key(x)], key=order))]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def _check(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "extra") for i, t in rows], ROWS)
    found = lines.dedup_lines(docs, **how)
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()], key=repr) == _brute(rows)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    pool = [("Ä" if k % 3 else "X") + f"{k:02d}" + "line " * rng.randint(6, 9) for k in range(12)] + ["short", "", " ", "É" * 40, "é" * 40, "K" * 40, "K" * 40]

    def shaped(s):
        return rng.choice(["", " ", "\t", "\r"]) + (s.upper() if s.isascii() and rng.random() < 0.3 else s) + rng.choice(["", "\x0b", "\x0c "])

    rows = [(i, "\n".join(shaped(s) for s in rng.choices(pool, k=rng.randint(0, 9)))) for i in range(60)]
    rows += [(1000 + i, pool[0]) for i in range(40)] + [(None, pool[0] + "\n" + pool[1]), (None, pool[2]), (70, None), (71, ""), (5, rows[5][1]), (5, pool[3] + "\nx")]
    for batches, fanout in ((1, 2), (4, 2), (5, 3)):
        _check(spark, rows, batches=batches, fanout=fanout)


def test_long_texts_and_empty_tables(spark):
    line = "the same line of forty characters or more, here"
    rows = [(i, "\n".join([line, f"own {i}"] * 3000)) for i in range(6)]
    _check(spark, rows)
    _check(spark, [])


def _batch(spark, k):
    return spark.range(k * 10, k * 10 + 20).selectExpr("id AS h1", "id AS h2", "1L AS n_docs", f"{k}L AS last_doc")


def test_runs_hold_each_hash_once(spark, tmp_path):
    runs = lines.LineRuns(spark, str(tmp_path / "state"), fanout=2)
    for k in range(5):
        runs.add(_batch(spark, k))
        keys = [r.h1 for level in runs.levels for run in level for r in run.collect()]
        assert len(keys) == len(set(keys)) == k * 10 + 20
        assert all(len(level) < 2 for level in runs.levels)
    got = {r.h1: (r.n_docs, r.last_doc) for r in runs.totals().collect()}
    assert len(got) == 60 and got[0] == (1, 0) and got[15] == (2, 1) and got[59] == (1, 4)
    assert {r.h1 for r in runs.totals(2).collect()} == set(range(10, 50))


def test_state_is_reopened(spark, tmp_path):
    """A state that another object wrote takes the next batch, and its folder holds only what the manifest names."""
    path = str(tmp_path / "state")
    for k in range(7):
        lines.LineRuns(spark, path, buckets=4, fanout=3).add(_batch(spark, k))
    again = lines.LineRuns(spark, path)
    assert {r.h1: (r.n_docs, r.last_doc) for r in again.totals().collect()} == {i: (1 + (10 <= i < 70), min(i // 10, 6)) for i in range(80)}
    state = again._state
    assert state["buckets"] == 4 and {p.name for p in (tmp_path / "state").iterdir() if p.is_dir()} == {*state["increments"], *(t for level in state["levels"] for t in level)}
    assert spark.catalog.listTables() == []


def test_old_runs_are_neither_moved_nor_sorted(spark, tmp_path):
    """The plan of a merge-anti-join reads the runs' buckets in order; the session's settings stay as they were."""
    runs = lines.LineRuns(spark, str(tmp_path / "state"), buckets=4, fanout=4)
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, None)
    for k in range(3):
        runs.add(_batch(spark, k))
    assert spark.conf.get(key, None) == before
    with lines._merging(spark):
        stored = runs._read(runs._state["levels"][0][0])
        plan = runs.fresh(stored)._jdf.queryExecution().executedPlan().toString()
        totals = runs._with_increments(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and "Sort [" not in plan
    assert totals.count("SortMergeJoin") == 2 and "Exchange" not in totals and "Sort [" not in totals


def test_query_columns(spark, tmp_path):
    from tavola.llm.queries import op6_line_dedup

    line = "x" * 40
    spark.createDataFrame([(i, line, "u") for i in range(5)], ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.kept_sha256 for r in op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got[4] == hashlib.sha256(line.encode()).hexdigest() and got[0] == hashlib.sha256(b"").hexdigest()


def test_clashing_columns(spark):
    line = "y" * 40
    docs = spark.createDataFrame([(i, line, "n", "k") for i in range(5)], "doc_id long, text string, pos string, h1 string")
    assert {r.doc_id: (r.pos, r.n_dropped) for r in lines.dedup_lines(docs).collect()} == {**{i: ("n", 1) for i in range(4)}, 4: ("n", 0)}
