import hashlib
import re

from tendril.llm.exact import drop_copies, exact_dedup, merge_round, merge_runs

SCHEMA = "doc_id long, text string, lang string, kept string, run string"


def brute(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), m == best, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], SCHEMA)


ROWS = [(3, "a b"), (1, "ab"), (2, "a  b\n"), (4, None), (5, ""), (6, " \t"), (None, "z"), (7, "z"), (8, "é" * 50_000), (9, "é" * 50_000), (10, "A b")]


def test_matches_brute_force(spark):
    for parts in (1, 5):
        got = exact_dedup(frame(spark, ROWS).repartition(parts), fan_in=2).collect()
        assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_repeated_rows_keep_one(spark):
    rows = [(1, "same")] * 40 + [(2, "other")]
    docs = frame(spark, rows).repartition(7)
    got = exact_dedup(docs).collect()
    assert sum(r.kept for r in got) == 2 and {r.group_size for r in got} == {40, 1}
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_empty_table(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def test_drop_copies_keeps_rows_without_id(spark):
    docs = frame(spark, ROWS)
    assert sorted((str(r.doc_id) for r in drop_copies(docs).collect())) == sorted(["2", "6", "7", "8", "10"])


def test_merge_runs_keeps_the_smallest(spark):
    runs = spark.sql("SELECT int(id % 29) run, unhex(hex(id % 4)) sha, id % 4 probe, 1 n_bytes, struct(id) best, 1L n FROM range(1000)")
    for fan_in in (2, 3, 8):
        got = merge_runs(runs, 29, fan_in).collect()
        assert sorted((r.probe, r.best.id, r.n) for r in got) == [(k, k, 250) for k in range(4)]


def test_rounds_are_binomial(spark):
    """In each round an entry moves to a run that differs in one digit, and no
    run receives a key from more than ``fan_in`` others; runs come out sorted."""
    runs = spark.sql("SELECT int(id % 27) run, unhex(hex(id % 7)) sha, id % 7 probe, 1 n_bytes, struct(id) best, 1L n FROM range(27 * 7)")
    before = {(r.run, r.probe) for r in runs.collect()}
    for k in range(3):
        runs = merge_round(runs, k, 3, 3)
        after = runs.collect()
        for r in after:
            sources = [run for run, probe in before if probe == r.probe and run // 3 ** (k + 1) == r.run // 3 ** (k + 1) and run % 3**k == r.run % 3**k]
            assert r.n == 3 ** (k + 1) and len(sources) == 3
        before = {(r.run, r.probe) for r in after}
        assert "SortAggregate" in runs._jdf.queryExecution().executedPlan().toString()
    assert len(before) == 7


def test_clashing_columns_keep_their_values(spark):
    docs = spark.createDataFrame([(1, "x", "keep-me", "a", 7, 8), (2, "x ", "b", "c", 9, 10), (3, "x", "d", "e", 1, 2)], "doc_id long, text string, id string, sha string, points long, nth long")
    assert [tuple(r) for r in drop_copies(docs).collect()] == [(2, "x ", "b", "c", 9, 10)]
