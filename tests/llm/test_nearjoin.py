import random
import re

import numpy as np

from tendril.llm import nearjoin
from tendril.llm.components import components
from tendril.llm.nearjoin import drop_near_copies, near_dedup

SCHEMA = "doc_id long, text string, lang string, n long, rep string"


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent=80):
    sets = {i: shingle_set(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    holds = {}
    for i, s in sets.items():
        for x in s:
            holds.setdefault(x, []).append(i)
    shared = {}
    for ids in holds.values():
        for k, i in enumerate(ids):
            for j in ids[:k]:
                shared[i, j] = shared.get((i, j), 0) + 1
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((top(i), top(j)))
            up[b] = a
    return {i: (len(s), top(i), i == top(i)) for i, s in sets.items()}


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "r") for i, t in rows], SCHEMA)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows, i = [], 0
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 150))]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 14))):
                edited[rng.randrange(len(base))] = rng.choice(words)
            rows.append((i, " ".join(edited)))
            i += 1
    big = [rng.choice(words) for _ in range(120)]
    for _ in range(150):
        edited = list(big)
        for _ in range(rng.randint(0, 4)):
            edited[rng.randrange(120)] = rng.choice(words)
        rows.append((i, "\n".join(edited)))
        i += 1
    return rows + [(i, ""), (i + 1, None), (i + 2, " \t"), (i + 3, "one"), (i + 4, "One"), (i + 5, "x" * 100_000)]


def test_matches_brute_force(spark):
    for seed, size in ((1, 2), (2, 5)):
        rows = corpus(seed)
        assert result(near_dedup(make(spark, rows), size=size)) == brute(rows, size)


def test_branching_on_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "NODE", 1)
    rows = corpus(3)
    assert result(near_dedup(make(spark, rows), size=2)) == brute(rows, 2)


def test_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "GRID", 3)
    monkeypatch.setattr(nearjoin, "COPIES_GRID", 1)
    monkeypatch.setattr(nearjoin, "BLOCK", 8)
    rows = corpus(4)
    assert result(near_dedup(make(spark, rows), size=2)) == brute(rows, 2)


def test_blocks_bounded_by_shingles_match_brute_force(spark, monkeypatch):
    for name, value in {"NODE": 1, "GRID": 1, "COPIES_GRID": 1, "ELEMENTS": 900}.items():
        monkeypatch.setattr(nearjoin, name, value)
    rows = corpus(5)
    assert result(near_dedup(make(spark, rows), size=2)) == brute(rows, 2)


def test_overlaps():
    sets = [np.unique(np.random.default_rng(k).integers(0, 60, 25)).astype(np.uint64) for k in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert nearjoin.overlaps(sets[:4], sets[4:]).tolist() == want


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(near_dedup(docs, size=2)) == brute([(r.doc_id, r.text) for r in docs.collect()], 2)


def test_empty_and_repeated_rows(spark):
    assert near_dedup(make(spark, [])).count() == 0
    docs = make(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f")])
    got = sorted(map(tuple, near_dedup(docs).drop("text_hash").collect()), key=str)
    assert got == sorted([(5, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (None, 2, None, True)], key=str)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "None"]


def test_components_of_a_chain(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.u: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def test_large_nodes_keep_their_recall(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "NODE", 0)
    rng, rows = random.Random(8), []
    common = [f"c{k}" for k in range(38)]  # words that all pairs share, so that most of a pair's nodes are large
    for k in range(700):  # pairs at exactly 0.8, below it to all others
        own = [f"w{rng.getrandbits(40)}" for _ in range(12)]
        rows += [(2 * k, " ".join(common + own[:7])), (2 * k + 1, " ".join(common + own[5:]))]
    got = result(near_dedup(make(spark, rows), size=1))
    assert [k for k in range(700) if got[2 * k + 1][1] != 2 * k] == []


def test_rows_that_share_an_id_stand_for_themselves(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, c + " tail"), (8, b), (1, c), (1, "lone words of one"), (None, a), (None, None), (4, None), (4, "")]
    got = sorted(map(tuple, near_dedup(make(spark, rows), size=2).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    want = [(3, 19, 3, True), (5, 19, 3, False), (5, 19, 5, True), (8, 19, 5, False), (1, 19, 1, True), (9, 20, 1, False), (1, 3, 1, True), (None, 19, None, True), (None, 0, None, True), (4, 0, 4, True), (4, 0, 4, True)]
    assert got == sorted(want, key=str)
    docs = make(spark, rows)
    kept = drop_near_copies(docs, size=2)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, a), (5, b), (1, c), (1, "lone words of one"), (None, a), (None, None), (4, None), (4, "")], key=str)
