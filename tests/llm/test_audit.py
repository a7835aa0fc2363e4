import re
from collections import Counter
from itertools import permutations, product
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tendril.llm import queries
from tendril.llm.audit import FILTERS, filter_audit, zeta

SF = "/root/testdata/sf0.001"
DOCS, LABELS = "doc_id long, text string, lang string, mask int, n string", "doc_id long, quality int, toxic int"


def fails(text, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(
        f
        for f, hit in zip(
            FILTERS,
            [
                len(words) < 200,
                100 * len(set(words)) < 50 * len(words),
                100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                bool(re.search(r"[#$%&*|]", text)),
                smaller,
            ],
            strict=True,
        )
        if hit
    )


def brute(docs, labels):
    texts = {}
    for i, text, *_ in docs:
        texts.setdefault(text or "", []).append(i)
    good, toxic = ({i for i, *l in labels if l[k] == 1 and i is not None} for k in (0, 1))
    parts = {}
    for i, text, lang, *_ in docs:
        others = texts[text or ""]
        smaller = any(o is not None and (i is None or o < i) for o in others)
        parts.setdefault(lang or "", []).append((fails(text or "", smaller), i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        removed = Counter()
        own = []
        for order in map("".join, permutations(FILTERS)):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                removed[f] += len(gone)
                failing = sum(f in r[0] for r in rows)
                own.append((part, order, step, f, len(left), len(gone), failing - len(gone), sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(p, o, s, *rest, removed[f]) for p, o, s, f, *rest in own]
    return sorted(out)


LONG = " ".join(f"w{k}" for k in range(250))
CASES = [
    (1, LONG, "en"), (2, LONG, "de"), (2, LONG, "en"), (2, LONG, "en"), (3, LONG + " #", "en"), (4, None, None), (5, "", ""), (6, " \t\n", "en"),
    (7, "A" * 4 + "b" * 96, "en"), (8, "A" * 3 + "b" * 97, "en"), (9, "same " * 300, "fr"), (10, "Same same " * 150, "fr"), (None, LONG, "en"),
    (None, "lone|", "es"), (None, "lone|", "es"), (11, "é É Ä " * 100, "fr"), (12, "x y " * 250, "fr"), (13, "a b " * 30_000 + "$", "de"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "other") for r in rows], DOCS)


def test_matches_brute_force(spark):
    labels = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (9, None, 1), (None, 1, 1), (77, 1, 1), (4, 1, None)]
    got = filter_audit(frame(spark, CASES).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(tuple, got)) == brute(CASES, labels)


def test_matches_sql(spark):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES["op11_filter_interaction_audit"](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES['op11_filter_interaction_audit']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) % 600 == 0


def test_copies_of_one_text_and_empty_tables(spark):
    rows = [(k, "hot", "en") for k in range(500)]
    none = spark.createDataFrame([], LABELS)
    got = filter_audit(frame(spark, rows).repartition(9), none).filter("filter_order = 'EABCD' AND step = 1").collect()
    assert [(r.kept, r.removed) for r in got] == [(1, 499)]
    assert filter_audit(frame(spark, []), none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_zeta_is_the_sum_over_subsets(seed):
    counts = np.random.default_rng(seed).integers(0, 100, (2, 32))
    want = [[sum(int(row[m]) for m in range(32) if m & s == m) for s in range(32)] for row in counts]
    assert zeta(counts).tolist() == want
    assert all(zeta(counts)[k, 31] == counts[k].sum() for k, _ in product(range(2), [0]))
