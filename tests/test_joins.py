"""Filter joins against all pairs."""

import itertools
import random

from tendril.functions.similarity import name_score
from tendril.operators.containment import containing
from tendril.operators import fuzzyjoin
from tendril.operators.fuzzyjoin import candidate_pairs, close_pairs

LETTERS = "абвгдежзиклмнопрст"


def names(seed, n):
    """Names in clusters: words swapped, dropped, repeated, mistyped, joined."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 11))) for _ in range(60)]
    out = []
    while len(out) < n:
        words = [rng.choice(pool) for _ in range(rng.randint(1, 9))]
        for _ in range(rng.randint(1, 5)):
            own = list(words)
            for _ in range(rng.randint(0, 2)):
                k, how = rng.randrange(len(own)), rng.random()
                if how < 0.35:
                    at = rng.randrange(len(own[k]) + 1)
                    own[k] = own[k][:at] + rng.choice(["", rng.choice(LETTERS)]) + own[k][at + rng.randint(0, 1) :]
                elif how < 0.5 and len(own) > 1:
                    own.pop(k)
                elif how < 0.65:
                    own.insert(k, own[rng.randrange(len(own))])
                elif how < 0.8:
                    rng.shuffle(own)
                elif len(own) > 1 and k:
                    own[k - 1 : k + 1] = [own[k - 1] + own[k]]
                else:
                    own.append(rng.choice("аб"))
            out.append((" " * rng.randint(1, 2) if rng.random() < 0.1 else " ").join(w for w in own if w))
    return [x for x in out if x][:n]


def test_close_pairs_equal_all_pairs(spark):
    found = 0
    for seed in range(3):
        q, c = names(seed, 160), names(seed, 260)[60:] + names(seed + 100, 60)
        asked, held = (spark.createDataFrame([(x,) for x in [*v, ""]], f"{n} string") for v, n in ((q, "query"), (c, "choice")))
        for threshold in (95, 91):
            got = {(r.query, r.choice): r.score for r in close_pairs(asked, held, threshold).collect()}
            want = {(a, b): s for a in set(q) for b in set(c) if (s := name_score(a, b)) >= threshold}
            assert got == want
            found += len(want) - sum(a == b for a, b in want)
    assert found > 1_000


def test_few_pairs_are_scored_and_none_in_a_nested_loop(spark):
    q = names(7, 300)
    asked, held = (spark.createDataFrame([(x,) for x in q], f"{n} string") for n in ("query", "choice"))
    met = candidate_pairs(asked, held)
    assert met.count() < 0.2 * len(set(q)) ** 2
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_of_a_few_words_meet_few(spark):
    """All names share their rare trigrams with many; their letters part them."""
    pools = [["small", "red", "blue", "heavy", "light", "round"], ["ring", "widget", "bolt", "gear", "valve"], ["ECONOMY", "SMALL", "PROMO"], [f"Brand#{k}" for k in range(10)]]
    made = [" ".join(w).lower() for w in itertools.product(*pools)]
    bags = fuzzyjoin._bags(spark.createDataFrame([(x,) for x in made], "text string"), 95)
    assert fuzzyjoin._met(bags, bags, 95).select("query", "choice").distinct().count() < 0.02 * len(made) ** 2


def test_containing_equals_the_nested_loop(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("аб в") for _ in range(rng.randint(0, 14))) for _ in range(300)] + [None, "ооо «весы»"]
    patterns = ["".join(rng.choice("аб в") for _ in range(rng.randint(0, 6))) for _ in range(120)] + [None, "весы", "яяя", "ы»"]
    held, asked = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    pairs = containing(held, asked)
    want = {(t, p) for t in texts for p in patterns if t and p and p in t}
    got = pairs.collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
