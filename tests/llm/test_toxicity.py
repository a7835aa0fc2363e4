import random

from tendril.llm import toxicity
from tendril.llm.toxicity import FIRST, FUZZY, Lexicon, learn_terms, score_toxicity

SCHEMA = "doc_id long, text string, label int, exact string"


def distance(a, b):
    """Edits from a to b, two swapped neighbours being one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[-1] = min(new[-1], rows[-2][j - 2] + 1)
        rows.append(new)
    return rows[-1][-1]


def mistyped(rng, word):
    """Up to two edits, at random."""
    w = list(word)
    for _ in range(rng.randint(0, 2)):
        k = rng.randrange(len(w) + 1)
        if rng.random() < 0.4 and 0 < k < len(w):
            w[k - 1], w[k] = w[k], w[k - 1]
        else:
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "o", "t", "s"])
    return "".join(w)


def test_product_finds_all_words_one_edit_away():
    rng = random.Random(1)
    terms = ["moron", "motor", "worthless", "abc", "ab", "stupid", "idiot", "blockheaded"]
    lexicon = Lexicon([(t, False, 1.0) for t in terms])
    words = {*terms, "idoit", "diiot", "morno", "lbockheaded", "bolckheaded", "wrothless"}
    for _ in range(4000):
        words.add(mistyped(rng, rng.choice(terms)))
    for w in words - {""}:
        near = [t for t in terms if len(t) >= (FUZZY if w[0] == t[0] else FIRST) and distance(w, t) == 1]
        found = lexicon.look(w)
        if w in terms:
            assert found == (terms.index(w), True)
        elif near:
            assert found is not None and not found[1] and terms[found[0]] in near, w
        else:
            assert found is None, w


def test_stems_and_context():
    lexicon = Lexicon([("lowei", True, 2.0), ("idiot", False, 3.0)])
    assert lexicon.look("loweischaft") == (0, True) and lexicon.look("lower") is None and lexicon.look("idi0t") == (1, False)
    abuse, quoted = lexicon.features("you are an idiot and that is all"), lexicon.features('he said "idiot" and that is all')
    assert abuse[0] > quoted[0] > 0 and quoted[2] > 0 == abuse[2]
    assert lexicon.features("") == [0.0] * 6 == lexicon.features("plain words")


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = score_toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    right = sum((r.predicted == 1) == (r.toxic == 1) for r in held) / len(held)
    assert right > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1, "e"), (2, "", 0, "e"), (2, "", 0, "e"), (None, "x" * 100_000, 0, "e")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = score_toxicity(docs, none).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.5}
    assert score_toxicity(docs.limit(0), none).count() == 0


def test_misspelled_stems_and_first_letters():
    rng = random.Random(2)
    terms = [("lowei", True), ("worthl", True), ("idio", True), ("verachtens", False), ("blockheadedness", False), ("stupid", False)]
    lexicon = Lexicon([(t, stem, 1.0) for t, stem in terms])
    words = {"lowi", "loweei", "wrthless", "worhtless", "orthless", "lower", "idoit", "lockheadedness", "xverachtens", "tupid"}
    for _ in range(4000):
        words.add(mistyped(rng, rng.choice(terms)[0] + rng.choice(["", "schaft", "ess", "t"])))
    for w in words - {""}:
        right, near = set(), set()
        for k, (t, stem) in enumerate(terms):
            if w.startswith(t) if stem else w == t:
                right.add((k, True))
            elif stem and len(t) >= FUZZY and w[0] == t[0]:
                heads = [w[:n] for n in range(2, len(w) + 1) if w[n - 1] == t[-1]]
                if any(distance(h[:-1], t[:-1]) == 1 for h in heads):
                    near.add((k, False))
            elif not stem and len(t) >= (FUZZY if w[0] == t[0] else FIRST) and distance(w, t) == 1:
                near.add((k, False))
        found = lexicon.look(w)
        assert found in right if right else found in near if near else found is None, (w, found)


def test_words_under_a_stem_are_learnt(spark):
    toxic = [f"plain {w} text" for w in ("idiotic", "idiocy", "idioten") for _ in range(20)]
    rows = [(t, 1) for t in toxic] + [("plain other text", 0)] * 60
    terms = learn_terms(spark.createDataFrame(rows, "text string, label int"))
    assert ("idio", True) in {t[:2] for t in terms} and {t for t, stem, _ in terms if not stem} == {"idiotic", "idiocy", "idioten"}
    assert Lexicon(terms).look("idotic") is not None and Lexicon(terms).look("idiotic")[1]


def test_masked_terms():
    lexicon = toxicity.Lexicon([("idiot", False, 3.0), ("lowei", True, 2.0)])
    for text in ("you 1diot!", "an id1ot", "i-d-i-o-t", "1d*i*0t", "so l0weish", "i.d.i.o.t."):
        features = dict(zip(toxicity.FEATURES, lexicon.features(f"some words {text} and more"), strict=True))
        assert features["misspelled"] > 0 and features["exact"] == 0, text
    for text in ("2024-10-11", "a.b.c.d", "well-being 3.5 times", "....", "____", "@$!|"):
        assert not any(lexicon.features(text)), text
