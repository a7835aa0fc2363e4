import random
import re

from tendril.llm.substring import ALONE, LONG, WORDS, drop_repeats, substring_dedup

SCHEMA = "doc_id long, text string, lang string, h1 string, id string"


def sentences(text):
    """Lists of (start, end) of words."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    out, cur = [], []
    for k, (a, b) in enumerate(words):
        cur.append((a, b))
        gap = text[b : words[k + 1][0]] if k + 1 < len(words) else "\n"
        if re.search(r"[.!?][\"')\]]?$", text[a:b]) or "\n" in gap:
            out.append(cur)
            cur = []
    parts = []
    for s in out:
        cur = []
        for a, b in s:
            cur.append((a, b))
            if len(s) > LONG and text[b - 1] in ",;":
                parts.append(cur)
                cur = []
        if cur:
            parts.append(cur)
    return parts


def spans(text):
    parts = sentences(text)
    out = []
    for i in range(len(parts)):
        if len(parts[i]) >= ALONE:
            j = i + 1
        else:
            j, n = i, 0
            while j < len(parts) and (n < WORDS or j < i + 2):
                n += len(parts[j])
                j += 1
            if n < WORDS or j < i + 2:
                continue
        out.append((i, j, tuple(text[a:b] for p in parts[i:j] for a, b in p)))
    return parts, out


def brute(rows):
    places = {}
    for doc_id, text in rows:
        for i, _, key in spans(text)[1]:
            places.setdefault(key, []).append((doc_id, i))
    out = {}
    for doc_id, text in rows:
        parts, own = spans(text)
        hit = {k for i, j, key in own if min(places[key]) != (doc_id, i) for k in range(i, j)}
        kept = ""
        at = 0
        for k in range(len(parts)):
            upto = parts[k + 1][0][0] if k + 1 < len(parts) else len(text)
            if k not in hit:
                kept += text[at:upto]
            at = upto
        out[doc_id] = ((kept.rstrip(" \t\n\x0b\x0c\r") if hit else text), len(parts), len(hit))
    return out


def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(2000)]

    def line(n):
        s = [rng.choice(words) for _ in range(n)]
        for k in range(n):
            if rng.random() < 0.15:
                s[k] += rng.choice([".", "!", "?\"", ",", ";", "\n"])
        return " ".join(s) + rng.choice([".", "\n", ". "])

    passages = [line(60) for _ in range(6)] + [" ".join(rng.choice(words) for _ in range(70)) + "."]
    rows = []
    for i in range(80):
        parts = [line(rng.randint(1, 60)) for _ in range(rng.randint(0, 6))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((i, "\n".join(parts)))
    return rows + [(80, None), (81, ""), (82, " \n"), (83, passages[0]), (84, "x" * 70_000 + ". y."), (85, passages[1] * 3)]


def result(frame):
    return {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in frame.collect()}


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", "b") for i, t in rows], SCHEMA)


def test_matches_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    docs = make(spark, rows).repartition(6)
    assert result(substring_dedup(docs)) == want
    assert sum(n for _, _, n in want.values()) > 50
    kept = drop_repeats(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, n, gone) in want.items() if not n or gone < n}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(substring_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_and_repeated(spark):
    assert substring_dedup(make(spark, [])).count() == 0
    text = " ".join(f"w{k}" for k in range(60)) + "."
    rows = [tuple(r) for r in substring_dedup(make(spark, [(3, text), (3, text), (7, text), (None, text)])).select("doc_id", "n_removed").collect()]
    assert sorted(rows, key=str) == [(3, 0), (3, 0), (7, 1), (None, 1)]


def both_ways(text):
    parts, out = sentences(text), set()
    for i in range(len(parts)):
        for way in (1, -1):
            j, n = i, 0
            while 0 <= j < len(parts) and (n < WORDS or abs(j - i) < 2) and not (j != i and len(parts[i]) >= WORDS):
                n += len(parts[j])
                j += way
            if n >= WORDS and (abs(j - i) >= 2 or len(parts[i]) >= WORDS):
                a, b = (i, j) if way > 0 else (j + 1, i + 1)
                out.add((a, b, tuple(text[x:y] for p in parts[a:b] for x, y in p)))
    return parts, sorted(out)


def test_tails_match_brute_force(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setitem(globals(), "spans", both_ways)
    want = brute(rows)
    assert result(substring_dedup(make(spark, rows).repartition(6), tails=True)) == want


def test_planted_passages_go_to_the_last_sentence(spark):
    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n)) + "."
    uneven = f"{line('a', 30)} {line('b', 12)} {line('c', 10)}"
    glued = f"{line('d', 26)} {line('e', 30)}"
    rows = [(k, f"{line(f'x{k}y', 9)} {uneven} {line(f'u{k}v', 40)}") for k in range(3)]
    rows += [(k, f"no stop {k} {glued} {line(f'z{k}w', 9)}") for k in range(5, 8)]
    got = result(substring_dedup(make(spark, rows), tails=True))
    assert [got[k][2] for k in range(3)] == [0, 3, 3] and [got[k][2] for k in range(5, 8)] == [0, 1, 1]
    assert "c9." not in got[1][0] and "e29." not in got[6][0] and "u1v39." in got[1][0]


def test_rows_without_id_are_documents_of_their_own(spark):
    passage = "One two three four five six seven eight nine ten eleven twelve. " + "Thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty and more words in here. "
    rows = [(None, f"Lead {k}. {passage}Tail {k}.") for k in range(30)] + [((1 << 63) - 1, f"Big. {passage}"), (5, passage + "Five.")]
    got = [tuple(r) for r in substring_dedup(make(spark, rows), tails=True).select("doc_id", "text", "n_removed").collect()]
    assert sorted(n for i, _, n in got if i is None) == [2] * 30
    assert {i: n for i, _, n in got if i is not None} == {(1 << 63) - 1: 2, 5: 0}
    got = [tuple(r) for r in substring_dedup(make(spark, rows[:30]), tails=True).select("n_removed").collect()]
    assert sorted(n for (n,) in got) == [0] + [2] * 29
