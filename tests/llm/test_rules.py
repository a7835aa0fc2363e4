import math
import re
from collections import Counter
from types import SimpleNamespace

from tendril.llm import rules
from tendril.llm.rules import judge, measure

SCHEMA = "doc_id long, text string, lang string, source string, kept string, n_words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(marked))


TEXTS = ["", None, " \n\t ", "one", "a b c a b c", "é|ß é|ß\nx\nx\n x\n\nx", "a b c d\na b c d\r\na b c d", "#" * 5, "a\x0bb\x0cc " * 40, "long word " * 30_000, "\n\n\na\n\n", "ends\n", "w x \x1c y"]


def test_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", "k", "n") for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in measure(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in measure(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def quantile(values, share):
    values = sorted(values)
    return values[max(math.ceil(len(values) * share), 1) - 1]


def exact_verdicts(rows, prior):
    """By document and measure: its value and the exact fences."""
    ratios = {
        "chars_per_word": lambda r: r.word_chars / max(r.n_words, 1),
        "symbols_per_word": lambda r: r.n_symbols / max(r.n_words, 1),
        "dup_lines": lambda r: r.n_dup_lines / max(r.lines, 1),
        "repeat_words": lambda r: r.n_repeat_words / max(r.n_words, 1),
    }
    out = {}
    for m, (lo, hi, times) in rules.FENCES.items():
        groups = {}
        for r in rows:
            if not r.base_failed:
                for key in ((r.lang, r.source), (r.lang,), ()):
                    groups.setdefault(key, []).append(ratios[m](r))
        bounds, top = {}, quantile(groups[()], hi)
        for key in sorted(groups, key=len):  # parents first
            values = groups[key]
            a, b = quantile(values, lo), quantile(values, hi)
            parent = bounds.get(key[:-1]) if key else None
            if b <= a * (1 + 5 * rules.ACCURACY):
                bounds[key] = parent
            elif parent:
                bounds[key] = tuple((len(values) * own + prior * of) / (len(values) + prior) for own, of in zip((a, b), parent, strict=True))
            else:
                bounds[key] = a, b
        for r in rows:
            a, b = next((bounds[k] for k in ((r.lang, r.source), (r.lang,), ()) if bounds.get(k)), (None, None))
            bound = (top - rules.SLACK[m], top + rules.SLACK[m], top) if a is None else (a - times * (b - a), b + times * (b - a), b)
            out[r.doc_id, m] = ratios[m](r), bound, times
    return out


def test_verdict_matches_exact_quantiles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang in ('en', 'fr')")
    rows = judge(docs).collect()
    lines = {r.doc_id: len([x for x in r.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]) for r in docs.collect()}
    rows = [SimpleNamespace(**r.asDict(), lines=lines[r.doc_id]) for r in rows]
    told = exact_verdicts(rows, rules.PRIOR)
    unclear = 0
    for r in rows:
        for m in rules.FENCES:
            value, (low, high, at), times = told[r.doc_id, m]
            error = (1 + 2 * times) * 2 * rules.ACCURACY * max(at, 1e-9)
            if value > high + error or value < low - error:
                assert m in r.beyond or r.base_failed, (r.doc_id, m, value, low, high)
            elif low + error < value < high - error:
                assert m not in r.beyond.split(","), (r.doc_id, m, value, low, high)
            else:
                unclear += 1
        assert r.kept == (not r.base_failed and not r.beyond)
    assert unclear < 0.02 * len(rows) * len(rules.FENCES)
    # Quantiles decide: fences differ between groups, and repetition is caught too.
    assert len({round(told[r.doc_id, "dup_lines"][1][1], 3) for r in rows}) > 3 and len({told[r.doc_id, "chars_per_word"][1][0] for r in rows}) > 5
    assert {m for r in rows for m in r.beyond.split(",") if m} >= {"chars_per_word", "symbols_per_word", "repeat_words"}


def test_documents_marked_bad_go_and_good_ones_stay(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    by = {0: [], 1: []}
    for r in judge(spark.read.parquet(f"{sf}/documents.parquet")).filter("NOT base_failed").join(labels, "doc_id").collect():
        by[r.quality].append(r.kept)
    assert sum(by[1]) > 0.99 * len(by[1]) and sum(by[0]) < 0.02 * len(by[0])


def test_judge(spark):
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(80)), "en" if i % 2 else None, "s", "k", "n") for i in range(500)]
    junk = [(1000 + i, " ".join(f"w{i}x{j}###" for j in range(80)), "en", "s", "k", "n") for i in range(20)]
    short = [(2000, "few words", "fr", None, "k", "n"), (2001, None, None, None, None, None)]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(clean + junk + short + clean[:1], SCHEMA)).collect()}
    assert all(got[i].kept for i in range(500)) and not any(got[1000 + i].kept for i in range(20))
    assert got[2000].base_failed and got[2001].base_failed and not got[2000].kept
    assert not got[1000].base_failed and got[1000].beyond.startswith("symbols_per_word")


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_groups_have_fences_of_their_own(spark):
    """Twelve documents of long words pull their fence, but hardly."""
    rows = [(i, " ".join(f"{'w' * (3 + i % 5)}{i}x{j}" for j in range(60)), "en", "a", "k", "n") for i in range(300)]
    long = [(1000 + i, " ".join(f"{'w' * (24 + i % 5)}{i}x{j}" for j in range(60)), "en", "b", "k", "n") for i in range(12)]
    alone = {r.doc_id: r.kept for r in judge(spark.createDataFrame(rows + long, SCHEMA)).collect()}
    more = [(5000 + i, " ".join(f"{'w' * (24 + i % 5)}{i}y{j}" for j in range(60)), "en", "b", "k", "n") for i in range(3000)]
    many = {r.doc_id: r.kept for r in judge(spark.createDataFrame(rows + long + more, SCHEMA)).collect()}
    assert not any(alone[1000 + i] for i in range(12)) and all(many[1000 + i] for i in range(12))
    assert all(alone[i] for i in range(300))
