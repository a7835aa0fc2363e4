import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tendril.llm import fingerprints as fp
from tendril.llm.fingerprints import PrefixHashes, codes_of, common_start, compare_with_next, fingerprint, fingerprints, likeness

SCHEMA = "doc_id long, text string, hash string, guest string, place string"


def brute(rows, hashes):
    """(doc_id, n_chars, edited sha, fingerprint, edited fingerprint, likenesses, common starts) of every row."""
    key = lambda k: (rows[k][0] is not None, rows[k][0] or 0, hashes[k])
    keys = sorted({key(k) for k in range(len(rows))}, reverse=True)
    text_of = {key(k): rows[k][1] or "" for k in range(len(rows))}
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", text_of[keys[(keys.index(key(k)) + 1) % len(keys)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, other = slow(text), slow(edited), slow(after)
        same = lambda a, b: next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, alike(own, changed), alike(own, other), same(text, edited), same(text, after)))
    return sorted(out, key=repr)


def span_hash(codes):
    out = 0
    for base in fp.BASES:
        out = out << 31 | sum((c + 1) * pow(base, i, fp.PRIME) for i, c in enumerate(codes)) % fp.PRIME
    return out


def slow(text):
    """The fingerprint by plain integers."""
    codes = [ord(c) for c in text]
    spans = [codes[i : i + fp.WINDOW] for i in range(max(len(codes) - fp.WINDOW, 0) + 1)] if codes else []
    mix = lambda x: int(fp.kernel.mix(np.array([x], np.uint64))[0])
    least = [2**64 - 1] * fp.SLOTS
    for s in spans:
        mixed = mix(span_hash(s) ^ mix(len(s)))
        least[mixed >> 58] = min(least[mixed >> 58], mixed & (1 << 58) - 1)
    return f"{len(codes):x}-{span_hash(codes):016x}-" + "".join("...." if x == 2**64 - 1 else f"{x & 65535:04x}" for x in least)


def alike(a, b):
    if a == b:
        return 1.0
    slots = lambda t: [t[-256:][i : i + 4] for i in range(0, 256, 4)]
    pairs = [(x, y) for x, y in zip(slots(a), slots(b), strict=True) if x != "...." or y != "...."]
    return sum(x == y for x, y in pairs) / max(len(pairs), 1)


ROWS = [
    (5, "the quick brown fox jumps over the lazy dog"), (9, "the quick brown cat sleeps under the lazy dog all day"), (2, None), (7, ""), (3, "é🙂" * 40), (3, "other text of three"),
    (3, "other text of three"), (None, "no id"), (None, "no id either"), (11, "a"), (12, "the quick brown fox jumps over the lazy dog"), (1, "x" * 3000), (0, "\x00\x00ab"),
]


def run(spark, rows, parts=4):
    docs = spark.createDataFrame([(i, t, "h", "g", "p") for i, t in rows], SCHEMA)
    hashes = [r[0] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("xxhash64(t)").collect()]
    got = sorted(map(tuple, compare_with_next(docs.repartition(parts)).collect()), key=repr)
    return got, brute(rows, hashes)


def test_matches_brute_force(spark):
    for parts in (1, 6):
        got, want = run(spark, ROWS, parts)
        assert got == want


def test_one_row_and_none(spark):
    got, want = run(spark, [(4, "alone here")])
    assert got == want and got[0][6] == 1.0
    assert compare_with_next(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_row_that_is_repeated_most(spark):
    rows = [(50, "hot row of many")] * 300 + [(k, f"text number {k} of a few") for k in range(100)]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA)
    out = compare_with_next(docs.repartition(5))
    got, want = run(spark, rows, 5)
    assert got == want
    sizes = [r.n for r in out.groupBy(fp.F.spark_partition_id()).agg(fp.F.count("*").alias("n")).collect()]
    assert max(sizes) < 150  # spread over several tasks


def test_ids_must_be_whole_numbers(spark):
    import pytest

    with pytest.raises(TypeError):
        compare_with_next(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_fingerprint_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "abc", "mine"), (2, None, "yours")], "doc_id long, text string, fingerprint string")
    got = fingerprint(docs).collect()
    assert [r.fingerprint for r in got] == ["mine", "yours"] and [r["_fingerprint"] for r in got] == fingerprints(["abc", ""])


def test_long_texts_by_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 101, n))) for n in (0, 5, 15, 16, 64, 65, 79, 80, 81, 300, 1000)]
    whole = fingerprints(texts)
    other = [t[:k] + "Z" + t[k:] for k, t in zip((0, 3, 15, 7, 63, 64, 70, 79, 80, 129, 999), texts, strict=True)]
    starts = common_start(texts, other).tolist()
    monkeypatch.setattr(fp, "SLAB", 64)
    assert fingerprints(texts) == whole == [slow(t) for t in texts]
    assert common_start(texts, other).tolist() == starts == [0, 3, 15, 7, 63, 64, 70, 79, 80, 129, 999]


@settings(max_examples=60, deadline=None)
@given(st.text("ab\U0001f642", min_size=1, max_size=60), st.data())
def test_spans_and_extensions(text, data):
    hashes, n = PrefixHashes(codes_of(text)), len(text)
    a, b = data.draw(st.integers(0, n - 1)), data.draw(st.integers(0, n - 1))
    most = n - max(a, b)
    length = data.draw(st.integers(0, most))
    assert bool(hashes.equal(np.array([a]), np.array([b]), np.array([length]))[0]) == (text[a : a + length] == text[b : b + length])
    want = next((i for i in range(most) if text[a + i] != text[b + i]), most)
    assert hashes.extension(np.array([a]), np.array([b]), np.array([most]))[0] == want
    assert hashes.span(np.array([a]), np.array([a + length]))[0] == span_hash([ord(c) for c in text[a : a + length]])


def test_likeness_tells_halves_copies_and_strangers():
    rng = np.random.default_rng(2)
    a, b = (" ".join(f"w{x}" for x in rng.integers(0, 10_000, 800)) for _ in range(2))
    half, near = a[: len(a) // 2] + b[: len(a) // 2], a.replace("w77", "v77")
    own = fingerprints([a])[0]
    found = likeness([own] * 4, fingerprints([a, near, half, b]))
    assert found[0] == 1.0 and found[1] > 0.7 and 0.15 < found[2] < 0.55 and found[3] < 0.1
