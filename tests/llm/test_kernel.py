"""Words that a hash linear in its bytes can't tell apart, in every operator
that goes by hashes of words."""

import sys

import numpy as np
import pyarrow as pa
import pytest

from tendril.llm import kernel, packing, pieces, rules
from tendril.llm.nearjoin import near_dedup
from tendril.llm.shared import tokenizer_path
from tendril.llm.substring import Sentences

sys.path.insert(0, __file__.rsplit("/", 1)[0])

from test_nearjoin import brute as near  # noqa: E402
from test_rules import brute as counts  # noqa: E402


def balanced(letters, size):
    out = letters[0]
    while len(out) < size:
        out += out.translate(str.maketrans(letters, letters[::-1]))
    return out


PAIRS = [(balanced("ab", n), balanced("ba", n)) for n in (1024, 2048, 8192)]
TEXTS = [" ".join(p) for p in PAIRS] + [w + " and " + w for p in PAIRS for w in p] + [f"{a} {b} {a}\n{a}\n{b}\n{a}" for a, b in PAIRS]


def test_hashes_tell_them_apart():
    words = [w for p in PAIRS for w in p]
    s = next(iter(kernel.slabs(pa.array([" ".join(words)]))))
    for key in (0, 1):
        assert len(set(s.hashes(False, key).tolist())) == len(words)
    assert s.hashes(True).tolist() == next(iter(kernel.slabs(pa.array([" ".join(words).upper()])))).hashes(True).tolist()


def test_windows_and_trees():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 3, 4000).astype(np.uint64)
    begin = rng.integers(0, 3900, 3000)
    end = begin + rng.integers(1, 90, 3000)
    owner, place = kernel.ranges(end - begin)
    trees = kernel.tree_hash(values[begin[owner] + place], end - begin)
    groups = {}
    for b, e, one, two in zip(begin, end, kernel.window_hash(values, begin, end).tolist(), trees.tolist(), strict=True):
        groups.setdefault(tuple(values[b:e].tolist()), set()).add((one, two))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


@pytest.mark.parametrize("broken", [False, True])
def test_same_spans_go_by_bytes(monkeypatch, broken):
    if broken:  # every span hashes alike
        monkeypatch.setattr(kernel, "span_hashes", lambda data, starts, ends, *_: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(("one two one " + "x" * 40 + " two one2 " + "x" * 40).encode(), np.uint8)
    s = kernel.slab(data, np.array([0, len(data)]))
    first, group = kernel.same_spans(s.data, s.starts, s.ends, np.array([0, 0, 1, 0, 0, 0, 0]))
    words = [data[a:b].tobytes() for a, b in zip(s.starts, s.ends)]
    assert [words[first[g]] for g in group] == words
    assert len(set(group.tolist())) == len(first) == 5 and group[1] == group[4] and group[3] == group[6] and group[0] != group[2]


def test_tokens_of_both_tokenizers():
    encoder = packing.ChunkEncoder(tokenizer_path("word_bpe_49k.json"))
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(pa.array(TEXTS))]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    v = pieces.Pieces(tokenizer_path("piece_bpe_32k.model"))
    for dropout in (0.0, 0.1):
        rows = list(v.encode(pa.array(TEXTS), np.arange(len(TEXTS), dtype=np.uint64), dropout, 5))
        assert [v.decode(r) for r in rows] == TEXTS


def test_counts():
    got = [rules.slab_counts(s) for s in kernel.slabs(pa.array(TEXTS))]
    rows = [tuple(int(g[c][r]) for c in rules.COUNTS[:5]) for g in got for r in range(len(g["n_words"]))]
    assert rows == [counts(t) for t in TEXTS]


def test_spans_of_sentences():
    a, b = PAIRS[0]
    texts = [f"{w} " + "one two three four five six seven " * 4 + "." for w in (a, b)]
    (s,) = kernel.slabs(pa.array(texts))
    own = Sentences(s, True)
    assert len({(x, y) for x, y in zip(own.h1[own.spans].tolist(), own.h2[own.spans].tolist())}) == own.spans.sum()


def test_shingle_sets(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs, size=2).collect()}
    assert got == near(list(enumerate(TEXTS)), 2)
