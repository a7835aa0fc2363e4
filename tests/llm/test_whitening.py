import math

import numpy as np
import pytest

from tendril.llm import whitening
from tendril.llm.whitening import subspace, whiten

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def brute(vectors):
    """Exact deviations, and the components of numpy's solver."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return deviations, centred, values[::-1], axes[:, ::-1]


def check(rows, ids, vectors, k=8):
    deviations, centred, values, axes = brute(vectors)
    k = min(k, len(values))
    got = {}
    for r in rows:
        got.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(got) == list(range(1, k + 1)) and len(rows) == k * len(vectors)
    for c in range(1, k + 1):
        want = centred @ axes[:, c - 1] / math.sqrt(values[c - 1])
        own = np.array([got[c][i].pop(0).whitened if len(got[c][i]) == 1 else got[c][i][0].whitened for i in ids])
        sign = np.sign(own @ want)
        assert np.allclose(own, sign * want, atol=1e-7)
    for i, d in zip(ids, deviations, strict=True):
        assert {r.deviation for r in rows if r.vec_id == i} == {d} and type(d) is int
    assert {r.n for r in rows} == {len(vectors)}
    explained = {r.component: r.explained for r in rows}
    assert np.allclose([explained[c] for c in sorted(explained)], values[:k] / values.sum(), rtol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_matches_the_dense_solver(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((300, 20)) * np.linspace(3, 1, 20) + 0.5).astype(np.float32).tolist()
    bad = [(1000, None), (1001, [1.0] * 19 + [None]), (1002, [float("nan")] * 20), (1003, [float("inf")] + [0.0] * 19), (1004, []), (1005, [1.0, 2.0])]
    rows = [*enumerate(vectors), *bad]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(7)
    check(whiten(table).collect(), range(300), vectors)


def test_the_registered_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in table.collect())
    check(whiten(table).collect(), [i for i, _ in rows], [v for _, v in rows])


def test_fewer_dimensions_than_components_repeats_and_null_ids(spark):
    vectors = [[0.5, -1.0, 2.0], [0.25, 3.0, -1.0], [4.0, 0.0, 0.125], [0.5, -1.0, 2.0], [-2.0, 1.0, 1.0]]
    table = spark.createDataFrame([(i, v, None, None) for i, v in zip([1, None, 1, 2, 3], vectors, strict=True)], SCHEMA)
    rows = whiten(table).collect()
    assert len(rows) == 15 and sum(r.vec_id is None for r in rows) == 3
    assert {r.deviation for r in rows} == set(brute(vectors)[0])


def test_no_variance_and_empty_tables(spark):
    for rows in ([], [(1, None, "", "")], [(1, [2.0, 3.0], "", "")], [(k, [2.0, 3.0], "", "") for k in range(4)]):
        out = whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = whiten(spark.createDataFrame([(k, [float(k), 1.0, 2.0 * k], "", "") for k in range(9)], SCHEMA)).collect()
    assert {r.component for r in flat} == {1}


def test_too_large_entries_raise(spark):
    table = spark.createDataFrame([(1, [1e30], "", ""), (2, [0.0], "", "")], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        whiten(table).collect()


@pytest.mark.parametrize("size, kept", [(200, 12), (200, 3), (60, 2), (17, 12), (5, 12)])
def test_subspace_settles_on_flat_and_tied_spectra(monkeypatch, size, kept):
    """Far below the full width, with restarts, and with equal eigenvalues."""
    monkeypatch.setattr(whitening, "KEPT", kept)
    rng = np.random.default_rng(size)
    axes = np.linalg.qr(rng.standard_normal((size, size)))[0]
    for spectrum in (np.linspace(2, 1, size), np.r_[np.full(min(4, size), 7.0), rng.random(size)[4:]], np.geomspace(1e6, 1e-3, size), np.r_[np.ones(2), np.zeros(size - 2)]):
        spectrum = np.sort(spectrum[:size])[::-1]
        matrix, passes = (axes * spectrum) @ axes.T, []
        values, vectors = subspace(lambda q, m=matrix, p=passes: (p.append(q.shape[1]), m @ q)[1], size, 8)
        k = min(8, size)
        assert np.allclose(values, spectrum[:k], rtol=1e-9, atol=1e-9 * spectrum[0])
        assert np.linalg.norm(matrix @ vectors - vectors * values) < 1e-11 * spectrum[0]
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12) and max(passes) <= 16
