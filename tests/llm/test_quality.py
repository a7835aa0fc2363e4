import numpy as np
import pyarrow as pa

from tendril.llm import kernel
from tendril.llm.quality import BIAS, SAME, features, score_quality, train

SCHEMA = "doc_id long, text string, label int, score string"


def test_features():
    column = pa.array(["a b a", None, "", "x x x x", "a###", "A b a" * 1])
    (s,) = kernel.slabs(column)
    row, slot, value = features(s)
    assert np.allclose(np.bincount(row, value**2, minlength=6), [1, 0, 0, 1, 1, 1])
    assert (np.diff(row) >= 0).all() and BIAS not in slot
    assert [int(r) for r in row[slot == SAME]] == [3]
    per = np.bincount(row, minlength=6)
    # a, b, ab, ba / - / - / x, same / a, ###, a### / A, b, a, Ab, ba
    assert per.tolist() == [4, 0, 0, 2, 3, 5]


def test_training_separates():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "fine"] if k % 2 else ["bad|", "poor|"], 12)) for k in range(200)]
    w = train(pa.array(texts), np.arange(200) % 2.0, 1)
    scores = []
    for s in kernel.slabs(pa.array(texts)):
        row, slot, value = features(s)
        scores += (np.bincount(row, 8 * value * w[slot], minlength=s.rows) + w[BIAS]).tolist()
    assert all((x > 0) == (k % 2 == 1) for k, x in enumerate(scores))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = [r for r in score_quality(docs, labels).join(labels, "doc_id").collect() if r.held_out]
    y = np.array([r.quality for r in held])
    rank = np.argsort(np.argsort([r.score for r in held]))
    area = (rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5
    right = np.mean([r.predicted == r.quality for r in held])
    print("area", area, "right", right)
    assert area > 0.97 and right > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1, "e"), (2, "", 0, "e"), (2, "", 0, "e"), (None, "x" * 100_000, 0, "e")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = score_quality(docs, none).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.5}
    assert score_quality(docs.limit(0), none).count() == 0
