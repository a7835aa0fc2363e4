"""Quality classifier: hashed word n-grams, FTRL logistic regression.

A text's tokens are runs of letters and digits, and runs of other marks; its
features are token unigrams, bigrams and whether neighbours are equal, hashed to
``SLOTS`` weights, each ``log(1 + count)`` over the text's norm.  Labelled rows
outside the held-out quarter, ``LEARN_ROWS`` at most, are dealt to ``SHARDS``
tasks; each trains by follow-the-regularised-leader updates for ``EPOCHS`` and
the weights are averaged on the executors (SLOTS numbers reach the driver).
Scoring is one sparse dot product a text.

Defined cases: null and empty texts have no features and get the bias's score;
repeated rows are separate documents; without labelled rows every score is 0.5;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.llm import kernel
from tendril.llm.labelled import learnable
from tendril.llm.shared import cut, held_out, small_batches

LEARN_ROWS = 16_000
SHARDS = 8
EPOCHS = 4
SLOTS = 1 << 18
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.5
THRESHOLD = 0.7

_U = np.uint64
_KIND = np.full(256, 2, np.int8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
#: The bias's slot, and that of equal neighbours.
BIAS, SAME = 0, 1


def features(s: kernel.Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of a slab's texts, ordered by row."""
    kinds = _KIND[s.data]
    starts = np.ones(len(kinds), bool)
    starts[1:] = kinds[1:] != kinds[:-1]
    inner = s.offsets[1:-1]
    starts[inner[inner < len(kinds)]] = True
    edges = np.append(np.flatnonzero(starts), len(kinds))
    first, last = edges[:-1], edges[1:]
    real = kinds[first] > 0 if len(kinds) else np.zeros(0, bool)
    first, last = first[real], last[real]
    row = np.searchsorted(s.offsets, first, "right") - 1
    tokens = kernel.span_hashes(s.data, first, last)
    pair = np.flatnonzero(row[:-1] == row[1:]) if len(row) else row
    equal = tokens[pair] == tokens[pair + 1]
    hashes = np.concatenate([tokens, kernel.mix(tokens[pair] + _U(3) * tokens[pair + 1])[~equal]])
    slot = np.concatenate([(hashes >> _U(46)).astype(np.int64), np.full(int(equal.sum()), SAME)])
    rows = np.concatenate([row, row[pair][~equal], row[pair][equal]])
    slot[(slot == BIAS) | ((slot == SAME) & (np.arange(len(slot)) < len(hashes)))] = 2
    key, count = np.unique(rows * SLOTS + slot, return_counts=True)
    row, slot, value = key // SLOTS, key % SLOTS, np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, minlength=s.rows))
    return row, slot, value / norm[row]


def train(texts: pa.Array, labels: np.ndarray, seed: int) -> np.ndarray:
    """Weights after EPOCHS passes of FTRL-proximal updates."""
    rng = np.random.default_rng(seed)
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)

    def weights(slot: np.ndarray) -> np.ndarray:
        free = np.abs(z[slot]) > L1
        return np.where(free, -(z[slot] - np.sign(z[slot]) * L1) / ((BETA + np.sqrt(n[slot])) / ALPHA + L2), 0.0)

    rows = []
    for s in kernel.slabs(texts):
        row, slot, value = features(s)
        bounds = np.searchsorted(row, np.arange(s.rows + 1))
        # Weights of the unit vectors are kept in reach by a larger scale.
        rows += [(np.append(slot[a:b], BIAS), np.append(8 * value[a:b], 1.0)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            slot, value = rows[i]
            w = weights(slot)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            g = (p - labels[i]) * value
            sigma = (np.sqrt(n[slot] + g * g) - np.sqrt(n[slot])) / ALPHA
            z[slot] += g - sigma * w
            n[slot] += g * g
    return weights(np.arange(SLOTS))


def _trainer(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("doc_id", kind="stable")
    w = train(pa.array(part["text"], pa.string()), (part["label"].to_numpy() > 0).astype(float), int(part["shard"].iloc[0]))
    at = np.flatnonzero(w)
    return pd.DataFrame({"slot": at, "w": w[at]})


def learn(sample: DataFrame, shards: int = SHARDS) -> np.ndarray:
    """The averaged weights; ``sample`` has doc_id, text, label."""
    dealt = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    # A shard's rows are at most LEARN_ROWS, whatever the corpus.
    parts = dealt.groupBy("shard").applyInPandas(_trainer, "slot long, w double")
    used = dealt.agg(F.count_distinct("shard")).first()[0]
    mean = parts.groupBy("slot").agg(F.sum("w").alias("w")).toPandas()
    out = np.zeros(SLOTS)
    out[mean["slot"].to_numpy(np.int64)] = mean["w"].to_numpy(float) / max(1, used)
    return out


def _scorer(model: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            parts = []
            for s in kernel.slabs(batch.column("text")):
                row, slot, value = features(s)
                parts.append(np.bincount(row, 8 * value * w[slot], minlength=s.rows) + w[BIAS])
            logit = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], ["doc_id", "score"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn_rows: int = LEARN_ROWS) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learn(cut(learnable(docs, labels, label_col, learn_rows, id_col, text_col))))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = texts.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
