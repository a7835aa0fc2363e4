"""Document fingerprints from prefix polynomial hashes.

``PrefixHashes`` holds, for code points ``c``, the sums ``c[0] B^0 + ... + c[i-1]
B^(i-1)`` modulo the prime ``2^31 - 1`` for two bases.  The hash of any span is a
difference of two sums times an inverse power: a few operations for any length
and place, so span equality is answered at once and the longest common
extension of two places by binary search over lengths.

A fingerprint is the text's length, the hash of the whole text, and for each of
``SLOTS`` slots the least span hash among the spans of ``WINDOW`` code points that
fall into it (shorter texts are one span).  Equal texts have equal fingerprints;
the likeness of two is the share of slots that agree among those that either
fills, an estimate of the share of spans in common.

``compare_with_next`` also needs each document's neighbour in descending order of
ids.  Only ids and text hashes are sorted over the whole table; that gives the
bounds of buckets in order.  The texts are dealt into the buckets once, and the
row at a bucket's upper bound is sent to the next bucket as well, so every task
walks through its bucket in order with the neighbour at hand.

Texts are taken whole: those over ``SLAB`` code points pass through the hashes in
chunks that overlap by a window.

Defined cases: a null text counts as empty; an empty text has no spans, is alike
(1.0) to empty texts and to nothing else (0.0); rows without id come last; rows
of one id are ordered by a hash of their text, descending; rows equal in id and
text have the same next document, the next row that differs (a table of one
such row is its own next); an empty table gives no rows; other columns are not
read.  Ids are whole numbers; another type raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tendril.llm import kernel
from tendril.llm.shared import cut, fresh, small_batches

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_640_531_527)
WINDOW = 8
SLOTS = 64
SLAB = 1 << 20
EMPTY = b"...."
#: Bytes of text that a task gets, about.
PART_BYTES = 64 << 20
#: Times its share of a bucket from which one repeated row is spread.
HOT = 4

_U = np.uint64
_P = _U(PRIME)


def _mod(x: np.ndarray) -> np.ndarray:
    """Below 2^63 to below the prime."""
    x = (x & _P) + (x >> _U(31))
    x = (x & _P) + (x >> _U(31))
    return np.where(x >= _P, x - _P, x)


class _Powers:
    """Powers of a base and of its inverse, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, PRIME - 2, PRIME)
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            have = len(self.up)
            self.up = np.concatenate([self.up, _mod(self.up * _U(pow(self.base, have, PRIME)))])
            self.down = np.concatenate([self.down, _mod(self.down * _U(pow(self.inverse, have, PRIME)))])
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in BASES]


class PrefixHashes:
    """Prefix sums of an array of code points."""

    def __init__(self, codes: np.ndarray):
        self.size = len(codes)
        shifted = codes.astype(_U) + _U(1)
        self.sums = []
        for powers in _POWERS:
            up, _ = powers.to(self.size)
            sums = np.zeros(self.size + 1, _U)
            np.cumsum(_mod(shifted * up), out=sums[1:])
            self.sums.append(_mod(sums))

    def span(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans ``begin`` to ``end`` (exclusive)."""
        begin, end = np.asarray(begin, np.int64), np.asarray(end, np.int64)
        out = np.zeros(np.broadcast(begin, end).shape, _U)
        for powers, sums in zip(_POWERS, self.sums, strict=True):
            _, down = powers.to(self.size + 1)
            out = out << _U(31) | _mod(_mod(sums[end] + _P - sums[begin]) * down[begin])
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray, other: PrefixHashes | None = None) -> np.ndarray:
        """Whether the spans of ``length`` at ``a`` here and at ``b`` in ``other``
        (or here) are the same."""
        return self.span(a, np.asarray(a) + length) == (other or self).span(b, np.asarray(b) + length)

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, other: PrefixHashes | None = None) -> np.ndarray:
        """Code points that agree from ``a`` here and ``b`` in ``other`` on, at
        most ``most``: by binary search, as longer spans can't agree again."""
        low, high = np.zeros(len(a), np.int64), np.asarray(most, np.int64).copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.equal(a, b, middle, other)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _slabs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``SLAB`` code points (or one row)."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLAB, "right"))
        yield first, (last := max(last, first + 1))
        first = last


def _least(hashes: PrefixHashes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(rows, SLOTS) least span hashes of the texts at ``begin`` to ``end``."""
    rows = len(begin)
    size = end - begin
    spans = np.where(size == 0, 0, np.maximum(size - WINDOW, 0) + 1)
    row, place = kernel.ranges(spans)
    at = begin[row] + place
    mixed = kernel.mix(hashes.span(at, np.minimum(at + WINDOW, end[row])) ^ kernel.mix(np.minimum(size, WINDOW).astype(_U))[row])
    least = np.full(rows * SLOTS, np.iinfo(np.uint64).max, _U)
    np.minimum.at(least, row * SLOTS + (mixed >> _U(58)).astype(np.int64), mixed & _U((1 << 58) - 1))
    return least.reshape(rows, SLOTS)


def _write(size: int, whole: int, least: np.ndarray) -> str:
    slots = "".join("...." if x > 1 << 58 else f"{x & 0xFFFF:04x}" for x in least.tolist())
    return f"{size:x}-{whole:016x}-{slots}"


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    out = []
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for first, last in _slabs(sizes):
        if sizes[first] > SLAB:
            out.append(_long(texts[first]))
            continue
        hashes = PrefixHashes(codes_of("".join(texts[first:last])))
        end = np.cumsum(sizes[first:last])
        begin = end - sizes[first:last]
        whole, least = hashes.span(begin, end), _least(hashes, begin, end)
        out += [_write(int(n), int(h), slots) for n, h, slots in zip(end - begin, whole, least, strict=True)]
    return out


def _long(text: str) -> str:
    """The same fingerprint, chunk by chunk."""
    whole, least = [0, 0], np.full(SLOTS, np.iinfo(np.uint64).max, _U)
    for at in range(0, len(text), SLAB):
        hashes = PrefixHashes(codes_of(text[at : at + SLAB + WINDOW - 1]))
        own = np.array([min(SLAB, hashes.size)])
        span = int(hashes.span(np.array([0]), own)[0])
        for k, (part, base) in enumerate(zip((span >> 31, span & PRIME), BASES, strict=True)):
            whole[k] = (whole[k] + part * pow(base, at, PRIME)) % PRIME
        if hashes.size >= WINDOW:  # the last chunk may be the overlap's rest
            least = np.minimum(least, _least(hashes, np.array([0]), np.array([hashes.size]))[0])
    return _write(len(text), whole[0] << 31 | whole[1], least)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """The share of filled slots that agree; 1 for equal fingerprints."""
    slots = lambda texts: np.frombuffer("".join(t[-4 * SLOTS :] for t in texts).encode(), "<u4").reshape(len(texts), SLOTS)
    if not left:
        return np.zeros(0)
    a, b, none = slots(left), slots(right), np.frombuffer(EMPTY, "<u4")[0]
    filled = ((a != none) | (b != none)).sum(1)
    agree = ((a == b) & (a != none)).sum(1)
    same = np.fromiter((x == y for x, y in zip(left, right, strict=True)), bool, len(left))
    return np.where(same, 1.0, agree / np.maximum(filled, 1))


def common_start(left: list[str], right: list[str]) -> np.ndarray:
    """Code points that each pair of texts shares from its start."""
    most = np.fromiter((min(len(x), len(y)) for x, y in zip(left, right, strict=True)), np.int64, len(left))
    out = np.zeros(len(left), np.int64)
    for first, last in _slabs(most):
        at = 0
        while True:  # once, but for texts of several chunks
            step = np.minimum(most[first:last] - at, SLAB)
            begin = np.cumsum(step) - step
            a, b = (PrefixHashes(codes_of("".join(t[at : at + n] for t, n in zip(side[first:last], step.tolist(), strict=True)))) for side in (left, right))
            out[first:last] += (found := a.extension(begin, begin, step, b))
            at += SLAB
            if last > first + 1 or found[0] < SLAB or at >= most[first]:
                break
    return out


def edit(text: str, after: str) -> str:
    """The last half of a text replaced by as much of the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_edited long, same_next long"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket in ascending order, its upper neighbour's last row first."""
    after = now = key = None  # the next document (text, fingerprint), the present one and its key
    for batch in batches:
        texts = batch.column("text").to_pylist()
        prints = fingerprints(texts)
        rows, nexts = [], []
        guests, ids, hashes = (batch.column(c).to_pylist() for c in ("guest", "place", "hash"))
        for k, (text, mark) in enumerate(zip(texts, prints, strict=True)):
            if guests[k]:
                after = text, mark
                continue
            if (ids[k], hashes[k]) != key:
                key, after, now = (ids[k], hashes[k]), now or after, (text, mark)
            if after is None:
                raise RuntimeError("rows changed between two passes")
            rows.append(k)
            nexts.append(after)
        texts, prints = [texts[k] for k in rows], [prints[k] for k in rows]
        edited = [edit(t, n) for t, (n, _) in zip(texts, nexts, strict=True)]
        marks = fingerprints(edited)
        columns = [
            pa.array(map(len, texts), pa.int64()),
            pa.array(map(_sha, edited), pa.string()),
            pa.array(prints, pa.string()),
            pa.array(marks, pa.string()),
            pa.array(likeness(prints, marks)),
            pa.array(likeness(prints, [m for _, m in nexts])),
            pa.array(common_start(texts, edited)),
            pa.array(common_start(texts, [n for n, _ in nexts])),
        ]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *columns], ["doc_id", *names])


def _dealer(bounds: list[tuple[int, int]], parts: list[range]) -> Callable:
    """A UDF: the partitions of a row by its place in the order, its own first,
    then those that need it as a guest."""
    ids, hashes = (np.array(x, np.int64) for x in zip(*bounds, strict=True))
    starts, sizes = np.array([p.start for p in parts]), np.array([len(p) for p in parts])

    def deal(place: pd.Series, mark: pd.Series) -> pd.Series:
        place, mark = place.to_numpy(np.int64), mark.to_numpy(np.int64)
        bucket, last = np.searchsorted(ids, place, "left"), np.searchsorted(ids, place, "right")
        tied = np.flatnonzero(bucket < last)
        begin = bucket[tied]
        for first in np.unique(begin):
            own = tied[begin == first]
            bucket[own] = first + np.searchsorted(hashes[first : last[own[0]]], mark[own], "left")
        bucket = np.minimum(bucket, len(ids) - 1)
        out = [[p] for p in (starts[bucket] + np.arange(len(bucket)) % sizes[bucket]).tolist()]
        # One row at a bound is enough for the bucket that follows.
        held = np.flatnonzero((ids[bucket] == place) & (hashes[bucket] == mark))
        for k in held[np.unique(bucket[held], return_index=True)[1]].tolist():
            out[k] += parts[(bucket[k] + 1) % len(parts)]
        return pd.Series(out)

    return F.pandas_udf(deal, "array<int>")


def _bounds(keys: DataFrame, n_parts: int) -> tuple[list[tuple[int, int]], list[range]]:
    """Upper bounds of the buckets, ascending, and the partitions of each: one,
    or several for a row that is repeated more often than a bucket has rows."""
    both = F.struct("place", "hash")
    ends = keys.repartitionByRange(n_parts, "place", "hash").groupBy(F.spark_partition_id().alias("p")).agg(F.max(both).alias("k"))
    bounds = {tuple(r.k) for r in ends.select("k").collect()}
    share = keys.agg(F.sum("n")).first()[0] / n_parts
    hot = {(r.place, r.hash): int(-(-r.n // share)) for r in keys.filter(F.col("n") > HOT * share).collect()}
    if hot:  # a bucket of its own, so the row before it is a bound as well
        below = [F.max(F.when((F.col("place") < p) | ((F.col("place") == p) & (F.col("hash") < h)), both)) for p, h in hot]
        bounds |= set(hot) | {tuple(x) for x in keys.agg(*[c.alias(f"b{k}") for k, c in enumerate(below)]).first() if x is not None}
    bounds, parts, at = sorted(bounds), [], 0
    for key in bounds:
        parts.append(range(at, at := at + hot.get(key, 1)))
    return bounds, parts


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: fingerprints of the text and of its edited text, their
    likeness, and how far the text agrees with the edited and the next one."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of whole numbers")
    small_batches(docs.sparkSession)
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), place.alias("place"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    keys = cut(rows.groupBy("place", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")))
    size = keys.agg(F.sum("bytes")).first()[0]
    if size is None:
        return docs.sparkSession.createDataFrame([], f"doc_id long, {COLUMNS}")
    bounds, parts = _bounds(keys, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)))
    dealt = rows.withColumn("to", _dealer(bounds, parts)("place", "hash"))
    dealt = dealt.select("doc_id", "place", "hash", "text", F.posexplode("to").alias("nth", "part")).withColumn("guest", F.col("nth") > 0)
    dealt = dealt.repartitionById(parts[-1].stop, "part").sortWithinPartitions(F.desc("guest"), "place", "hash")
    return dealt.select("doc_id", "place", "hash", "guest", "text").mapInArrow(_walk, f"doc_id long, {COLUMNS}")


def fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each row's text as one more column."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def mark(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(texts.fillna("").tolist()), dtype=object)

    return docs.withColumn(fresh(docs, out_col), mark(text_col))
