"""Substring dedup by sliding sentence spans.

A sentence ends with a word that ends in ``.``, ``!`` or ``?`` (closing quotes
and brackets aside), at a line feed, or with its text; one of over ``LONG``
words also ends at commas and semicolons.  At every sentence starts a *span*:
the shortest run of at least two sentences that has ``WORDS`` words, or the
sentence alone if it has ``ALONE`` words.  With ``tails`` a span also ends at
every sentence, the shortest such run up to it, and a sentence of ``WORDS`` words
is a span alone: then a repeated run of whole sentences with ``WORDS`` words is
covered to its last sentence, whatever stands before and behind it.  Spans are hashed to 128 bits over
their words, so white space doesn't matter; they are counted and their first
document (least id) found by a partial and a final aggregation; and every
sentence that a repeated span covers is removed from all but its first place:
from other documents, and from later places in the first document itself.

Spans are made once and written.  The join with the repeated ones deals them by
hash, whose hot keys (a passage of a third of all documents) are one aggregated
row on one side and are split on the other.

Defined cases: null texts stay null, empty ones empty, with no sentences; rows
of one id are one document; rows without id come after all others and are
documents of their own, those of equal text being one; what stays of a text keeps its white space, but for its end; an empty table
gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tendril.llm import kernel
from tendril.llm.shared import cut, small_batches

WORDS = 25
ALONE = 50
LONG = 30

_U = np.uint64
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSER = np.zeros(256, bool)
_CLOSER[list(b"\"')]")] = True
_PAUSE = np.zeros(256, bool)
_PAUSE[list(b",;")] = True
_ADDED = StructType([StructField("text", StringType()), StructField("n_sentences", LongType()), StructField("n_removed", LongType())])


class Sentences:
    """The sentences of a slab and the spans that start at them."""

    def __init__(self, s: kernel.Slab, tails: bool = False):
        self.slab, self.tails = s, tails
        n = len(s.starts)
        if not n:
            self.first = self.last = self.row = self.start = self.upto = np.zeros(0, np.int64)
            self.spans = np.zeros(0, bool)
            self.h1 = self.h2 = np.zeros(0, np.int64)
            return
        final = s.data[s.ends - 1]
        before = s.data[np.maximum(s.ends - 2, s.starts)]
        stops = _STOP[final] | (_CLOSER[final] & _STOP[before])
        feeds = np.zeros(len(s.data) + 1, np.int64)
        np.cumsum(s.data == 10, out=feeds[1:])
        following = np.append(s.starts[1:], len(s.data))
        stops |= feeds[following] > feeds[s.ends]
        stops |= np.append(s.row[1:] != s.row[:-1], True)
        ends = np.flatnonzero(stops)
        lengths = np.diff(ends, prepend=-1)
        stops |= np.repeat(lengths > LONG, lengths) & _PAUSE[final]
        #: First and last word (exclusive) of each sentence, and its row.
        self.last = np.flatnonzero(stops) + 1
        self.first = np.append(0, self.last[:-1])
        self.row = s.row[self.first]
        self._span()

    def _span(self) -> None:
        s, count = self.slab, self.last - self.first
        k = len(count)
        #: The sentences (the last exclusive) from and to which each span runs.
        self.start = np.arange(k)
        upto = np.searchsorted(self.last, self.first + WORDS) + 1
        upto = np.maximum(upto, self.start + 2)
        alone = count >= (WORDS if self.tails else ALONE)
        self.upto = np.where(alone, self.start + 1, upto)
        if self.tails:
            back = np.minimum(np.searchsorted(self.first, self.last - WORDS, "right") - 1, np.arange(k) - 1)
            ends = np.flatnonzero((back >= 0) & ~alone)
            ends = ends[self.upto[back[ends]] != ends + 1]  # those are spans already
            start, upto = np.append(self.start, back[ends]), np.append(self.upto, ends + 1)
            order = np.argsort(start, kind="stable")
            self.start, self.upto = start[order], upto[order]
        end = np.minimum(self.upto, k) - 1
        self.spans = (self.upto <= k) & (self.row[end] == self.row[self.start])
        begin, end = self.first[self.start], self.last[end]
        real = np.flatnonzero(self.spans)
        words, hashes = s.hashes(fold=False), np.zeros((2, len(begin)), np.int64)
        for key in (0, 1):
            hashes[key, real] = kernel.window_hash(words, begin[real], end[real], key).view(np.int64)
        self.h1, self.h2 = hashes

    def covered(self, spans: np.ndarray) -> np.ndarray:
        """Whether each sentence lies in one of these spans."""
        edge = np.zeros(len(self.first) + 1, np.int64)
        np.add.at(edge, self.start[spans], 1)
        np.subtract.at(edge, self.upto[spans], 1)
        return np.cumsum(edge[:-1]) > 0


def _keys(h1: np.ndarray, h2: np.ndarray, row: np.ndarray) -> np.ndarray:
    out = np.empty(len(h1), [("row", np.int64), ("h1", np.int64), ("h2", np.int64)])
    out["row"], out["h1"], out["h2"] = row, h1, h2
    return out


def _spans(batches: Iterator[pa.RecordBatch], tails: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, anon = batch.column("id"), batch.column("anon")
        for s in kernel.slabs(batch.column("text")):
            own = Sentences(s, tails)
            at = np.flatnonzero(own.spans)
            if len(at):
                keys = np.unique(_keys(own.h1[at], own.h2[at], own.row[own.start[at]]))
                row = pa.array(s.first + keys["row"])
                yield pa.RecordBatch.from_arrays([pa.array(keys["h1"]), pa.array(keys["h2"]), ids.take(row), anon.take(row)], ["h1", "h2", "id", "anon"])


def _cleaned(batches: Iterator[pa.RecordBatch], tails: bool = False) -> Iterator[pa.RecordBatch]:
    names = _ADDED.names
    for batch in batches:
        texts, counts, removed = [], [], []
        gone, column = batch.column("_gone"), batch.column("_text")
        for s in kernel.slabs(column):
            own, part = Sentences(s, tails), gone.slice(s.first, s.rows)
            at = np.flatnonzero(own.spans)
            keys = _keys(own.h1[at], own.h2[at], own.row[own.start[at]])
            # Later places of a span in its own document.
            _, place = np.unique(keys, return_index=True)
            drop = np.ones(len(at), bool)
            drop[place] = False
            flat = part.flatten()
            if len(flat):
                sizes = part.value_lengths().fill_null(0).to_numpy()
                listed = _keys(flat.field(0).to_numpy(), flat.field(1).to_numpy(), np.repeat(np.arange(s.rows), sizes))
                drop |= np.isin(keys, listed)
            hit = own.covered(at[drop])
            data = s.data.tobytes()
            bounds = np.searchsorted(own.row, np.arange(s.rows + 1))
            for r in range(s.rows):
                a, b = bounds[r], bounds[r + 1]
                lost = int(hit[a:b].sum())
                counts.append(int(b - a))
                removed.append(lost)
                if not lost:
                    texts.append(None)  # stays as it is
                    continue
                texts.append(_without(data, own, hit, a, b, s.offsets[r], s.offsets[r + 1]))
        kept = [old if new is None else new for old, new in zip(column.to_pylist(), texts, strict=True)]
        cols = [pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("_rest"), *cols], ["_rest", *names])


def _without(data: bytes, own: Sentences, hit: np.ndarray, a: int, b: int, begin: int, end: int) -> str:
    """Row text from begin to end less the sentences of a..b that are hit."""
    s, parts, at = own.slab, [], begin
    for k in range(a, b):
        upto = int(s.starts[own.first[k + 1]]) if k + 1 < b else end
        if not hit[k]:
            parts.append(data[at:upto])
        elif k == a:
            parts.append(b"")  # white space before the text goes too
        at = upto
    return b"".join(parts).decode().rstrip(" \t\n\x0b\x0c\r")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tails: bool = False) -> DataFrame:
    """``docs`` with repeated passages out of its text, and the columns
    n_sentences and n_removed after the others (in place of like-named ones)."""
    small_batches(docs.sparkSession)
    # A document goes by its id, or without one by its text.
    key = F.col(id_col).cast("long")
    anon = F.when(key.isNull(), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    spans = docs.select(key.alias("id"), anon.alias("anon"), F.col(text_col).alias("text")).mapInArrow(partial(_spans, tails=tails), "h1 long, h2 long, id long, anon long")
    spans = cut(spans)
    firsts = spans.groupBy("h1", "h2").agg(*[f(c).alias(f"{name}_{c}") for c in ("id", "anon") for name, f in (("first", F.min), ("last", F.max))])
    both = F.col("first_id").isNotNull() & F.col("first_anon").isNotNull()
    firsts = firsts.filter(both | (F.col("first_id") < F.col("last_id")) | (F.col("first_anon") < F.col("last_anon"))).drop("last_id", "last_anon")
    after = (F.col("id") > F.col("first_id")) | (F.col("anon").isNotNull() & (F.col("first_id").isNotNull() | (F.col("anon") > F.col("first_anon"))))
    later = spans.join(firsts, ["h1", "h2"]).filter(after)
    gone = later.groupBy("id", "anon").agg(F.collect_set(F.struct("h1", "h2")).alias("_gone"))
    gone = gone.select(F.coalesce("id", "anon").alias("_gone_key"), F.col("id").isNull().alias("_gone_anon"), "_gone")
    others = [c for c in docs.columns if c not in (text_col, "n_sentences", "n_removed")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others])
    keyed = docs.select(rest.alias("_rest"), F.col(text_col).alias("_text"), F.coalesce(key, anon).alias("_key"), key.isNull().alias("_anon"))
    joined = keyed.join(gone, (F.col("_key") == F.col("_gone_key")) & (F.col("_anon") == F.col("_gone_anon")), "left").select("_rest", "_text", "_gone")
    schema = StructType([joined.schema["_rest"], *_ADDED.fields])
    out = joined.mapInArrow(partial(_cleaned, tails=tails), schema)
    back = {c: F.col("_rest").getField(c) for c in others} | {text_col: F.col("text")}
    return out.select(*[back[c].alias(c) for c in docs.columns if c in back], "n_sentences", "n_removed")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages removed; documents that are nothing but
    repeats go, and n_chars (if there) is counted again."""
    out = substring_dedup(docs.drop("n_sentences", "n_removed"), id_col, text_col)
    out = out.filter(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_sentences"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*[c for c in docs.columns if c in out.columns])
