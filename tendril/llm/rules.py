"""Quality rules with thresholds learnt from the corpus.

``measure`` counts words, symbols, repeated lines and repeated 3-word windows of
each whole text.  ``sketch`` builds one mergeable quantile sketch a language,
source and measure: values fall into logarithmic bins (relative error
``ACCURACY``), bins are counted by a partial and a final sum, and quantiles are
read off the running counts (``quantiles``).  Bin counts merge in any order to the same sketch,
so a lost executor changes nothing.  A document goes if it fails the base rules
or lies outside the fences of its language and source: for each measure two
quantiles (``FENCES``), and from the higher one upwards and the lower one
downwards a multiple of their distance.  A group's quantiles are averaged with its
language's, and those with the corpus's, which count as ``PRIOR`` documents: so
every group of every size has fences of its own, the nearer to its language's the
fewer documents it has.  Quantiles that fall in one bin say nothing of a spread
and weigh nothing; only a measure without spread in the whole corpus has a fixed
distance (``SLACK``) from its quantile.

Defined cases: null and empty texts have no words and fail the base rules; null
and empty languages or sources are one group; repeated rows are separate
documents; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.llm import kernel
from tendril.llm.shared import cut, small_batches

ACCURACY = 0.001
#: Documents that a parent's quantiles count as.
PRIOR = 500
#: What is measured: lower and upper quantile, and the multiple of their
#: distance.  Few texts repeat anything, so repetition goes by upper quantiles.
FENCES = {
    "chars_per_word": (0.25, 0.75, 4.0),
    "symbols_per_word": (0.25, 0.75, 4.0),
    "dup_lines": (0.5, 0.99, 1.0),
    "repeat_words": (0.5, 0.99, 1.0),
}
#: The distance of a fence where all documents measure much the same.
SLACK = {"chars_per_word": 2.0, "symbols_per_word": 0.05, "dup_lines": 0.05, "repeat_words": 0.05}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _sum_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def slab_counts(s: kernel.Slab) -> dict[str, np.ndarray]:
    """The six counts of each row of a slab."""
    n, rows = len(s.data), s.rows
    words = s.word_bounds()
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, s.starts, 1)
    np.subtract.at(inside, s.ends, 1)
    inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
    points = (s.data & 0xC0) != 0x80
    # Lines: the pieces between line feeds and row ends that hold a word.
    breaks = np.flatnonzero(s.data == 10)
    starts = np.union1d(s.offsets[:-1], breaks + 1)
    starts = starts[starts < n]
    line_row = np.searchsorted(s.offsets, starts, "right") - 1
    ends = np.minimum(np.append(breaks, n)[np.searchsorted(breaks, starts)], s.offsets[line_row + 1])
    has_word = np.searchsorted(s.starts, ends, "left") > np.searchsorted(s.starts, starts, "left")
    starts, ends, line_row = starts[has_word], ends[has_word], line_row[has_word]
    lines = kernel.span_hashes(s.data, starts, ends)
    n_lines = np.bincount(line_row, minlength=rows)
    _, first = np.unique(kernel.mix(lines ^ kernel.mix(line_row.astype(np.uint64))), return_index=True)
    n_dup = n_lines - np.bincount(line_row[first], minlength=rows)
    # Words in 3-word windows that their text holds twice or more.
    hashes = s.hashes(fold=False)
    repeated = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= 3:
        at = np.flatnonzero(s.row[:-2] == s.row[2:])
        window = kernel.mix(kernel.mix(kernel.mix(hashes[at]) + hashes[at + 1]) + hashes[at + 2])
        window = kernel.mix(window ^ kernel.mix(s.row[at].astype(np.uint64)))
        _, back, count = np.unique(window, return_inverse=True, return_counts=True)
        twice = at[count[back] > 1]
        for k in range(3):
            repeated[twice + k] = 1
    return {
        "n_words": np.diff(words),
        "word_chars": _sum_by_row(points & inside, s.offsets),
        "n_symbols": _sum_by_row(_SYMBOL[s.data], s.offsets),
        "n_dup_lines": n_dup,
        "n_repeat_words": _sum_by_row(repeated[:-1], words),
        "n_lines": n_lines,
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [slab_counts(s) for s in kernel.slabs(batch.column("text"))]
        counts = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COUNTS]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), *counts], ["doc_id", "lang", "source", *COUNTS])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(_measure, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "chars_per_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_words": F.col("n_repeat_words") / words,
    }


def _bin(value: Column) -> Column:
    step = float(np.log1p(2 * ACCURACY))
    return F.when(value < 1e-6, F.lit(-10_000)).otherwise(F.ceil(F.log(value) / step).cast("int"))


def _value(bin_col: Column) -> Column:
    step = float(np.log1p(2 * ACCURACY))
    return F.when(bin_col == -10_000, F.lit(0.0)).otherwise(F.exp((bin_col - 0.5) * step))


def sketch(measured: DataFrame, by: list[str]) -> DataFrame:
    """Bin counts by group and measure: the mergeable sketch."""
    names = F.array(*[F.struct(F.lit(k).alias("measure"), _bin(v).alias("bin")) for k, v in ratios().items()])
    return measured.select(*by, F.explode(names).alias("m")).groupBy(*by, "m.measure", "m.bin").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of finer groups summed to those of coarser ones."""
    return sketches.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """For each group its documents and by measure a struct of the quantiles
    ``low`` and ``high`` (null without spread), and the upper quantile ``at``."""
    keys = [*by, "measure"]
    so_far = Window.partitionBy(*keys).orderBy("bin")
    ranked = sketches.withColumn("below", F.sum("n").over(so_far)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    table = F.create_map(*[x for m, levels in FENCES.items() for x in (F.lit(m), F.array(*map(F.lit, levels)))])
    level = lambda k: table[F.col("measure")][k]
    # A quantile is the value at rank ceil(share x documents).
    at = lambda q: F.min(F.when(F.col("below") >= F.greatest(F.ceil(F.col("all") * q), F.lit(1)), F.col("bin")))
    per = ranked.groupBy(*keys).agg(F.max("all").alias("size"), at(level(0)).alias("lower"), at(level(1)).alias("upper"))
    low, high = _value(F.col("lower")), _value(F.col("upper"))
    wide = lambda v: F.when(F.col("upper") > F.col("lower"), v)
    per = per.withColumn("fence", F.struct(wide(low).alias("low"), wide(high).alias("high"), high.alias("at")))
    return per.groupBy(*by).agg(F.max("size").alias("size"), *[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(m) for m in FENCES])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a document: the counts, base_failed, kept and what it failed."""
    measured = cut(measure(docs, id_col, text_col, lang_col, source_col))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = cut(sketch(measured.filter(~failed), ["lang", "source"]))
    coarse = merge(fine, ["lang"])
    # A few numbers: the corpus's quantiles are values of the plan, not a join.
    whole = quantiles(merge(coarse, []), []).first()
    own = quantiles(fine, ["lang", "source"]).select("lang", "source", F.struct("size", *FENCES).alias("own"))
    lang = quantiles(coarse, ["lang"]).select("lang", F.struct("size", *FENCES).alias("of_lang"))
    joined = measured.join(own, ["lang", "source"], "left").join(lang, ["lang"], "left")

    def outside(m: str, value: Column) -> Column:
        of = whole[m] if whole and whole[m] is not None else None
        if of is None:  # nothing passed the base rules
            return F.lit(False)

        def shrunk(side: str) -> Column:
            level = F.lit(of[side]).cast("double")
            for name in ("of_lang", "own"):
                mine, n = F.col(name)[m][side], F.col(name)["size"]
                level = F.coalesce((n * mine + PRIOR * level) / (n + PRIOR), mine, level)
            return level

        low, high = shrunk("low"), shrunk("high")
        far = FENCES[m][2] * (high - low)
        return (value > F.coalesce(high + far, F.lit(of.at + SLACK[m]))) | (value < F.coalesce(low - far, F.lit(of.at - SLACK[m])))

    beyond = [F.when(outside(m, value), F.lit(m)) for m, value in ratios().items()]
    return (
        joined.withColumn("base_failed", failed)
        .withColumn("beyond", F.array_compact(F.array(*beyond)))
        .select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.size("beyond") == 0)).alias("kept"), F.array_join("beyond", ",").alias("beyond"), "lang", "source")
    )
