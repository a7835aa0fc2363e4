"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined in one posterior for each row:

* the text: a byte-trigram model of each language, its counts summed over all
  rows by the language they declare (a log-likelihood, tempered by ``TEMPER``
  because trigrams of a text aren't independent), with one more model, ``und``,
  that gives every trigram the same chance;
* the declared markup language: how often texts that read as a language declare
  each (a confusion table by grouped aggregation);
* the address suffix, in the same way;
* the host: its own share of the languages, smoothed to its parent domain's,
  which is smoothed to the corpus's (``HOST_WEIGHT`` and ``DOMAIN_WEIGHT``
  pseudo-rows), all counted by grouped aggregation of what the texts read as.

Rows of a host or suffix are only joined to one aggregated row, without their
texts: aggregates of up to ``MOST_SHARED`` rows are counted and broadcast, larger
ones are joined in ``SALT`` parts a key, so a suffix or host that a third of all
rows share is no task of its own.  The models are a fixed number of values and
are broadcast.

A row is rejected if ``und`` reads better than every language, if it has no
letters, or if the posterior of the best language is below ``LEAST``.  A verdict
follows from what a row holds, so ``drop_foreign`` drops rows by id, text,
declaration and source together: rows that share an id, or have none, are judged
each by itself.

Defined cases: null or empty texts have no evidence of their own and are
rejected; null markup, suffix or host is no evidence; declared languages outside
the list count as one other; repeated rows are separate rows; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.llm import kernel
from tendril.llm.shared import cut, fresh, small_batches

LANGUAGES = ("en", "fr", "de", "es")
BUCKETS = 1 << 15
TEMPER = 0.3
LEAST = 0.5
HOST_WEIGHT = 20.0
DOMAIN_WEIGHT = 20.0
#: Rows of an aggregate that may be broadcast; parts of a key beyond that.
MOST_SHARED = 100_000
SALT = 32

_FOLD = np.full(256, 32, np.int64)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(s: kernel.Slab) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each byte trigram with a letter in its middle."""
    codes = _FOLD[s.data]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
    rows = np.repeat(np.arange(s.rows), np.diff(s.offsets))
    at = np.flatnonzero((codes[1:-1] != 32) & (rows[:-2] == rows[2:]))
    return ((whole[at] * 0x9E3779B1) & 0xFFFFFFFF) >> 17, rows[at]


def _counter(languages: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        index = {name: k for k, name in enumerate(languages)}
        for batch in batches:
            declared = np.array([index.get(m, -1) for m in batch.column("markup").to_pylist()], np.int64)
            for s in kernel.slabs(batch.column("text")):
                bucket, row = trigrams(s)
                lang = declared[s.first + row]
                total += np.bincount((lang * BUCKETS + bucket)[lang >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    return count


def text_model(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log-probabilities: a line for each language, and one for ``und``."""
    counts = rows.select("text", "markup").mapInArrow(_counter(languages), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most languages x BUCKETS rows
    table = np.zeros(len(languages) * BUCKETS)
    table[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    table = table.reshape(len(languages), BUCKETS) + 0.5
    # A language that nothing declares reads as nothing.
    model = np.log(table / np.maximum(table.sum(1, keepdims=True), 1.0 * BUCKETS))
    return np.vstack([model, np.full(BUCKETS, -np.log(BUCKETS))]).astype(np.float32)


def _scorer(model: np.ndarray, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, sizes = [], []
            for s in kernel.slabs(batch.column("text")):
                bucket, row = trigrams(s)
                sizes.append(np.bincount(row, minlength=s.rows))
                parts.append(np.array([np.bincount(row, line[bucket], minlength=s.rows) for line in model]))
            cols = np.concatenate(parts, 1) if parts else np.zeros((len(model), 0))
            size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(size, pa.int64()), *(pa.array(c, pa.float64()) for c in cols)], [*keep, "n_trigrams", *names])

    return score


def _best(scores: dict[str, Column]) -> Column:
    """The name with the greatest score; of ties the first."""
    best = F.greatest(*scores.values())
    pick = F.lit(None).cast("string")
    for name in reversed(list(scores)):
        pick = F.when(scores[name] == best, F.lit(name)).otherwise(pick)
    return pick


def _attach(rows: DataFrame, table: DataFrame, by: str) -> DataFrame:
    """``rows`` with the one row of ``table`` that has their ``by``, if any."""
    table = cut(table)
    if table.count() <= MOST_SHARED:
        return rows.join(F.broadcast(table), by, "left")
    parts = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id", "n_trigrams"), F.lit(SALT)).cast("int")).join(parts, [by, "_salt"], "left").drop("_salt")


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    markup: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    languages: tuple[str, ...] = LANGUAGES,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row a row: the id, lang (or und), confidence, text_lang, kept, and
    the columns ``carry``."""
    carry = {f"_c{k}": c for k, c in enumerate((carry or {}).values())}, list(carry or {})
    small_batches(docs.sparkSession)
    none = F.lit(None).cast("string")
    low = lambda c: none if c is None else F.nullif(F.lower(F.trim(c)), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        low(markup).alias("markup"),
        low(suffix).alias("suffix"),
        low(host).alias("host"),
        *[c.alias(name) for name, c in carry[0].items()],
    )
    model = text_model(rows, languages)
    names = [f"t{k}" for k in range(len(languages) + 1)]
    kind = dict(rows.dtypes)["id"]
    read = rows.mapInArrow(_scorer(model, names), f"id {kind}, markup string, suffix string, host string, {''.join(f'{c} {k}, ' for c, k in rows.dtypes if c in carry[0])}n_trigrams long, " + ", ".join(f"{n} double" for n in names))
    texts = {name: F.col(t) for name, t in zip((*languages, "und"), names, strict=True)}
    read = read.withColumn("text_lang", F.when(F.col("n_trigrams") > 0, _best(texts)))
    domain = F.substring_index("host", ".", -2)
    read = cut(read.withColumn("domain", F.when(domain != F.col("host"), domain)))

    sure = read.filter(F.col("text_lang").isin(*languages))
    declared = F.when(F.col("markup").isin(*languages), F.col("markup")).when(F.col("markup").isNotNull(), "other")
    # languages x (languages + 1) counts: values of the plan.
    table = {(r.text_lang, r.m): r.n for r in sure.groupBy("text_lang", declared.alias("m")).agg(F.count(F.lit(1)).alias("n")).collect() if r.m}
    shares = lambda by: sure.filter(F.col(by).isNotNull()).groupBy(by).agg(*[F.count_if(F.col("text_lang") == name).alias(name) for name in languages])
    corpus = sure.agg(*[F.count_if(F.col("text_lang") == name).alias(name) for name in languages]).first()
    total = sum(corpus[name] for name in languages)
    prior = {name: (corpus[name] + 1.0) / (total + len(languages)) for name in languages}

    def counts(by: str, prefix: str) -> DataFrame:
        return shares(by).select(F.col(by), *[F.col(name).alias(f"{prefix}{name}") for name in languages])

    joined = read
    for by, prefix, used in (("domain", "d_", host), ("host", "h_", host), ("suffix", "s_", suffix)):
        if used is None:  # no such evidence
            joined = joined.withColumns({f"{prefix}{name}": F.lit(0) for name in languages})
        else:
            joined = _attach(joined, counts(by, prefix), by)
    at = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    size = lambda prefix: sum((at(f"{prefix}{name}") for name in languages), F.lit(0.0))
    scores = {}
    for name, text in list(texts.items())[:-1]:
        of_domain = (at(f"d_{name}") + DOMAIN_WEIGHT * prior[name]) / (size("d_") + DOMAIN_WEIGHT)
        of_host = (at(f"h_{name}") + HOST_WEIGHT * of_domain) / (size("h_") + HOST_WEIGHT)
        of_suffix = F.when(F.col("suffix").isNotNull(), F.log((at(f"s_{name}") + 1) / (corpus[name] + 2.0))).otherwise(0.0)
        said = sum(n for (lang, _), n in table.items() if lang == name)
        of_markup = F.lit(0.0)
        for m in (*languages, "other"):
            chance = (table.get((name, m), 0) + 1.0) / (said + len(languages) + 1)
            of_markup = F.when(declared == m, F.lit(float(np.log(chance)))).otherwise(of_markup)
        scores[name] = TEMPER * text + F.log(of_host) + of_suffix + of_markup
    out = joined.select("id", *carry[0], "n_trigrams", "text_lang", *[v.alias(f"p_{k}") for k, v in scores.items()])
    logs = {name: F.col(f"p_{name}") for name in languages}
    top = F.greatest(*logs.values())
    out = out.withColumns({"best": _best(logs), "confidence": 1 / sum((F.exp(v - top) for v in logs.values()), F.lit(0.0))})
    kept = (F.col("n_trigrams") > 0) & (F.col("text_lang") != "und") & (F.col("confidence") >= LEAST)
    kept = F.coalesce(kept, F.lit(False))
    return out.select(
        F.col("id").alias(id_col),
        F.when(kept, F.col("best")).otherwise("und").alias("lang"),
        F.when(kept, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.coalesce("text_lang", F.lit("und")).alias("text_lang"),
        kept.alias("kept"),
        *[F.col(c).alias(name) for c, name in zip(*carry, strict=True)],
    )


def identify_documents(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """Documents declare ``lang`` and their ``source`` is their host, whose
    last label is the address suffix where it has several."""
    suffix = F.when(F.col("source").contains("."), F.substring_index("source", ".", -1))
    return identify(docs, markup=F.col("lang"), suffix=suffix, host=F.col("source"), carry=carry)


def identify_pages(pages: DataFrame) -> DataFrame:
    """Pages declare ``<html lang>``; host and suffix come from their url."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#:]*)", 1))
    markup = F.substring_index(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1), "-", 1)
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&[#\w]+;", " ")
    return identify(pages.withColumn("_text", plain), "page_id", "_text", markup, F.substring_index(host, ".", -1), host)


def drop_foreign(docs: DataFrame) -> DataFrame:
    """The documents whose language is told, with all their columns."""
    held = {"digest": F.md5(F.coalesce("text", F.lit(""))), "said": F.col("lang"), "origin": F.col("source")}
    gone = identify_documents(docs, held).filter("NOT kept").select("doc_id", *held).distinct()
    digest = fresh(docs, "digest")
    rows, gone = docs.withColumn(digest, held["digest"]).alias("r"), gone.alias("g")
    same = F.col(f"r.{digest}") == F.col("g.digest")
    for mine, other in (("doc_id", "doc_id"), ("lang", "said"), ("source", "origin")):
        same = same & F.col(f"r.{mine}").eqNullSafe(F.col(f"g.{other}"))
    return rows.join(gone, same, "left_anti").drop(digest)
