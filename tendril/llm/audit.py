"""Which filter removes what, in every order of five filters.

Each whole text fails some of five conditions, a mask of five bits.  Texts are
counted by part and mask; a subset-zeta transform turns the counts into the
survivors of every filter subset, and each step of each order is the difference
between the survivors of two neighbouring subsets.  The same transform over the
counts of labelled texts gives the labels that a step costs.

Conditions (words are maximal ``[^\\x20\\x09-\\x0D]+``, case-sensitive): A under 200
words; B ``100 * distinct words < 50 * words``; C ``100 * [A-Z] > 3 * code
points``; D any of ``#$%&*|``; E equal to the text of any smaller id, anywhere in
the table.

Only counts leave the scan, at most ``32 * 4`` for each part.  E needs no join of
copies: what passes E is counted over the rows of each text's least id, and what
fails it is the difference, so a hot text meets partial aggregates only (it is
told by its SHA-256 and length).

Defined cases: a null text counts as empty, a null part as the empty string; a
text without words passes B and C; repeated rows are separate documents, and
rows of one id and text pass E together; a row without id fails E if any row with
an id has its text; labels of an id that occur several times count as their
greatest value; documents without labels are neither good nor toxic; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
FULL = (1 << len(FILTERS)) - 1
SPACE = r"[\x20\x09-\x0D]+"
STEPS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in STEPS)


def failures(text: Column, words: Column) -> Column:
    """The bits of A to D; ``words`` is the array of the text's words."""
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, failed filters and labels."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    same = F.struct(F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size"))
    rows = rows.select("id", "part", same.alias("same"), failures(F.col("text"), F.col("words")).alias("mask"))
    rows = rows.groupBy("id", "same", "part", "mask").agg(F.count(F.lit(1)).alias("n"))

    told = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.max("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic")
    )
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = rows.join(told, "id", "left").select("id", "same", "part", "mask", no("good"), no("toxic"), "n")

    by = ["part", "mask", "good", "toxic"]
    least = rows.groupBy("same").agg(F.min("id").alias("id"))  # min passes over nulls
    r, m = rows.alias("r"), least.alias("m")
    first = r.join(m, (F.col("r.same") == F.col("m.same")) & F.col("r.id").eqNullSafe(F.col("m.id")), "left_semi")
    every = rows.groupBy(*by).agg(F.sum("n").alias("n"))
    passed = first.groupBy(*by).agg(F.sum("n").alias("n"))
    # Of each cell of A to D: those that pass E, and the others.
    e = 1 << 4
    both = passed.unionByName(passed.withColumns({"mask": F.col("mask") + e, "n": -F.col("n")})).unionByName(every.withColumn("mask", F.col("mask") + e))
    return both.groupBy(*by).agg(F.sum("n").alias("n")).filter("n > 0")


def zeta(counts: np.ndarray) -> np.ndarray:
    """Sums over the subsets of each mask, along the last axis."""
    sums = counts.copy()
    masks = np.arange(sums.shape[-1])
    for bit in range(len(FILTERS)):
        holds = masks[(masks >> bit) & 1 == 1]
        sums[..., holds] += sums[..., holds ^ (1 << bit)]
    return sums


def _orders() -> tuple[list[str], np.ndarray, np.ndarray]:
    """Every order and its steps: the filter, and the filters before it."""
    orders = list(permutations(range(len(FILTERS))))
    own = np.array(orders)
    bits = 1 << own
    return ["".join(FILTERS[k] for k in o) for o in orders], own, np.cumsum(bits, 1) - bits


def audit_part(cells: pd.DataFrame) -> pd.DataFrame:
    """All steps of one part, from its cells (at most 128)."""
    # all documents, good ones, toxic ones
    counts = np.zeros((3, FULL + 1), np.int64)
    n = cells["n"].to_numpy()
    for k, own in enumerate((n, n * cells["good"].to_numpy(), n * cells["toxic"].to_numpy())):
        np.add.at(counts[k], cells["mask"].to_numpy(), own)
    # Those that fail none of S have masks within S's complement.
    survivors = zeta(counts)[:, FULL - np.arange(FULL + 1)]
    names, own, before = _orders()
    after = before | 1 << own
    lost = survivors[:, before] - survivors[:, after]
    removed = lost[0]
    fails = survivors[0, 0] - survivors[0, 1 << np.arange(len(FILTERS))]
    shapley = np.zeros(len(FILTERS), np.int64)
    np.add.at(shapley, own, removed)
    columns = [survivors[0, after], removed, fails[own] - removed, counts[0, 1 << own], lost[1], lost[2], shapley[own]]
    steps = len(FILTERS)
    out = pd.DataFrame({"part": cells["part"].iloc[0], "filter_order": np.repeat(names, steps), "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names))})
    return out.assign(**{c: v.ravel() for c, v in zip(STEPS, columns, strict=True)})


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step."""
    return mask_counts(docs, labels, id_col, text_col, part_col).groupBy("part").applyInPandas(audit_part, SCHEMA)
