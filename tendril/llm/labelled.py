"""Labelled rows that a model may learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.llm.shared import held_out


def learnable(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled rows outside the held
    out quarter, taken by a hash of their ids; of rows of one id the one whose
    text has the least hash.  The ids are the only broadcast: ``rows`` numbers at
    most."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("_known")).agg(F.max(label).cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("_known"), "_known").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(some), F.col("doc_id") == F.col("_known"))
    return met.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label")
