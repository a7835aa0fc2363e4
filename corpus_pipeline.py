"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared checkpoint folder and hands what it reads back to
the next.  All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tendril.llm.exact import drop_copies
from tendril.llm.langid import drop_foreign
from tendril.llm.nearjoin import drop_near_copies
from tendril.llm.packing import pack_documents
from tendril.llm.shared import shared_folder, table, tokenizer_path
from tendril.llm.substring import drop_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told (operator 8)."""
    return drop_foreign(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 4)."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five words a shingle and a
    similarity of 0.8 or more (operator 5)."""
    return drop_near_copies(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has (operator 1)."""
    return drop_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces placed in sequences (operator 9)."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: SQL can't express the middle stages; tests/llm/test_pipeline.py has them by brute force.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; what the stage before wrote is
    read when the rows are."""
    docs, folder, before = table(spark, sf_dir, "documents"), _folder(spark), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
