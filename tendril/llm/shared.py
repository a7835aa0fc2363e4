"""Helpers that the operators share: tables, checkpoints and batch sizes."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to Python at once; keeps a batch of long texts small.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the machine keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Batches for Python that hold whole texts: few rows, and few bytes (or
    one row)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there.

    The folder is the cluster's ``spark.checkpoint.dir``.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, a
    temporary one, but only if all of Spark runs in this process."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return tempfile.mkdtemp(prefix="checkpoints")


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now; it
    goes by the driver's garbage, of which a driver that only plans has little."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows for which a table of short rows gets a partition of its own.
FIT_ROWS = 100_000


def fitted(df: DataFrame) -> DataFrame:
    """``cut(df)``, in as many partitions as its rows call for: what an
    iteration starts from is often far smaller than what its partitions were
    laid out for, and every task of it writes files."""
    out = cut(df)
    return out.coalesce(max(1, -(-out.count() // FIT_ROWS)))


def fold_case(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of(column: Column) -> Column:
    """crc32 of a key as text, the split that the labels use."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    """The quarter of the rows whose labels are never learnt."""
    return bucket_of(doc_id) % 4 == 2
