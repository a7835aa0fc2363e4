"""Exact dedup: a tree merge of sorted digest runs, DataFrame functions only.

Every input partition makes a *run*: its digests in order, one entry a digest
with the best row and a count.  Runs meet in binomial rounds of ``FAN_IN``: a
run is numbered to the base ``FAN_IN``, and in round k the runs whose numbers
differ in digit k only exchange slices, each keeping the entries whose slice (a
number made of the digest) has its own digit k.  What a run receives, sorted, is
merged entry by entry (a sort aggregate streams it), and the best row of each
digest stays.  After log(runs) rounds run and slice agree: all entries of a
digest are one.  At every level a digest comes from ``FAN_IN`` runs at most, so
one that a third of all rows share never gathers in a task.  The result travels
down by run as well: slices to first runs, first runs to their rows.

A key is verified at every level: SHA-256, a second hash and the byte length of
the normalised text all have to agree for two entries to merge.

Defined cases: a null text counts as empty and all empty texts are one group;
null ids sort after all others and keep their rows; of rows alike in id and
length the first read stays, so exactly one row of a group has ``kept``;
columns other than the two named are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.llm.shared import cut, fresh

#: Runs that meet in one merge; the rounds are log(partitions) to this base.
FAN_IN = 8

WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
KEY = ["sha", "probe", "n_bytes"]


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char in WHITE:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
        .select("doc_id", F.char_length("text").alias("n_points"), normalised(F.col("text")).alias("norm"))
        .select(
            "doc_id",
            "n_points",
            F.unhex(F.sha2("norm", 256)).alias("sha"),
            F.xxhash64("norm").alias("probe"),
            F.octet_length("norm").alias("n_bytes"),
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("uid"),
        )
    )


def rounds_of(n_runs: int, fan_in: int) -> int:
    """Rounds until each of ``n_runs`` has met each other."""
    rounds = 0
    while fan_in**rounds < n_runs:
        rounds += 1
    return rounds


def merge_round(runs: DataFrame, k: int, rounds: int, fan_in: int) -> DataFrame:
    """Round ``k``: every entry goes to the run that has its slice's digit k
    for its own; sorted runs are merged to sorted runs."""
    digit = fan_in**k
    of = lambda number: f"(int({number} div {digit}) % {fan_in})"
    slice_of = F.pmod(F.xxhash64(*KEY), F.lit(fan_in**rounds))
    moved = runs.withColumn("slice", slice_of).withColumn("run", F.expr(f"int(run + ({of('slice')} - {of('run')}) * {digit})")).drop("slice")
    in_order = moved.repartition("run").sortWithinPartitions("run", *KEY)
    return in_order.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def merge_runs(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """Each key's one entry after all rounds; columns KEY, best, n."""
    rounds = rounds_of(n_runs, fan_in)
    for k in range(rounds):
        runs = merge_round(runs, k, rounds, fan_in)
    return runs.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(digest_rows(docs, id_col, text_col))
    last = rows.agg(F.max("run")).first()[0]
    # The order of rows in a group: longest original first, then smallest id.
    best = F.struct(
        (-F.col("n_points")).alias("shorter"),
        F.col("doc_id").isNull().alias("no_id"),
        F.col("doc_id").alias("doc_id"),
        F.col("uid").alias("uid"),
    )
    runs = rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    root = merge_runs(runs, (last or 0) + 1, fan_in)
    told = runs.select("run", *KEY).join(root, KEY)
    return rows.join(told, ["run", *KEY]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are found again by id and digest; of rows alike in both one stays.
    """
    own_id, sha, points, nth = (fresh(docs, c) for c in ("id", "sha", "points", "nth"))
    kept = exact_dedup(docs, id_col, text_col).filter("kept")
    kept = kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(own_id), F.col("text_sha256").alias(sha))
    keyed = docs.withColumns(
        {
            own_id: F.coalesce(F.col(id_col).cast("string"), F.lit("")),
            sha: F.sha2(normalised(F.col(text_col)), 256),
            points: F.char_length(F.coalesce(F.col(text_col), F.lit(""))),
        }
    )
    one = Window.partitionBy(own_id, sha).orderBy(F.desc(points))
    return (
        keyed.join(kept, [own_id, sha], "left_semi")
        .withColumn(nth, F.row_number().over(one))
        .filter(F.col(nth) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
