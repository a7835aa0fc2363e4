"""JSON documents rewritten value by value, in the plan.

A document is parsed to a VARIANT and taken apart level by level: each object's
members and each array's items become rows, members of unwanted keys are left out,
texts are rewritten, and the pieces are put together again from the deepest level
up.  Each level is written once.  Work is by rows of values, so large documents are
spread like small ones; only one container's direct pieces ever meet in a group.

Members come back in the order of their keys, and numbers in their shortest form.
A text that is no JSON, or none, gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.functions.pii import SENSITIVE_KEYS, mask
from tendril.sources.shared import written


def _kind(value: Column) -> Column:
    return F.substring(F.schema_of_variant(value), 1, 5)


def walk(docs: DataFrame, id_col: str, json_col: str, drop: list[str], rewrite: Callable[[Column], Column]) -> DataFrame:
    """(id, json): ``docs`` without the members whose key, case aside, is in
    ``drop``, every text rewritten; ids are unique."""
    spark = docs.sparkSession
    root = docs.select(F.col(id_col).alias("id"), F.lit("").alias("node"), F.try_parse_json(json_col).alias("v")).filter("v IS NOT NULL")
    levels = [written(root.withColumns({"parent": F.lit(None).cast("string"), "pos": F.lit(0), "key": F.lit(None).cast("string"), "kind": _kind(F.col("v"))}))]
    while True:
        inner = levels[-1].filter(F.col("kind").isin("OBJEC", "ARRAY")).select("id", F.col("node").alias("parent"), "v")
        if inner.isEmpty():
            break
        parts = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        parts = parts.select("id", F.concat_ws(".", F.nullif("parent", F.lit("")), F.col("pos").cast("string")).alias("node"), F.col("value").alias("v"), "parent", "pos", "key")
        kept = parts.filter(F.col("key").isNull() | ~F.lower("key").isin(*drop))
        levels.append(written(kept.withColumn("kind", F.when(F.col("v").isNotNull(), _kind(F.col("v"))))))

    quoted = lambda text: F.to_json(text.cast("variant"))
    below = None
    for level in reversed(levels):
        leaf = F.when(F.col("kind") == "STRIN", quoted(rewrite(F.col("v").cast("string")))).otherwise(F.to_json("v"))
        if below is None:
            done = level.withColumn("json", F.when(F.col("kind") == "OBJEC", "{}").when(F.col("kind") == "ARRAY", "[]").otherwise(leaf))
        else:
            pieces = F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"])
            named = below.withColumn("piece", F.when(F.col("key").isNotNull(), F.concat(quoted(F.col("key")), F.lit(":"), F.col("json"))).otherwise(F.col("json")))
            held = named.groupBy("id", F.col("parent").alias("node")).agg(F.array_join(pieces, ",").alias("inside"))
            inside = F.coalesce("inside", F.lit(""))
            json = F.when(F.col("kind") == "OBJEC", F.concat(F.lit("{"), inside, F.lit("}"))).when(F.col("kind") == "ARRAY", F.concat(F.lit("["), inside, F.lit("]"))).otherwise(leaf)
            done = level.join(held, ["id", "node"], "left").withColumn("json", json)
        below = done.select("id", "node", "parent", "pos", "key", "json")
    return docs.select(F.col(id_col).alias("id")).join(below.select("id", "json"), "id", "left").withColumnRenamed("id", id_col)


def anonymize(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Documents without members that name persons or addresses, personal data
    in all other texts masked."""
    return walk(docs, id_col, json_col, SENSITIVE_KEYS, mask)
