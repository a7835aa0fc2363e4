"""The star-schema tables as the entities of quotation matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Every column of lineitem: (orderkey, linenumber) repeats, the whole row doesn't.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key: millions of short rows lie in one small file,
    which Spark reads in one task, however much there is to do for each."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, cost, price (null for every fifth row), row_idx."""
    raised = F.round(F.col("p_retailprice").cast("decimal(18,4)") * F.lit("1.2").cast("decimal(5,4)"), 2).cast("double")
    return load(spark, sf_dir, "part").select(
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"),
        F.col("p_retailprice").alias("cost"),
        F.when(F.col("p_partkey") % 5 != 0, raised).alias("price"),
        F.col("p_partkey").alias("row_idx"),
    )


def price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, supplier id and unit price of every sale."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("code"),
        F.col("l_suppkey").alias("supplier_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order is one request: its lines numbered, with part and quantity.

    Lines that are equal down to the quantity have one part and one quantity, so
    that it's the same which of them comes first: the columns after it aren't read.
    """
    order = LINE_ORDER[: LINE_ORDER.index("l_quantity") + 1]
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), number.alias("number"), F.col("l_partkey").alias("code"), F.col("l_quantity").alias("quantity")
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned stock by part."""
    returned = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return returned.groupBy(F.col("l_partkey").alias("code")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("stock"))
