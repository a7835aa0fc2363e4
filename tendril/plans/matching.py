"""Registered query: requests matched through every step of the flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tendril.operators import catalog as C
from tendril.operators import flow as Fl
from tendril.plans.quoting import CATALOG_SQL
from tendril.sources.tables import LINE_ORDER, catalog, load

QUERIES: dict = {}
ORACLES: dict = {}

#: Numbers between the three forms of an item.
FORM = 100_000_000

MATCHED_SQL = f"""WITH {CATALOG_SQL}, p AS (SELECT p_partkey, p_name, p_size, name, cost, price FROM catalog JOIN part ON p_partkey = row_idx),
least AS (SELECT p_name, min(p_partkey) AS k FROM p GROUP BY 1),
asked AS (SELECT p_name, k AS item, 0 AS form, lower(p_name) AS query FROM least UNION ALL SELECT l.p_name, l.k, 1, lower(p.name) FROM least l JOIN p ON p.p_partkey = l.k),
held AS (SELECT item, form, p_partkey AS k, least(length(p.name) / CAST(length(query) AS DOUBLE), 1.5) AS longer, row_number() OVER (PARTITION BY item, form ORDER BY p_partkey) AS rank FROM asked JOIN p ON list_has_all(string_split(lower(p.name), ' '), string_split(query, ' '))),
items AS (
  SELECT form * {FORM} + item AS item_id, item, min(k) AS k, arg_max(k, longer * 1000000 - rank) AS longest, 100.0 AS score FROM held WHERE rank <= 5 GROUP BY item, form
  UNION ALL SELECT {2 * FORM} + k, k, k, k, 100.0 * (1 - 1 / CAST(2 * length(p.name) + 1 AS DOUBLE)) FROM least JOIN p ON p_partkey = k
), g AS (
  SELECT l_partkey AS k, s_name AS supplier, strftime(l_shipdate, '%d.%m.%Y') AS purchase_date, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS nth
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
), m AS (
  SELECT i.item_id, i.score, p.name AS matched_name, p.cost AS unit_cost, coalesce(p.price, CAST(round(CAST(f.cost AS DECIMAL(18, 4)) * 1.1, 2) AS DOUBLE)) AS base, o.p_size AS quantity, g.supplier, g.purchase_date
  FROM items i JOIN p ON p.p_partkey = i.longest JOIN p o ON o.p_partkey = i.item JOIN p f ON f.p_partkey = i.k LEFT JOIN g ON g.k = i.k AND nth = 1
)
SELECT item_id, 'exact' AS status, 'catalog' AS source, round(score, 6) AS score, matched_name, unit_cost, base AS unit_base_price, CAST(round(CAST(base AS DECIMAL(18, 4)) * 1.3, 2) AS DOUBLE) AS unit_price,
  CAST(round(round(CAST(base AS DECIMAL(18, 4)) * 1.3, 2) * quantity, 2) AS DOUBLE) AS total_price, supplier, purchase_date, false AS internet, false AS is_kit, 1 AS rung FROM m"""


def request_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part name as it is (two of a catalog name's words), the whole
    catalog name of its first part in capitals, and that name with a letter
    too many."""
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_idx"), "p_name", F.col("p_size").cast("double").alias("quantity"))
    first = catalog(spark, sf_dir).select("row_idx", F.col("name").alias("full")).join(parts, "row_idx")
    first = first.groupBy("p_name").agg(F.min_by(F.struct("row_idx", "full", "quantity"), "row_idx").alias("f")).select("p_name", "f.*")
    forms = F.array(*[F.struct((F.lit(k * FORM) + F.col("row_idx")).alias("item_id"), name.alias("name")) for k, name in enumerate((F.col("p_name"), F.upper("full"), F.concat("full", F.lit("s"))))])
    return first.select(F.explode(forms).alias("i"), "quantity").select("i.*", F.lit("").alias("specifications"), "quantity")


def tables(spark: SparkSession, sf_dir: str) -> Fl.Tables:
    """Catalog, a price list of one supplier, stock and purchases by part; no
    web quotes were fetched."""
    shelf = catalog(spark, sf_dir)
    names = shelf.select("row_idx", "name", "cost")
    raised = F.round(F.col("cost").cast("decimal(18,4)") * F.lit("1.1").cast("decimal(3,1)"), 2).cast("double")
    prices = names.select("row_idx", "name", F.col("row_idx").cast("string").alias("code"), F.lit("ООО Весы").alias("supplier"), raised.alias("price"))
    lines = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    latest = F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("l_shipdate"), "l_linenumber", "l_suppkey", *[c for c in LINE_ORDER if c not in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")]))
    goods = lines.withColumn("nth", latest).filter("nth = 1").join(names, F.col("l_partkey") == F.col("row_idx"))
    goods = goods.select("row_idx", "name", F.col("s_name").alias("supplier"), F.date_format("l_shipdate", "dd.MM.yyyy").alias("purchase_date"), "cost", F.lit(None).cast("double").alias("price"), F.lit(False).alias("procurement"))
    stock = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("row_idx")).agg(F.sum("l_quantity").alias("quantity")).join(names.drop("cost"), "row_idx")
    web = spark.createDataFrame([], "item_id long, label string, matched_name string, url string, match_score double, price double, pos int")
    return Fl.Tables(C.classify(shelf.withColumn("sheet", F.lit(1)), ["sheet"]), prices, stock.select("row_idx", "name", "quantity"), goods, web)


def match_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in three forms through candidates, catalog, purchases,
    ladder and prices."""
    out = Fl.match_items(request_forms(spark, sf_dir), tables(spark, sf_dir), sheets=["sheet"])
    shown = ["status", "source", "matched_name", "unit_cost", "unit_base_price", "unit_price", "total_price", "supplier", "purchase_date", "internet", "is_kit"]
    return out.select("item_id", *shown, F.round("score", 6).alias("score"), F.col("rung").cast("int").alias("rung"))


def direct_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: the best catalog row of each request's name, by index."""
    found = Fl.direct_catalog(request_forms(spark, sf_dir), tables(spark, sf_dir).catalog)
    return found.select("item_id", F.col("row_idx").cast("long").alias("row_idx"), F.col("name").alias("matched_name"), F.round("score", 6).alias("score"), "cost")


def goods_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase of each request's name, by index."""
    found = Fl.goods_match(request_forms(spark, sf_dir), tables(spark, sf_dir).goods)
    return found.select("item_id", F.col("goods_name").alias("matched_name"), "supplier", "purchase_date", F.round("goods_score", 6).alias("score"))


_FORMS_SQL = MATCHED_SQL[: MATCHED_SQL.index(", m AS (")]
QUERIES |= {"match_items": match_items, "direct_catalog": direct_catalog, "goods_match": goods_match}
ORACLES |= {
    "match_items": MATCHED_SQL,
    "direct_catalog": f"{_FORMS_SQL} SELECT item_id, i.k AS row_idx, p.name AS matched_name, round(score, 6) AS score, p.cost FROM items i JOIN p ON p.p_partkey = i.k",
    # A part without a sale isn't among the purchases; every part of these tables has one.
    "goods_match": f"{_FORMS_SQL} SELECT item_id, p.name AS matched_name, g.supplier, g.purchase_date, round(score, 6) AS score FROM items i JOIN p ON p.p_partkey = i.k JOIN g ON g.k = i.k AND g.nth = 1",
}
