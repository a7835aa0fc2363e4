"""Registered queries: sheets, results of a request, and their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.functions import pricing as P
from tendril.functions import text as T
from tendril.operators import catalog as C
from tendril.operators import quotes as Q
from tendril.operators import results as R
from tendril.plans.quoting import CATALOG_SQL, PRICED_SQL, PRICES_SQL, results
from tendril.sources.tables import catalog, load, price_list

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("grand_totals", PRICED_SQL + " SELECT request_id, CAST(sum(round(CAST(coalesce(total_price, 0) AS DECIMAL(18,4)), 2)) AS DOUBLE) AS grand_total FROM results GROUP BY request_id")
def grand_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total under each quotation."""
    return R.grand_total(results(spark, sf_dir), ["request_id"])


@query("requests_without_match", PRICED_SQL + " SELECT request_id, bool_and(NOT (price IS NOT NULL AND quantity > 10)) AS all_missing FROM results GROUP BY request_id")
def requests_without_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: whether none of a request's lines was found (a priced part, more
    than ten of it)."""
    found = results(spark, sf_dir).withColumn("found", F.when(F.col("quantity") > 10, F.col("price").isNotNull()))
    return R.none_found(found, ["request_id"])


@query(
    "results_json",
    PRICED_SQL + " SELECT request_id, number, status, CAST(round(CAST(unit_base_price AS DECIMAL(18,4)) * CAST(quantity AS DECIMAL(18,4)), 2) AS DOUBLE) AS base_total FROM results",
)
def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: results as JSON, read again."""
    rows = results(spark, sf_dir).select(F.struct("request_id", "number").alias("item_id"), "request_id", "number", "status", "unit_base_price", "quantity", F.lit(97.25).alias("score"))
    told = R.to_json(rows).withColumn("j", F.from_json("json", "status string, total_base_price double"))
    return told.select("item_id.request_id", "item_id.number", "j.status", F.col("j.total_base_price").alias("base_total"))


@query(
    "results_subset",
    PRICED_SQL + " SELECT request_id, number, total_price FROM results r WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = r.request_id AND l.l_linenumber = r.number AND l.l_returnflag = 'R')",
)
def results_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of numbers that are asked for again, here returned ones."""
    again = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("number"))
    return R.subset(results(spark, sf_dir), again, ["request_id", "number"]).select("request_id", "number", "total_price")


@query(
    "items_with_results",
    PRICED_SQL + ", o AS (SELECT request_id, number, code FROM lines), x AS (SELECT request_id, number, total_price FROM results WHERE status = 'exact') SELECT request_id, number, code, total_price FROM o LEFT JOIN x USING (request_id, number)",
)
def items_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, with its exact result if it has one."""
    rows = results(spark, sf_dir)
    found = rows.filter("status = 'exact'").select("request_id", "number", "total_price")
    return R.with_results(rows.select("request_id", "number", "code"), found, ["request_id", "number"])


@query(
    "comparison_sheet",
    f"""WITH {CATALOG_SQL}, {PRICES_SQL}, low AS (SELECT code, min(price) AS list_price FROM prices GROUP BY code),
w AS (SELECT page_id AS code, url, CAST(page_id AS DOUBLE) AS web_price FROM pages)
SELECT c.row_idx AS code, coalesce(c.price, c.cost) AS catalog_price, l.list_price, w.web_price, w.url AS link FROM catalog c LEFT JOIN low l ON l.code = c.row_idx LEFT JOIN w ON w.code = c.row_idx""",
)
def comparison_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: a part's prices by source and its first web link (a page of the same
    number)."""
    none = F.lit(None)
    side = lambda df, source, place, cost, price, url: df.select("code", F.lit(source).alias("source"), F.lit(place).alias("place"), cost.cast("double").alias("cost"), price.cast("double").alias("price"), url.cast("string").alias("url"))
    own = catalog(spark, sf_dir).withColumnRenamed("row_idx", "code")
    low = price_list(spark, sf_dir).groupBy("code").agg(F.min("price").alias("price")).join(own.select("code"), "code", "left_semi")
    web = load(spark, sf_dir, "pages").withColumnRenamed("page_id", "code").join(own.select("code"), "code", "left_semi")
    quotes = side(own, "catalog", 1, F.col("cost"), F.col("price"), none).unionByName(side(low, "price_list", 2, none, F.col("price"), none)).unionByName(side(web, "web", 3, none, F.col("code"), F.col("url")))
    return R.comparison_rows(quotes, ["code"]).select("code", "catalog_price", "list_price", "web_price", F.get("links", F.lit(0)).alias("link"))


@query(
    "first_reports",
    """WITH r AS (SELECT lower(p_name) AS norm_name, p_size AS source_idx, p_partkey AS row_idx, p_retailprice AS cost, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_size, p_partkey) AS nth FROM part)
SELECT norm_name, source_idx, row_idx, cost FROM r WHERE nth = 1""",
)
def first_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first purchase of each name, a size being a report."""
    rows = load(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("source_idx"), F.col("p_partkey").alias("row_idx"), F.col("p_retailprice").alias("cost"))
    return C.first_by_name(rows).select("norm_name", "source_idx", "row_idx", "cost")


@query(
    "kit_sheet",
    """WITH r AS (SELECT p_brand AS sheet, p_type AS grp, p_partkey AS row_idx, p_retailprice AS cost, CASE WHEN p_partkey % 19 = 0 THEN 'kit_total' WHEN p_partkey % 23 = 0 THEN 'sub_kit' ELSE 'item' END AS entry_type FROM part),
m AS (SELECT k.row_idx AS kit_row, m.row_idx, m.cost FROM r k JOIN r m ON k.sheet = m.sheet AND k.grp = m.grp WHERE k.entry_type = 'kit_total' AND m.entry_type <> 'kit_total' UNION ALL SELECT row_idx, row_idx, cost FROM r WHERE entry_type = 'sub_kit')
SELECT kit_row, count(*) AS n_components, count(*) AS n_priced, CAST(round(sum(CAST(cost AS DECIMAL(18,4)) * 2), 2) AS DOUBLE) AS quote_cost, CAST(round(sum(CAST(cost AS DECIMAL(18,4))), 2) AS DOUBLE) AS sum_cost FROM m GROUP BY kit_row""",
)
def kit_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kits and their members' sums; a brand is a sheet and a
    type a group, two of each member."""
    key = F.col("p_partkey")
    kind = F.when(key % 19 == 0, "kit_total").when(key % 23 == 0, "sub_kit").otherwise("item")
    rows = load(spark, sf_dir, "part").select(
        F.col("p_brand").alias("sheet"), F.col("p_type").alias("components_group"), key.alias("row_idx"), F.col("p_retailprice").alias("cost"), F.lit(None).cast("double").alias("price"), kind.alias("entry_type")
    )
    return C.catalog_kit_totals(rows, ["sheet"], 2.0).select("kit_row", "n_components", "n_priced", "quote_cost", "sum_cost")


@query(
    "line_labels",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_linenumber % 3 = 0 THEN '—' WHEN l_linenumber % 3 = 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5' END AS quantity,
  CASE WHEN l_returnflag = 'R' THEN '−5.0% от цены в интернете' ELSE '+30.0%' END AS adjustment FROM lineitem""",
)
def line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and price adjustments as text."""
    nth = F.col("l_linenumber") % 3
    amount = F.when(nth == 1, F.col("l_quantity")).when(nth == 2, F.col("l_quantity") + 0.5)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", T.quantity_text(amount).alias("quantity"), P.adjustment_label(F.col("l_returnflag") == "R").alias("adjustment"))


@query(
    "internet_links",
    """WITH w AS (SELECT page_id % 40 AS item, page_id, url, regexp_matches(lower(url), '^https?://') AS card FROM pages WHERE url <> '' AND NOT regexp_matches(lower(url), '/search\\?|/search/|search\\?text=|\\?q=')),
r AS (SELECT item, url, row_number() OVER (PARTITION BY item ORDER BY card DESC, page_id) AS nth FROM w)
SELECT item, url AS internet_url FROM r WHERE nth = 1""",
)
def internet_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: an item's link: of forty items' pages the best product page, else
    the best of those that may set a price."""
    key = F.col("page_id")
    quotes = load(spark, sf_dir, "pages").select((key % 40).alias("item"), F.lit("web").alias("source"), "url", F.lit(100.0).alias("match_score"), key.cast("double").alias("price"), key.alias("pos"))
    return Q.internet_url(quotes, ["item"])
