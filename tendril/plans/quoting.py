"""Registered queries: names, catalog, pricing, quotes, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tendril.functions import pricing as P
from tendril.functions import text as T
from tendril.operators import catalog as C
from tendril.operators import matching as M
from tendril.operators import quotes as Q
from tendril.operators import results as R
from tendril.sources.tables import LINE_ORDER, catalog, load, price_list, registry, request_lines

QUERIES: dict = {}
ORACLES: dict = {}

CATALOG_SQL = """catalog AS (
  SELECT p_partkey AS row_idx, p_name || ' ' || p_type || ' ' || p_brand AS name, p_retailprice AS cost,
         CASE WHEN p_partkey % 5 <> 0 THEN CAST(round(CAST(p_retailprice AS DECIMAL(18,4)) * CAST(1.2 AS DECIMAL(5,4)), 2) AS DOUBLE) END AS price
  FROM part)"""
LINES_SQL = """lines AS (
  SELECT l_orderkey AS request_id, l_partkey AS code, l_quantity AS quantity,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS number
  FROM lineitem)"""
PRICES_SQL = """prices AS (
  SELECT l_partkey AS code, l_suppkey AS supplier_id, l_extendedprice / l_quantity AS price
  FROM lineitem)"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def priced_lines(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Request lines with their catalog row's cost and price, marked up;
    ``together``: a request's lines lie in one partition, and go there before
    anything is made of them."""
    rows = catalog(spark, sf_dir).select(F.col("row_idx").alias("code"), "name", "cost", "price")
    lines = request_lines(spark, sf_dir).join(rows, "code")
    lines = lines.repartition("request_id") if together else lines
    lines = lines.withColumn("unit_base_price", F.coalesce(P.present(F.col("price")), F.col("cost")))
    return P.priced(lines, "cost", "unit_base_price", "quantity", F.lit(False))


PRICED_SQL = f"""WITH {CATALOG_SQL}, {LINES_SQL}, priced AS (
  SELECT l.request_id, l.number, l.code, l.quantity, c.name, c.cost, coalesce(nullif(c.price, 0), c.cost) AS unit_base_price, c.price,
         CAST(round(CAST(c.cost AS DECIMAL(18,4)) * CAST(l.quantity AS DECIMAL(18,4)), 2) AS DOUBLE) AS total_cost,
         CAST(round(CAST(coalesce(nullif(c.price, 0), c.cost) AS DECIMAL(18,4)) * CAST(1.3 AS DECIMAL(7,4)), 2) AS DOUBLE) AS unit_price
  FROM lines l JOIN catalog c ON c.row_idx = l.code), results AS (
  SELECT *, CAST(round(CAST(unit_price AS DECIMAL(18,4)) * CAST(quantity AS DECIMAL(18,4)), 2) AS DOUBLE) AS total_price,
         CASE WHEN price IS NOT NULL THEN 'exact' WHEN quantity > 25 THEN 'similar' ELSE 'not_found' END AS status
  FROM priced)"""


def results(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    status = F.when(F.col("price").isNotNull(), "exact").when(F.col("quantity") > 25, "similar").otherwise("not_found")
    return priced_lines(spark, sf_dir, together).withColumn("status", status)


@query(
    "quote_summary",
    PRICED_SQL
    + """
SELECT request_id, count(*) AS items, count(*) FILTER (WHERE status = 'exact') AS exact_items, count(*) FILTER (WHERE status = 'similar') AS similar_items,
       count(*) FILTER (WHERE status = 'not_found') AS missing_items, CAST(sum(CAST(coalesce(total_cost, 0) AS DECIMAL(18,2))) AS DOUBLE) AS sum_cost,
       CAST(sum(round(CAST(unit_base_price AS DECIMAL(18,4)) * CAST(quantity AS DECIMAL(18,4)), 2)) AS DOUBLE) AS sum_base,
       CAST(sum(CAST(coalesce(total_price, 0) AS DECIMAL(18,2))) AS DOUBLE) AS sum_price
FROM results GROUP BY request_id""",
)
def quote_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 over every request: counts by status and totals."""
    return results(spark, sf_dir).groupBy("request_id").agg(*R.summary_columns())


@query(
    "normalize_names",
    f"""WITH {CATALOG_SQL}
SELECT regexp_replace(regexp_replace(trim(lower(name)), '\\s+', ' ', 'g'), '[«»"'']', '', 'g') AS norm_name, count(*) AS n, min(row_idx) AS first_row
FROM catalog GROUP BY 1""",
)
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = catalog(spark, sf_dir).withColumn("norm_name", T.normalize_name("name"))
    return named.groupBy("norm_name").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row"))


@query(
    "catalog_classify_carry",
    """WITH rows AS (
  SELECT p_partkey AS row_idx, p_brand AS sheet,
         CASE WHEN p_partkey % 17 = 0 THEN 'составляющие ' || p_name WHEN p_partkey % 29 = 0 THEN 'комплект ' || p_name ELSE p_name END AS name,
         CASE WHEN p_partkey % 13 = 0 OR p_partkey % 58 = 0 THEN NULL ELSE p_retailprice END AS cost,
         CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS price
  FROM part), kinds AS (
  SELECT *, CASE WHEN name LIKE '%составляющие%' THEN 'components_header' WHEN cost IS NULL AND price IS NULL THEN 'section'
                 WHEN name LIKE '%комплект%' AND price IS NOT NULL AND cost IS NULL THEN 'kit_total'
                 WHEN name LIKE '%комплект%' AND cost IS NOT NULL THEN 'sub_kit' ELSE 'item' END AS entry_type
  FROM rows), marks AS (
  SELECT *, max(CASE WHEN entry_type IN ('components_header', 'section') THEN row_idx END) OVER (PARTITION BY sheet ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS mark FROM kinds)
SELECT m.row_idx, m.sheet, m.entry_type, CASE WHEN h.entry_type = 'components_header' THEN h.name END AS components_group
FROM marks m LEFT JOIN kinds h ON h.row_idx = m.mark""",
)
def catalog_classify_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 and W1, a brand being a sheet."""
    key = F.col("p_partkey")
    rows = load(spark, sf_dir, "part").select(
        key.alias("row_idx"),
        F.col("p_brand").alias("sheet"),
        F.concat(F.when(key % 17 == 0, "составляющие ").when(key % 29 == 0, "комплект ").otherwise(""), F.col("p_name")).alias("name"),
        F.when((key % 13 != 0) & (key % 58 != 0), F.col("p_retailprice")).alias("cost"),
        F.when(key % 13 != 0, F.col("p_retailprice")).alias("price"),
    )
    return C.classify(rows, ["sheet"]).select("row_idx", "sheet", "entry_type", "components_group")


@query(
    "exact_match_join",
    f"""WITH {CATALOG_SQL}, {LINES_SQL}, named AS (SELECT lower(name) AS norm_name, row_idx, cost FROM catalog),
last AS (SELECT norm_name, max(row_idx) AS row_idx FROM named GROUP BY norm_name)
SELECT l.request_id, l.number, n.norm_name, t.row_idx AS matched_row, c.cost
FROM lines l JOIN named n ON n.row_idx = l.code JOIN last t ON t.norm_name = n.norm_name JOIN named c ON c.row_idx = t.row_idx""",
)
def exact_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request lines to the last catalog row of the same name."""
    rows = catalog(spark, sf_dir)
    asked = request_lines(spark, sf_dir).join(rows.select(F.col("row_idx").alias("code"), T.normalize_name("name").alias("norm_name")), "code")
    found = C.last_by_name(rows).select("norm_name", F.col("row_idx").alias("matched_row"), "cost")
    return asked.join(found, "norm_name").select("request_id", "number", "norm_name", "matched_row", "cost")


@query(
    "supplier_contains_join",
    f"""WITH {PRICES_SQL}, needs AS (SELECT s_suppkey AS need_id, 'plier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS part FROM supplier),
named AS (SELECT s_suppkey, s_name FROM supplier), met AS (
  SELECT n.need_id, s.s_suppkey FROM needs n JOIN named s ON strpos(lower(s.s_name), n.part) > 0)
SELECT m.need_id, count(*) AS n_prices, min(p.price) AS lowest, max(p.price) AS highest
FROM met m JOIN prices p ON p.supplier_id = m.s_suppkey GROUP BY m.need_id""",
)
def supplier_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows whose supplier's name holds a given part of a name."""
    names = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier"))
    prices = price_list(spark, sf_dir).join(names, "supplier_id")
    needs = names.select(F.col("supplier_id").alias("need_id"), F.concat(F.lit("PLIER#"), F.lpad(F.col("supplier_id").cast("string"), 9, "0")).alias("supplier"))
    met = Q.by_supplier(needs, prices.select("supplier", "price"))
    return met.groupBy("need_id").agg(F.count(F.lit(1)).alias("n_prices"), F.min("price").alias("lowest"), F.max("price").alias("highest"))


@query(
    "goods_latest_purchase",
    """WITH r AS (
  SELECT l_partkey AS code, l_suppkey AS supplier_id, strftime(l_shipdate, '%d.%m.%Y') AS purchase_date,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS nth
  FROM lineitem)
SELECT r.code, r.supplier_id, s.s_name AS supplier, r.purchase_date FROM r JOIN supplier s ON s.s_suppkey = r.supplier_id WHERE nth = 1""",
)
def goods_latest_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of each part, with its supplier."""
    order = [F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"]
    last = M.top(load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), ["l_partkey"], order, 1)
    names = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("supplier"))
    return last.join(names, "l_suppkey").select(F.col("l_partkey").alias("code"), F.col("l_suppkey").alias("supplier_id"), "supplier", F.date_format("l_shipdate", "dd.MM.yyyy").alias("purchase_date"))


@query(
    "extra_price_quotes",
    f"""WITH {PRICES_SQL}, one AS (
  SELECT *, row_number() OVER (PARTITION BY code, supplier_id ORDER BY price) AS a FROM (SELECT DISTINCT code, supplier_id, price FROM prices WHERE price < 2000)), three AS (
  SELECT code, supplier_id, price, row_number() OVER (PARTITION BY code ORDER BY price, supplier_id) AS place FROM one WHERE a = 1)
SELECT code, supplier_id, price, place FROM three WHERE place <= 3""",
)
def extra_price_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a part's good offers (under 2,000) the three cheapest, one a
    supplier."""
    hits = price_list(spark, sf_dir).select("code", F.col("supplier_id").alias("supplier"), "price", F.when(F.col("price") < 2000, 100.0).otherwise(90.0).alias("score"), F.struct("price", "supplier_id").alias("rank"))
    return Q.extra_quotes(hits, ["code"]).select("code", F.col("supplier").alias("supplier_id"), "price", "place")


@query(
    "local_quote_priority",
    f"""WITH {CATALOG_SQL}, {PRICES_SQL}, stock AS (SELECT l_partkey AS code, sum(CAST(l_quantity AS DECIMAL(18,2))) AS stock FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
best AS (SELECT code, min(price) AS price FROM prices WHERE price < 2000 GROUP BY code)
SELECT c.row_idx AS code, CASE WHEN b.price IS NOT NULL THEN 'price_list' WHEN c.price IS NOT NULL THEN 'catalog' ELSE 'registry' END AS source,
       coalesce(b.price, c.price, CAST(s.stock AS DOUBLE)) AS price
FROM catalog c LEFT JOIN best b ON b.code = c.row_idx LEFT JOIN stock s ON s.code = c.row_idx
WHERE coalesce(b.price, c.price, CAST(s.stock AS DOUBLE)) IS NOT NULL""",
)
def local_quote_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price list, catalog, registry; the first with a price."""
    fields = lambda df, source, price: df.select("code", F.lit(source).alias("source"), price.alias("price"), F.lit(None).cast("double").alias("cost"), F.lit(100.0).alias("match_score"), F.lit(0).alias("pos"))
    lowest = price_list(spark, sf_dir).filter("price < 2000").groupBy("code").agg(F.min("price").alias("price"))
    quotes = (
        fields(lowest, "price_list", F.col("price"))
        .unionByName(fields(catalog(spark, sf_dir).withColumnRenamed("row_idx", "code"), "catalog", F.col("price")))
        .unionByName(fields(registry(spark, sf_dir), "registry", F.col("stock")))
    )
    return Q.best_local(quotes, ["code"]).select("code", "source", "price")


@query(
    "price_upper_median",
    f"""WITH {PRICES_SQL}, r AS (SELECT code, price, row_number() OVER (PARTITION BY code ORDER BY price) AS nth, count(*) OVER (PARTITION BY code) AS n FROM prices)
SELECT code, n, price AS upper_median FROM r WHERE nth = n // 2 + 1""",
)
def price_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle price of each part, the upper one of two."""
    prices = price_list(spark, sf_dir)
    by = Window.partitionBy("code")
    ranked = prices.select("code", "price", F.row_number().over(by.orderBy("price")).alias("nth"), F.count(F.lit(1)).over(by).alias("n"))
    return ranked.filter(F.col("nth") == F.floor(F.col("n") / 2) + 1).select("code", "n", F.col("price").alias("upper_median"))


@query(
    "kit_aggregate",
    PRICED_SQL
    + """, parts AS (SELECT *, CASE WHEN code % 7 = 0 THEN NULL ELSE cost END AS part_cost FROM results)
SELECT request_id, CASE WHEN count(*) = count(part_cost) THEN CAST(round(sum(CAST(part_cost AS DECIMAL(18,4)) * CAST(quantity AS DECIMAL(18,4))), 2) AS DOUBLE) END AS strict_cost,
       CAST(round(sum(CAST(part_cost AS DECIMAL(18,4))), 2) AS DOUBLE) AS lenient_cost,
       CAST(round(100 * count(part_cost) / CAST(count(*) AS DOUBLE), 1) AS DOUBLE) AS found_share, count(*) FILTER (WHERE part_cost IS NOT NULL OR price IS NOT NULL) AS n_priced
FROM parts GROUP BY request_id""",
)
def kit_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a kit, its lines as components."""
    parts = priced_lines(spark, sf_dir).withColumn("part_cost", F.when(F.col("code") % 7 != 0, F.col("cost")))
    return parts.groupBy("request_id").agg(
        C.kit_strict("part_cost", "quantity").alias("strict_cost"),
        C.kit_lenient("part_cost").alias("lenient_cost"),
        F.round(100 * F.count("part_cost") / F.count(F.lit(1)), 1).alias("found_share"),
        F.count_if(F.col("part_cost").isNotNull() | F.col("price").isNotNull()).alias("n_priced"),
    )


@query(
    "primary_ladder",
    f"""WITH {CATALOG_SQL}, {LINES_SQL}, i AS (
  SELECT l.request_id, l.number, l.code, c.cost, c.price, l.quantity,
         CASE WHEN l.code % 3 = 0 THEN 100.0 WHEN l.code % 3 = 1 THEN 96.0 ELSE 60.0 END AS local_score,
         CASE WHEN l.code % 4 = 0 THEN NULL ELSE c.cost END AS local_cost
  FROM lines l JOIN catalog c ON c.row_idx = l.code)
SELECT request_id, number,
  CASE WHEN local_score >= 90 AND (local_cost IS NOT NULL OR price IS NOT NULL) THEN CASE WHEN local_score = 100 THEN 1 ELSE 2 END
       WHEN code % 2 = 0 THEN 3 WHEN code % 5 = 0 THEN 4 WHEN code % 11 = 0 THEN 5 WHEN code % 13 = 0 THEN 6 WHEN code % 17 = 0 THEN 7 ELSE 8 END AS rung,
  CASE WHEN local_score >= 90 AND (local_cost IS NOT NULL OR price IS NOT NULL) THEN coalesce(nullif(price, 0), local_cost)
       WHEN code % 2 = 0 THEN coalesce(nullif(price, 0), cost) WHEN code % 5 = 0 THEN cost WHEN code % 11 = 0 THEN quantity WHEN code % 13 = 0 THEN 12.5 END AS unit_base_price
FROM i""",
)
def primary_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: every rung of the ladder, its inputs made from keys."""
    rows = catalog(spark, sf_dir).withColumnRenamed("row_idx", "code")
    code, none = F.col("code"), F.lit(None).cast("double")
    score = F.when(code % 3 == 0, 100.0).when(code % 3 == 1, 96.0).otherwise(60.0)
    items = request_lines(spark, sf_dir).join(rows, "code").select(
        "request_id",
        "number",
        F.when(code % 3 == 0, "exact").when(code % 3 == 1, "similar").otherwise("not_found").alias("local_status"),
        score.alias("local_score"),
        F.lit("catalog").alias("local_source"),
        F.when(code % 4 != 0, F.col("cost")).alias("local_cost"),
        F.col("price").alias("local_price"),
        F.when(code % 2 == 0, 97.0).otherwise(0.0).alias("catalog_score"),
        F.col("cost").alias("catalog_cost"),
        F.col("price").alias("catalog_price"),
        (code % 2 == 0).alias("catalog_ok"),
        F.when(code % 5 == 0, F.col("cost")).alias("goods_cost"),
        F.lit(95.0).alias("goods_score"),
        (code % 5 == 0).alias("goods_ok"),
        F.when(code % 11 == 0, 98.0).otherwise(0.0).alias("price_score"),
        F.col("quantity").alias("price_price"),
        (code % 11 == 0).alias("price_ok"),
        F.when(code % 13 == 0, 12.5).alias("web_price"),
        F.when(code % 17 == 0, "https://example.com/").alias("web_url"),
        none.alias("kit_cost"),
    )
    return Q.resolve(items).select("request_id", "number", "rung", "unit_base_price")


@query(
    "results_merge_stub",
    PRICED_SQL
    + """
SELECT request_id, number, CASE WHEN number % 3 = 0 THEN status WHEN number % 2 = 0 THEN 'old' ELSE 'not_found' END AS status,
       CASE WHEN number % 3 = 0 THEN total_price WHEN number % 2 = 0 THEN 1.0 END AS total_price
FROM results""",
)
def results_merge_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A re-run of some lines merged into the old results, else a stub."""
    all_rows = results(spark, sf_dir).select("request_id", "number", "status", "total_price")
    new = all_rows.filter("number % 3 = 0")
    old = all_rows.filter("number % 2 = 0").select("request_id", "number", F.lit("old").alias("status"), F.lit(1.0).alias("total_price"))
    return R.merge_results(all_rows.select("request_id", "number"), old, new, ["request_id", "number"])


@query(
    "detail_sheet",
    PRICED_SQL
    + """
SELECT request_id, number, 0 AS pos, CAST(number AS VARCHAR) AS label, CASE WHEN status = 'similar' THEN name || ' *' WHEN status = 'not_found' THEN name || ' (не подобрано)' ELSE name END AS name, quantity, unit_price, total_price FROM results
UNION ALL
SELECT request_id, number, p AS pos, CAST(number AS VARCHAR) || '.' || CAST(p AS VARCHAR) AS label, 'part ' || CAST(p AS VARCHAR) AS name, quantity, unit_price, total_price
FROM results, (VALUES (1), (2)) AS v(p) WHERE code % 10 = 0""",
)
def detail_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: item rows, and the component rows of every tenth part."""
    rows = results(spark, sf_dir).withColumn("name", R.sheet_name(F.col("name"), F.col("status")))
    parts = rows.filter("code % 10 = 0").withColumn("pos", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("name", F.concat(F.lit("part "), F.col("pos").cast("string")))
    return R.detail_rows(rows, parts, ["request_id"])


@query(
    "source_status",
    f"""WITH {PRICES_SQL}
SELECT 'catalog' AS source, count(*) AS n FROM part UNION ALL SELECT 'price_list', count(*) FROM prices
UNION ALL SELECT 'registry', count(DISTINCT l_partkey) FROM lineitem WHERE l_returnflag = 'R'""",
)
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by source."""
    size = lambda df, source: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(source).alias("source"), "n")
    return size(catalog(spark, sf_dir), "catalog").union(size(price_list(spark, sf_dir), "price_list")).union(size(registry(spark, sf_dir), "registry"))


@query(
    "supplier_ids",
    """WITH s AS (SELECT s_suppkey, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS base FROM supplier)
SELECT s_suppkey, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY s_suppkey) = 1 THEN base ELSE base || '_' || CAST(row_number() OVER (PARTITION BY base ORDER BY s_suppkey) AS VARCHAR) END AS id FROM s""",
)
def supplier_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: slug ids, numbered where they repeat."""
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", T.slug(F.col("s_name")).alias("base"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("s_suppkey"))
    return rows.select("s_suppkey", F.when(nth == 1, F.col("base")).otherwise(F.concat_ws("_", "base", nth.cast("string"))).alias("id"))


@query(
    "money_texts",
    """SELECT c_custkey, replace(format('{:,.2f}', c_acctbal), ',', ' ') || ' ₽' AS money FROM customer""",
)
def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances as money."""
    return load(spark, sf_dir, "customer").select("c_custkey", T.money_text(F.col("c_acctbal")).alias("money"))


@query(
    "procurement_records",
    """WITH rows AS (
  SELECT l_orderkey AS sheet, 2 * n AS row_idx, 'item ' || CAST(l_partkey AS VARCHAR) AS name, l_quantity AS quantity, 'шт' AS unit, l_extendedprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS n FROM lineitem)
  UNION ALL
  SELECT l_orderkey, 2 * n + 1, CASE WHEN l_suppkey % 2 = 0 THEN 'ООО ' ELSE '' END || 'S' || CAST(l_suppkey AS VARCHAR), NULL, NULL, NULL FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS n FROM lineitem) WHERE l_suppkey % 3 <> 0),
held AS (SELECT *, lead(name) OVER (PARTITION BY sheet ORDER BY row_idx) AS next_name, lead(unit) OVER (PARTITION BY sheet ORDER BY row_idx) AS next_unit FROM rows)
SELECT sheet, row_idx, name, price AS cost, CASE WHEN next_unit IS NULL AND next_name LIKE 'ООО %' THEN next_name END AS supplier FROM held WHERE unit IS NOT NULL""",
)
def procurement_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-row purchase records, made from order lines."""
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    lines = load(spark, sf_dir, "lineitem").withColumn("n", nth)
    items = lines.select(F.col("l_orderkey").alias("sheet"), (2 * F.col("n")).alias("row_idx"), F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("name"), F.col("l_quantity").alias("quantity"), F.lit("шт").alias("unit"), F.col("l_extendedprice").alias("price"))
    firm = F.concat(F.when(F.col("l_suppkey") % 2 == 0, "ООО ").otherwise(""), F.lit("S"), F.col("l_suppkey").cast("string"))
    none = F.lit(None)
    firms = lines.filter("l_suppkey % 3 <> 0").select(F.col("l_orderkey").alias("sheet"), (2 * F.col("n") + 1).alias("row_idx"), firm.alias("name"), none.cast("double").alias("quantity"), none.cast("string").alias("unit"), none.cast("double").alias("price"))
    return C.procurement_items(items.union(firms), ["sheet"]).select("sheet", "row_idx", "name", "cost", "supplier")


@query(
    "quotes_not_yet_known",
    f"""WITH {PRICES_SQL}, p AS (SELECT code, CASE WHEN supplier_id % 7 <> 0 THEN CAST(supplier_id AS VARCHAR) END AS supplier, price FROM prices), known AS (SELECT DISTINCT code, coalesce(supplier, '') AS s FROM p WHERE price < 1000)
SELECT DISTINCT code, supplier FROM p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.code = p.code AND k.s = coalesce(p.supplier, ''))""",
)
def quotes_not_yet_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that no known one equals; some name no supplier, and in
    known quotes that is an empty text."""
    supplier = F.when(F.col("supplier_id") % 7 != 0, F.col("supplier_id").cast("string"))
    prices = price_list(spark, sf_dir).select("code", supplier.alias("supplier"), "price")
    known = prices.filter("price < 1000").select("code", F.coalesce("supplier", F.lit("")).alias("supplier"))
    return Q.new_quotes(prices.select("code", "supplier").distinct(), known, ["code", "supplier"])


@query(
    "reselected_sources",
    f"""WITH {CATALOG_SQL}, {PRICES_SQL}, best AS (SELECT code, min(price) AS price FROM prices GROUP BY code)
SELECT c.row_idx AS code, CASE WHEN c.price IS NOT NULL THEN 'catalog' ELSE 'price_list' END AS source, coalesce(c.price, b.price) AS price
FROM catalog c LEFT JOIN best b ON b.code = c.row_idx WHERE coalesce(c.price, b.price) IS NOT NULL""",
)
def reselected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order after a source was switched off: catalog first."""
    fields = lambda df, source: df.select("code", F.lit(source).alias("source"), "price", F.lit(None).cast("double").alias("cost"), F.lit(100.0).alias("match_score"), F.lit(0).alias("pos"))
    lowest = price_list(spark, sf_dir).groupBy("code").agg(F.min("price").alias("price"))
    quotes = fields(lowest, "price_list").unionByName(fields(catalog(spark, sf_dir).withColumnRenamed("row_idx", "code"), "catalog"))
    return Q.best_local(quotes, ["code"], Q.RESELECT_PRIORITY).select("code", "source", "price")
