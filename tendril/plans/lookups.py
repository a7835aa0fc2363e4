"""Registered queries: product questions and their answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tendril.functions import lookup as L
from tendril.operators import lookup as Lk
from tendril.plans.quoting import CATALOG_SQL, PRICES_SQL
from tendril.sources.tables import catalog, load, price_list, registry, spread

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query(
    "lookup_requests",
    """SELECT p_partkey, p_partkey % 5 <> 4 AS is_lookup, p_name AS name,
  CASE p_partkey % 5 WHEN 0 THEN 'cost,price,price_kp,price_supplier' WHEN 1 THEN 'quantity,unit' WHEN 2 THEN 'cost,price,price_kp,price_supplier' WHEN 3 THEN 'quantity' ELSE 'cost,price,price_supplier,price_kp,quantity,unit' END AS fields
FROM part""",
)
def lookup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about every part, asked in five ways, read back."""
    key, name = F.col("p_partkey") % 5, F.col("p_name")
    said = (
        F.when(key == 0, F.concat(F.lit("Сколько стоит "), name, F.lit("?")))
        .when(key == 1, F.concat(F.lit("/find "), name, F.lit(" | остаток, единица")))
        .when(key == 2, F.concat(F.lit("найди "), name, F.lit(": цена")))
        .when(key == 3, F.concat(F.lit("покажи "), name, F.lit(" и количество")))
        .otherwise(name)
    )
    asked = spread(load(spark, sf_dir, "part"), "p_partkey").select("p_partkey", said.alias("said"))
    return L.questions(asked, "said").select("p_partkey", "is_lookup", "name", F.array_join("fields", ",").alias("fields"))


ANSWERS_SQL = f"""WITH {CATALOG_SQL}, {PRICES_SQL}, low AS (SELECT code, min(price) AS price FROM prices GROUP BY code),
stock AS (SELECT l_partkey AS code, sum(CAST(l_quantity AS DECIMAL(18,2))) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
h AS (SELECT c.row_idx, c.name, c.cost, c.price, l.price AS listed, s.n, c.row_idx % 3 <> 0 AS cat, l.price IS NOT NULL AND c.row_idx % 4 <> 0 AS lis FROM catalog c LEFT JOIN low l ON l.code = c.row_idx LEFT JOIN stock s ON s.code = c.row_idx),
a AS (SELECT *, CASE WHEN cat AND price IS NOT NULL THEN price WHEN lis THEN listed END AS base FROM h)"""


@query(
    "lookup_values",
    ANSWERS_SQL
    + """ SELECT row_idx, CASE WHEN cat THEN replace(format('{:,.2f}', cost), ',', ' ') || ' ₽' END AS cost,
  replace(format('{:,.2f}', CAST(round(CAST(base AS DECIMAL(18,4)) * CAST(1.3 AS DECIMAL(7,4)), 2) AS DOUBLE)), ',', ' ') || ' ₽' AS price_kp,
  CASE WHEN n IS NOT NULL THEN 'реестр: ' || CAST(CAST(n AS BIGINT) AS VARCHAR) || ' шт.' ELSE 'нет данных' END AS quantity,
  CAST(cat AS INTEGER) + CAST(n IS NOT NULL AS INTEGER) + CAST(lis AS INTEGER) AS n_sources FROM a""",
)
def lookup_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for every part from its catalog row, its stock and
    its lowest listed price, some of them poor hits."""
    low = price_list(spark, sf_dir).groupBy("code").agg(F.min("price").alias("listed_price"))
    rows = catalog(spark, sf_dir).join(low, F.col("row_idx") == low["code"], "left").drop("code")
    rows = rows.join(registry(spark, sf_dir), F.col("row_idx") == F.col("code"), "left")
    key, none = F.col("row_idx"), F.lit(None).cast("double")
    score = lambda n: F.when(key % n == 0, 60.0).otherwise(97.0).alias("score")
    hits = rows.select(
        "row_idx",
        F.array(*map(F.lit, L.DEFAULT_FIELDS)).alias("fields"),
        F.struct("name", score(3), "cost", "price", none.alias("stock"), F.lit("").alias("unit")).alias("catalog"),
        F.when(F.col("stock").isNotNull(), F.struct("name", F.lit(97.0).alias("score"), F.col("stock").alias("quantity"))).alias("registry"),
        F.when(F.col("listed_price").isNotNull(), F.struct("name", score(4), F.col("listed_price").alias("price"), F.lit("С").alias("supplier"), key.cast("string").alias("code"))).alias("listed"),
    )
    told = Lk.answers(hits)
    return told.select("row_idx", *[F.col("values")[c].alias(c) for c in ("cost", "price_kp", "quantity")], F.size("sources").alias("n_sources"))


@query(
    "secondary_hits",
    """WITH p AS (SELECT p_partkey, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS other FROM part)
SELECT p_partkey, p_name = other OR CAST(len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), string_split(lower(other), ' '))) AS DOUBLE) / len(list_distinct(string_split(lower(p_name), ' '))) >= 0.45 AS relevant FROM p WHERE other IS NOT NULL""",
)
def secondary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether the next part of a brand is about the same product."""
    other = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    both = load(spark, sf_dir, "part").select("p_partkey", "p_name", other.alias("other")).filter("other IS NOT NULL")
    return both.select("p_partkey", Lk.is_relevant_hit(F.col("p_name"), F.col("other"), F.lit(75.0)).alias("relevant"))


@query(
    "lookup_urls",
    r"""WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages), e AS (SELECT page_id, url, nullif(regexp_replace(regexp_extract('см. ' || url || ').', 'https?://[^\s<>"'']+'), '[.,);\]]+$', ''), '') AS found FROM p),
t AS (SELECT page_id, found, regexp_replace(found, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') AS tail FROM e WHERE found IS NOT NULL)
SELECT page_id, found AS url, regexp_matches(tail, '\?[^#]|#.') OR (trim(regexp_extract(tail, '^[^?#]*'), '/') <> '' AND lower(trim(regexp_extract(tail, '^[^?#]*'), '/')) NOT IN ('catalog', 'search', 'shop', 'market', 'products')) AS shows_product FROM t""",
)
def lookup_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls found in a sentence, and whether they show a product."""
    said = F.concat(F.lit("см. "), F.coalesce("url", F.lit("")), F.lit(")."))
    found = load(spark, sf_dir, "pages").select("page_id", L.extract_url(said).alias("url")).filter("url IS NOT NULL")
    return found.select("page_id", "url", L.shows_product(F.col("url")).alias("shows_product"))


@query(
    "answer_labels",
    """SELECT event_id, CASE WHEN event_type IN ('exact', 'similar', 'not_found') THEN event_type ELSE 'not_found' END AS status,
  CASE event_id % 6 WHEN 0 THEN 'catalog' WHEN 1 THEN 'registry' WHEN 2 THEN 'price_list' WHEN 3 THEN 'web' WHEN 4 THEN 'ai' ELSE 'none' END AS source,
  CASE event_id % 6 WHEN 0 THEN 'Каталог: ' || event_type WHEN 1 THEN 'Реестр: ' || event_type WHEN 2 THEN 'Прайс: ' || event_type WHEN 3 THEN 'Оценка по открытым источникам (AI)' ELSE '' END AS detail FROM events""",
)
def answer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses and sources as a service names them, and their texts."""
    said = F.element_at(F.array(*map(F.lit, ["catalog", "registry", "price_list", "web", "ai", "shop"])), (F.col("event_id") % 6 + 1).cast("int"))
    source = Lk.known_source(said)
    return load(spark, sf_dir, "events").select(
        "event_id", Lk.known_status(F.col("event_type")).alias("status"), source.alias("source"), Lk.source_detail(source, F.col("event_type"), F.lit(None).cast("string")).alias("detail")
    )
