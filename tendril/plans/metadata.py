"""Registered queries: what results say of themselves, and model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tendril.operators import answers as An
from tendril.operators import metadata as Md
from tendril.sources.tables import load

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _pick(key: Column, *values: object) -> Column:
    """The value whose place is the key's remainder."""
    out = F.lit(None)
    for k, v in enumerate(values):
        out = F.when(key % len(values) == k, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def given_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every part as a result whose state goes by its key, and its kit."""
    k, retail, none = F.col("p_partkey"), F.col("p_retailprice"), F.lit(None)
    parts = load(spark, sf_dir, "part")
    results = parts.select(
        k.alias("item_id"), F.col("p_name").alias("name"), _pick(k, "not_found", "similar", "exact", "not_found").alias("status"), _pick(k, "none", "catalog", "price_list", "web", "none").alias("source"),
        F.when(k % 3 != 0, F.col("p_name")).otherwise("").alias("matched_name"), _pick(k, 0.0, 92.0, 97.0).alias("score"), F.when(k % 7 >= 4, retail).alias("unit_cost"), F.when(k % 7 >= 3, retail).alias("unit_base_price"),
        (k % 6 == 0).alias("internet"), _pick(k, none, "", "note", "note −").cast("string").alias("notes"), F.when(k % 9 == 0, "told").alias("source_detail"), F.when(k % 13 == 0, "own").alias("supplier"), none.cast("string").alias("purchase_date"), (k % 11 == 0).alias("is_kit"),
    )
    kits = parts.filter(k % 11 == 0).select(k.alias("item_id"), (k % 5 + 1).alias("n_components"), F.least(k % 3, k % 5 + 1).alias("in_catalog"), (k % 2 == 0).alias("any_priced"))
    return results, kits


def given_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sale as a quote of its part."""
    c, n = F.col, F.col("l_linenumber")
    lines = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey")).join(load(spark, sf_dir, "supplier"), c("l_suppkey") == c("s_suppkey"))
    web, price = c("l_suppkey") % 6 >= 4, c("l_extendedprice") / c("l_quantity")
    shop = F.concat(F.lit("https://shop"), c("l_suppkey").cast("string"), F.lit(".example/p/"), c("l_orderkey").cast("string"))
    market = F.when(n % 3 == 0, F.concat(F.lit("https://www.ozon.ru/product/"), c("l_orderkey").cast("string"))).when(n % 3 == 1, "https://www.ozon.ru/search/?text=a")
    return lines.select(
        c("l_partkey").alias("item_id"),
        _pick(c("l_suppkey"), "price_list", "price_list", "catalog", "registry", "web", "web").alias("source"),
        F.concat(F.lit("L"), c("l_suppkey").cast("string")).alias("label"),
        c("p_name").alias("matched_name"),
        F.when(n == 2, price - 1).alias("cost"),
        F.when(n != 3, price).alias("price"),
        F.when(web, F.when(c("l_suppkey") % 6 == 4, shop).otherwise(market)).alias("url"),
        F.when(web, F.when(c("l_orderkey") % 9 == 0, 100.0).otherwise(60.0)).otherwise(F.when(c("l_orderkey") % 40 == 0, 95.0 + n % 4).otherwise(50.0)).alias("match_score"),
        c("s_name").alias("supplier"),
        F.date_format("l_shipdate", "dd.MM.yyyy").alias("purchase_date"),
        (c("l_orderkey") * 10 + n).alias("pos"),
        (c("l_returnflag") == "R").alias("fetched"),
    )


QUOTES_SQL = """q AS (
  SELECT l_partkey AS item_id, CASE WHEN l_suppkey % 6 < 2 THEN 'price_list' WHEN l_suppkey % 6 = 2 THEN 'catalog' WHEN l_suppkey % 6 = 3 THEN 'registry' ELSE 'web' END AS source, 'L' || CAST(l_suppkey AS VARCHAR) AS label, p_name AS matched_name,
    CASE WHEN l_linenumber = 2 THEN l_extendedprice / l_quantity - 1 END AS cost, CASE WHEN l_linenumber <> 3 THEN l_extendedprice / l_quantity END AS price,
    CASE WHEN l_suppkey % 6 = 4 THEN 'https://shop' || CAST(l_suppkey AS VARCHAR) || '.example/p/' || CAST(l_orderkey AS VARCHAR) WHEN l_suppkey % 6 = 5 AND l_linenumber % 3 = 0 THEN 'https://www.ozon.ru/product/' || CAST(l_orderkey AS VARCHAR) WHEN l_suppkey % 6 = 5 AND l_linenumber % 3 = 1 THEN 'https://www.ozon.ru/search/?text=a' END AS url,
    CASE WHEN l_suppkey % 6 >= 4 THEN CASE WHEN l_orderkey % 9 = 0 THEN 100.0 ELSE 60.0 END WHEN l_orderkey % 40 = 0 THEN 95.0 + l_linenumber % 4 ELSE 50.0 END AS match_score,
    s_name AS supplier, strftime(l_shipdate, '%d.%m.%Y') AS purchase_date, l_orderkey * 10 + l_linenumber AS pos, l_returnflag = 'R' AS fetched
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
), s AS (SELECT *, coalesce(cost, price) AS paid, url IS NOT NULL AS linked, coalesce(contains(url, '/search/?'), false) AS listing, coalesce(contains(url, 'ozon.ru'), false) AS market, coalesce(contains(url, 'ozon.ru/product/'), false) AS card FROM q),
a AS (SELECT *, source = 'web' AND match_score >= 100 AND paid IS NOT NULL AND NOT listing AND (NOT market OR card) AS usable, CASE WHEN NOT market THEN 0 ELSE 1 END AS tier, CASE WHEN linked THEN 0 ELSE 1 END AS bare FROM s),
loc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE source WHEN 'price_list' THEN 1 WHEN 'catalog' THEN 2 ELSE 3 END, match_score DESC, pos, label) AS nth FROM a WHERE source <> 'web' AND match_score >= 95 AND paid IS NOT NULL AND NOT fetched) WHERE nth = 1),
web AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, fetched ORDER BY tier, bare, pos, label) AS nth FROM a WHERE usable) WHERE nth = 1),
lnk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY tier, pos, label) AS nth FROM a WHERE usable AND linked) WHERE nth = 1),
facts AS (SELECT item_id, bool_or(linked AND NOT listing) AS has_link, bool_or(coalesce(price <> 0, false) OR coalesce(cost <> 0, false)) AS web_priced FROM a WHERE source = 'web' GROUP BY item_id)"""

RESULTS_SQL = """r0 AS (
  SELECT p_partkey AS item_id, p_name AS name, CASE p_partkey % 4 WHEN 1 THEN 'similar' WHEN 2 THEN 'exact' ELSE 'not_found' END AS status, CASE p_partkey % 5 WHEN 1 THEN 'catalog' WHEN 2 THEN 'price_list' WHEN 3 THEN 'web' ELSE 'none' END AS source,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS matched_name, CASE p_partkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 92.0 ELSE 97.0 END AS score, CASE WHEN p_partkey % 7 >= 4 THEN p_retailprice END AS unit_cost, CASE WHEN p_partkey % 7 >= 3 THEN p_retailprice END AS unit_base_price,
    p_partkey % 6 = 0 AS internet, CASE p_partkey % 4 WHEN 2 THEN 'note' WHEN 3 THEN 'note −' WHEN 1 THEN '' END AS notes, CASE WHEN p_partkey % 9 = 0 THEN 'told' END AS source_detail, CASE WHEN p_partkey % 13 = 0 THEN 'own' END AS supplier, CAST(NULL AS VARCHAR) AS purchase_date,
    p_partkey % 11 = 0 AS is_kit, p_partkey % 5 + 1 AS n_components, least(p_partkey % 3, p_partkey % 5 + 1) AS in_catalog, p_partkey % 11 = 0 AND p_partkey % 2 = 0 AS any_priced
  FROM part
)"""


def _quoted(before: str, after: str, table: str, cases: str, own: dict[str, str], extra: str = "") -> str:
    """A step in which rows with ``hit`` take the quote of ``table``."""
    said = "t.label || CASE WHEN t.source = 'web' AND t.url IS NOT NULL THEN ' | ' || t.url ELSE '' END"
    take = {
        "status": "CASE WHEN r.status = 'not_found' OR greatest(r.score, t.match_score) < 90 THEN 'similar' ELSE r.status END",
        "source": "t.source",
        "matched_name": "t.matched_name",
        "score": "greatest(r.score, t.match_score)",
        "unit_cost": "t.paid",
        "unit_base_price": "t.paid",
        "internet": "t.source = 'web'",
        "source_detail": said,
        "notes": "coalesce(nullif(r.notes, '') || ' | ', '') || 'Подбор по сравнению: ' || t.label || CASE WHEN t.source = 'web' THEN ' | Цена КП: −5.0% от найденной в интернете' ELSE '' END",
        "supplier": "coalesce(nullif(r.supplier, ''), t.supplier)",
        "purchase_date": "coalesce(r.purchase_date, t.purchase_date)",
    }
    cols = ", ".join(f"CASE WHEN {cases} THEN {take[c]} ELSE {own.get(c, 'r.' + c)} END AS {c}" for c in take)
    return f"{after} AS (SELECT r.item_id, r.name, r.is_kit, r.n_components, r.in_catalog, r.any_priced{extra}, {cols} FROM {before} r LEFT JOIN {table} t ON t.item_id = r.item_id)"


def _changed(before: str, after: str, joins: str, changes: dict[str, str], extra: str = "") -> str:
    cols = ", ".join(f"{changes.get(c, 'r.' + c)} AS {c}" for c in Md.FIELDS)
    return f"{after} AS (SELECT r.item_id, r.name, r.is_kit, r.n_components, r.in_catalog, r.any_priced{extra}, {cols} FROM {before} r {joins})"


def _metadata_sql() -> str:
    """Rule by rule, each over the rows that the last one left; ``rule`` is the
    first rule of the normalising that holds."""
    name = "coalesce(nullif(r.matched_name, ''), r.name)"
    graded = "CASE WHEN r.score >= 90 THEN 'exact' ELSE 'similar' END"
    rule = """r1 AS (SELECT r0.*, CASE WHEN unit_base_price IS NULL AND unit_cost IS NULL THEN 0 WHEN status <> 'not_found' AND r0.source <> 'none' THEN 1 WHEN is_kit AND any_priced THEN 2 WHEN loc.item_id IS NOT NULL THEN 3 WHEN w.item_id IS NOT NULL THEN 4 WHEN internet OR coalesce(web_priced, false) THEN 5 ELSE 6 END AS rule
  FROM (SELECT *, item_id AS id FROM r0) r0 LEFT JOIN (SELECT item_id FROM loc) loc ON loc.item_id = r0.id LEFT JOIN (SELECT item_id FROM web WHERE NOT fetched) w ON w.item_id = r0.id LEFT JOIN (SELECT item_id AS f, web_priced FROM facts) ON f = r0.id)"""
    plain = {
        "status": f"CASE WHEN rule IN (2, 6) THEN 'similar' WHEN rule = 5 THEN {graded} ELSE r.status END",
        "source": "CASE WHEN rule = 1 AND r.internet THEN 'web' WHEN rule = 2 THEN 'catalog' WHEN rule = 5 THEN 'web' WHEN rule = 6 AND r.source = 'none' THEN 'catalog' ELSE r.source END",
        "internet": "CASE WHEN rule = 2 THEN false ELSE r.internet END",
        "matched_name": f"CASE WHEN rule IN (2, 5, 6) THEN {name} ELSE r.matched_name END",
        "score": "CASE WHEN rule = 2 THEN greatest(r.score, round(100.0 * in_catalog / n_components, 1)) ELSE r.score END",
        "source_detail": "CASE rule WHEN 2 THEN 'Комплект по составу ТЗ (' || in_catalog || '/' || n_components || ' поз. в каталоге)' WHEN 5 THEN coalesce(nullif(r.source_detail, ''), 'Интернет') WHEN 6 THEN coalesce(nullif(r.source_detail, ''), 'Подбор по сравнению') ELSE r.source_detail END",
        "notes": "CASE WHEN rule = 2 THEN coalesce(nullif(r.notes, '') || ' | ', '') || 'Себестоимость по составу комплекта: ' || n_components || ' поз.' ELSE r.notes END",
    }
    opened = "r5 AS (SELECT *, NOT ((unit_base_price IS NOT NULL OR unit_cost IS NOT NULL) AND NOT internet AND source <> 'web' AND (is_kit OR (source <> 'none' AND score >= 95))) AS open FROM r4)"
    takes = "(r.unit_base_price IS NULL AND k.item_id IS NOT NULL)"
    found = "(open AND ((r.internet AND r.unit_base_price IS NOT NULL) OR k.item_id IS NOT NULL))"
    link = f"(open AND NOT {found} AND (r.status = 'not_found' OR r.source = 'none') AND coalesce(has_link, false))"
    score = f"CASE WHEN {takes} THEN greatest(r.score, k.match_score) ELSE r.score END"
    internet = f"(r.internet OR {takes})"
    detail = "coalesce('Интернет | ' || k.url, 'Интернет')"
    last = {
        "status": f"CASE WHEN {found} THEN CASE WHEN {score} >= 90 THEN 'exact' ELSE 'similar' END WHEN {link} THEN 'similar' ELSE r.status END",
        "source": f"CASE WHEN {found} OR {link} THEN 'web' ELSE r.source END",
        "matched_name": f"CASE WHEN {found} THEN coalesce(nullif(CASE WHEN {takes} THEN k.matched_name ELSE r.matched_name END, ''), r.name) WHEN {link} THEN r.name ELSE r.matched_name END",
        "score": f"CASE WHEN {found} THEN {score} ELSE r.score END",
        "unit_cost": f"CASE WHEN {found} AND {takes} THEN k.paid ELSE r.unit_cost END",
        "unit_base_price": f"CASE WHEN {found} AND {takes} THEN k.paid ELSE r.unit_base_price END",
        "internet": f"CASE WHEN {found} THEN {internet} ELSE r.internet END",
        "source_detail": f"CASE WHEN {found} THEN coalesce(nullif(r.source_detail, ''), {detail}) WHEN {link} THEN {detail} ELSE r.source_detail END",
        "notes": f"CASE WHEN {found} AND {internet} AND NOT contains(coalesce(r.notes, ''), '−') THEN coalesce(nullif(r.notes, '') || ' | ', '') || 'Цена КП: −5.0% от найденной в интернете' WHEN {link} THEN coalesce(nullif(r.notes, '') || ' | ', '') || 'Цена не извлечена — проверьте ссылки' ELSE r.notes END",
    }
    steps = [
        QUOTES_SQL,
        RESULTS_SQL,
        rule,
        _quoted("r1", "r2", "loc", "rule = 3", {}, ", r.rule"),
        _quoted("r2", "r3", "(SELECT * FROM web WHERE NOT fetched)", "rule = 4", {}, ", r.rule"),
        _changed("r3", "r4", "", plain, ", r.rule"),
        opened,
        _quoted("r5", "r6", "(SELECT * FROM web WHERE fetched)", "open AND r.unit_base_price IS NULL AND r.unit_cost IS NULL AND t.item_id IS NOT NULL", {}, ", r.open"),
        _changed("r6", "r7", "LEFT JOIN lnk k ON k.item_id = r.item_id LEFT JOIN facts f ON f.item_id = r.item_id", last),
    ]
    return f"WITH {', '.join(steps)} SELECT item_id, {', '.join(Md.FIELDS)} FROM r7"


@query("result_metadata", _metadata_sql())
def result_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as results in every state, sales as their quotes;
    returned sales are the quotes that were fetched later."""
    results, kits = given_results(spark, sf_dir)
    quotes = given_quotes(spark, sf_dir)
    known, found = quotes.filter("NOT fetched").drop("fetched"), quotes.filter("fetched AND source = 'web'").drop("fetched")
    return Md.finish(results, kits, known, found).select("item_id", *Md.FIELDS)


@query(
    "answer_sources",
    """WITH c AS (SELECT p_partkey AS item_id, CASE p_size % 3 WHEN 0 THEN 'catalog' WHEN 1 THEN 'price_list' ELSE 'registry' END AS source, p_name, p_type, p_brand, p_partkey % 8 AS k FROM part),
l AS (SELECT l_partkey AS item_id, s_name AS supplier, CAST(l_orderkey AS VARCHAR) AS code, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS rank, l_linenumber, l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
h AS (SELECT c.item_id, rank, CASE l_linenumber % 3 WHEN 0 THEN upper(p_name) || ' ' || p_type WHEN 1 THEN split_part(p_name, ' ', 2) ELSE p_brand END AS name, supplier, code, CASE WHEN l_linenumber % 2 = 0 THEN 'shop.example/item/' || code ELSE 'https://shop.example/catalog/' END AS link FROM l JOIN c USING (item_id)),
m AS (SELECT h.*, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS nth FROM h JOIN c USING (item_id) WHERE contains(lower(name), lower(p_name)) OR contains(lower(p_name), lower(name))),
f AS (SELECT * FROM m WHERE nth = 1), u AS (SELECT item_id, arg_min(link, rank) AS link FROM m WHERE link LIKE 'shop%' GROUP BY 1)
SELECT c.item_id, CASE WHEN k = 0 THEN 'given' WHEN k = 1 THEN 'see https://a.example/p/1.' WHEN c.source = 'catalog' THEN coalesce('Каталог: ' || f.name, 'Каталог') WHEN c.source = 'price_list' THEN coalesce('Прайс (' || f.supplier || '): ' || f.name || ', код ' || f.code, 'Прайс поставщика') ELSE coalesce('Реестр остатков: ' || f.name, 'Реестр остатков') END AS price_source_text,
  CASE WHEN k = 1 THEN 'https://a.example/p/1' WHEN k = 2 THEN 'https://www.b.example/x?y=1' WHEN c.source = 'registry' THEN 'https://' || u.link END AS product_url
FROM c LEFT JOIN f USING (item_id) LEFT JOIN u ON u.item_id = c.item_id""",
)
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a model's answer, its sales as the candidates."""
    c, k = F.col, F.col("p_partkey") % 8
    parts = load(spark, sf_dir, "part").withColumn("source", _pick(c("p_size"), "catalog", "price_list", "registry"))
    none = F.lit(None).cast("string")
    answers = parts.select(
        c("p_partkey").alias("item_id"), "source", c("p_name").alias("matched_name"), F.when(k == 0, " given ").when(k == 1, "see https://a.example/p/1.").alias("price_source"), none.alias("source_detail"), F.when(k == 3, "only words").alias("notes"),
        F.when(k == 2, "https://shop.example/").alias("product_url"), F.when(k == 2, "www.b.example/x?y=1").alias("source_url"), none.alias("url"), none.alias("link"),
    )
    # Any value in order is a rank: sales needn't be numbered for their first.
    rank = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    lines = load(spark, sf_dir, "lineitem").withColumn("rank", rank).join(suppliers, c("l_suppkey") == c("s_suppkey")).join(parts, c("l_partkey") == c("p_partkey"))
    n = c("l_linenumber")
    name = F.when(n % 3 == 0, F.concat_ws(" ", F.upper("p_name"), "p_type")).when(n % 3 == 1, F.split("p_name", " ")[1]).otherwise(c("p_brand"))
    link = F.when(n % 2 == 0, F.concat(F.lit("shop.example/item/"), c("l_orderkey").cast("string"))).otherwise("https://shop.example/catalog/")
    candidates = lines.select(c("l_partkey").alias("item_id"), "source", "rank", name.alias("name"), c("s_name").alias("supplier"), c("l_orderkey").cast("string").alias("code"), link.alias("link"))
    return An.resolve(answers, candidates).select("item_id", "price_source_text", "product_url")
