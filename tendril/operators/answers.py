"""Where a model's answer has its price and its product's address from.

Answers meet the candidates of their own item only; of these the first counts
whose name holds the answer's, or is held by it, case aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.functions import lookup as L

# Texts for sources without a candidate of the name.
PLAIN = {"catalog": "Каталог", "price_list": "Прайс поставщика", "registry": "Реестр остатков"}
ESTIMATE, MODEL, TOLD = "Оценка по открытым источникам (конкретный сайт не указан)", "Нейросеть", "источник"
URL_FIELDS = ["product_url", "source_url", "url", "link"]


def same_name(asked: Column, name: Column) -> Column:
    """Either name holds the other; an empty one that is asked for, none."""
    a, b = F.lower(F.coalesce(asked, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    return (a != "") & (b.contains(a) | a.contains(b))


def _text(c: str) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def resolve(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """``answers`` (item_id, source, matched_name, price_source, source_detail,
    notes and the url fields) with price_source_text, and with the address that
    was found as product_url.

    ``candidates``: item_id, source, rank, name, supplier, code, link.
    """
    product = lambda url: F.when(L.shows_product(url), url)
    hits = candidates.select("item_id", "source", "rank", F.col("name").alias("_name"), F.col("supplier").alias("_supplier"), F.col("code").alias("_code"), F.col("link").alias("_link"))
    met = answers.select("item_id", "source", "matched_name").join(hits, ["item_id", "source"]).filter(same_name(F.col("matched_name"), F.col("_name")))
    # Both picks are one aggregate, so candidates are joined once; only a stock's
    # addresses are read.
    met = met.withColumn("_link", F.when(F.col("source") == "registry", L.normalize_url(F.col("_link"))))
    met = met.withColumn("_link", product(F.col("_link")))
    linked = F.when(F.col("_link").isNotNull(), F.col("rank"))
    picked = met.groupBy("item_id").agg(F.min_by(F.struct("_name", "_supplier", "_code"), "rank").alias("_first"), F.min_by("_link", linked).alias("_link"))
    out = answers.join(picked.select("item_id", "_first.*", "_link"), "item_id", "left")

    explicit = _some_of(_text("price_source"), _text("source_detail"))
    code = F.coalesce(F.concat(F.lit(", код "), F.nullif("_code", F.lit(""))), F.lit(""))
    shelf = F.concat(F.lit("Прайс ("), F.coalesce(F.nullif("_supplier", F.lit("")), F.lit("прайс")), F.lit("): "), F.col("_name"), code)
    named = {"catalog": F.concat(F.lit("Каталог: "), F.col("_name")), "price_list": shelf, "registry": F.concat(F.lit("Реестр остатков: "), F.col("_name"))}
    by_source = F.when(F.col("source") == "web", F.coalesce(F.nullif(_text("notes"), F.lit("")), F.lit(ESTIMATE)))
    for source, text in named.items():
        by_source = by_source.when(F.col("source") == source, F.coalesce(text, F.lit(PLAIN[source])))
    urls = [product(L.normalize_url(F.col(c))) for c in URL_FIELDS] + [product(L.extract_url(F.col(c))) for c in ("price_source", "notes")]
    return out.withColumns({"price_source_text": F.coalesce(explicit, by_source.otherwise(MODEL)), "product_url": F.coalesce(*urls, F.col("_link"))}).drop("_name", "_supplier", "_code", "_link")


def _some_of(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])
