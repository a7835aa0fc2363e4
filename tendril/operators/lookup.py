"""Answers to product questions from the best hits of three sources.

A hit is a struct: ``catalog`` (name, score, cost, price, stock, unit),
``registry`` (name, score, quantity), ``listed`` (name, score, price, supplier,
code); null where a source has none.  Hits under 70 count nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.functions import text as T
from tendril.functions.pricing import MARKUP, unit_price

# Texts of an answer.
NO_QUANTITY, PIECES = "нет данных", "шт."
SOURCE_LABELS = {"web": "Оценка по открытым источникам (AI)", "catalog": "Каталог: ", "price_list": "Прайс: ", "registry": "Реестр: "}
NOTES = {"exact": "Точное совпадение по наименованию", "similar": "Похожая позиция — требуется проверка менеджером"}
STATUSES, SOURCES = ["exact", "similar", "not_found"], ["catalog", "registry", "price_list", "web", "ai"]
OVERLAP = 0.45


def _good(hit: str) -> Column:
    return F.coalesce(F.col(f"{hit}.score") >= T.SIMILAR_THRESHOLD, F.lit(False))


def is_relevant_hit(primary: Column, name: Column, score: Column) -> Column:
    """Whether a second source's hit is about the primary hit's product."""
    first = F.array_distinct(T.tokens(T.normalize_name(primary)))
    shared = F.size(F.array_intersect(first, T.tokens(T.normalize_name(name)))) / F.nullif(F.size(first), F.lit(0))
    alike = (name == primary) | (score >= T.EXACT_THRESHOLD) | (shared >= OVERLAP)
    return F.coalesce((score >= T.SIMILAR_THRESHOLD) & alike, F.lit(False))


def markup_base() -> Column:
    """The catalog's price, else the price list's."""
    return F.coalesce(F.when(_good("catalog"), F.col("catalog.price")), F.when(_good("listed"), F.col("listed.price")))


def answers(asked: DataFrame, markup: float = MARKUP) -> DataFrame:
    """Adds ``values`` (field -> text, fields without a value left out) and
    ``sources`` for rows with ``fields`` and the three hits."""
    catalog = lambda c: F.when(_good("catalog"), F.col(f"catalog.{c}"))
    listed = lambda c: F.when(_good("listed"), F.col(f"listed.{c}"))
    raised = unit_price(markup_base(), F.lit(False), markup)
    amounts = [F.concat(F.lit(label), T.quantity_text(x), F.lit(" шт.")) for label, x in (("реестр: ", F.when(_good("registry"), F.col("registry.quantity"))), ("каталог: ", catalog("stock")))]
    held = F.concat_ws("; ", *[F.when(~a.endswith("— шт."), a) for a in amounts])
    best = F.greatest("catalog.score", "registry.score", "listed.score")
    known = {
        "cost": T.money_text(catalog("cost")),
        "price": T.money_text(catalog("price")),
        "price_kp": T.money_text(raised),
        "price_supplier": T.money_text(listed("price")),
        "quantity": F.coalesce(F.nullif(held, F.lit("")), F.lit(NO_QUANTITY)),
        "unit": F.coalesce(F.nullif(catalog("unit"), F.lit("")), F.lit(PIECES)),
        "code_supplier": listed("supplier"),
        "code": listed("code"),
        "match": F.concat(F.bround(best).cast("long").cast("string"), F.lit("%")),
    }
    told = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), v)])
    wanted = F.map_filter(told, lambda k, v: F.array_contains(F.col("fields"), k) & v.isNotNull())
    labels = [
        F.when(_good("catalog"), F.concat(F.lit("Каталог: "), F.col("catalog.name"))),
        F.when(_good("registry"), F.concat(F.lit("Реестр: "), F.col("registry.name"))),
        F.when(_good("listed"), F.concat(F.lit("Прайс ("), F.col("listed.supplier"), F.lit("): "), F.col("listed.name"))),
    ]
    return asked.withColumns({"values": wanted, "sources": F.array_compact(F.array(*labels))})


def other_names(catalog: Column, registry: Column, listed: Column, exclude: Column) -> Column:
    """Three further names: each source's second to fourth, in that order."""
    rest = F.concat(*[F.slice(F.coalesce(x, F.array().cast("array<string>")), 2, 3) for x in (catalog, registry, listed)])
    return F.slice(F.array_distinct(F.filter(rest, lambda n: n != F.coalesce(exclude, F.lit("")))), 1, 3)


def known_status(value: Column) -> Column:
    return F.when(value.isin(*STATUSES), value).otherwise("not_found")


def known_source(value: Column) -> Column:
    return F.when(value.isin(*SOURCES), value).otherwise("none")


def source_detail(source: Column, name: Column, before: Column) -> Column:
    """Where a match comes from; what was said before for other sources."""
    out = F.when(source == "web", SOURCE_LABELS["web"])
    for kind in ("catalog", "price_list", "registry"):
        out = out.when(source == kind, F.concat(F.lit(SOURCE_LABELS[kind]), name))
    return out.otherwise(F.coalesce(before, F.lit("")))


def match_note(status: Column) -> Column:
    return F.when(status == "exact", NOTES["exact"]).otherwise(NOTES["similar"])
