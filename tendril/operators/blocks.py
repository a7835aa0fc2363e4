"""The best candidates of every source, as nested rows of an item.

Each source keeps its first few hits by a window that Spark cuts before the
shuffle (at most ``most`` rows a group and partition), then the few that stay are
gathered; no group is ever collected whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.functions import text as T
from tendril.operators.matching import rank_hits, top

# How many candidates of each source go to a model, their fields,
# and the text for an empty registry block.
MODEL_CANDIDATES = {"catalog": (8, ["name", "cost", "unit"]), "registry": (5, ["name", "quantity", "link"]), "price_list": (8, ["name", "code", "price", "supplier"])}
REGISTRY_NOT_FOUND = "В Реестре остатков нет такого наименования"


def model_candidates(hits: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: the arrays catalog, registry and price_list of its best
    hits (source, rank, score and the fields), scores to one decimal."""
    most = max(n for n, _ in MODEL_CANDIDATES.values())
    some = top(hits, [*by, "source"], [F.col("rank")], most, "_place")

    def block(source: str, n: int, fields: list[str]) -> Column:
        row = F.struct("_place", F.struct(*fields, F.round("score", 1).alias("score")).alias("row"))
        own = F.collect_list(F.when((F.col("source") == source) & (F.col("_place") <= n), row))
        return F.transform(F.array_sort(own), lambda x: x["row"]).alias(source)

    return some.groupBy(*by).agg(*[block(source, n, fields) for source, (n, fields) in MODEL_CANDIDATES.items()])


def _shown_quantity(x: Column) -> Column:
    return F.when(x.isNull(), "—").otherwise(F.concat(T.quantity_text(x), F.lit(" шт.")))


def _shown_sum(quantity: Column, total: Column) -> Column:
    money = T.money_text(F.coalesce(total, F.lit(0.0)))
    return F.when((quantity > 0) | (total > 0), money).otherwise("—")


def _fields(source: str) -> dict[str, Column]:
    c = F.col
    if source == "catalog":
        return {"cost": T.money_text(c("cost")), "price": T.money_text(c("price")), "stock": F.when(c("stock").isNotNull(), _shown_quantity(c("stock"))), "unit": F.coalesce(F.nullif("unit", F.lit("")), F.lit("шт"))}
    if source == "price_list":
        return {"price": T.money_text(c("price")), "code": c("code"), "supplier": c("supplier"), "recommended_qty": _shown_quantity(c("recommended_qty")), "order_qty": _shown_quantity(c("order_qty")), "order_sum": _shown_sum(c("order_qty"), c("order_sum"))}
    return {"quantity": T.quantity_text(c("quantity")), "condition": c("condition"), "link": c("link"), "photo_files": c("photo_files")}


def lookup_block(hits: DataFrame, asked: DataFrame, source: str, by: list[str], primary: DataFrame | None = None) -> DataFrame:
    """A source's block of each lookup: found, the primary hit's fields, and
    the ranked items as an array of rows.

    ``hits`` has the keys, query, choice, name, score, rank and the source's
    fields; ``asked`` every lookup's keys; ``primary`` (keys, primary_name) the
    hits that were picked before, else the first is the primary one.
    """
    ranked = rank_hits(hits, by)
    if primary is None:
        primary = ranked.filter("place = 1").select(*by, F.col("name").alias("primary_name"))
    shown = _fields(source)
    row = F.struct("name", F.round("score", 1).alias("match_score"), "is_primary", *[v.alias(k) for k, v in shown.items()])
    items = ranked.join(primary, by, "left").withColumn("is_primary", F.coalesce(F.col("name") == F.col("primary_name"), F.lit(False)))
    items = items.select(*by, F.struct("place", row.alias("row")).alias("e"))
    block = items.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["row"]).alias("items"))
    chosen = F.coalesce(F.try_element_at(F.filter("items", lambda x: x["is_primary"]), F.lit(1)), F.try_element_at("items", F.lit(1)))
    block = block.withColumn("_p", chosen).select(*by, "items", "_p.name", "_p.match_score", *[F.col(f"_p.{k}").alias(k) for k in shown])
    out = asked.select(*by).join(block, by, "left").withColumn("found", F.col("items").isNotNull())
    if source == "registry":
        out = out.withColumn("message", F.when(~F.col("found"), REGISTRY_NOT_FOUND))
    return out.withColumn("items", F.coalesce("items", F.array().cast(block.schema["items"].dataType)))
