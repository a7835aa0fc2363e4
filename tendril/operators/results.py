"""Results of a request: summary, merge of re-runs, sheets and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary_columns() -> list[Column]:
    """Counts by status and totals of priced results."""
    cents = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(18,2)")).cast("double")
    base = F.round(F.col("unit_base_price").cast("decimal(18,4)") * F.col("quantity").cast("decimal(18,4)"), 2)
    return [
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("status") == "exact").alias("exact_items"),
        F.count_if(F.col("status") == "similar").alias("similar_items"),
        F.count_if(F.col("status") == "not_found").alias("missing_items"),
        cents("total_cost").alias("sum_cost"),
        F.coalesce(F.sum(base), F.lit(0)).cast("double").alias("sum_base"),
        cents("total_price").alias("sum_price"),
    ]


def merge_results(items: DataFrame, old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Each item's new result, else its old one, else a not-found stub."""
    fields = [c for c in new.columns if c not in key]
    side = lambda df, p: df.select(*key, *[F.col(c).alias(f"{p}{c}") for c in fields], F.lit(True).alias(f"{p}there"))
    out = items.join(side(new, "n_"), key, "left").join(side(old, "o_"), key, "left")
    stub = {"status": F.lit("not_found"), "source": F.lit("none"), "score": F.lit(0.0)}
    pick = [F.when(F.col("n_there"), F.col(f"n_{c}")).when(F.col("o_there"), F.col(f"o_{c}")).otherwise(stub.get(c, F.lit(None))).alias(c) for c in fields]
    return out.select(*items.columns, *pick)


def with_results(items: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Every item with its result, if it has one."""
    return items.join(results, key, "left")


def override_kits(results: DataFrame, sums: DataFrame) -> DataFrame:
    """Results of kits take the sums over their components that there are."""
    out = results.join(sums.select("item_id", "sum_cost", "sum_price"), "item_id", "left")
    return out.withColumns({"unit_cost": F.coalesce("sum_cost", "unit_cost"), "unit_base_price": F.coalesce("sum_price", "unit_base_price")}).drop("sum_cost", "sum_price")


def grand_total(results: DataFrame, by: list[str]) -> DataFrame:
    """The sum of a sheet's rounded lines; missing ones count nothing."""
    cents = F.round(F.coalesce("total_price", F.lit(0.0)).cast("decimal(18,4)"), 2)
    return results.groupBy(*by).agg(F.sum(cents).cast("double").alias("grand_total"))


def none_found(blocks: DataFrame, by: list[str], found: str = "found") -> DataFrame:
    """Whether none of a group's sources found anything."""
    return blocks.groupBy(*by).agg(F.bool_and(~F.coalesce(F.col(found), F.lit(False))).alias("all_missing"))


def comparison_rows(quotes: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """The comparison sheet: a line each item, a column each source's best
    price, and the first web links."""
    price = F.coalesce("price", "cost")
    own = {"catalog": "catalog_price", "goods_report": "purchase_price", "price_list": "list_price"}
    links = F.array_sort(F.collect_list(F.when((F.col("source") == "web") & F.col("url").isNotNull(), F.struct("place", "url"))))
    cells = [F.min_by(F.when(F.col("source") == s, price), F.when((F.col("source") == s) & price.isNotNull(), F.col("place"))).alias(c) for s, c in own.items()]
    return quotes.groupBy(*by).agg(*cells, F.min(F.when(F.col("source") == "web", price)).alias("web_price"), F.slice(F.transform(links, lambda x: x["url"]), 1, most).alias("links"))


def to_json(results: DataFrame) -> DataFrame:
    """The results' JSON for an interface: scores to one decimal, five other
    names at most, and the base total."""
    base = F.round(F.col("unit_base_price").cast("decimal(18,4)") * F.col("quantity").cast("decimal(18,4)"), 2).cast("double")
    shown = results.withColumns({"score": F.round("score", 1), "total_base_price": base})
    if "alternatives" in results.columns:
        shown = shown.withColumn("alternatives", F.slice("alternatives", 1, 5))
    return shown.select("item_id", F.to_json(F.struct("*")).alias("json"))


def subset(results: DataFrame, numbers: DataFrame, key: list[str]) -> DataFrame:
    return results.join(numbers.select(*key).distinct(), key, "left_semi")


def detail_rows(results: DataFrame, components: DataFrame, by: list[str]) -> DataFrame:
    """The detail sheet: an item's row, then its components as ``n.1, n.2``.
    ``components`` has the keys, number, pos, name, quantity, unit_price."""
    label = lambda *c: F.concat_ws(".", *[x.cast("string") for x in c])
    items = results.select(*by, "number", F.lit(0).alias("pos"), label(F.col("number")).alias("label"), "name", "quantity", "unit_price", "total_price")
    total = F.round(F.col("unit_price").cast("decimal(18,4)") * F.col("quantity").cast("decimal(18,4)"), 2).cast("double")
    parts = components.select(*by, "number", "pos", label(F.col("number"), F.col("pos")).alias("label"), "name", "quantity", "unit_price", total.alias("total_price"))
    return items.unionByName(parts)


def sheet_name(name: Column, status: Column) -> Column:
    return F.concat(name, F.when(status == "similar", " *").when(status == "not_found", " (не подобрано)").otherwise(""))


def alive_sessions(sessions: DataFrame, now: Column, hours: int = 8, most: int = 30) -> DataFrame:
    """Sessions created within ``hours``; of those the newest ``most``.  The
    age counts from creation, not from the last use."""
    fresh = sessions.filter(F.col("created_at") >= now - F.expr(f"INTERVAL {hours} HOURS"))
    return fresh.orderBy(F.desc("created_at"), F.desc("session_id")).limit(most)


def recent_distinct(events: DataFrame, by: list[str], value: str, at: str, tie: str, most: int = 50) -> DataFrame:
    """History: the last use of each value, newest first, ``most`` a group."""
    last = events.groupBy(*by, value).agg(F.max(F.struct(F.col(at), F.col(tie))).alias("m"))
    order = Window.partitionBy(*by).orderBy(F.desc("m"))
    return last.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select(*by, value, F.col(f"m.{at}").alias(at), "place")
