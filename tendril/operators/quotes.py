"""Price quotes, the primary-match ladder, and how preferences change them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.functions import text as T
from tendril.functions import web as Wb
from tendril.operators.containment import containing
from tendril.operators.matching import top

# Which source's price counts first, when matching and when a
# source was switched off later.
LOCAL_PRIORITY = {"price_list": 1, "catalog": 2, "registry": 3}
RESELECT_PRIORITY = {"catalog": 1, "price_list": 2, "registry": 3, "web": 4}


def priority(source: Column, order: dict[str, int]) -> Column:
    out = F.lit(99)
    for name, place in order.items():
        out = F.when(source == name, place).otherwise(out)
    return out


def by_supplier(needs: DataFrame, prices: DataFrame) -> DataFrame:
    """Needs (supplier) and prices (supplier) where one name holds the other's,
    case aside.  The distinct supplier names are matched first, by an index of
    their substrings, so that the rows themselves meet in an equi-join."""
    wanted = needs.select("supplier").distinct().withColumn("pattern", F.lower(F.trim("supplier")))
    known = prices.select(F.col("supplier").alias("known")).distinct().withColumn("text", F.lower("known"))
    names = containing(known, wanted).join(known, "text").join(wanted, "pattern").select("supplier", "known")
    return needs.join(names, "supplier").join(prices.withColumnRenamed("supplier", "known"), "known")


def extra_quotes(hits: DataFrame, by: list[str], least: float = T.LOCAL_THRESHOLD, most: int = 3) -> DataFrame:
    """At most ``most`` good hits a group, one a supplier."""
    good = hits.filter(F.col("score") >= least)
    order = [F.desc("score"), F.col("rank")]
    return top(top(good, [*by, "supplier"], order, 1, "_supplier"), by, order, most, "place").drop("_supplier")


def best_local(quotes: DataFrame, by: list[str], order: dict[str, int] | None = None) -> DataFrame:
    """The priced quote of the first source that has one, then by score; where
    quotes have ``relevant`` and ``mismatch``, only those that tell the item."""
    order = order or LOCAL_PRIORITY
    usable = quotes.filter(F.col("source").isin(*order) & F.coalesce("price", "cost").isNotNull())
    if {"relevant", "mismatch"} <= set(quotes.columns):
        usable = usable.filter((F.col("match_score") >= T.LOCAL_THRESHOLD) & F.col("relevant") & ~F.col("mismatch"))
    return top(usable, by, [priority(F.col("source"), order), F.desc("match_score"), F.col("pos")], 1, "_best").drop("_best")


def sorted_quotes(quotes: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``place``: local quotes as they are, then web quotes best first."""
    keys = Wb.quote_order(F.col("url"), F.col("match_score"), F.col("price"))
    web = F.col("source") == "web"
    order = [web, *[F.when(web, k) for k in keys], F.col("pos")]
    return quotes.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def best_web(quotes: DataFrame, by: list[str]) -> DataFrame:
    """The best acceptable web quote with a price."""
    good = quotes.filter((F.col("source") == "web") & Wb.acceptable_quote(F.col("source"), F.col("url"), F.col("match_score"), F.col("price")))
    return top(good, by, [*Wb.quote_order(F.col("url"), F.col("match_score"), F.col("price")), F.col("pos")], 1, "_best").drop("_best")


def internet_url(quotes: DataFrame, by: list[str]) -> DataFrame:
    """The url of the best product page among the web quotes that may set a
    price, else of the best of them."""
    paid = F.coalesce("price", "cost") if "cost" in quotes.columns else F.col("price")
    linked = quotes.filter((F.col("source") == "web") & (F.coalesce("url", F.lit("")) != "") & Wb.acceptable_quote(F.col("source"), F.col("url"), F.col("match_score"), paid))
    order = [F.desc(Wb.is_product_page(F.col("url"))), *Wb.quote_order(F.col("url"), F.col("match_score"), paid), F.col("pos")]
    return top(linked, by, order, 1, "_best").select(*by, F.col("url").alias("internet_url"))


def filter_quotes(quotes: DataFrame, disabled: list[str] = (), excluded_platforms: list[str] = ()) -> DataFrame:
    """Quotes that the preferences leave: web quotes of a full score from no
    listing and with no excluded word in label or url, local quotes of 95 and
    more."""
    url = F.coalesce("url", F.lit(""))
    label = F.col("label") if "label" in quotes.columns else F.concat_ws(" ", F.lit("Интернет:"), Wb.platform_label(url))
    where = F.lower(F.concat_ws(" ", F.coalesce(label, F.lit("")), url))
    platform = F.lit(False)
    for token in filter(None, excluded_platforms):
        platform = platform | where.contains(token.lower())
    web = (F.col("match_score") >= T.WEB_THRESHOLD) & ~Wb.is_listing(url) & ~platform
    kept = F.when(F.col("source") == "web", web).otherwise(F.col("match_score") >= T.LOCAL_THRESHOLD)
    return quotes.filter(kept & (~F.col("source").isin(*disabled) if disabled else F.lit(True)))


def new_quotes(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Quotes that no known one equals in ``keys`` (null equals empty)."""
    text = lambda side, k: F.coalesce(F.col(f"{side}.{k}").cast("string"), F.lit(""))
    condition = F.lit(True)
    for k in keys:
        condition = condition & (text("found", k) == text("known", k))
    return found.alias("found").join(known.select(*keys).distinct().alias("known"), condition, "left_anti")


def extended(known: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The known quotes and, behind them, the first of each found one that no
    other equals in ``keys`` (null equals empty)."""
    one = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    fresh = new_quotes(found, known, keys).withColumn("_one", F.row_number().over(Window.partitionBy(*one).orderBy("pos")))
    return known.unionByName(fresh.filter("_one = 1").drop("_one"), allowMissingColumns=True)


def first_by_url(quotes: DataFrame, by: list[str]) -> DataFrame:
    """The first quote of each url in a group; those without a url all stay."""
    linked = F.coalesce("url", F.lit("")) != ""
    nth = F.row_number().over(Window.partitionBy(*by, "url").orderBy("pos"))
    return quotes.filter(linked).withColumn("_one", nth).filter("_one = 1").drop("_one").unionByName(quotes.filter(~linked))


def resolve(items: DataFrame) -> DataFrame:
    """The primary match of each item by the first rung whose test holds.

    ``items`` has one row an item: local_status, local_score, local_source,
    local_cost, local_price; catalog_score, catalog_cost, catalog_price,
    catalog_ok; goods_cost, goods_score, goods_ok; price_score, price_price,
    price_ok; web_price, web_url; kit_cost.
    """
    c = F.col
    priced = c("local_cost").isNotNull() | c("local_price").isNotNull()
    catalog_price = F.coalesce(F.nullif("catalog_price", F.lit(0.0)), c("catalog_cost"))
    no = F.lit(None).cast("double")

    def answer(rung: int, source: Column, status: Column, score: Column, cost: Column, base: Column) -> Column:
        return F.struct(F.lit(rung).alias("rung"), source.alias("source"), status.alias("status"), score.alias("score"), cost.alias("unit_cost"), base.alias("unit_base_price"))

    graded = lambda s: F.when(s >= T.EXACT_THRESHOLD, "exact").otherwise("similar")
    local = lambda rung: answer(rung, c("local_source"), c("local_status"), c("local_score"), c("local_cost"), F.coalesce(F.nullif("local_price", F.lit(0.0)), c("local_cost")))
    ladder = (
        F.when((c("local_status") == "exact") & priced, local(1))
        .when((c("local_score") >= T.LOCAL_THRESHOLD) & priced, local(2))
        .when((c("catalog_score") >= T.LOCAL_THRESHOLD) & c("catalog_ok"), answer(3, F.lit("catalog"), graded(c("catalog_score")), c("catalog_score"), F.coalesce("kit_cost", "catalog_cost"), catalog_price))
        .when(c("goods_cost").isNotNull() & c("goods_ok"), answer(4, F.lit("catalog"), graded(c("goods_score")), c("goods_score"), c("goods_cost"), c("goods_cost")))
        .when((c("price_score") >= T.LOCAL_THRESHOLD) & c("price_ok"), answer(5, F.lit("price_list"), graded(c("price_score")), c("price_score"), c("price_price"), c("price_price")))
        .when(c("web_price").isNotNull(), answer(6, F.lit("web"), F.lit("exact"), F.lit(100.0), no, c("web_price")))
        .when(c("web_url").isNotNull(), answer(7, F.lit("none"), F.lit("similar"), F.lit(0.0), no, no))
        .otherwise(answer(8, F.lit("none"), F.lit("not_found"), F.lit(0.0), no, no))
    )
    return items.withColumn("_m", ladder).select("*", "_m.*").drop("_m")
