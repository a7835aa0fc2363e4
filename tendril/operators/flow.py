"""The whole match of a request: candidates of every source, kits, quotes, the
ladder, prices.

Tables: ``items`` (item_id, name, specifications, quantity), ``catalog``
(row_idx, name, cost, price, and entry_type, components_group of ``classify``),
``prices`` (row_idx, name, code, supplier, price), ``registry`` (row_idx, name,
quantity), ``goods`` (row_idx, name, supplier, purchase_date, cost, price,
procurement), ``web`` (item_id, label, matched_name, url, match_score, price,
pos), fetched before.  The items are the stated query set: only their pairs with
the tables' names are scored; all later steps are equi-joins by item.  What several
steps read is written to the shared checkpoint folder once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.functions import pricing as P
from tendril.functions import text as T
from tendril.functions.similarity import name_match_score
from tendril.operators import catalog as C
from tendril.operators import quotes as Q
from tendril.operators.fuzzyjoin import close_pairs
from tendril.operators.items import apply_quotes, local_match, pick_best
from tendril.operators.matching import best_fuzzy, is_relevant, pairs, scored, top
from tendril.sources.shared import written

# Labels of the comparison, and a purchase report's score.
CATALOG_LABEL, REGISTRY_LABEL = "Каталог", "Реестр остатков"
GOODS_LABEL, PROCUREMENT_LABEL, GOODS_SCORE = "Товарный отчёт", "Отчёт по закупкам", 85.0

_QUOTE = {"item_id": None, "source": "string", "label": "string", "matched_name": "string", "cost": "double", "price": "double", "supplier": "string", "purchase_date": "string", "match_score": "double", "url": "string", "notes": "string", "pos": "int"}


@dataclass
class Tables:
    """What a request is matched with."""

    catalog: DataFrame
    prices: DataFrame
    registry: DataFrame
    goods: DataFrame
    web: DataFrame


def find_candidates(items: DataFrame, tables: Tables) -> DataFrame:
    """The best five rows of each of the three sources for each item, with the
    fields of their rows: item_id, source, row_idx, name, score, rank, cost,
    price, supplier, code, stock."""
    none = lambda kind: F.lit(None).cast(kind)
    payload = {
        "catalog": tables.catalog.select("row_idx", "name", "cost", "price", none("string").alias("supplier"), none("string").alias("code"), none("double").alias("stock")),
        "price_list": tables.prices.select("row_idx", "name", none("double").alias("cost"), "price", "supplier", F.col("code").cast("string").alias("code"), none("double").alias("stock")),
        "registry": tables.registry.select("row_idx", "name", none("double").alias("cost"), none("double").alias("price"), none("string").alias("supplier"), none("string").alias("code"), F.col("quantity").alias("stock")),
    }
    out = None
    for source, rows in payload.items():
        hits = best_fuzzy(items, rows.select("row_idx", "name")).join(rows.drop("name"), "row_idx").withColumn("source", F.lit(source))
        out = hits if out is None else out.unionByName(hits)
    return out


def _asked(items: DataFrame) -> DataFrame:
    spec = T.usable_spec(F.col("asked"), F.col("specifications"))
    return items.select("item_id", F.col("name").alias("asked"), "specifications").withColumns({"query": T.normalize_name("asked"), "spec_query": T.normalize_name(spec)})


def judged_pairs(items: DataFrame, rows: DataFrame, most: int | None) -> DataFrame:
    """Items and the rows of a table (row_idx, name, ...), the ``most`` best of
    each item by name (None: all that score 95, found by index), with of_name,
    of_spec, relevance (the better of both), relevant and mismatch."""
    asked = _asked(items)
    rows = rows.withColumn("choice", T.normalize_name("name"))
    texts = rows.groupBy("choice").agg(F.min("row_idx").alias("first_row"))
    if most is None:
        found = close_pairs(asked, texts).withColumnRenamed("score", "of_name")
        return _judged(asked.join(found, "query").join(rows, "choice"), F.col("of_name"))
    found = scored(pairs(asked, texts)).withColumnRenamed("score", "of_name")
    found = top(found.join(texts, "choice"), ["query"], [F.desc("of_name"), F.col("first_row")], most, "_text").drop("_text", "first_row")
    met = top(asked.join(found, "query").join(rows, "choice"), ["item_id"], [F.desc("of_name"), F.col("row_idx")], most, "_nth")
    return _judged(met, None)


def _judged(met: DataFrame, score: Column | None) -> DataFrame:
    met = met.withColumn("of_spec", F.when(F.col("spec_query").isNotNull(), name_match_score(F.coalesce("spec_query", F.lit("")), F.col("choice"))))
    met = met.withColumn("relevance", F.greatest(F.col("of_name"), F.coalesce("of_spec", F.lit(0.0))))
    score = F.col("relevance") if score is None else score
    relevant = is_relevant(F.col("asked"), F.col("specifications"), F.col("choice"), F.col("of_name"), F.col("of_spec"), score)
    return met.withColumns({"relevant": relevant, "mismatch": T.distinctive_mismatch(F.col("query"), F.col("choice"))})


def direct_catalog(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each item's best catalog row of all, by name alone: 95, relevant and no
    mismatch; of equal ones the first."""
    met = judged_pairs(items, catalog, None).filter("relevant AND NOT mismatch")
    best = top(met, ["item_id"], [F.desc("of_name"), F.col("row_idx")], 1, "_one")
    return best.select("item_id", "row_idx", "name", F.col("of_name").alias("score"), "cost", "price")


def goods_match(items: DataFrame, goods: DataFrame) -> DataFrame:
    """Each item's purchase: of the three best rows by name the most relevant,
    if it reaches 95.

    Rows that reach 95 by name or by specification come from the index.  Only
    where a specification finds a row that the name doesn't, and the name finds
    under three, does it matter which rows are best below 95: those items, and no
    others, are scored against all rows.
    """
    asked, rows = _asked(items), goods.withColumn("choice", T.normalize_name("name"))
    texts = rows.select("choice").distinct()
    both = asked.select("query").union(asked.select(F.col("spec_query").alias("query")))
    near = written(close_pairs(both, texts))
    by_name = asked.join(near.withColumnRenamed("score", "of_name"), "query").join(rows, "choice")
    counts = by_name.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    by_spec = asked.join(near.select(F.col("query").alias("spec_query"), "choice"), "spec_query").join(near.select("query", "choice"), ["query", "choice"], "left_anti")
    open_items = by_spec.select("item_id").distinct().join(counts.filter("_n >= 3"), "item_id", "left_anti")
    rest = written(items.join(open_items, "item_id", "left_semi"))
    first = top(by_name.join(rest.select("item_id"), "item_id", "left_anti"), ["item_id"], [F.desc("of_name"), F.col("row_idx")], 3, "_nth")
    met = _judged(first, None)
    if not rest.isEmpty():
        met = met.unionByName(judged_pairs(rest, goods, 3))
    good = met.filter((F.col("relevance") >= T.LOCAL_THRESHOLD) & F.col("relevant") & ~F.col("mismatch"))
    best = top(good, ["item_id"], [F.desc("relevance"), F.desc("of_name"), F.col("row_idx")], 1, "_one")
    return best.select("item_id", F.col("name").alias("goods_name"), "supplier", "purchase_date", F.col("cost").alias("goods_cost"), F.col("price").alias("goods_price"), F.col("relevance").alias("goods_score"), "procurement")


def supplier_price(needs: DataFrame, prices: DataFrame) -> DataFrame:
    """Each need's (item_id, name, supplier) best row among its supplier's
    prices, from a score of 70."""
    own = needs.select("item_id", T.normalize_name("name").alias("_query"), "supplier")
    met = Q.by_supplier(own, prices.select("row_idx", F.col("name").alias("matched_name"), "code", "supplier", "price"))
    met = met.withColumn("match_score", name_match_score("_query", T.normalize_name("matched_name")))
    best = top(met, ["item_id"], [F.desc("match_score"), F.col("row_idx")], 1, "_one").filter(F.col("match_score") >= T.SIMILAR_THRESHOLD)
    return best.select("item_id", "matched_name", F.col("known").alias("supplier"), "code", "price", "match_score")


def catalog_hits(items: DataFrame, candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each item's catalog row: the picked candidate, or the direct one where
    that scores higher; none where the names tell different things."""
    picked = pick_best(items, candidates.filter("source = 'catalog'")).select("item_id", "row_idx", "name", "score", "cost", "price", F.lit(1).alias("_place"))
    both = picked.unionByName(direct_catalog(items, catalog).withColumn("_place", F.lit(2)))
    one = top(both, ["item_id"], [F.desc("score"), F.col("_place")], 1, "_one").drop("_one", "_place")
    names = items.select("item_id", T.normalize_name("name").alias("_query"))
    return one.join(names, "item_id").filter(~T.distinctive_mismatch(F.col("_query"), T.normalize_name("name"))).drop("_query")


def component_lines(names: DataFrame, tables: Tables) -> DataFrame:
    """Prices of components that a specification lists (column name, distinct):
    the catalog's row from 95, its purchase going first for the cost; else the
    price list's price."""
    minis = names.select(F.col("name").alias("item_id"), "name", F.lit("").alias("specifications"))
    minis = written(minis)
    hits = written(find_candidates(minis, tables).filter("source <> 'registry'"))
    picked = written(pick_best(minis, hits))
    own = picked.filter((F.col("source") == "catalog") & (F.col("score") >= T.LOCAL_THRESHOLD) & ~F.col("mismatch"))
    own = written(own.select("item_id", F.col("name").alias("catalog_name"), "cost", "price"))
    listed = picked.filter("source = 'price_list'").select("item_id", F.col("price").alias("list_price"))
    purchase = lambda asked, p: goods_match(asked, tables.goods).select("item_id", *[F.col(c).alias(f"{p}{c}") for c in ("supplier", "purchase_date", "goods_cost", "goods_price")])
    by_catalog = purchase(own.select("item_id", F.col("catalog_name").alias("name"), F.lit("").alias("specifications")), "c_")
    by_name = purchase(minis, "n_")
    out = minis.select("item_id").join(own, "item_id", "left").join(listed, "item_id", "left").join(by_catalog, "item_id", "left").join(by_name, "item_id", "left")
    found, told = F.col("catalog_name").isNotNull(), F.col("c_supplier").isNotNull() | F.col("c_goods_cost").isNotNull()
    bought = lambda c: F.when(found, F.when(told, F.col(f"c_{c}")).otherwise(F.col(f"n_{c}")))
    return out.select(
        F.col("item_id").alias("name"),
        F.coalesce(bought("goods_cost"), F.col("cost")).alias("unit_cost"),
        F.when(found, F.coalesce(P.present(F.col("price")), F.col("cost"), bought("goods_price"))).otherwise(F.col("list_price")).alias("unit_price"),
        bought("supplier").alias("supplier"),
        bought("purchase_date").alias("purchase_date"),
        found.alias("found_in_catalog"),
        "catalog_name",
    )


def kit_lines(items: DataFrame, hits: DataFrame, tables: Tables, sheets: list[str] = ()) -> DataFrame:
    """Components of items that are kits: those that the specification lists,
    unless the catalog has the item itself; else the catalog's own."""
    judged = hits.join(items.select("item_id", F.col("name").alias("_asked"), "specifications"), "item_id")
    spec = T.usable_spec(F.col("_asked"), F.col("specifications"))
    judged = judged.withColumns({"_choice": T.normalize_name("name"), "_q": T.normalize_name("_asked"), "_s": T.normalize_name(spec)})
    judged = judged.withColumns({"_n": name_match_score("_q", "_choice"), "_p": F.when(F.col("_s").isNotNull(), name_match_score(F.coalesce("_s", F.lit("")), F.col("_choice")))})
    sure = is_relevant(F.col("_asked"), F.col("specifications"), F.col("_choice"), F.col("_n"), F.col("_p"), F.col("score")) & (F.greatest(F.col("_n"), F.coalesce("_p", F.lit(0.0))) >= T.LOCAL_THRESHOLD)
    known = judged.filter(sure).select("item_id")
    listed = C.kit_components(items.select("item_id", "specifications")).join(known, "item_id", "left_anti").select("item_id", F.posexplode("components").alias("pos", "name"))
    listed = written(listed)
    told = listed.join(component_lines(listed.select("name").distinct(), tables), "name").withColumns({"from_specs": F.lit(True), "quantity": F.lit(1.0)})
    own = C.kit_members(tables.catalog, list(sheets)).select("kit_row", F.col("row_idx").alias("pos"), "name", "cost", "price")
    own = hits.select("item_id", F.col("row_idx").alias("kit_row")).join(listed.select("item_id").distinct(), "item_id", "left_anti").join(own, "kit_row")
    own = own.select("item_id", F.col("pos").cast("int"), "name", F.col("cost").alias("unit_cost"), F.coalesce(P.present(F.col("price")), F.col("cost")).alias("unit_price"), F.lit(None).cast("string").alias("supplier"), F.lit(None).cast("string").alias("purchase_date"), F.lit(True).alias("found_in_catalog"), F.col("name").alias("catalog_name"), F.lit(False).alias("from_specs"), F.lit(1.0).alias("quantity"))
    return told.select(*own.columns).unionByName(own)


def _quote(df: DataFrame, source: str, label: Column, pos: int, **cells: Column) -> DataFrame:
    values = {"source": F.lit(source), "label": label, "pos": F.lit(pos), **cells}
    return df.select("item_id", *[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _QUOTE.items() if kind])


def comparison(candidates: DataFrame, picked: DataFrame, hits: DataFrame, kits: DataFrame, goods: DataFrame, checks: DataFrame, web: DataFrame) -> DataFrame:
    """All quotes of each item, in the order of their sources."""
    c = F.col
    of_list = lambda df, pos: _quote(df, "price_list", F.concat(F.lit("Прайс ("), F.coalesce("supplier", F.lit("")), F.lit(")")), pos, matched_name=c("matched_name"), price=c("price"), supplier=c("supplier"), match_score=c("match_score"), notes=F.concat(F.lit("код "), c("code").cast("string")))
    cost = F.coalesce("quote_cost", "cost")
    catalog = hits.join(kits.select("item_id", "quote_cost", "n_components"), "item_id", "left")
    rename = lambda df: df.withColumnsRenamed({"name": "matched_name", "score": "match_score"})
    first = rename(picked.filter("source = 'price_list'"))
    extra = Q.extra_quotes(candidates.filter("source = 'price_list'"), ["item_id"])
    extra = rename(extra).join(first.select("item_id", "matched_name"), ["item_id", "matched_name"], "left_anti")
    parts = [
        _quote(catalog, "catalog", F.lit(CATALOG_LABEL), 0, matched_name=c("name"), cost=cost, price=F.coalesce(P.present(c("price")), cost), match_score=c("score"), notes=F.concat(F.lit("состав: "), c("n_components").cast("string"), F.lit(" поз."))),
        _quote(goods, "goods_report", F.when(c("procurement"), PROCUREMENT_LABEL).otherwise(GOODS_LABEL), 1, matched_name=c("goods_name"), cost=c("goods_cost"), price=F.coalesce(P.present(c("goods_price")), c("goods_cost")), supplier=c("supplier"), purchase_date=c("purchase_date"), match_score=F.lit(GOODS_SCORE)),
        of_list(first, 2),
        _quote(rename(picked.filter("source = 'registry'")), "registry", F.lit(REGISTRY_LABEL), 3, matched_name=c("matched_name"), match_score=c("match_score"), notes=F.concat(F.lit("остаток: "), c("stock").cast("string"), F.lit(" шт."))),
        of_list(checks, 4),
        of_list(extra, 5),
        _quote(web, "web", c("label"), 6, matched_name=c("matched_name"), price=c("price"), url=c("url"), match_score=c("match_score")).withColumn("pos", F.lit(6)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def match_items(items: DataFrame, tables: Tables, disabled: list[str] = (), excluded: list[str] = (), sheets: list[str] = (), markup: float = P.MARKUP) -> DataFrame:
    """One row an item: status, source, matched_name, score, unit_cost,
    unit_base_price, unit_price, total_price, supplier, purchase_date, is_kit,
    n_components, n_quotes, internet, url, local_miss and the ladder's rung."""
    c = F.col
    items = written(items)
    candidates = written(find_candidates(items, tables))
    picked = written(pick_best(items, candidates))
    hits = written(catalog_hits(items, candidates, tables.catalog))
    goods = written(goods_match(items, tables.goods))
    lines = written(kit_lines(items, hits, tables, sheets))
    kits = C.kit_totals(lines, ["item_id"]).join(lines.groupBy("item_id").agg(F.bool_or("from_specs").alias("from_specs"), F.count_if("found_in_catalog").alias("in_catalog")), "item_id")
    checks = supplier_price(items.select("item_id", "name").join(goods.select("item_id", "supplier"), "item_id").filter("supplier IS NOT NULL"), tables.prices)
    web = tables.web if "web" not in disabled else tables.web.limit(0)
    quotes = written(Q.filter_quotes(comparison(candidates, picked, hits, kits, goods, checks, web), list(disabled), list(excluded)))

    sure = picked.filter("source <> 'registry'").select("item_id", "source", "score", "price", "relevant", "mismatch")
    side = lambda source, p: sure.filter(c("source") == source).select("item_id", c("price").alias(f"{p}_price"), c("score").alias(f"{p}_score"), (c("relevant") & ~c("mismatch")).alias(f"{p}_ok"))
    # The catalog's own row was judged when it was picked.
    own = hits.select("item_id", c("cost").alias("catalog_cost"), c("price").alias("catalog_price"), c("score").alias("catalog_score"))
    own = own.join(side("catalog", "picked"), "item_id", "left").withColumn("catalog_ok", F.coalesce(c("picked_ok") | (c("catalog_score") > c("picked_score")), F.lit(True))).drop("picked_price", "picked_score", "picked_ok")
    local = written(local_match(items, candidates)).select("item_id", c("status").alias("local_status"), c("source").alias("local_source"), c("score").alias("local_score"), c("unit_cost").alias("local_cost"), c("unit_base_price").alias("local_price"), c("matched_name").alias("local_name"))
    best_web = Q.best_web(quotes, ["item_id"]).select("item_id", c("price").alias("web_price"), c("matched_name").alias("web_name"))
    joined = items
    for df in (local, own, goods, side("price_list", "price"), best_web, Q.internet_url(quotes, ["item_id"]), kits):
        joined = joined.join(df, "item_id", "left")
    confident = (c("catalog_score") >= T.LOCAL_THRESHOLD) & c("catalog_ok") | (c("price_score") >= T.LOCAL_THRESHOLD) & c("price_ok") | c("goods_cost").isNotNull()
    false, zero = F.lit(False), F.lit(0.0)
    joined = joined.withColumns(
        {
            "local_status": F.coalesce("local_status", F.lit("not_found")),
            "local_score": F.coalesce("local_score", zero),
            "catalog_score": F.coalesce("catalog_score", zero),
            "price_score": F.coalesce("price_score", zero),
            "catalog_ok": F.coalesce("catalog_ok", false),
            "price_ok": F.coalesce("price_ok", false),
            "goods_ok": c("goods_name").isNotNull(),
            "price_price": c("price_price"),
            "web_url": c("internet_url"),
            "kit_cost": c("quote_cost"),
            "local_miss": ~F.coalesce(confident, false),
        }
    )
    solved = written(Q.resolve(written(joined)))
    # A kit by its specification is priced by its components.
    by_kit = F.coalesce(c("from_specs") & (c("sum_cost").isNotNull() | c("sum_price").isNotNull()), false)
    solved = solved.withColumns(
        {
            "unit_cost": F.when(by_kit, F.coalesce("sum_cost", "unit_cost")).otherwise(c("unit_cost")),
            "unit_base_price": F.when(by_kit, F.coalesce("sum_price", "unit_base_price")).otherwise(c("unit_base_price")),
            "status": F.when(by_kit, "similar").otherwise(c("status")),
            "source": F.when(by_kit, "catalog").otherwise(c("source")),
            "score": F.when(by_kit, F.greatest("score", F.round(c("in_catalog") / c("n_components") * 100, 1))).otherwise(c("score")),
        }
    )
    names = F.when(c("rung") <= 2, c("local_name")).when(c("rung") == 4, c("goods_name")).when(c("rung") == 6, c("web_name"))
    named = hits.select("item_id", c("name").alias("hit_name"))
    shelf = picked.filter("source = 'price_list'").select("item_id", c("name").alias("shelf_name"))
    solved = solved.join(named, "item_id", "left").join(shelf, "item_id", "left")
    names = F.coalesce(names, F.when(c("rung") == 3, c("hit_name")).when(c("rung") == 5, c("shelf_name")), F.when(by_kit, c("name")))
    solved = written(solved)
    results = solved.select("item_id", "name", "status", "source", "score", names.alias("matched_name"), "unit_cost", "unit_base_price", (c("rung") == 6).alias("internet"))
    # Of the local quotes only those that tell the item may price it.
    judged = quotes.join(picked.select("item_id", "source", c("name").alias("matched_name"), "relevant", "mismatch"), ["item_id", "source", "matched_name"], "left")
    judged = judged.withColumns({"relevant": F.coalesce("relevant", c("match_score") >= T.LOCAL_THRESHOLD), "mismatch": F.coalesce("mismatch", false)})
    final = apply_quotes(results, judged).join(items.select("item_id", "quantity"), "item_id")
    final = P.priced(final, "unit_cost", "unit_base_price", "quantity", c("internet"), markup)
    counts = quotes.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_quotes"))
    rest = solved.select("item_id", "supplier", "purchase_date", F.coalesce(c("n_components") > 0, false).alias("is_kit"), F.coalesce("n_components", F.lit(0)).alias("n_components"), "local_miss", "rung")
    return final.join(rest, "item_id").join(counts, "item_id", "left").withColumn("n_quotes", F.coalesce("n_quotes", F.lit(0)))
