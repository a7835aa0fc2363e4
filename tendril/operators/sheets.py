"""The six sheets of a quotation as tables: a row a line, in the sheet's columns.

Every sheet has the request's keys and ``row``, the line's place on it.  Rows are
numbered within their request, so no window spans more than one quotation.
``results``: keys, number, name, unit, quantity, specifications, status, source,
matched_name, score, unit_cost, unit_base_price, unit_price, total_price, supplier,
purchase_date, notes, source_detail, alternatives, internet, is_kit.
``components``: keys, number, pos, name, catalog_name, quantity, unit_cost,
unit_price, supplier, purchase_date, found_in_catalog, list_price, competitor_url,
competitor_platform.  ``quotes``: keys, number, pos, source, label, matched_name,
cost, price, supplier, purchase_date, match_score, notes, url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.functions import pricing as P
from tendril.functions import text as T
from tendril.operators.quotes import filter_quotes
from tendril.operators.results import sheet_name

# Labels of states and sources, and the sheets' own words.
STATUS_LABELS = {"exact": "Точное совпадение", "similar": "Похожее (проверить)", "not_found": "Не найдено"}
SOURCE_LABELS = {"catalog": "Каталог", "registry": "Реестр остатков", "price_list": "Прайс поставщика", "web": "Интернет (оценка AI)", "ai": "AI-подбор", "none": "—"}
DASH, TOTAL = "—", "Всего:"
ITEM_ROW, PART_ROW, PARTS = "Позиция ТЗ", "Составляющая", "Состав комплекта"
IN_CATALOG, KIT_CATALOG, LISTED, PART_MARK, SHELF = "найдено в каталоге", "каталог", "прайс: ", "  ↳ ", "каталог: "
NO_KITS, ALL_FOUND = "— комплекты с составом не найдены", "— все позиции подобраны"
SUMMARY = ["Всего позиций в ТЗ", "Точных совпадений", "Похожих (требуют проверки)", "Не найдено", "Итого себестоимость", "Итого цена без наценки", "Итого цена КП"]
SEARCHES = [
    (r"(?iuU)ozon", "https://www.ozon.ru/search/?text="), (r"(?iuU)яндекс|yandex|маркет", "https://market.yandex.ru/search?text="),
    (r"(?iuU)wildberries|вайлдберриз", "https://www.wildberries.ru/catalog/0/search.aspx?search="), (r"(?iuU)ситилинк|citilink", "https://www.citilink.ru/search/?text="),
]
FALLBACKS = ["Ozon", "Яндекс.Маркет", "Wildberries"]
WEB_LABEL = "Интернет: "


def _labelled(c: str, labels: dict[str, str]) -> Column:
    out = F.col(c)
    for value, label in labels.items():
        out = F.when(F.col(c) == value, label).otherwise(out)
    return out


def _cents(x: Column) -> Column:
    return F.round(F.coalesce(x, F.lit(0.0)).cast("decimal(18,4)"), 2).cast("double")


def _shown(x: Column) -> Column:
    """Money as the sheet shows it; a dash for none or nothing."""
    return F.when(_cents(x) == 0, DASH).otherwise(F.format_number(_cents(x), 2))


def _numbered(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    return rows.withColumn("row", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def quotation_sheet(results: DataFrame, by: list[str]) -> DataFrame:
    """Lines with their prices, and under them the total."""
    lines = _numbered(results, by, "number")
    body = lines.select(*by, "row", F.col("number").cast("string").alias("number"), sheet_name(F.col("name"), F.col("status")).alias("name"), "unit", "quantity", _shown(F.col("unit_price")).alias("unit_price"), _shown(F.col("total_price")).alias("total_price"))
    none = F.lit(None)
    total = results.groupBy(*by).agg((F.count(F.lit(1)) + 1).cast("int").alias("row"), F.sum(_cents(F.col("total_price")).cast("decimal(18,2)")).cast("double").alias("t"))
    total = total.select(*by, "row", none.cast("string").alias("number"), none.cast("string").alias("name"), none.cast("string").alias("unit"), none.cast("double").alias("quantity"), F.lit(TOTAL).alias("unit_price"), F.format_number("t", 2).alias("total_price"))
    return body.unionByName(total)


def search_url(platform: Column, query: Column) -> Column:
    """A platform's search address for a name; an unknown one's, the first's."""
    plus = F.replace(F.replace(F.url_encode(F.trim(query)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    base = F.lit(SEARCHES[0][1])
    for pattern, address in reversed(SEARCHES):
        base = F.when(platform.rlike(pattern), address).otherwise(base)
    return F.when(F.trim(query) != "", F.concat(base, plus)).otherwise("")


def _url_excluded(url: Column, excluded: list[str]) -> Column:
    low, out = F.lower(url), F.lit(False)
    for token in filter(None, excluded):
        out = out | low.contains(token.lower())
        for pattern, _ in SEARCHES:
            out = out | (F.lit(token).rlike(pattern) & low.rlike(pattern))
    return out


def _named(label: Column, excluded: list[str]) -> Column:
    out = F.lit(False)
    for token in filter(None, excluded):
        out = out | F.lower(label).contains(token.lower())
    return out


def _platform(label: Column) -> Column:
    return F.coalesce(F.nullif(F.replace(label, F.lit(WEB_LABEL), F.lit("")), F.lit("")), F.lit("Интернет"))


def _offer(label: Column, pos: Column, url: Column, asked: Column) -> Column:
    return F.struct(pos.cast("long").alias("pos"), F.trim(F.coalesce(url, F.lit(""))).alias("url"), F.nullif(asked, F.lit("")).alias("asked"), _platform(label).alias("platform"))


def _addresses(told: Column, excluded: list[str], most: int) -> Column:
    """The first distinct addresses of a line's offers, in their order."""

    def own(q: Column) -> Column:
        return F.when(F.lower(q["url"]).rlike("^https?://"), q["url"]).otherwise(search_url(q["platform"], F.coalesce(q["asked"], F.col("name"))))

    none = F.array().cast("array<string>")
    spare = F.array(*[F.when(~_named(F.lit(x), excluded), search_url(F.lit(x), F.col("name"))) for x in FALLBACKS])
    every = F.concat(F.coalesce(F.transform(told, own), none), spare)
    kept = F.filter(every, lambda url: url.isNotNull() & (url != "") & ~_url_excluded(url, excluded))
    return F.slice(F.array_distinct(kept), 1, most)


def with_links(items: DataFrame, quotes: DataFrame, by: list[str], excluded: list[str] = (), web: bool = True, most: int = 3) -> DataFrame:
    """Items with ``links``: their first distinct addresses of web quotes, a
    search where a quote has none, then searches of the large marketplaces.

    An item's web quotes are gathered in one row, and addresses are made where
    that row meets its item: no address is shuffled.
    """
    if not web:
        return items.withColumn("links", F.array().cast("array<string>"))
    told = _offer(F.col("label"), F.col("pos"), F.col("url"), F.col("matched_name"))
    offered = quotes.filter("source = 'web'").filter(~_named(_platform(F.col("label")), excluded)).groupBy(*by).agg(F.array_sort(F.collect_list(told)).alias("_told"))
    return items.join(offered, by, "left").withColumn("links", _addresses(F.col("_told"), excluded, most)).drop("_told")


def links_sheet(results: DataFrame, quotes: DataFrame, by: list[str], excluded: list[str] = (), web: bool = True) -> DataFrame:
    """Lines with their specification in short and three addresses."""
    key = [*by, "number"]
    lines = with_links(_numbered(results, by, "number"), quotes, key, excluded, web)
    cells = [F.coalesce(F.try_element_at("links", F.lit(k)), F.lit(DASH)).alias(f"link_{k}") for k in (1, 2, 3)]
    return lines.select(*by, "row", "number", sheet_name(F.col("name"), F.col("status")).alias("name"), T.spec_preview(F.col("specifications"), 2000).alias("specifications"), *cells)


#: Of the arrays that a line of ``detail_rows`` holds: what its quotes and its components tell.
OFFER = ["pos", "source", "label", "matched_name", "url"]
PART = ["pos", "name", "catalog_name", "quantity", "unit_cost", "unit_price", "supplier", "purchase_date", "found_in_catalog", "list_price", "competitor_url", "competitor_platform"]
_DETAIL = ["label", "kind", "name", "matched_name", "status", "source", "score", "quantity", "unit_cost", "base_price", "markup", "unit_price", "total_price", "supplier", "purchase_date", "notes", "source_detail", "alternatives", "link"]


def _listed(price: Column) -> Column:
    return F.concat(F.lit(LISTED), price.cast("string"))


def detail_sheet(results: DataFrame, components: DataFrame, quotes: DataFrame, by: list[str], excluded: list[str] = (), web: bool = True) -> DataFrame:
    """Lines in all their fields, each kit's components under it."""
    key = [*by, "number"]
    gathered = lambda df, fields, name: df.groupBy(*key).agg(F.collect_list(F.struct(*fields)).alias(name))
    offers = gathered(quotes.filter("source = 'web'"), OFFER, "offers")
    lines = results.join(gathered(components, PART, "parts"), key, "left").join(offers, key, "left")
    return detail_rows(placed(lines, by, F.when(F.col("is_kit"), F.array_size("parts"))), by, excluded, web)


def placed(lines: DataFrame, by: list[str], parts: Column) -> DataFrame:
    """Lines with ``row``, their place on the detail sheet: under each stand as
    many components as ``parts`` says (null: none)."""
    parts = F.coalesce(parts, F.lit(0))
    before = Window.partitionBy(*by).orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("row", (F.sum(parts + 1).over(before) - parts).cast("int"))


def detail_rows(lines: DataFrame, by: list[str], excluded: list[str] = (), web: bool = True) -> DataFrame:
    """The detail sheet of placed lines that hold their quotes (``offers``) and
    components (``parts``) as arrays: each line's rows are made from it alone,
    so that no text is shuffled."""
    c, none = F.col, F.lit(None)
    kind = dict(lines.dtypes)
    offers = F.filter("offers", lambda q: (q["source"] == "web") & ~_named(_platform(q["label"]), excluded))
    offers = F.array_sort(F.transform(offers, lambda q: _offer(q["label"], q["pos"], q["url"], q["matched_name"])))
    link = F.try_element_at(_addresses(offers, excluded, 1), F.lit(1)) if web else none.cast("string")
    discounted = c("internet") & c("unit_base_price").isNotNull()
    notes = F.when(discounted, F.concat_ws(" | ", F.nullif("notes", F.lit("")), P.adjustment_label(F.lit(True)))).otherwise(c("notes"))
    item = F.struct(
        c("row").alias("row"), c("number").cast("string").alias("label"), F.lit(ITEM_ROW).alias("kind"), c("name").alias("name"), F.coalesce(F.nullif("matched_name", F.lit("")), F.lit(DASH)).alias("matched_name"), _labelled("status", STATUS_LABELS).alias("status"), _labelled("source", SOURCE_LABELS).alias("source"),
        F.round("score", 1).alias("score"), c("quantity").alias("quantity"), c("unit_cost").alias("unit_cost"), c("unit_base_price").alias("base_price"), F.when(c("unit_base_price").isNotNull() & c("unit_price").isNotNull(), _cents(c("unit_price").cast("decimal(18,4)") - c("unit_base_price").cast("decimal(18,4)"))).alias("markup"), c("unit_price").alias("unit_price"), c("total_price").alias("total_price"), c("supplier").alias("supplier"), c("purchase_date").alias("purchase_date"),
        notes.alias("notes"), c("source_detail").alias("source_detail"), F.array_join(F.slice(F.coalesce("alternatives", F.array().cast("array<string>")), 1, 3), "; ").alias("alternatives"), F.coalesce(link, F.lit(DASH)).alias("link"),
    )

    def part(x: Column, k: Column) -> Column:
        found = F.coalesce(x["found_in_catalog"], F.lit(False))
        told = F.when(found, IN_CATALOG).when(x["list_price"].isNotNull(), _listed(x["list_price"]))
        return F.struct(
            (c("row") + k + 1).alias("row"), F.concat_ws(".", c("number").cast("string"), x["pos"].cast("string")).alias("label"), F.lit(PART_ROW).alias("kind"), F.concat(F.lit(PART_MARK), x["name"]).alias("name"), F.coalesce(F.when(found, F.nullif(x["catalog_name"], F.lit(""))), x["name"]).alias("matched_name"), F.lit(PARTS).alias("status"), _labelled("source", SOURCE_LABELS).alias("source"),
            none.cast("double").alias("score"), x["quantity"].cast(kind["quantity"]).alias("quantity"), x["unit_cost"].alias("unit_cost"), x["unit_price"].alias("base_price"), none.cast("double").alias("markup"), none.cast("double").alias("unit_price"), F.when(x["unit_price"].isNotNull(), P.line_total(x["unit_price"], x["quantity"])).alias("total_price"),
            F.when(found, x["supplier"]).alias("supplier"), F.when(found, x["purchase_date"]).alias("purchase_date"), F.concat_ws(" | ", told, F.nullif(x["competitor_platform"], F.lit(""))).alias("notes"), F.lit("").alias("source_detail"), F.lit("").alias("alternatives"), F.coalesce(F.nullif(x["competitor_url"], F.lit("")), F.lit(DASH)).alias("link"),
        )

    under = F.transform(F.array_sort(F.when(c("is_kit"), c("parts"))), part)
    rows = F.array(item)
    return lines.select(*by, F.inline(F.coalesce(F.concat(rows, under), rows))).select(*by, "row", *_DETAIL)


def kit_sheet(results: DataFrame, components: DataFrame, by: list[str]) -> DataFrame:
    """Kits' components; one that the catalog has with a supplier has a row
    for the supplier under it.  Without kits the sheet says so."""
    c, key = F.col, [*by, "number"]
    kits = results.filter("is_kit").select(*key, c("name").alias("kit"), c("unit_base_price").alias("kit_base"), c("unit_price").alias("kit_price"))
    rows = components.join(kits, key).withColumn("found", F.coalesce("found_in_catalog", F.lit(False)))
    total = F.when(c("unit_price").isNotNull(), P.line_total(c("unit_price"), c("quantity")))
    first = c("pos") == 1
    text = lambda x: F.coalesce(x, F.lit(""))
    shown = F.when(c("found") & (F.coalesce("catalog_name", F.lit("")) != ""), F.concat(c("name"), F.lit(f" ({SHELF}"), c("catalog_name"), F.lit(")"))).otherwise(c("name"))
    own = rows.select(*key, "pos", F.lit(0).alias("sub"), F.when(first, c("number").cast("string")).otherwise("").alias("item"), F.when(first, c("kit")).otherwise("").alias("kit"), c("pos").cast("string").alias("place"), shown.alias("component"), "quantity", "unit_cost", "unit_price", total.alias("total_price"), text(F.when(c("found"), c("supplier"))).alias("supplier"), text(F.when(c("found"), c("purchase_date"))).alias("purchase_date"), "list_price", F.when(first, c("kit_base")).alias("kit_base"), F.when(first, c("kit_price")).alias("kit_price"))
    none = F.lit(None).cast("double")
    sub = rows.filter(c("found") & (F.coalesce("supplier", F.lit("")) != "")).select(*key, "pos", F.lit(1).alias("sub"), F.lit("").alias("item"), F.lit("").alias("kit"), F.lit("").alias("place"), F.concat(F.lit(PART_MARK), c("supplier")).alias("component"), "quantity", none.alias("unit_cost"), "unit_price", total.alias("total_price"), "supplier", "purchase_date", "list_price", none.alias("kit_base"), none.alias("kit_price"))
    every = own.unionByName(sub)
    bare = results.select(*by).distinct().join(every.select(*by).distinct(), by, "left_anti")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in every.schema if f.name not in by} | {"item": F.lit(NO_KITS)}
    return _numbered(every.unionByName(bare.withColumns(empty)), by, "number", "pos", "sub").drop("number", "pos", "sub")


def comparison_sheet(results: DataFrame, components: DataFrame, quotes: DataFrame, by: list[str]) -> DataFrame:
    """Every quote that the plain preferences leave, then kits' components."""
    c, key = F.col, [*by, "number"]
    names = results.select(*key, c("name").alias("item"))
    left = filter_quotes(quotes).join(names, key)
    score = F.when(F.coalesce("match_score", F.lit(0.0)) != 0, F.round("match_score", 1))
    body = left.select(*key, F.lit(0).alias("_part"), c("pos").cast("long").alias("_pos"), "item", c("label").alias("source"), c("matched_name").alias("found"), "cost", "price", "supplier", "purchase_date", score.alias("score"), "notes")
    own = F.coalesce("found_in_catalog", F.lit(False))
    note = F.when(own, KIT_CATALOG).when(c("list_price").isNotNull(), _listed(c("list_price"))).otherwise("")
    parts = components.join(names, key).select(*key, F.lit(1).alias("_part"), c("pos").cast("long").alias("_pos"), "item", F.lit(PARTS).alias("source"), c("name").alias("found"), c("unit_cost").alias("cost"), c("unit_price").alias("price"), F.when(own, c("supplier")).alias("supplier"), F.when(own, c("purchase_date")).alias("purchase_date"), c("quantity").cast("double").alias("score"), note.alias("notes"))
    return _numbered(body.unionByName(parts), by, "number", "_part", "_pos").drop("_part", "_pos")


def summary_sheet(summaries: DataFrame, results: DataFrame, by: list[str]) -> DataFrame:
    """Labels and values, then the lines without a match or that there is none.

    ``summaries`` has the columns of ``results.summary_columns``.
    """
    fields = ["items", "exact_items", "similar_items", "missing_items", "sum_cost", "sum_base", "sum_price"]
    cells = F.array(*[F.struct(F.lit(k + 1).alias("row"), F.lit(label).alias("label"), F.col(c).cast("double").alias("value")) for k, (label, c) in enumerate(zip(SUMMARY, fields, strict=True))])
    body = summaries.select(*by, F.explode(cells).alias("x")).select(*by, "x.*")
    missing = _numbered(results.filter("status = 'not_found'"), by, "number")
    lines = missing.select(*by, (F.col("row") + len(SUMMARY)).alias("row"), F.concat(F.col("number").cast("string"), F.lit(". "), F.col("name")).alias("label"), F.lit(None).cast("double").alias("value"))
    done = summaries.filter("missing_items = 0").select(*by, F.lit(len(SUMMARY) + 1).alias("row"), F.lit(ALL_FOUND).alias("label"), F.lit(None).cast("double").alias("value"))
    return body.unionByName(lines).unionByName(done)
