"""What a result says of itself: three rewrites, each over the last one's rows.

``normalize`` gives a price without a source the quote or kit that it comes from,
``price_from_internet`` prices what no local source prices surely from quotes that
were fetched for it, and ``promote_internet`` makes internet finds results of their
own.  Every rewrite is one choice among ordered cases over the columns of a row and
the best quotes of its item, which are picked before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.functions import text as T
from tendril.functions import web as Wb
from tendril.functions.pricing import WEB_DISCOUNT
from tendril.operators import quotes as Q
from tendril.operators.matching import top

FIELDS = ["status", "source", "matched_name", "score", "unit_cost", "unit_base_price", "internet", "source_detail", "notes", "supplier", "purchase_date"]

# Notes and details.
DISCOUNT = f"Цена КП: −{WEB_DISCOUNT}%"
CHOSEN, FROM_WEB = "Подбор по сравнению: ", f"{DISCOUNT} от найденной в интернете"
KIT_DETAIL, KIT_NOTE = ("Комплект по составу ТЗ (", "/", " поз. в каталоге)"), ("Себестоимость по составу комплекта: ", " поз.")
INTERNET, COMPARED, NO_PRICE = "Интернет", "Подбор по сравнению", "Цена не извлечена — проверьте ссылки"


def _some(c: str | Column) -> Column:
    """A text, null where it is empty."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _noted(note: Column) -> Column:
    return F.concat_ws(" | ", _some("notes"), note)


def _chosen(rows: DataFrame, cases: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """Each row with the changes of the first case that holds for it."""
    case = F.lit(len(cases))
    for k, (holds, _) in reversed(list(enumerate(cases))):
        case = F.when(holds, k).otherwise(case)
    # The case is a column of its own, so that no field repeats its conditions.
    out = {}
    for name in (f for f in FIELDS if any(f in changes for _, changes in cases)):
        value = F.col(name)
        for k, (_, changes) in enumerate(cases):
            if name in changes:
                value = F.when(F.col("_case") == k, changes[name]).otherwise(value)
        out[name] = value
    return rows.withColumn("_case", case).withColumns(out).drop("_case")


def _graded(score: Column) -> Column:
    return F.when(score >= T.EXACT_THRESHOLD, "exact").otherwise("similar")


def by_quote(q: str) -> dict[str, Column]:
    """What a row becomes that takes its price from the quote in column ``q``."""
    c = lambda name: F.col(f"{q}.{name}")
    base, web = F.coalesce(c("cost"), c("price")), c("source") == "web"
    score = F.greatest("score", F.coalesce(c("match_score"), F.lit(0.0)))
    note = F.concat(F.lit(CHOSEN), c("label"))
    return {
        "source": c("source"),
        "internet": web,
        "matched_name": F.coalesce(_some(c("matched_name")), F.col("matched_name")),
        "unit_cost": base,
        "unit_base_price": base,
        "score": score,
        "status": F.when((F.col("status") == "not_found") | (score < T.EXACT_THRESHOLD), "similar").otherwise(F.col("status")),
        "supplier": F.coalesce(_some("supplier"), _some(c("supplier")), F.col("supplier")),
        "purchase_date": F.coalesce(_some("purchase_date"), _some(c("purchase_date")), F.col("purchase_date")),
        "notes": _noted(F.when(web, F.concat(note, F.lit(f" | {FROM_WEB}"))).otherwise(note)),
        "source_detail": F.when(web & _some(c("url")).isNotNull(), F.concat(c("label"), F.lit(" | "), c("url"))).otherwise(c("label")),
    }


_QUOTE = ["source", "label", "matched_name", "cost", "price", "url", "match_score", "supplier", "purchase_date"]


def _best(quotes: DataFrame, name: str) -> DataFrame:
    return quotes.select("item_id", F.struct(*_QUOTE).alias(name))


def with_best(results: DataFrame, kits: DataFrame, quotes: DataFrame, found: DataFrame) -> DataFrame:
    """Results with what the rewrites look at: the best local, web and linked
    quote, the best of ``found``, the internet url and the kit's counts."""
    every = quotes.unionByName(Q.new_quotes(found, quotes, ["item_id", "source", "url", "matched_name", "price", "cost"]), allowMissingColumns=True)
    paid = F.coalesce("price", "cost")
    priced = every.withColumn("_paid", paid)
    web = priced.filter("source = 'web'")
    linked = web.filter((F.coalesce("url", F.lit("")) != "") & Wb.acceptable_quote(F.col("source"), F.col("url"), F.col("match_score"), F.col("_paid")))
    linked = top(linked, ["item_id"], [*Wb.quote_order(F.col("url"), F.col("match_score"), F.col("_paid")), F.col("pos")], 1, "_one")
    best_of = lambda df: Q.best_web(df.withColumns({"_price": F.col("price"), "price": paid}), ["item_id"]).withColumn("price", F.col("_price"))
    local = Q.best_local(quotes.filter(F.col("match_score") >= T.LOCAL_THRESHOLD), ["item_id"])
    facts = web.groupBy("item_id").agg(F.max((F.coalesce("url", F.lit("")) != "") & ~Wb.is_listing(F.col("url"))).alias("has_link"), F.max(F.coalesce(F.col("price") != 0, F.lit(False)) | F.coalesce(F.col("cost") != 0, F.lit(False))).alias("web_priced"))
    out = results
    for side in (_best(local, "_local"), _best(best_of(quotes), "_web"), _best(best_of(found), "_found"), _best(linked, "_linked"), Q.internet_url(every, ["item_id"]), facts, kits.select("item_id", "n_components", "in_catalog", "any_priced")):
        out = out.join(side, "item_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_link", "web_priced", "any_priced")})


def _priced() -> Column:
    return F.col("unit_base_price").isNotNull() | F.col("unit_cost").isNotNull()


def normalize(rows: DataFrame) -> DataFrame:
    """Results with a price say where it comes from."""
    c = F.col
    told = (c("status") != "not_found") & (c("source") != "none")
    name = F.coalesce(_some("matched_name"), c("name"))
    share = F.round(c("in_catalog") / c("n_components") * 100, 1)
    kit = {
        "status": F.lit("similar"),
        "source": F.lit("catalog"),
        "internet": F.lit(False),
        "matched_name": name,
        "score": F.greatest("score", share),
        "source_detail": F.concat(F.lit(KIT_DETAIL[0]), c("in_catalog").cast("string"), F.lit(KIT_DETAIL[1]), c("n_components").cast("string"), F.lit(KIT_DETAIL[2])),
        "notes": _noted(F.concat(F.lit(KIT_NOTE[0]), c("n_components").cast("string"), F.lit(KIT_NOTE[1]))),
    }
    return _chosen(
        rows,
        [
            (~_priced(), {}),
            (told, {"source": F.when(c("internet"), "web").otherwise(c("source"))}),
            (c("is_kit") & c("any_priced"), kit),
            (c("_local").isNotNull(), by_quote("_local")),
            (c("_web").isNotNull(), by_quote("_web")),
            (c("internet") | c("web_priced"), {"source": F.lit("web"), "status": _graded(c("score")), "matched_name": name, "source_detail": F.coalesce(_some("source_detail"), F.lit(INTERNET))}),
            (F.lit(True), {"status": F.lit("similar"), "source": F.when(c("source") == "none", "catalog").otherwise(c("source")), "matched_name": name, "source_detail": F.coalesce(_some("source_detail"), F.lit(COMPARED))}),
        ],
    )


def confident_local() -> Column:
    """Whether a local source prices the row surely."""
    c = F.col
    local = _priced() & ~c("internet") & (c("source") != "web")
    kit = c("is_kit") & (F.coalesce("n_components", F.lit(0)) > 0)
    return local & (kit | ((c("source") != "none") & (c("score") >= T.LOCAL_THRESHOLD)))


def promote_internet(rows: DataFrame, where: Column) -> DataFrame:
    """Rows with an internet price or a usable link become internet results."""
    c = F.col
    detail = F.coalesce(F.concat(F.lit(f"{INTERNET} | "), c("internet_url")), F.lit(INTERNET))
    linked = c("_linked").isNotNull()
    price = F.coalesce("_linked.cost", "_linked.price")
    rows = rows.withColumn("_takes", c("unit_base_price").isNull() & linked & price.isNotNull())
    takes = c("_takes")
    internet = c("internet") | takes
    score = F.when(takes, F.greatest("score", F.coalesce(F.nullif(F.col("_linked.match_score"), F.lit(0.0)), F.lit(T.WEB_THRESHOLD)))).otherwise(c("score"))
    name = F.when(takes, F.coalesce(_some(c("_linked.matched_name")), c("name"))).otherwise(c("matched_name"))
    noted = internet & ~F.coalesce("notes", F.lit("")).contains("−")
    found = {
        "unit_cost": F.when(takes, price).otherwise(c("unit_cost")),
        "unit_base_price": F.when(takes, price).otherwise(c("unit_base_price")),
        "internet": internet,
        "score": score,
        "status": _graded(score),
        "source": F.lit("web"),
        "matched_name": F.coalesce(_some(name), c("name")),
        "source_detail": F.coalesce(_some("source_detail"), detail),
        "notes": F.when(noted, _noted(F.lit(FROM_WEB))).otherwise(c("notes")),
    }
    link = {"status": F.lit("similar"), "source": F.lit("web"), "matched_name": c("name"), "notes": _noted(F.lit(NO_PRICE)), "source_detail": detail}
    unset = (c("status") == "not_found") | (c("source") == "none")
    return _chosen(rows, [(where & ((c("internet") & c("unit_base_price").isNotNull()) | linked), found), (where & unset & c("has_link"), link)]).drop("_takes")


def price_from_internet(rows: DataFrame, web: bool = True) -> DataFrame:
    """Rows that no local source prices surely take a fetched quote's price,
    and internet finds are promoted; with ``web`` off they are only promoted."""
    rows = rows.withColumn("_open", ~confident_local() if web else F.lit(True))
    if web:
        rows = _chosen(rows, [(F.col("_open") & ~_priced() & F.col("_found").isNotNull(), by_quote("_found"))])
    return promote_internet(rows, F.col("_open")).drop("_open")


def finish(results: DataFrame, kits: DataFrame, quotes: DataFrame, found: DataFrame, web: bool = True) -> DataFrame:
    """All three rewrites; the columns of ``results`` come back."""
    rows = with_best(results, kits, quotes, found)
    return price_from_internet(normalize(rows), web).select(*results.columns)
