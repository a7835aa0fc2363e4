"""Item results: the best local match, kits, and what web quotes change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.functions import text as T
from tendril.functions import web as Wb
from tendril.functions.similarity import name_match_score
from tendril.operators.matching import is_relevant, rank_order, top
from tendril.operators.quotes import best_local, best_web

LOCAL_SOURCES = ["catalog", "price_list", "registry"]


def _judged(items: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits (item_id, source, name, score, rank, cost, price) with their item's
    fields and whether each is relevant and not a distinctive mismatch."""
    spec = T.usable_spec(F.col("item_name"), F.col("specifications"))
    asked = items.select("item_id", F.col("name").alias("item_name"), "specifications")
    met = hits.join(asked, "item_id").withColumns({"choice": T.normalize_name("name"), "name_query": T.normalize_name("item_name"), "spec_query": T.normalize_name(spec)})
    met = met.withColumns({"of_name": name_match_score("name_query", "choice"), "of_spec": F.when(F.col("spec_query").isNotNull(), name_match_score(F.coalesce("spec_query", F.lit("")), F.col("choice")))})
    relevant = is_relevant(F.col("item_name"), F.col("specifications"), F.col("choice"), F.col("of_name"), F.col("of_spec"), F.col("score"))
    primary = T.normalize_name(T.primary_search_text(F.col("item_name"), F.col("specifications")))
    return met.withColumns({"relevant": relevant, "mismatch": T.distinctive_mismatch(F.col("name_query"), F.col("choice")), "query": primary})


def pick_best(items: DataFrame, hits: DataFrame) -> DataFrame:
    """The best relevant hit of each item and source (the first of eight by
    score, equality, containment, overlap and length), else its first hit."""
    judged = _judged(items, hits)
    good = F.col("relevant") & ~((F.col("source") == "catalog") & F.col("mismatch"))
    by = ["item_id", "source"]
    first = top(judged.withColumn("good", good), by, [F.desc("good"), F.col("rank")], 8, "_first")
    order = rank_order(F.col("query"), F.col("choice"), F.col("score"), F.col("name"))
    fallback = top(first.filter("NOT good"), by, [F.col("rank")], 1, "_one")
    best = top(first.filter("good"), by, [*order, F.col("rank")], 1, "_one")
    return best.unionByName(fallback.join(best.select(*by), by, "left_anti")).drop("_one", "_first")


def local_match(items: DataFrame, hits: DataFrame) -> DataFrame:
    """One row for each item that a local source answers: the best source's
    hit, a costed catalog hit of 95 going first; other names as alternatives."""
    best = pick_best(items, hits)
    costed = best_catalog(items, hits)
    both = best.select("item_id", "source", "name", "score", "cost", "price", "relevant", "mismatch", F.lit(1).alias("place"))
    both = both.unionByName(costed.select("item_id", F.lit("catalog").alias("source"), "name", "score", "cost", "price", "relevant", "mismatch", F.lit(0).alias("place")))
    chosen = top(both, ["item_id"], [F.col("place"), F.desc("score"), F.desc(F.length("name"))], 1, "_one")
    least = F.when(F.col("source").isin("catalog", "price_list"), T.LOCAL_THRESHOLD).otherwise(T.SIMILAR_THRESHOLD)
    chosen = chosen.filter(F.col("relevant") & ~F.col("mismatch") & (F.col("score") >= least))
    shelf = top(hits.filter("source = 'price_list'"), ["item_id"], [F.col("rank")], 1, "_one").filter(F.col("score") >= T.LOCAL_THRESHOLD)
    shelf = shelf.select("item_id", F.col("price").alias("shelf_price"))
    ranked = top(hits, ["item_id"], [F.desc("score"), F.desc(F.length("name")), F.col("source"), F.col("rank")], 4, "_nth")
    others = ranked.filter("_nth > 1").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("_nth", F.col("name").alias("other")))).alias("o"))
    base = F.coalesce(F.nullif("price", F.lit(0.0)), F.when(F.col("source") == "catalog", F.col("shelf_price")))
    out = chosen.join(shelf, "item_id", "left").join(others, "item_id", "left")
    return out.select(
        "item_id",
        F.when(F.col("score") >= T.EXACT_THRESHOLD, "exact").otherwise("similar").alias("status"),
        "source",
        F.col("name").alias("matched_name"),
        "score",
        F.col("cost").alias("unit_cost"),
        base.alias("unit_base_price"),
        F.filter(F.transform(F.coalesce("o", F.array().cast("array<struct<_nth:int,other:string>>")), lambda x: x["other"]), lambda x: x != F.col("name")).alias("alternatives"),
    )


def best_catalog(items: DataFrame, hits: DataFrame) -> DataFrame:
    """Of an item's first five catalog hits the costed one that ranks best by
    score, word overlap and length, if it reaches 95."""
    judged = _judged(items, hits.filter("source = 'catalog' AND rank <= 5 AND cost IS NOT NULL"))
    overlap, longer = T.token_overlap(F.col("name_query"), F.col("choice")), F.length("choice") / F.greatest(F.length("name_query"), F.lit(1))
    rank = F.col("score") + 8 * overlap + 3 * F.least(longer, F.lit(1.5))
    return top(judged, ["item_id"], [F.desc(rank), F.col("rank")], 1, "_one").filter((F.col("score") >= T.LOCAL_THRESHOLD) & ~F.col("mismatch")).drop("_one")


def merge_kits(results: DataFrame, components: DataFrame) -> DataFrame:
    """Kit sums into results: a cost only where there is none, a price always,
    and the cost as a price where neither gave one."""
    sums = components.groupBy("item_id").agg(F.round(F.sum(F.col("unit_cost").cast("decimal(18,4)")), 2).cast("double").alias("kit_cost"), F.round(F.sum(F.col("unit_price").cast("decimal(18,4)")), 2).cast("double").alias("kit_price"))
    out = results.join(sums, "item_id", "left")
    base = F.coalesce("kit_price", "unit_base_price", "kit_cost")
    return out.withColumns({"unit_base_price": base, "unit_cost": F.coalesce("unit_cost", "kit_cost")}).drop("kit_cost", "kit_price")


def apply_quotes(results: DataFrame, quotes: DataFrame) -> DataFrame:
    """Results without a price take the best local quote's, else the best web
    quote's; results that a web price made are from the web, and those with a
    usable link only are similar finds without a price.

    ``results``: item_id, name, status, source, score, matched_name, unit_cost,
    unit_base_price, internet.  ``quotes``: item_id, source, matched_name, url,
    match_score, price, cost, pos.
    """
    pick = lambda df, p: df.select("item_id", *[F.col(c).alias(f"{p}{c}") for c in ("source", "matched_name", "url", "match_score", "price", "cost")])
    local = pick(best_local(quotes.filter(F.col("match_score") >= T.LOCAL_THRESHOLD), ["item_id"]), "l_")
    web = pick(best_web(quotes, ["item_id"]), "w_")
    links = quotes.filter((F.col("source") == "web") & (F.coalesce("url", F.lit("")) != "") & ~Wb.is_listing(F.col("url"))).groupBy("item_id").agg(F.min_by("url", "pos").alias("link"))
    out = results.join(local, "item_id", "left").join(web, "item_id", "left").join(links, "item_id", "left")
    bare = F.col("unit_base_price").isNull()
    price = lambda p: F.coalesce(f"{p}cost", f"{p}price")
    by_local = bare & price("l_").isNotNull()
    by_web = bare & ~by_local & price("w_").isNotNull()
    only_link = bare & ~by_local & ~by_web & F.col("link").isNotNull() & ((F.col("status") == "not_found") | (F.col("source") == "none"))
    score = F.when(by_local, F.greatest("score", "l_match_score")).when(by_web, F.greatest("score", "w_match_score")).otherwise(F.col("score"))
    internet = F.col("internet") | by_web

    def either(a: Column, b: Column, c: Column) -> Column:
        return F.when(by_local, a).when(by_web, b).otherwise(c)

    graded = F.when(score >= T.EXACT_THRESHOLD, "exact").otherwise("similar")
    status = F.when(internet, graded).when(by_local & ((F.col("status") == "not_found") | (score < T.EXACT_THRESHOLD)), "similar").when(only_link, "similar").otherwise(F.col("status"))
    return out.select(
        "item_id",
        "name",
        status.alias("status"),
        F.when(internet | only_link, "web").otherwise(either(F.col("l_source"), F.lit("web"), F.col("source"))).alias("source"),
        score.alias("score"),
        F.coalesce(either(F.col("l_matched_name"), F.col("w_matched_name"), F.col("matched_name")), F.when(internet | only_link, F.col("name"))).alias("matched_name"),
        either(price("l_"), price("w_"), F.col("unit_cost")).alias("unit_cost"),
        F.coalesce(F.col("unit_base_price"), price("l_"), price("w_")).alias("unit_base_price"),
        internet.alias("internet"),
        F.when(internet, F.col("w_url")).when(only_link, F.col("link")).alias("url"),
    )


def photo_files(rows: DataFrame, files: DataFrame, by: list[str] = ()) -> DataFrame:
    """Each row's picture files ``0007.png, 0007_2.png, ...`` to the first gap;
    of one number's kinds the preferred.  ``files`` has a column file; ``by``
    names the folder, in which numbers are counted anew."""
    kinds = ["png", "jpg", "jpeg", "gif", "webp"]
    name = r"^(\d+)(?:_([2-9]))?\.(png|jpg|jpeg|gif|webp)$"
    key = [*by, "row_pos"]
    known = files.filter(F.lower("file").rlike(name)).select(
        *by,
        "file",
        F.regexp_extract(F.lower("file"), name, 1).cast("int").alias("row_pos"),
        F.coalesce(F.nullif(F.regexp_extract(F.lower("file"), name, 2), F.lit("")).cast("int"), F.lit(1)).alias("k"),
        F.array_position(F.array(*map(F.lit, kinds)), F.regexp_extract(F.lower("file"), name, 3)).alias("kind"),
    )
    known = top(known, [*key, "k"], [F.col("kind"), F.col("file")], 1, "_one")
    numbered = top(known, key, [F.col("k")], 9, "nth").filter("nth = k")
    lists = numbered.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "file"))), lambda x: x["file"]).alias("photo_files"))
    return rows.join(lists, key, "left").withColumn("photo_files", F.coalesce("photo_files", F.array().cast("array<string>")))
