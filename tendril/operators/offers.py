"""Offers from search pages that a provider has fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendril.functions import web as Wb
from tendril.functions.similarity import name_match_score
from tendril.functions.text import normalize_name
from tendril.operators.quotes import first_by_url

# A search page's link and snippet, and how many pages are read.
LINK = r'(?is)class="result__a"[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
SNIPPET = r'(?is)class="result__snippet"[^>]*>(.*?)</(?:a|td|div)'
PAGES, RESULTS = 2, 3


def search_results(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, pos, url, title, snippet: links and snippets paired by place; a
    link without a snippet has an empty one."""
    both = pages.select(*keys, F.regexp_extract_all(html, F.lit(LINK), 1).alias("u"), F.regexp_extract_all(html, F.lit(LINK), 2).alias("t"), F.regexp_extract_all(html, F.lit(SNIPPET), 1).alias("s"))
    rows = both.select(*keys, F.posexplode(F.arrays_zip("u", "t", "s")).alias("pos", "r")).filter("r.u IS NOT NULL")
    return rows.select(*keys, "pos", Wb.unwrap_redirect(Wb.unescape(F.col("r.u"))).alias("url"), Wb.strip_html(F.col("r.t")).alias("title"), Wb.strip_html(F.coalesce("r.s", F.lit(""))).alias("snippet"))


def offers(results: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    """At most RESULTS offers of each query, in result order, to the first
    priced one that isn't a marketplace's.  ``results`` has query, pos, url,
    title, snippet; ``fetched`` has url and text of pages that were read, of
    which the first PAGES of a query count."""
    score = name_match_score(normalize_name("query"), Wb.clean_title(F.col("title")))
    good = results.filter(~Wb.is_blocked(F.col("url")) & ~Wb.is_listing(F.col("url"))).withColumn("score", score)
    good = good.filter(Wb.exact_title(F.col("query"), F.col("title"), F.col("snippet"), F.col("score")))
    good = first_by_url(good, keys)
    by = Window.partitionBy(*keys).orderBy("pos")
    good = good.withColumn("nth", F.row_number().over(by))
    page = fetched.select("url", Wb.upper_median(Wb.prices(F.col("text"))).alias("page_price"))
    inline = Wb.upper_median(Wb.prices(F.concat_ws(" ", "title", "snippet")))
    priced = good.join(page, "url", "left").withColumn("price", F.coalesce(inline, F.when(F.col("nth") <= PAGES, F.col("page_price"))))
    stop = F.sum((F.col("price").isNotNull() & ~Wb.is_marketplace(F.col("url"))).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    kept = priced.withColumn("_stop", F.coalesce(stop, F.lit(0))).filter((F.col("_stop") == 0) & (F.col("nth") <= RESULTS))
    return kept.select(*keys, "pos", "url", "title", Wb.platform_label(F.col("url")).alias("platform"), "price")
