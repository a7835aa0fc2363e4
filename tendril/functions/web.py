"""Column builders for urls, page titles and prices on web pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tendril.functions.text import WEB_THRESHOLD, normalize_name, tokens

# Host and url fragments, title affixes, price patterns.
MARKETPLACES = ["ozon.ru", "wildberries.ru", "market.yandex.ru"]
LISTING_MARKERS = ["/search?", "/search/", "search?text=", "search.aspx?search=", "catalog/0/search", "?q="]
BLOCKED = ["youtube.com", "youtu.be", "wikipedia.org", "vk.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "tiktok.com", "pinterest.com", "duckduckgo.com", "google.com", "yandex.ru/search", "ya.ru/search"]
TITLE_PREFIXES = ["купить ", "заказать ", "цена ", "цены ", "интернет-магазин ", "магазин "]
TITLE_SUFFIXES = [" - купить", " купить в", " купить по", " цена", " цены", " в москве", " в спб", " в магазине", " в интернет-магазине", " официальный сайт", " интернет-магазин"]
TITLE_TAILS = ["", "купить", "цена", "цены", "в магазине", "в интернет-магазине", "официальный сайт", "интернет-магазин", "от производителя", "с доставкой"]
AMOUNT = r"(\d{1,3}(?:\s\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
PRICE_PATTERNS = [
    r'(?i)(?:"price"|"lowPrice"|"highPrice")\s*:\s*"?(\d[\d\s]{0,9})"?',
    r"(?i)data-price=[\"'](\d[\d\s]{0,9})[\"']",
    rf"(?iuU){AMOUNT}\s*(?:₽|руб\.?|rub)(?:\s|$|[^\w])",
    r"(?i)price[\"']?\s*[:=]\s*[\"']?(\d[\d\s]{0,9})",
]
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
PLATFORM_LABELS = {"ozon": "Ozon", "wildberries": "Wildberries", "market.yandex": "Яндекс.Маркет"}


def _any(x: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | x.contains(part)
    return F.coalesce(out, F.lit(False))


def is_marketplace(url: Column) -> Column:
    return _any(F.lower(url), MARKETPLACES)


def is_listing(url: Column) -> Column:
    return _any(F.lower(url), LISTING_MARKERS)


def is_product_page(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    card = low.contains("ozon.ru/product/") | low.contains("market.yandex.ru/product/") | low.rlike(r"wildberries\.ru/catalog/\d+/detail\.aspx")
    return ~is_listing(url) & (card | (~is_marketplace(url) & low.rlike("^https?://")))


def is_blocked(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return ~low.rlike("^https?://") | _any(low, BLOCKED)


def acceptable_quote(source: Column, url: Column, score: Column, price: Column) -> Column:
    """Whether a quote may set a price; local quotes always may."""
    link = F.coalesce(url, F.lit(""))
    good = (F.coalesce(score, F.lit(0.0)) >= WEB_THRESHOLD) & price.isNotNull()
    page = (link == "") | (~is_listing(link) & (~is_marketplace(link) | is_product_page(link)))
    return (source != "web") | (good & page)


def quote_tier(url: Column, score: Column, price: Column) -> Column:
    """0 shop, 1 marketplace card, 2 other marketplace page, 9 not usable."""
    bad = is_listing(url) | price.isNull() | (F.coalesce(score, F.lit(0.0)) < WEB_THRESHOLD)
    return F.when(bad, 9).when(~is_marketplace(url), 0).when(is_product_page(url), 1).otherwise(2)


def quote_order(url: Column, score: Column, price: Column) -> list[Column]:
    """Sort keys of web quotes, best first."""
    return [quote_tier(url, score, price), F.when(is_product_page(url), 0).otherwise(1), -F.coalesce(score, F.lit(0.0)), F.when(price.isNull(), 1).otherwise(0)]


def host_of(url: Column) -> Column:
    return F.replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("www."), F.lit(""))


def platform_label(url: Column) -> Column:
    host = host_of(url)
    out = F.when(host == "", "Интернет").otherwise(F.initcap(F.substring_index(host, ".", 1)))
    for part, label in reversed(PLATFORM_LABELS.items()):
        out = F.when(host.contains(part), label).otherwise(out)
    return out


def unwrap_redirect(url: Column) -> Column:
    target = F.try_url_decode(F.try_url_decode(F.regexp_extract(url, r"[?&]uddg=([^&#]*)", 1)))
    return F.when(url.contains("uddg=") & (F.coalesce(target, F.lit("")) != ""), target).otherwise(F.coalesce(url, F.lit("")))


def marketplace_search(platform: str, query: Column) -> Column:
    """A marketplace's search address for a query."""
    base = {"Ozon": "https://www.ozon.ru/search/?text=", "Wildberries": "https://www.wildberries.ru/catalog/0/search.aspx?search=", "Яндекс.Маркет": "https://market.yandex.ru/search?text="}[platform]
    return F.concat(F.lit(base), F.url_encode(query))


def _numbered(mark: str, base: int) -> Callable[[Column, Column], Column]:
    """Puts the character of a number in the place of its entity."""

    def put(text: Column, digits: Column) -> Column:
        number = F.conv(digits, base, 10).cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        known = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.when(known, F.replace(text, F.concat(F.lit(mark), digits, F.lit(";")), char)).otherwise(text)

    return put


def unescape(x: Column) -> Column:
    """The common named entities, and characters by their numbers."""
    for mark, digits, base in (("&#", "[0-9]{1,7}", 10), ("&#x", "[0-9a-fA-F]{1,6}", 16), ("&#X", "[0-9a-fA-F]{1,6}", 16)):
        x = F.aggregate(F.array_distinct(F.regexp_extract_all(x, F.lit(f"{mark}({digits});"), 1)), x, _numbered(mark, base))
    for entity, char in ENTITIES.items():
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def strip_html(x: Column) -> Column:
    plain = unescape(F.regexp_replace(x, "<[^>]+>", " "))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def page_title(html: Column) -> Column:
    """og:title, else the title element, else empty."""
    og = F.regexp_extract(html, r"(?is)<meta[^>]+(?:property|name)=[\"']og:title[\"'][^>]+content=[\"']([^\"']+)[\"']", 1)
    plain = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return strip_html(F.coalesce(F.nullif(og, F.lit("")), plain, F.lit("")))


def clean_title(title: Column) -> Column:
    """A title without shop words and its last ``-`` or ``|`` part."""
    x = normalize_name(strip_html(title))
    cut = lambda t, p: F.trim(F.substr(t, F.length(p) + 1))
    x = F.aggregate(F.array(*map(F.lit, TITLE_PREFIXES)), x, lambda t, p: F.when(t.startswith(p), cut(t, p)).otherwise(t))
    end = lambda t, p: F.trim(F.substr(t, F.lit(1), F.length(t) - F.length(p)))
    x = F.aggregate(F.array(*map(F.lit, TITLE_SUFFIXES)), x, lambda t, p: F.when(t.endswith(p), end(t, p)).otherwise(t))
    return F.trim(F.regexp_replace(x, r"\s*[-|]\s*[^-|]+$", ""))


def exact_title(query: Column, title: Column, snippet: Column, score: Column) -> Column:
    """Whether a result's title (or snippet) is about exactly this query."""
    q, t = normalize_name(query), clean_title(title)
    raw, side = normalize_name(strip_html(title)), normalize_name(strip_html(F.coalesce(snippet, F.lit(""))))
    words = tokens(q)
    same = F.array_sort(F.array_distinct(words)) == F.array_sort(F.array_distinct(tokens(t)))
    tail = F.regexp_replace(F.substr(t, F.length(q) + 1), r"^[ \-|:]+|[ \-|:]+$", "")
    every = (F.size(words) > 1) & (F.size(F.array_except(words, tokens(raw))) == 0)
    told = (t != "") & (same | (t.startswith(q) & tail.isin(TITLE_TAILS)) | every | (score >= WEB_THRESHOLD))
    return (q != "") & (raw.contains(q) | side.contains(q) | told)


def parse_price(raw: Column) -> Column:
    """10 to 50,000,000, else null."""
    x = F.regexp_replace(F.replace(raw, F.lit(" "), F.lit(" ")), r"(?U)\s+", "")
    x = F.when(x.contains(",") & x.contains("."), F.replace(x, F.lit(","), F.lit(""))).otherwise(F.replace(x, F.lit(","), F.lit(".")))
    value = x.try_cast("double")
    return F.when(value.between(10, 50_000_000), F.round(value, 2))


def prices(text: Column) -> Column:
    """All prices that the patterns find, repeats included."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in PRICE_PATTERNS])
    return F.array_compact(F.transform(found, parse_price))


def upper_median(values: Column) -> Column:
    """The middle value, the upper one of two."""
    return F.try_element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)
