"""What a free-text product question asks for, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that ask for a field, words around a name, triggers.
FIELD_ALIASES = {
    "cost": ["себестоимость", "себест", "закупочн", "закуп"],
    "price": ["продажная цена", "цена продажи", "отпускная цена"],
    "price_kp": ["цена кп", "цена продажи", "с наценкой", "наценк", "продажн", "кп"],
    "price_supplier": ["прайс", "цена поставщика", "цена прайса", "закупочная цена"],
    "quantity": ["количество", "остаток", "наличие", "сколько есть", "склад", "кол-во", "кол во"],
    "unit": ["единица", "ед. изм", "единицы", "едизм"],
    "code_supplier": ["поставщик"],
    "code": ["код", "артикул"],
}
DEFAULT_FIELDS = ["cost", "price", "price_supplier", "price_kp", "quantity", "unit"]
PRICE_FIELDS = ["cost", "price", "price_kp", "price_supplier"]
PRICE_ALIASES = ["цена", "стоимость", "сколько стоит", "прайс"]
PRICE_QUESTION = r"(?iuU)\b(?:цена|стоимость|сколько\s+стоит)\b"
NOISE = [
    r"сколько\s+стоит", r"какая\s+(?:цена|стоимость)", r"какой\s+(?:остаток|количество)", r"и\s+какой", r"есть\s+ли", r"найди(?:те)?", "найти", r"покажи(?:те)?",
    r"узнай(?:те)?", r"информация\s+о", r"данные\s+по", r"подскажи(?:те)?", r"что\s+с", r"дай(?:те)?", r"нужн(?:а|о|ы)?", "интересует", r"\?",
]
JOINING = r"(?iuU)\b(?:и|или|а также)\b"
TRIGGER = r"(?iuU)\b(?:сколько\s+стоит|какая\s+цена|какой\s+остаток|найди|найти|покажи|узнай|есть\s+ли|цена|стоимость|остаток|количество|себестоимость)\b|[|:]"
COMMAND = "/find"


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _words(aliases: list[str]) -> str:
    return r"\b(?:" + "|".join(a.replace(".", r"\.") for a in aliases) + r")\b"


def is_lookup(message: Column) -> Column:
    """A command, or any text that isn't one and holds a trigger."""
    x = _trim(F.coalesce(message, F.lit("")))
    return F.when((x == "") | x.startswith("/"), F.lower(x).startswith(COMMAND)).otherwise(x.rlike(TRIGGER))


def requested_fields(text: Column) -> Column:
    """The fields that are named, prices first where prices are asked for."""
    none = F.array().cast("array<string>")
    asked = [F.when(text.rlike(PRICE_QUESTION), F.array(*map(F.lit, PRICE_FIELDS))).otherwise(none)]
    for field, aliases in FIELD_ALIASES.items():
        asked.append(F.when(text.rlike("(?iuU)" + _words(aliases)), F.array(F.lit(field))).otherwise(none))
    return F.array_distinct(F.concat(*asked))


#: What goes from a name, in this order, in groups that are looked for at once.
_GONE = [*NOISE, *[_words([w]) for group in (*FIELD_ALIASES.values(), PRICE_ALIASES) for w in group], JOINING.removeprefix("(?iuU)")]
_GROUPS = [_GONE[k : k + 9] for k in range(0, len(_GONE), 9)]


def _without(text: Column, group: list[str]) -> Column:
    """Text with each of the patterns, one after another, as a space; left as
    it is where none of them is found."""
    there = text.rlike("(?iuU)" + "|".join(f"(?:{p})" for p in group))
    return F.when(there, reduce(lambda x, p: F.regexp_replace(x, "(?iuU)" + p, " "), group, text)).otherwise(text)


def _tidy(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, "[,;]+", " "), r"(?U)\s+", " ")
    return F.regexp_replace(bare, r"^[ .,-]+|[ .,-]+$", "")


def questions(df: DataFrame, message_col: str) -> DataFrame:
    """Adds ``is_lookup``, and ``name`` and ``fields`` of a question: null for
    a name under two characters.  The first ``|``, else the first ``:``, parts
    name and fields.  A name is the text without question words, field names,
    commas and conjunctions.

    Each step is a column over the last one's, so that no text is read twice for
    one pattern.
    """
    c = F.col
    rows = df.withColumn("_text", _trim(F.coalesce(message_col, F.lit(""))))
    rows = rows.withColumn("is_lookup", is_lookup(c("_text")))
    rows = rows.withColumn("_text", F.when(F.lower("_text").startswith(COMMAND), _trim(F.substr("_text", F.lit(len(COMMAND) + 1)))).otherwise(c("_text")))
    rows = rows.withColumn("_at", F.when(c("_text").contains("|"), F.locate("|", "_text")).otherwise(F.locate(":", "_text")))
    rows = rows.withColumns({"_name": F.when(c("_at") > 0, _trim(F.substr("_text", F.lit(1), c("_at") - 1))).otherwise(c("_text")), "_asked": F.when(c("_at") > 0, F.nullif(_trim(F.substr("_text", c("_at") + 1)), F.lit("")))})
    rows = rows.withColumn("_asked", F.coalesce("_asked", "_text")).withColumn("_fields", requested_fields(c("_asked")))
    for group in _GROUPS:
        rows = rows.withColumn("_name", _without(c("_name"), group))
    rows = rows.withColumn("_name", _tidy(c("_name")))
    told = F.length("_name") >= 2
    fields = F.when(F.size("_fields") > 0, c("_fields")).otherwise(F.array(*map(F.lit, DEFAULT_FIELDS)))
    return rows.withColumns({"name": F.when(told, c("_name")), "fields": F.when(told, fields)}).drop("_text", "_at", "_name", "_asked", "_fields")


def product_name(text: Column) -> Column:
    """The text without question words, field names, commas and conjunctions."""
    return _tidy(reduce(lambda x, p: F.regexp_replace(x, "(?iuU)" + p, " "), _GONE, text))


def parse(message: Column) -> Column:
    """struct(name, fields) of a question; null for a name under two
    characters.  The first ``|``, else the first ``:``, parts name and fields."""
    raw = _trim(F.coalesce(message, F.lit("")))
    raw = F.when(F.lower(raw).startswith(COMMAND), _trim(F.substr(raw, F.lit(len(COMMAND) + 1)))).otherwise(raw)
    at = F.when(raw.contains("|"), F.locate("|", raw)).otherwise(F.locate(":", raw))
    left = F.when(at > 0, F.substr(raw, F.lit(1), at - 1)).otherwise(raw)
    right = F.when(at > 0, _trim(F.substr(raw, at + 1))).otherwise("")
    fields = requested_fields(F.when(right != "", right).otherwise(raw))
    fields = F.when(F.size(fields) > 0, fields).otherwise(F.array(*map(F.lit, DEFAULT_FIELDS)))
    name = product_name(_trim(left))
    return F.when(F.length(name) >= 2, F.struct(name.alias("name"), fields.alias("fields")))


# A url's form, and paths that show no product.
URL = r"https?://[^\s<>\"']+"
BARE_URL = r"(?U)^[\w.-]+\.\w{2,}(/|\?|$)"
HOME_PATHS = ["catalog", "search", "shop", "market", "products"]


def normalize_url(value: Column) -> Column:
    """A whole url, with a scheme where a bare host has none; null else."""
    x = _trim(F.coalesce(value, F.lit("")))
    return F.when(x.startswith("http://") | x.startswith("https://"), x).when(x.startswith("www.") | x.rlike(BARE_URL), F.concat(F.lit("https://"), x))


def extract_url(value: Column) -> Column:
    """The first url in a text without closing marks, else the text as one."""
    found = F.regexp_replace(F.regexp_extract(F.coalesce(value, F.lit("")), URL, 0), r"[.,);\]]+$", "")
    return F.coalesce(F.nullif(found, F.lit("")), normalize_url(value))


def shows_product(url: Column) -> Column:
    """Whether a url leads beyond a shop's home pages."""
    tail = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(F.regexp_extract(tail, r"^[^?#]*", 0), "^/+|/+$", "")
    return tail.rlike(r"\?[^#]|#.") | ((path != "") & ~F.lower(path).isin(*HOME_PATHS))


def source_label(text: Column) -> Column:
    """A price source's words without its urls."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), URL, ""), r"(?U)\s+", " ")
    return F.coalesce(F.nullif(F.regexp_replace(bare, "^[ ,.—-]+|[ ,.—-]+$", ""), F.lit("")), F.lit("Источник из базы"))
