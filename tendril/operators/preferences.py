"""Preferences of conversations: every turn's patch folded in order.

A patch adds and removes values and sets flags.  Whether a value is preferred in
the end depends on two moments only: its last removal, and its first addition
after that.  Both are aggregates that merge in any order, so the turns of a
conversation never have to be in one place in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTS = {"excluded_platforms": False, "disabled_sources": True}
FLAGS = ["search_kit_component_links", "force_kit_component_pricing"]

# What a refinement names, its labels and replies.
REFINED = [("ozon", "Ozon"), ("wildberries", "Wildberries"), ("яндекс", "Яндекс.Маркет"), ("маркет", "Яндекс.Маркет"), ("авито", "Авито")]
DROPPED = ["не использ", "исключ", "убери"]
BY_PARTS = ["составляющ", "по составу"]
WITHOUT = ["не использ", "отключ"]
REPLY = "Применены базовые правила (AI недоступен)."
REPLY_PARTS = "Пересчитываю комплекты по составляющим."
REPLY_MARKUP = "Наценка изменена на {}%."
REPLY_ITEMS = "Пересчитываю позиции: {}."


def _any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def refinement(message: Column) -> dict[str, Column]:
    """The patch that a message asks for by plain rules."""
    x = F.lower(F.coalesce(message, F.lit("")))
    platforms = F.array_compact(F.array(*[F.when(x.contains(part) & _any(x, DROPPED), label) for part, label in REFINED]))
    parts, links = _any(x, BY_PARTS), x.contains("ссылк") & x.contains("состав")
    offline = x.contains("интернет") & _any(x, WITHOUT)
    markup = F.replace(F.nullif(F.regexp_extract(x, r"(?U)наценк\w*\s*(\d+(?:[.,]\d+)?)\s*%?", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    numbers = F.transform(F.regexp_extract_all(x, F.lit(r"(?U)(?:позици\w*|№|#)\s*(\d+)"), 1), lambda n: n.cast("int"))
    said = lambda text, value: F.concat(F.lit(text.split("{}")[0]), value, F.lit(text.split("{}")[1]))
    reply = F.when(F.size(numbers) > 0, said(REPLY_ITEMS, F.array_join(numbers.cast("array<string>"), ", "))).when(markup.isNotNull(), said(REPLY_MARKUP, markup.cast("string"))).when(parts, REPLY_PARTS)
    none = F.array().cast("array<string>")
    return {
        "reply": F.coalesce(reply, F.lit(REPLY)),
        "excluded_platforms_add": platforms,
        "excluded_platforms_remove": none,
        "disabled_sources_add": F.when(offline, F.array(F.lit("web"))).otherwise(none),
        "disabled_sources_remove": none,
        "search_kit_component_links": F.when(links, True),
        "force_kit_component_pricing": F.when(parts, True),
        "markup_percent": markup,
        "reprocess_items": numbers,
        "reprocess_all": (F.size(platforms) > 0) | parts | links | offline | (x.contains("пересчит") & x.contains("все")),
    }


def _list_events(patches: DataFrame, by: list[str], order: str, name: str, lower: bool) -> DataFrame:
    """(by, at, removes, value, low) of one list's additions and removals; the
    removals of a patch come after its additions."""
    def side(column: str, removes: bool) -> DataFrame:
        out = patches.select(*by, F.col(order).alias("_turn"), F.posexplode(column).alias("_k", "_v"))
        value = F.lower("_v") if lower else F.col("_v")
        return out.select(*by, F.struct(F.col("_turn"), F.lit(removes), F.col("_k")).alias("at"), F.lit(removes).alias("removes"), value.alias("value"), F.lower("_v").alias("low"))

    return side(f"{name}_add", False).unionByName(side(f"{name}_remove", True)).filter("value <> '' OR removes")


def _list_state(patches: DataFrame, by: list[str], order: str, name: str, lower: bool) -> DataFrame:
    events = _list_events(patches, by, order, name, lower)
    gone = events.filter("removes").groupBy(*by, "low").agg(F.max("at").alias("last"))
    added = events.filter("NOT removes").join(gone, [*by, "low"], "left").filter("last IS NULL OR at > last")
    first = added.groupBy(*by, "value").agg(F.min("at").alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "value")))
    return first.groupBy(*by).agg(F.transform(ordered, lambda e: e["value"]).alias(name))


def fold(patches: DataFrame, by: list[str], order: str = "turn") -> DataFrame:
    """One row a conversation: the preferences after its last patch.

    ``patches`` has the keys, the order (a turn's number), the ``_add`` and
    ``_remove`` arrays of both lists, both flags (null: as before),
    markup_percent and save_rule.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    out = patches.groupBy(*by).agg(*[F.coalesce(last(c), F.lit(False)).alias(c) for c in FLAGS], last("markup_percent"))
    rules = patches.select(*by, order, F.regexp_replace("save_rule", r"(?U)^\s+|\s+$", "").alias("rule")).filter("rule <> ''")
    rules = rules.groupBy(*by, "rule").agg(F.min(order).alias("at")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "rule"))), lambda e: e["rule"]).alias("rules"))
    lists = {name: _list_state(patches, by, order, name, lower) for name, lower in LISTS.items()} | {"rules": rules}
    for name, state in lists.items():
        out = out.join(state, by, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out
