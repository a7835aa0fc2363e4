"""What a chat message asks for, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trigger phrases.
LOCAL = ["найди", "найти", "ищи", "искать", "поиск", "обработай", "подбери", "сопостав", "рассчитай себест", "начни поиск", "запусти поиск", "ищи в каталог", "ищи в прайс"]
WEB = ["конкурент", "интернет", "маркетплейс", "ozon", "wildberries", "яндекс", "рынок", "задача 2", "задача 1+2", "1+2", "1 и 2"]
EXCEL = ["сформируй excel", "сформируй кп", "выгрузи excel", "скачать excel", "готовый файл"]
RULE = ["запомни как правило", "запомни правило", "сохрани правило"]
PLATFORMS = [("ozon", "Ozon"), ("wildberries", "Wildberries"), ("яндекс", "Яндекс.Маркет"), ("маркет", "Яндекс.Маркет")]


def _any(x: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | x.contains(part)
    return out


def detect(message: Column, has_items: Column, searched: Column) -> dict[str, Column]:
    """Name -> Column for every flag of the intent record."""
    raw = F.coalesce(message, F.lit(""))
    x = F.lower(F.trim(raw))
    both = x.contains("задача 1+2") | x.contains("задача 1 и 2") | x.contains("1+2")
    first = x.rlike(r"(?U)задач\w*\s*1\b") & ~x.contains("2")
    only = x.contains("только поиск") | x.contains("задача 1")
    local, web = _any(x, LOCAL), _any(x, WEB)
    mode = F.when(both, "task1_task2").when(first | only, "task1")
    wide = (both | web) & has_items & (local | web)
    numbers = F.transform(F.regexp_extract_all(x, F.lit(r"(?U)(?:позици\w*|№|#)\s*(\d+)"), 1), lambda n: n.cast("int"))
    again = (F.size(numbers) > 0) & (x.contains("пересчит") | x.contains("найди") | x.contains("ищи"))
    every = x.contains("пересчит") & x.contains("все")
    run_local = has_items & (only | wide | local | again | every)
    dropped = x.contains("не использ") | x.contains("исключ") | x.contains("убери")
    without = x.contains("интернет") & (x.contains("не использ") | x.contains("отключ") | x.contains("без"))
    return {
        "task_mode": F.when(wide, "task1_task2").otherwise(mode),
        "run_local_search": run_local,
        "run_web_search": wide,
        "generate_excel": _any(x, EXCEL) & searched,
        "save_rule": F.when(_any(x, RULE), F.when(raw.contains(":"), F.trim(F.substr(raw, F.locate(":", raw) + 1))).otherwise(raw)),
        "markup_percent": F.replace(F.nullif(F.regexp_extract(x, r"(?U)наценк\w*\s*(\d+(?:[.,]\d+)?)\s*%?", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"),
        "reprocess_items": F.when(again, numbers).otherwise(F.array().cast("array<int>")),
        "reprocess_all": every,
        "force_kit_component_pricing": x.contains("составляющ") | x.contains("по составу"),
        "disabled_sources_add": F.when(without, F.array(F.lit("web"))).otherwise(F.array().cast("array<string>")),
        "excluded_platforms_add": F.array_compact(F.array(*[F.when(x.contains(p) & dropped, label) for p, label in PLATFORMS])),
    }
