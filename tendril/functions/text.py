"""Column builders for names, specifications and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, marker pairs and patterns that results depend on.
GENERIC_WORDS = """
предназначена предназначен предназначено предназначены изготовлена изготовлен изготовлено изготовлены
комплект набор модель система прибор приборы соответствие требованиям требование
наличие наличии имеет иметь более менее размер размеры длина диаметр штука штук шт
включает следующие следующий состоит входит перечень
""".split()
CATEGORY_CONFLICTS = [
    ("аудио", "dvd"), ("аудиосистем", "dvd"), ("аудиосистем", "астроном"), ("микрофон", "dvd"), ("микрофон", "астроном"),
    ("partybox", "dvd"), ("partybox", "астроном"), ("jbl", "dvd"), ("jbl", "астроном"), ("behringer", "dvd"), ("behringer", "астроном"),
    ("планетар", "dvd"), ("планетар", "микрофон"), ("гипсов", "dvd"), ("гипсов", "провод"), ("гипсов", "калориметр"),
    ("геометрич", "калориметр"), ("геометрич", "калориметрич"), ("мольберт", "dvd"), ("термометр", "dvd"),
]
DISTINCTIVE_MARKERS = ["голов", "натюрморт", "натюрмор", "растен", "гипсов", "геометрич", "фрукт", "овощ", "гриб", "портрет", "художник", "муляж"]
SUPPLIER_PATTERN = r"(?iuU)\b(ооо|оао|зао|пао|ип|ао|нпо|тд|чп)\b|[«\"]"
COMPLIANCE_SUFFIX = r"(?iuU)\s*[–—-]\s*соответствие\s*$"
CODE_PREFIX = r"(?U)^\d+(?:\.\d+)+\.(?!\d)\s*"  # of 10.0.0.1 nothing is a code
KIT_HEADER = r"(?iuU)(?:включает|в\s+состав\s+вход|состоит\s+из|комплектация)\s*(?:следующ|перечень)?"
EXACT_THRESHOLD, LOCAL_THRESHOLD, SIMILAR_THRESHOLD, WEB_THRESHOLD = 90.0, 95.0, 70.0, 100.0


def strip(x: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_name(x: Column) -> Column:
    """Lower case, one space between words, then no quote marks (which may
    leave two spaces where a mark stood alone)."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(x)), r"(?U)\s+", " "), "[«»\"']", "")


def tokens(x: Column) -> Column:
    """The non-empty space-separated words."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def looks_like_supplier(name: Column) -> Column:
    return name.rlike(SUPPLIER_PATTERN)


def catalog_row_kind(name: Column, cost: Column, price: Column) -> Column:
    low = F.lower(name)
    kit = low.contains("комплект")
    return (
        F.when(low.contains("составляющие"), "components_header")
        .when(cost.isNull() & price.isNull(), "section")
        .when(kit & price.isNotNull() & cost.isNull(), "kit_total")
        .when(kit & cost.isNotNull(), "sub_kit")
        .otherwise("item")
    )


def optional_number(x: Column) -> Column:
    """Text with a decimal comma or point as a double, else null."""
    return F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("double")


def cell_text(x: Column) -> Column:
    """A numeric cell as text, whole numbers without decimals."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def primary_spec_line(specs: Column) -> Column:
    """The first line without its code and compliance mark; empty for none."""
    first = F.substring_index(F.regexp_replace(F.coalesce(specs, F.lit("")), "\r\n|\r", "\n"), "\n", 1)
    line = strip(F.regexp_replace(strip(first), COMPLIANCE_SUFFIX, ""))
    blank = strip(F.coalesce(specs, F.lit(""))) == ""
    return F.when(blank, "").otherwise(strip(F.regexp_replace(line, CODE_PREFIX, "")))


def is_kit_header(line: Column) -> Column:
    return (line != "") & (F.lower(line).rlike(KIT_HEADER) | F.regexp_replace(line, r"(?U)\s+$", "").endswith(":"))


def usable_spec(name: Column, specs: Column) -> Column:
    """The spec line if it can be searched by, else null."""
    line = primary_spec_line(specs)
    return F.when((line != "") & ~is_kit_header(line) & (normalize_name(line) != normalize_name(strip(name))), line)


def search_queries(name: Column, specs: Column) -> Column:
    """Distinct normalised queries in order: name, spec line, both."""
    line, plain = usable_spec(name, specs), strip(name)
    wanted = F.array(plain, line, F.when(line.isNotNull(), F.concat(plain, F.lit(" "), line)))
    return F.array_distinct(F.filter(F.transform(F.array_compact(wanted), normalize_name), lambda q: q != ""))


def primary_search_text(name: Column, specs: Column) -> Column:
    return F.coalesce(usable_spec(name, specs), strip(name))


def required_tokens(name: Column, specs: Column) -> Column:
    """At most eight telling words of the spec line that the name lacks."""
    line = primary_spec_line(specs)
    found = F.transform(F.regexp_extract_all(line, F.lit("([A-Za-zА-Яа-яЁё0-9]+)"), 1), normalize_name)
    found = F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(GENERIC_WORDS))
    found = F.array_distinct(F.array_except(found, tokens(normalize_name(name))))
    telling = F.filter(found, lambda t: t.rlike(r"\d") | (F.length(t) >= 5))
    return F.when((line == "") | is_kit_header(line), F.array().cast("array<string>")).otherwise(F.slice(telling, 1, 8))


def required_present(required: Column, choice: Column) -> Column:
    """Enough of the required words in the candidate; true for none required."""
    hits = F.size(F.filter(required, lambda t: choice.contains(t)))
    n = F.size(required)
    return F.when(n == 0, True).when(n <= 2, hits >= 1).otherwise(hits >= F.greatest(F.lit(2), F.floor(n / 2)))


def category_conflict(name: Column, specs: Column, choice: Column) -> Column:
    """The query names one category and the candidate an excluded one."""
    asked = normalize_name(F.concat(name, F.lit(" "), primary_spec_line(specs)))
    out = F.lit(False)
    for query, other in CATEGORY_CONFLICTS:
        out = out | (asked.contains(query) & choice.contains(other))
    return out


def distinctive_mismatch(query: Column, choice: Column) -> Column:
    """A marker in the query that the candidate lacks (both normalised)."""
    out = F.lit(False)
    for marker in DISTINCTIVE_MARKERS:
        out = out | (query.contains(marker) & ~choice.contains(marker))
    return out


def token_overlap(query: Column, choice: Column) -> Column:
    """Share of the query's distinct words that the candidate has."""
    asked = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(asked, tokens(choice))) / F.greatest(F.size(asked), F.lit(1))


def adjust_score(query: Column, choice: Column, base: Column) -> Column:
    """Equality is 100, containment 95 at least, with a bonus for length."""
    inside = choice.contains(query)
    bonus = F.when(inside, F.least(F.length(choice) - F.length(query), F.lit(20)) * 0.3).otherwise(0.0)
    held = F.when(inside | query.contains(choice), F.greatest(base, F.lit(95.0))).otherwise(base)
    return F.when(query == choice, 100.0).otherwise(F.least(held + bonus, F.lit(100.0)))


def money_text(x: Column) -> Column:
    return F.concat(F.translate(F.format_number(x, 2), ",", " "), F.lit(" ₽"))


def quantity_text(x: Column) -> Column:
    return F.when(x.isNull(), "—").when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def spec_preview(x: Column, most: int = 2000) -> Column:
    flat = strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def slug(x: Column) -> Column:
    """An id of letters, digits and underscores, at most 40 long."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(plain, 1, 40), "_+$", ""), F.lit("")), F.lit("price"))
