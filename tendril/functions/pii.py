"""Masking of personal data before text leaves the cluster."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories and patterns, applied in this order.
PATTERNS = [
    ("URL", r"(?i)https?://[^\s<>\"']+|www\.[^\s<>\"']+"),
    ("EMAIL", r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"),
    ("SNILS", r"\b\d{3}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{2}\b"),
    ("INN", r"(?i)\b(?:ИНН|INN)[\s:]*\d{10}(?:\d{2})?\b"),
    ("KPP", r"(?i)\b(?:КПП|KPP)[\s:]*\d{9}\b"),
    ("OGRN", r"(?i)\b(?:ОГРН|OGRN)[\s:]*\d{13}(?:\d{2})?\b"),
    ("PASSPORT", r"\b\d{4}\s+\d{6}\b"),
    ("PHONE", r"(?:\+7|8|7)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b|\b\d{3}[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b"),
    ("CARD", r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"),
    ("BANK_ACCOUNT", r"\b\d{20}\b"),
    ("BIK", r"(?i)\b(?:БИК|BIK)[\s:]*\d{9}\b"),
    ("USERNAME", r"@[A-Za-z0-9_]{4,32}\b"),
    ("IP", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
    ("ADDRESS", r"(?i)(?:г\.|город|ул\.|улица|пр\.|проспект|пер\.|переулок|ш\.|шоссе|д\.|дом|кв\.|квартира|стр\.|строение|обл\.|область|м\.р-н|район)[^\n,.;]{0,80}"),
    ("FIO", r"\b[А-ЯЁ][а-яё]{2,}\s+[А-ЯЁ][а-яё]{2,}\s+[А-ЯЁ][а-яё]+(?:ович|евич|овна|евна|ична|инич)\b"),
]
SENSITIVE_KEYS = ["link", "url", "email", "phone", "fio", "contact", "address", "passport", "snils"]
#: Categories whose patterns are of ASCII only.
PLAIN = ["URL", "EMAIL", "SNILS", "PASSPORT", "PHONE", "CARD", "BANK_ACCOUNT", "USERNAME", "IP"]


def mask(text: Column, categories: list[str] | None = None, unicode: bool = True) -> Column:
    """Text with each find replaced by its category in brackets."""
    for name, pattern in PATTERNS:
        if categories is None or name in categories:
            text = F.regexp_replace(text, ("(?uU)" if unicode else "") + pattern, f"[{name}]")
    return text


def counts(text: Column, categories: list[str], unicode: bool = True) -> dict[str, Column]:
    """How many finds each category has, earlier categories masked first."""
    out = {}
    for name, pattern in PATTERNS:
        if name in categories:
            out[name] = F.regexp_count(text, F.lit(("(?uU)" if unicode else "") + pattern))
            text = F.regexp_replace(text, ("(?uU)" if unicode else "") + pattern, f"[{name}]")
    return out


#: What a text must hold for a category to be looked for.
NEEDS = {"EMAIL": "@", "USERNAME": "@", "URL": "."}


#: Stands for a find while finds are counted; a text that holds it is read twice.
MARK = "\ue000"


def counted(df: DataFrame, text_col: str, categories: list[str], unicode: bool = True, masked: str | None = None) -> DataFrame:
    """``df`` with the number of finds of each category in a column of its name
    in lower case, earlier categories masked first, and the masked text in the
    column ``masked``, if one is named.

    Each category is one column over the text that the last one left, so the
    work grows with the categories and not with their square.  A pattern is
    searched once: finds become marks, which are counted and named.
    """
    rows = df.withColumn("_masked", F.coalesce(F.col(text_col), F.lit("")))
    for name, pattern in PATTERNS:
        if name not in categories:
            continue
        full = ("(?uU)" if unicode else "") + pattern
        there = F.col("_masked").contains(NEEDS[name]) if name in NEEDS else F.lit(True)
        mark, n = F.lit(MARK), F.col(name.lower())
        rows = rows.withColumn("_marked", F.when(there & ~F.col("_masked").contains(MARK), F.regexp_replace("_masked", full, MARK)))
        marks = F.length("_marked") - F.length(F.replace("_marked", mark, F.lit("")))
        rows = rows.withColumn(name.lower(), F.when(F.col("_marked").isNotNull(), marks).when(there, F.regexp_count("_masked", F.lit(full))).otherwise(0).cast("long"))
        named = F.coalesce(F.replace("_marked", mark, F.lit(f"[{name}]")), F.regexp_replace("_masked", full, f"[{name}]"))
        rows = rows.withColumn("_masked", F.when(n > 0, named).otherwise(F.col("_masked")))
    if masked:
        rows = rows.withColumn(masked, F.when(F.col(text_col).isNotNull(), F.col("_masked")))
    return rows.drop("_masked", "_marked")


def numbered(text: str, org_terms: list[str] = ()) -> tuple[str, list[tuple[str, str]]]:
    """One text with numbered tokens, equal values sharing one, and the pairs
    of token and value in the order in which they were made."""
    made: dict[tuple[str, str], str] = {}
    counts: dict[str, int] = {}

    def token(kind: str, value: str) -> str:
        value = value.strip()
        if (kind, value) not in made:
            counts[kind] = counts.get(kind, 0) + 1
            made[kind, value] = f"[{kind}_{counts[kind]}]"
        return made[kind, value]

    for kind, pattern in PATTERNS:
        text = re.sub(pattern, lambda m, kind=kind: token(kind, m[0]), text)
    for term in sorted({t.strip() for t in org_terms if len(t.strip()) > 3}, key=lambda t: (-len(t), t)):
        text = re.sub(re.escape(term), lambda m: token("ORG", m[0]), text, flags=re.IGNORECASE)
    return text, [(t, value) for (_, value), t in made.items()]


def anonymize(df: DataFrame, id_col: str, text_col: str, org_terms: list[str] = ()) -> DataFrame:
    """id, masked text and its tokens; numbering starts anew in each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [numbered(t or "", org_terms) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "masked": [d[0] for d in done], "tokens": [[{"token": t, "original": o} for t, o in d[1]] for d in done]})

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, masked string, tokens array<struct<token string, original string>>")


def restore(text: Column, tokens: Column) -> Column:
    """Tokens put back last made first, so that one inside another's value
    comes back too."""
    return F.aggregate(F.reverse(tokens), text, lambda out, t: F.replace(out, t["token"], t["original"]))


def anonymize_value(value: object, mask_text) -> object:
    """A JSON value with sensitive keys dropped and all its texts masked."""
    if isinstance(value, dict):
        return {k: anonymize_value(v, mask_text) for k, v in value.items() if k.lower() not in SENSITIVE_KEYS}
    if isinstance(value, list):
        return [anonymize_value(v, mask_text) for v in value]
    return mask_text(value) if isinstance(value, str) else value
