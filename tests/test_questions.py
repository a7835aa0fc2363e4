"""Questions read step by step; tables of text in one sort."""

import random

from pyspark.sql import functions as F

from tendril.functions import lookup as L
from tendril.operators import requests as Rq
from tendril.plans import registry

WORDS = ["найди", "Сколько стоит", "цена", "и", "продажная цена", "кп", "остаток", "гиря", "М1", "нужен", "?", ",", ":", "|", "/find", "а также", "кол-во", "ед. изм", "что с", "прайс", "какой", "x", "сколько есть", "Дайте", " ", "покажите", "информация о"]


def test_questions_are_what_parse_reads(spark):
    rng = random.Random(3)
    said = ["", None, "/find a", "//", ":", "|", "ab|"] + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(said)), "i int, said string")
    whole = df.select("i", L.is_lookup(F.col("said")).alias("is_lookup"), L.parse(F.col("said")).alias("q")).select("i", "is_lookup", "q.name", "q.fields")
    key = lambda r: r.i
    assert sorted(L.questions(df, "said").select("i", "is_lookup", "name", "fields").collect(), key=key) == sorted(whole.collect(), key=key)


def test_each_pattern_is_read_once(spark):
    plan = registry.QUERIES["lookup_requests"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") + plan.count("RLIKE") < 100


def test_tables_are_sorted_once(spark):
    texts = spark.createDataFrame([("a", "№\tнаимен\n1\tx\tшт\t2\nконец\n2\ty\tшт\t3\nнаимен  ед  кол  нет\n3.  z  кг  4\n4.  z  кг  5"), ("b", "1\tx"), ("c", None), ("d", "наимен\nслова\n7 q\n\n8 r")], "id string, text string")
    out = Rq.text_tables(texts, "id", "text")
    assert sorted((r.id, r.number, r.name, r.quantity) for r in out.collect()) == [("a", 1, "x", 2.0), ("a", 3, "3.", 1.0), ("a", 4, "4.", 1.0), ("d", 7, "7", 1.0)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") >= 2
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Sort [") == 1
