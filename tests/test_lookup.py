"""Product questions by hand-made cases."""

from pyspark.sql import functions as F

from tendril.functions import lookup as L
from tendril.operators import lookup as Lk


def test_questions(spark):
    said = ["сколько стоит весы лабораторные?", "/find стол | код, поставщик", "/start", "  ", None, "шкаф", "Найди стул и остаток", "весы: себестоимость", "я|", "покажите термометр, пожалуйста"]
    df = spark.createDataFrame(list(enumerate(said)), "i int, said string")
    got = {r.i: r for r in df.select("i", L.is_lookup(F.col("said")).alias("is"), L.parse(F.col("said")).alias("q")).collect()}
    assert [got[i]["is"] for i in range(10)] == [True, True, False, False, False, False, True, True, True, False]
    assert (got[0].q.name, got[0].q.fields) == ("весы лабораторные", L.PRICE_FIELDS)
    assert (got[1].q.name, got[1].q.fields) == ("стол", ["code_supplier", "code"])
    assert got[3].q is None and got[4].q is None and got[8].q is None
    assert (got[5].q.name, got[5].q.fields) == ("шкаф", L.DEFAULT_FIELDS)
    assert (got[6].q.name, got[6].q.fields) == ("стул", ["quantity"])
    assert (got[7].q.name, got[7].q.fields) == ("весы", ["cost"])
    assert got[9].q.name == "термометр пожалуйста"


def test_urls(spark):
    rows = [("см. https://a.ru/p/1).", "https://a.ru/p/1", True), ("www.b.ru", "https://www.b.ru", False), ("c.ru/catalog/", "https://c.ru/catalog/", False), ("нет ссылки", None, None), ("", None, None), (None, None, None), ("https://d.ru/?id=3", "https://d.ru/?id=3", True)]
    df = spark.createDataFrame(rows, "said string, url string, shows boolean")
    for r in df.select("*", L.extract_url(F.col("said")).alias("u")).select("*", L.shows_product(F.col("u")).alias("s")).collect():
        assert (r.u, r.s) == (r.url, r.shows), r
    assert spark.createDataFrame([("Озон — https://a.ru, ",), (" ",)], "t string").select(L.source_label(F.col("t")).alias("x")).collect() == [("Озон",), ("Источник из базы",)]


def test_answers(spark):
    hit = "struct<name: string, score: double, "
    schema = f"i int, fields array<string>, catalog {hit} cost: double, price: double, stock: double, unit: string>, registry {hit} quantity: double>, listed {hit} price: double, supplier: string, code: string>"
    every = [*L.DEFAULT_FIELDS, "code", "code_supplier", "match"]
    rows = [
        (1, every, ("весы", 95.0, 10.0, None, 3.0, "кг"), ("весы М", 80.0, 2.5), ("весы Л", 70.0, 100.0, "ООО А", "12")),
        (2, every, ("весы", 69.0, 10.0, 20.0, 3.0, "кг"), None, None),
        (3, ["price"], None, None, None),
    ]
    got = {r.i: r for r in Lk.answers(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["values"] == {"cost": "10.00 ₽", "price_supplier": "100.00 ₽", "price_kp": "130.00 ₽", "quantity": "реестр: 2.5 шт.; каталог: 3 шт.", "unit": "кг", "code": "12", "code_supplier": "ООО А", "match": "95%"}
    assert got[1].sources == ["Каталог: весы", "Реестр: весы М", "Прайс (ООО А): весы Л"]
    assert got[2]["values"] == {"quantity": "нет данных", "unit": "шт.", "match": "69%"} and got[2].sources == []
    assert got[3]["values"] == {}


def test_relevance_and_alternatives(spark):
    rows = [("весы лаб", "весы М", 75.0, True), ("весы лаб", "стол", 89.0, False), ("весы лаб", "стол", 90.0, True), ("весы", "весы", 69.0, False), ("", "стол", 80.0, False), ("весы", None, None, False)]
    df = spark.createDataFrame(rows, "p string, n string, s double, want boolean")
    for r in df.select("*", Lk.is_relevant_hit(F.col("p"), F.col("n"), F.col("s")).alias("got")).collect():
        assert r.got == r.want, r
    names = spark.createDataFrame([(["а", "б", "в", "г", "д"], None, ["е", "б", "ж"])], "c array<string>, r array<string>, l array<string>")
    assert names.select(Lk.other_names(F.col("c"), F.col("r"), F.col("l"), F.lit("в")).alias("x")).first().x == ["б", "г", "ж"]
