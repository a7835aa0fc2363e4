"""The rewrites of a result's metadata, a row for each rule."""

import pytest

from tendril.operators import answers as An
from tendril.operators import metadata as Md

RESULT = "item_id int, name string, status string, source string, matched_name string, score double, unit_cost double, unit_base_price double, internet boolean, source_detail string, notes string, supplier string, purchase_date string, is_kit boolean"
QUOTE = "item_id int, source string, label string, matched_name string, cost double, price double, url string, match_score double, supplier string, purchase_date string, pos int"
SHOP = "https://shop.example/p/1"


def result(i, status="not_found", source="none", matched="", score=0.0, cost=None, base=None, internet=False, detail=None, notes=None, kit=False, supplier=None):
    return (i, f"item {i}", status, source, matched, score, cost, base, internet, detail, notes, supplier, None, kit)


RESULTS = [
    result(1),  # no price, no quote: stays
    result(2, "exact", "catalog", "x", 96.0, 5.0, 6.0, internet=True),  # told, but priced from the internet
    result(3, base=5.0, kit=True, score=20.0, notes="n"),  # a kit by its parts
    result(4, base=5.0, notes="n"),  # the local quote
    result(5, base=5.0),  # the web quote
    result(6, base=5.0, score=91.0),  # priced web quotes that may not set a price
    result(7, base=5.0, source="none", status="similar"),  # nothing tells it
    result(8, "similar", "price_list", "y", 80.0),  # fetched quotes price it
    result(9, "similar", "price_list", "y", 80.0, 7.0, None),  # a cost, not sure: a linked quote's price
    result(10),  # links only
    result(11, "exact", "catalog", "z", 97.0, 5.0, 6.0),  # sure: stays
    result(12, "similar", "web", "w", 95.0, 5.0, 6.0, True, "given", "−"),  # noted already
    result(13, base=9.0, kit=True),  # a kit without a priced part
]
QUOTES = [
    (4, "catalog", "Каталог", "low", 1.0, None, None, 94.0, None, None, 0), (4, "catalog", "Каталог", "good", None, 3.0, None, 99.0, "S", "01.01.2024", 1), (4, "registry", "Реестр", "r", 1.0, None, None, 100.0, None, None, 2),
    (5, "web", "Интернет: Shop", "w", None, 8.0, SHOP, 100.0, None, None, 0), (5, "web", "Интернет: A", "w", None, 7.0, "https://www.ozon.ru/product/1", 100.0, None, None, 1),
    (6, "web", "Интернет: B", "w", None, 8.0, SHOP, 60.0, None, None, 0),
    (9, "web", "Интернет: C", "c", None, 4.0, SHOP, 100.0, None, None, 0), (10, "web", "Интернет: D", "d", None, None, SHOP, 60.0, None, None, 0), (10, "web", "Интернет: D", "d", None, 3.0, "https://www.ozon.ru/search/?text=a", 100.0, None, None, 1),
    (11, "web", "Интернет: E", "e", None, 1.0, SHOP, 100.0, None, None, 0),
]
FOUND = [(8, "web", "Интернет: F", "", 2.0, 9.0, None, 100.0, "F", None, 0), (1, "web", "Интернет: G", "g", None, 2.0, SHOP, 50.0, None, None, 0)]
KITS = [(3, 4, 3, True), (13, 2, 0, False)]


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.createDataFrame(rows, schema) for rows, schema in ((RESULTS, RESULT), (KITS, "item_id int, n_components int, in_catalog int, any_priced boolean"), (QUOTES, QUOTE), (FOUND, QUOTE))]


def told(rows):
    return {r.item_id: (r.status, r.source, r.matched_name, r.score, r.unit_cost, r.unit_base_price, r.internet, r.source_detail, r.notes) for r in rows.collect()}


def test_every_rule(tables):
    web = "Цена КП: −5.0% от найденной в интернете"
    rows = Md.finish(*tables)
    assert rows.columns == tables[0].columns
    got = told(rows)
    assert got[1] == ("similar", "web", "item 1", 0.0, None, None, False, "Интернет", "Цена не извлечена — проверьте ссылки")
    assert got[2] == ("exact", "web", "x", 96.0, 5.0, 6.0, True, "Интернет", web)
    assert got[3] == ("similar", "catalog", "item 3", 75.0, None, 5.0, False, "Комплект по составу ТЗ (3/4 поз. в каталоге)", "n | Себестоимость по составу комплекта: 4 поз.")
    assert got[4] == ("similar", "catalog", "good", 99.0, 3.0, 3.0, False, "Каталог", "n | Подбор по сравнению: Каталог")
    assert got[5] == ("exact", "web", "w", 100.0, 8.0, 8.0, True, f"Интернет: Shop | {SHOP}", f"Подбор по сравнению: Интернет: Shop | {web}")
    # Not internet priced and without a usable link, so promoting leaves it.
    assert got[6] == ("exact", "web", "item 6", 91.0, None, 5.0, False, "Интернет", None)
    assert got[7] == ("similar", "catalog", "item 7", 0.0, None, 5.0, False, "Подбор по сравнению", None)
    assert got[8] == ("exact", "web", "y", 100.0, 2.0, 2.0, True, "Интернет: F", f"Подбор по сравнению: Интернет: F | {web}")
    assert got[9] == ("exact", "web", "c", 100.0, 4.0, 4.0, True, f"Интернет | {SHOP}", web)
    assert got[10] == ("similar", "web", "item 10", 0.0, None, None, False, "Интернет", "Цена не извлечена — проверьте ссылки")
    assert got[11] == ("exact", "catalog", "z", 97.0, 5.0, 6.0, False, None, None)
    assert got[12] == ("exact", "web", "w", 95.0, 5.0, 6.0, True, "given", "−")
    assert got[13] == ("similar", "catalog", "item 13", 0.0, None, 9.0, False, "Подбор по сравнению", None)


def test_without_the_internet_results_are_promoted_only(tables):
    got = told(Md.finish(*tables, web=False))
    assert got[8] == ("similar", "price_list", "y", 80.0, None, None, False, None, None)
    assert got[11][:2] == ("exact", "web") and got[5][1] == "web"


def test_answers(spark):
    schema = "item_id int, source string, matched_name string, price_source string, source_detail string, notes string, product_url string, source_url string, url string, link string"
    rows = [
        (1, "catalog", "Весы", None, None, None, None, None, None, None), (2, "price_list", "Весы малые", "", " ", None, None, None, None, None), (3, "registry", "весы", None, "дано", "см. https://a.example/p/1).", None, None, None, None),
        (4, "registry", "весы", None, None, None, "https://shop.example/", None, None, None), (5, "web", "x", None, None, " Источник: a ", None, None, "www.b.example/x", None), (6, "web", "x", None, None, None, None, None, None, None),
        (7, "none", "x", None, None, None, None, None, None, None), (8, "catalog", "", None, None, None, None, None, None, None), (9, "price_list", "стул", None, None, None, None, None, None, "c.example/cart#1"),
    ]
    hits = [(1, "catalog", 1, "Стол", None, None, None), (1, "catalog", 2, "ВЕСЫ лабораторные", None, None, None), (2, "price_list", 1, "весы", "ООО", "A1", None), (4, "registry", 1, "Весы", None, None, "https://r.example/"), (4, "registry", 2, "Весы 2", None, None, "r.example/item"), (8, "catalog", 1, "Стол", None, None, None), (9, "price_list", 1, "Стул", None, "", None)]
    candidates = spark.createDataFrame(hits, "item_id int, source string, rank int, name string, supplier string, code string, link string")
    out = An.resolve(spark.createDataFrame(rows, schema), candidates)
    got = {r.item_id: (r.price_source_text, r.product_url) for r in out.collect()}
    assert got == {
        1: ("Каталог: ВЕСЫ лабораторные", None), 2: ("Прайс (ООО): весы, код A1", None), 3: ("дано", "https://a.example/p/1"), 4: ("Реестр остатков: Весы", "https://r.example/item"), 5: ("Источник: a", "https://www.b.example/x"),
        6: (An.ESTIMATE, None), 7: ("Нейросеть", None), 8: ("Каталог", None), 9: ("Прайс (прайс): Стул", "https://c.example/cart#1"),
    }
    assert out.columns == [*schema.replace(" string", "").replace(" int", "").split(", "), "price_source_text"]


def test_json_documents_without_contacts(spark):
    import json

    from tendril.operators import jsonwalk as Jw

    docs = [
        (1, '{"b": {"URL": 1, "a": ["x@y.example", {"fio": "z"}, [], {}, [[1.50, null]]]}, "a": "тел. +7 (999) 123-45-67", "Phone": {"deep": 1}}'),
        (2, '"петров@a.example"'), (3, "[]"), (4, '{"link": 1}'), (5, "not json"), (6, None), (7, "7"), (8, '{"a.b": {"0": {"k": "\\"q\\" \\n"}}, "0": ["t"]}'),
    ]
    rows = spark.createDataFrame(docs, "i int, doc string")
    got = {r.i: r.json for r in Jw.anonymize(rows, "i", "doc").collect()}
    want = {1: {"b": {"a": ["[EMAIL]", {}, [], {}, [[1.5, None]]]}, "a": "тел. [PHONE]"}, 2: "[EMAIL]", 3: [], 4: {}, 7: 7, 8: {"a.b": {"0": {"k": '"q" \n'}}, "0": ["t"]}}
    assert {k: json.loads(v) for k, v in got.items() if v is not None} == want and got[5] is None and got[6] is None


def test_distinct_quotes(spark):
    from tendril.operators import quotes as Q

    rows = [(1, "web", "u", "a", 1.0, 0), (1, "web", None, "b", 1.0, 1), (1, "web", None, "b", 1.0, 2), (1, "web", "u", "c", 2.0, 3), (2, "web", "u", "a", 1.0, 4), (1, "web", "", "d", None, 5)]
    quotes = spark.createDataFrame(rows, "item_id int, source string, url string, matched_name string, price double, pos int")
    assert sorted(r.pos for r in Q.first_by_url(quotes, ["item_id"]).collect()) == [0, 1, 2, 4, 5]
    keys = ["item_id", "source", "url", "matched_name", "price"]
    known = quotes.filter("pos = 1")
    assert sorted(r.pos for r in Q.extended(known, quotes.filter("pos <> 1"), keys).collect()) == [0, 1, 3, 4, 5]


def test_entities(spark):
    from tendril.functions import web as Wb

    texts = {"a &#8211; b": "a – b", "&#x2013;&#X41;": "–A", "&amp;#39; &amp;lt;": "&#39; &lt;", "&#128512;&#55296;": "😀&#55296;", "&#39;&quot;&nbsp;": "'\" ", "&#0; &#x110000;": "&#0; &#x110000;", "&#1;5": "\x015"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.u for r in rows.select("t", Wb.unescape(rows.t).alias("u")).collect()} == texts
