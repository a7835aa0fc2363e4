"""A request from its items to prices, on hand-made rows of each branch."""

import pytest

from tendril.operators import catalog as C
from tendril.operators import flow as Fl
from tendril.operators import quotes as Q
from tendril.operators import results as R

ITEMS = [
    (1, "Термометр лабораторный", "", 2.0),
    (2, "Весы электронные", "", 3.0),
    (3, "Микроскоп школьный", "", 1.0),
    (4, "Набор гирь", "Состав комплекта: гиря малая; гиря большая; комплект принадлежностей", 1.0),
    (5, "Проектор мультимедийный", "", 1.0),
    (6, "Неведомый предмет", "", 4.0),
    (7, "Комплект приборов", "", 1.0),
]
CATALOG = [
    (1, "Комплект приборов составляющие", None, None),
    (2, "Комплект приборов", None, 900.0),
    (3, "Прибор первый", 100.0, 150.0),
    (4, "Прибор второй", 200.0, None),
    (5, "Раздел", None, None),
    (6, "Термометр лабораторный", 50.0, 80.0),
    (7, "Гиря малая", 10.0, None),
]
PRICES = [(1, "Весы электронные", "A1", "ООО Весы", 500.0), (2, "Весы электронные", "A2", "ООО Другие", 510.0), (3, "Термометр лабораторный", "B1", "ООО Тепло", 70.0), (4, "Гиря большая", "C1", "ООО Весы", 40.0)]
GOODS = [(1, "Микроскоп школьный", "ООО Оптика", "01.02.2024", 3000.0, None, False), (2, "Термометр лабораторный", "ООО Тепло", "05.03.2024", 45.0, 60.0, True)]
WEB = [
    (5, "Интернет: Shop", "Проектор мультимедийный", "https://shop.example/p/1", 100.0, 20000.0, 0),
    (5, "Интернет: Ozon", "Проектор мультимедийный", "https://www.ozon.ru/product/1", 100.0, 19000.0, 1),
    (6, "Интернет: Shop", "Неведомый предмет", "https://shop.example/p/2", 100.0, None, 0),
    (6, "Интернет: Shop", "Иное", "https://shop.example/p/3", 80.0, 5.0, 1),
]


@pytest.fixture(scope="module")
def tables(spark):
    catalog = C.classify(spark.createDataFrame([(*r, "s") for r in CATALOG], "row_idx int, name string, cost double, price double, sheet string"), ["sheet"])
    return Fl.Tables(
        catalog,
        spark.createDataFrame(PRICES, "row_idx int, name string, code string, supplier string, price double"),
        spark.createDataFrame([(1, "Термометр лабораторный", 7.0)], "row_idx int, name string, quantity double"),
        spark.createDataFrame(GOODS, "row_idx int, name string, supplier string, purchase_date string, cost double, price double, procurement boolean"),
        spark.createDataFrame(WEB, "item_id int, label string, matched_name string, url string, match_score double, price double, pos int"),
    )


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id int, name string, specifications string, quantity double")


def test_match_items(items, tables):
    got = {r.item_id: r for r in Fl.match_items(items, tables, sheets=["sheet"]).collect()}
    told = lambda i: (got[i].status, got[i].source, got[i].rung, got[i].unit_base_price)
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]
    assert told(1) == ("exact", "catalog", 1, 80.0) and (got[1].unit_cost, got[1].supplier, got[1].purchase_date) == (50.0, "ООО Тепло", "05.03.2024")
    assert (got[1].unit_price, got[1].total_price, got[1].n_quotes) == (104.0, 208.0, 4)
    assert told(2) == ("exact", "price_list", 1, 500.0) and got[2].unit_price == 650.0
    assert told(3) == ("exact", "catalog", 4, 3000.0) and got[3].supplier == "ООО Оптика" and not got[3].local_miss
    assert told(4)[:2] == ("similar", "catalog") and got[4].is_kit and got[4].n_components == 2 and (got[4].unit_cost, got[4].unit_base_price, got[4].score) == (10.0, 50.0, 50.0)
    assert told(5) == ("exact", "web", 6, 20000.0) and got[5].internet and got[5].unit_price == 19000.0 and got[5].url == "https://shop.example/p/1"
    assert got[5].local_miss and told(6)[:2] == ("similar", "web") and got[6].unit_base_price is None and got[6].url == "https://shop.example/p/2"
    assert got[7].is_kit and got[7].n_components == 2 and got[7].unit_base_price == 900.0


def test_preferences_change_the_match(items, tables):
    got = {r.item_id: r for r in Fl.match_items(items.filter("item_id > 4"), tables, excluded=["SHOP.example"]).collect()}
    assert got[5].unit_base_price == 19000.0 and got[6].status == "not_found"


def test_parts(items, tables, spark):
    direct = {r.item_id: (r.row_idx, r.score) for r in Fl.direct_catalog(items, tables.catalog).collect()}
    assert direct[1] == (6, 100.0) and direct[7][0] == 1 and 5 not in direct  # all words of 7 are in row 1, the first of equal scores
    goods = {r.item_id: r.goods_cost for r in Fl.goods_match(items, tables.goods).collect()}
    assert goods == {1: 45.0, 3: 3000.0}
    needs = spark.createDataFrame([(1, "Термометр лабораторный", "тепло"), (2, "Стул", "ООО Весы"), (3, "x", "Никто")], "item_id int, name string, supplier string")
    assert [(r.item_id, r.price, r.supplier) for r in Fl.supplier_price(needs, tables.prices).collect()] == [(1, 70.0, "ООО Тепло")]
    lines = {r.name: r for r in Fl.component_lines(spark.createDataFrame([("гиря малая",), ("гиря большая",), ("ничто",)], "name string"), tables).collect()}
    assert (lines["гиря малая"].unit_cost, lines["гиря малая"].found_in_catalog) == (10.0, True)
    assert (lines["гиря большая"].unit_cost, lines["гиря большая"].unit_price, lines["гиря большая"].found_in_catalog) == (None, 40.0, False)


def test_component_names(spark):
    # A text that doesn't speak of a kit lists none.
    specs = ["состав комплекта: колба; комплект ложек; пробирка;", "Комплект:\n1. Стакан\n2) Воронка большая\nокпд 12.3;", "1. Стакан\n2) Воронка большая", None]
    rows = C.kit_components(spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "item_id int, specifications string")).collect()
    assert {r.item_id: r.components for r in rows} == {0: ["колба", "пробирка"], 1: ["Стакан", "Воронка большая"], 2: [], 3: []}


def test_internet_url_and_preferences(spark):
    rows = [(1, "web", "Интернет: A", "https://a.example/search?q=x", 100.0, 5.0, 0), (1, "web", "Интернет: B", "https://b.example/p", 100.0, 6.0, 1), (2, "web", "Интернет: C", "https://c.example/search?q=1", 50.0, None, 0), (3, "catalog", "Каталог", None, 96.0, 1.0, 0)]
    quotes = spark.createDataFrame(rows, "item_id int, source string, label string, url string, match_score double, price double, pos int")
    assert {r.item_id: r.internet_url for r in Q.internet_url(quotes, ["item_id"]).collect()} == {1: "https://b.example/p"}
    assert [r.item_id for r in Q.filter_quotes(quotes, excluded_platforms=["b.EXAMPLE"]).collect()] == [3]
    assert sorted(r.item_id for r in Q.filter_quotes(quotes, excluded_platforms=["ozon", ""]).collect()) == [1, 3]


def test_sheets(spark):
    results = spark.createDataFrame([(1, 1, 10.005, 2.0, 5.0, 91.26, ["a"] * 7), (1, 2, None, 1.0, None, 0.0, [])], "request_id int, item_id int, total_price double, quantity double, unit_base_price double, score double, alternatives array<string>")
    assert R.grand_total(results, ["request_id"]).first().grand_total == 10.01
    shown = {r.item_id: r.json for r in R.to_json(results).collect()}
    assert '"score":91.3' in shown[1] and '"total_base_price":10.0' in shown[1] and shown[1].count('"a"') == 5
    assert {r.request_id: r.all_missing for r in R.none_found(spark.createDataFrame([(1, False), (1, None), (2, True), (2, False)], "request_id int, found boolean"), ["request_id"]).collect()} == {1: True, 2: False}
    kits = spark.createDataFrame([(1, 7.0, None)], "item_id int, sum_cost double, sum_price double")
    out = {r.item_id: (r.unit_cost, r.unit_base_price) for r in R.override_kits(results.withColumn("unit_cost", results.quantity), kits).collect()}
    assert out == {1: (7.0, 5.0), 2: (1.0, None)}
    quotes = spark.createDataFrame([(1, "catalog", 5.0, None, None, 0), (1, "price_list", None, 9.0, None, 1), (1, "price_list", None, 8.0, None, 2), (1, "web", None, 7.0, "u1", 3), (1, "web", None, None, "u2", 4)], "item_id int, source string, cost double, price double, url string, place int")
    row = R.comparison_rows(quotes, ["item_id"]).first()
    assert (row.catalog_price, row.list_price, row.purchase_price, row.web_price, row.links) == (5.0, 9.0, None, 7.0, ["u1", "u2"])
