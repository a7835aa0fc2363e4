from tendril.functions import pii
from tendril.functions.preferences import Preferences
from tendril.operators import items as I
from tendril.plans import offers
from tendril.operators import offers as O

HITS = "item_id int, source string, name string, score double, rank int, cost double, price double"


def test_local_match(spark):
    items = spark.createDataFrame([(1, "весы лабораторные", ""), (2, "стол", ""), (3, "гипсовая голова", ""), (4, "шкаф", "")], "item_id int, name string, specifications string")
    hits = spark.createDataFrame(
        [
            (1, "catalog", "Весы лабораторные", 100.0, 1, 5.0, None), (1, "catalog", "Весы лабораторные М", 100.0, 2, None, 9.0), (1, "price_list", "Весы лабораторные АБ", 100.0, 1, None, 7.0),
            (2, "registry", "Стол", 100.0, 1, None, None), (3, "catalog", "голова гипс", 100.0, 1, 1.0, 1.0), (4, "catalog", "шкаф", 96.0, 1, None, 3.0),
        ],
        HITS,
    )
    got = {r.item_id: r for r in I.local_match(items, hits).collect()}
    assert sorted(got) == [1, 2, 4]
    assert (got[1].source, got[1].matched_name, got[1].unit_cost, got[1].unit_base_price) == ("catalog", "Весы лабораторные", 5.0, 7.0)
    assert got[1].alternatives == ["Весы лабораторные М"] or len(got[1].alternatives) == 2
    assert got[2].source == "registry" and got[4].unit_base_price == 3.0


def test_quotes_change_results(spark):
    fields = "item_id int, name string, status string, source string, score double, matched_name string, unit_cost double, unit_base_price double, internet boolean"
    results = spark.createDataFrame([(k, "имя", "not_found", "none", 0.0, None, None, None, False) for k in (1, 2, 3, 4)] + [(5, "имя", "exact", "catalog", 100.0, "м", 1.0, 2.0, False)], fields)
    quotes = spark.createDataFrame([(1, "catalog", "а", None, 96.0, 8.0, None, 0), (1, "web", "б", "https://s.ru/a", 100.0, 4.0, None, 1), (2, "web", "б", "https://s.ru/a", 100.0, 4.0, None, 0), (3, "web", "в", "https://s.ru/b", 80.0, None, None, 0), (5, "web", "б", "https://s.ru/a", 100.0, 4.0, None, 0)], "item_id int, source string, matched_name string, url string, match_score double, price double, cost double, pos int")
    got = {r.item_id: (r.status, r.source, r.unit_base_price, r.internet, r.url) for r in I.apply_quotes(results, quotes).collect()}
    assert got == {1: ("similar", "catalog", 8.0, False, None), 2: ("exact", "web", 4.0, True, "https://s.ru/a"), 3: ("similar", "web", None, False, "https://s.ru/b"), 4: ("not_found", "none", None, False, None), 5: ("exact", "catalog", 2.0, False, None)}


def test_kits_and_photos(spark):
    results = spark.createDataFrame([(1, None, 5.0), (2, 3.0, None), (3, 1.0, 1.0)], "item_id int, unit_cost double, unit_base_price double")
    parts = spark.createDataFrame([(1, 2.0, 4.0), (1, 3.0, None), (2, 7.0, None)], "item_id int, unit_cost double, unit_price double")
    assert sorted((r.item_id, r.unit_cost, r.unit_base_price) for r in I.merge_kits(results, parts).collect()) == [(1, 5.0, 4.0), (2, 3.0, 7.0), (3, 1.0, 1.0)]
    files = spark.createDataFrame([("0001.jpg",), ("0001.png",), ("0001_2.gif",), ("0001_4.gif",), ("x.png",), ("0002_2.png",)], "file string")
    rows = spark.createDataFrame([(1,), (2,)], "row_pos int")
    assert {r.row_pos: r.photo_files for r in I.photo_files(rows, files).collect()} == {1: ["0001.png", "0001_2.gif"], 2: []}


def test_offers(spark):
    html = '<a class="result__a" href="https://shop.ru/a">Весы АБ - купить</a><a class="result__snippet">по цене 1 500 руб. </a><a class="result__a" href="https://other.ru/b">Весы АБ</a>'
    found = O.search_results(spark.createDataFrame([(1, html)], "item int, html string"), ["item"])
    rows = found.orderBy("pos").collect()
    assert [(r.url, r.snippet) for r in rows] == [("https://shop.ru/a", "по цене 1 500 руб."), ("https://other.ru/b", "")]
    fetched = spark.createDataFrame([("https://other.ru/b", "data-price='900'")], "url string, text string")
    from pyspark.sql import functions as F

    got = O.offers(found.withColumn("query", F.lit("Весы АБ")), fetched, ["item"]).collect()
    assert [(r.url, r.price, r.platform) for r in got] == [("https://shop.ru/a", 1500.0, "Shop")]


def test_preferences_and_json():
    p = Preferences(["Ozon"]).merge({"excluded_platforms_add": ["WB"], "excluded_platforms_remove": ["ozon"], "disabled_sources_add": ["Web"], "force_kit_component_pricing": True, "save_rule": " правило "})
    assert p == Preferences(["WB"], ["web"], False, True, ["правило"])
    assert p.merge({"force_kit_component_pricing": None}).component_pricing
    clean = pii.anonymize_value({"Email": "a@b.ru", "notes": ["пишите a@b.ru", 5]}, lambda t: pii.numbered(t)[0])
    assert clean == {"notes": ["пишите [EMAIL_1]", 5]}


def test_photo_files_by_folder(spark):
    rows = spark.createDataFrame([("", 1), ("0", 1)], "folder string, row_pos int")
    files = spark.createDataFrame([("", "0001.JPG"), ("0", "0001.png"), ("0", "0001_2.gif")], "folder string, file string")
    assert {r.folder: r.photo_files for r in I.photo_files(rows, files, ["folder"]).collect()} == {"": ["0001.JPG"], "0": ["0001.png", "0001_2.gif"]}


def test_stock_of_seven_digits(spark, tmp_path):
    """Parts 100000 and 1000000 share six digits, but no pictures."""
    spark.createDataFrame([(100_000,), (1_000_000,), (1_000_007,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    shown = {r.row_pos: r.photos for r in offers.stock_photos(spark, str(tmp_path)).collect()}
    assert shown == {100_000: "100000.png|100000_2.webp|100000_3.gif", 1_000_000: "100000.png|100000_2.webp|100000_3.gif", 1_000_007: "100000.JPG|100000_2.webp"}
