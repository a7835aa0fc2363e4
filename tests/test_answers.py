"""Sources of answers: both picks from one join."""

from tendril.operators import answers as An
from tendril.plans import registry


def test_first_and_linked_differ(spark):
    empty = {c: None for c in ("price_source", "source_detail", "notes", *An.URL_FIELDS)}
    kinds = "item_id long, source string, matched_name string, " + ", ".join(f"{c} string" for c in empty)
    answers = spark.createDataFrame([(1, "registry", "гиря", *empty.values()), (2, "price_list", "ось", *empty.values()), (3, "registry", "нет", *empty.values())], kinds)
    rows = [
        (1, "registry", 3, "Гиря М1", "C", "3", "b.example/item/3"), (1, "registry", 1, "гиря", "A", "1", "https://a.example/catalog/"), (1, "registry", 0, "другое", "X", "0", "x.example/item/0"), (1, "catalog", 0, "гиря", "Y", "9", "y.example/item/9"),
        (1, "registry", 2, "гиря", "B", "2", "b.example/item/2"), (2, "price_list", 5, "Ось", None, None, "c.example/item/5"), (2, "price_list", 7, "ось", "Z", "7", None),
    ]
    hits = spark.createDataFrame(rows, "item_id long, source string, rank int, name string, supplier string, code string, link string")
    out = An.resolve(answers, hits)
    assert {r.item_id: (r.price_source_text, r.product_url) for r in out.collect()} == {1: ("Реестр остатков: гиря", "https://b.example/item/2"), 2: ("Прайс (прайс): Ось", None), 3: ("Реестр остатков", None)}


def test_sales_are_read_once(spark):
    plan = registry.QUERIES["answer_sources"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_suppkey#") and plan.count("Relation [l_orderkey") == 1 and "Window" not in plan
