"""Sheets of a quotation: links, details."""

from datetime import datetime

from pyspark.sql import functions as F

from tendril.functions.text import spec_preview
from tendril.operators import sheets as Sh
from tendril.plans import workbook as W
from tendril.sources.tables import request_lines


def test_addresses_are_made_after_the_shuffle(spark):
    items = spark.createDataFrame([(1, "red bolt"), (2, "gear")], "number int, name string")
    quotes = spark.createDataFrame(
        [(1, 3, "web", "Интернет: Ozon", None, None), (1, 1, "web", "Интернет: Shop", " https://a.example/1", None), (1, 2, "web", "Интернет: Shop", "https://a.example/1", None), (1, 4, "price_list", "Прайс", "https://b.example/", None)],
        "number int, pos int, source string, label string, url string, matched_name string",
    )
    out = Sh.with_links(items, quotes, ["number"])
    ozon, yandex, wild = "https://www.ozon.ru/search/?text=", "https://market.yandex.ru/search?text=", "https://www.wildberries.ru/catalog/0/search.aspx?search="
    assert {r.number: r.links for r in out.collect()} == {1: ["https://a.example/1", ozon + "red+bolt", yandex + "red+bolt"], 2: [ozon + "gear", yandex + "gear", wild + "gear"]}
    bare = {r.number: r.links for r in Sh.with_links(items, quotes, ["number"], excluded=["ozon"]).collect()}
    assert bare[2] == [yandex + "gear", wild + "gear"]
    exchanged = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert not any("url_encode" in line or "links" in line for line in exchanged)
    assert {r.number: r.links for r in Sh.with_links(items, quotes, ["number"], web=False).collect()} == {1: [], 2: []}


def detail_tables(spark):
    """A kit whose components come in no order, a line that is none but has a component, one of which that isn't known."""
    fields = "request int, number int, name string, unit string, quantity double, status string, source string, matched_name string, score double, unit_cost double, unit_base_price double, unit_price double, total_price double, supplier string, purchase_date string, notes string, source_detail string, alternatives array<string>, internet boolean, is_kit boolean"
    line = lambda request, number, name, kit: (request, number, name, "шт.", 2.0, "exact", "catalog", "", 95.04, 1.0, 2.0, 2.6, 5.2, "S", None, None, "d", ["a", "b", "c", "d"], number == 2, kit)
    results = spark.createDataFrame([line(1, 3, "gear", None), line(1, 1, "scales", True), line(1, 2, "bolt", False), line(2, 1, "rod", True)], fields)
    part = lambda number, pos, found: (1, number, pos, f"part {pos}", "shelf", 3.0, 1.0, 1.5, "P", "01.02.2024", found, 7.25, None if pos > 1 else "https://c.example/p", "Shop")
    parts = spark.createDataFrame([part(1, 2, None), part(1, 1, True), part(2, 1, True), part(3, 1, True), part(9, 1, True)], "request int, number int, pos int, name string, catalog_name string, quantity double, unit_cost double, unit_price double, supplier string, purchase_date string, found_in_catalog boolean, list_price double, competitor_url string, competitor_platform string")
    quotes = spark.createDataFrame([(1, 2, 2, "web", "Интернет: Shop", "https://b.example/2", None), (1, 2, 1, "web", "Интернет: Яндекс.Маркет", None, "nut"), (1, 1, 1, "price_list", "Прайс", "https://a.example/", None)], "request int, number int, pos int, source string, label string, url string, matched_name string")
    return results, parts, quotes


def test_detail_sheet(spark):
    rows = {(r.request, r.row): r for r in Sh.detail_sheet(*detail_tables(spark), ["request"]).collect()}
    assert {k: (r.label, r.name, r.matched_name) for k, r in rows.items()} == {
        (1, 1): ("1", "scales", Sh.DASH), (1, 2): ("1.1", Sh.PART_MARK + "part 1", "shelf"), (1, 3): ("1.2", Sh.PART_MARK + "part 2", "part 2"), (1, 4): ("2", "bolt", Sh.DASH), (1, 5): ("3", "gear", Sh.DASH), (2, 1): ("1", "rod", Sh.DASH),
    }
    assert rows[1, 4].link == "https://market.yandex.ru/search?text=nut" and rows[1, 2].link == "https://c.example/p" and rows[1, 3].link == Sh.DASH
    assert (rows[1, 2].notes, rows[1, 3].notes, rows[1, 3].total_price, rows[1, 1].markup, rows[1, 1].score) == (Sh.IN_CATALOG + " | Shop", Sh.LISTED + "7.25 | Shop", 4.5, 0.6, 95.0)
    assert {r.link for r in Sh.detail_sheet(*detail_tables(spark), ["request"], web=False).collect() if r.kind == Sh.ITEM_ROW} == {Sh.DASH}


def test_detail_query_shuffles_a_line_thrice(spark):
    """Numbered, met with its part, put with its request: no text or quote of it after that."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = W.sheet_detail(spark, "/root/testdata/sf0.001")
        plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    exchanged = [line for line in plan if "Exchange" in line]
    assert len(exchanged) == 4  # three of lines, one of parts
    rows = W.lines(spark, "/root/testdata/sf0.001")
    flat = Sh.detail_sheet(rows, W.components(rows), W.quotes(rows), W.BY)
    assert out.columns == flat.columns and sorted(map(repr, out.collect())) == sorted(map(repr, flat.collect()))


def test_lines_are_numbered_by_what_tells_them_apart(spark, tmp_path):
    """Equal lines but for discount or flag, and lines of one part and supplier whose price decides."""
    day = datetime(2024, 1, 2)
    line = lambda number, part, price, quantity, discount, flag: (7, part, 3, number, quantity, price, discount, 0.0, flag, "O", day)
    rows = [line(1, 5, 10.0, 2.0, 0.1, "R"), line(1, 5, 10.0, 2.0, 0.0, "N"), line(1, 5, 9.0, 4.0, 0.2, "R"), line(1, 4, 50.0, 1.0, 0.0, "N"), line(2, 1, 1.0, 1.0, 0.0, "N")]
    fields = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, fields).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = request_lines(spark, str(tmp_path))
    assert "l_discount" not in out._jdf.queryExecution().executedPlan().toString()
    want = [(1, 4, 1.0), (2, 5, 4.0), (3, 5, 2.0), (4, 5, 2.0), (5, 1, 1.0)]
    assert sorted((r.number, r.code, r.quantity) for r in out.collect()) == want


def test_preview_is_cut_as_in_the_reference(spark):
    """A space before the ellipsis stays: nothing of the cut text is trimmed."""
    texts = {" ab\n\tcd  ef ": "ab cd ef", "ab cd efg": "ab cd e…", "abcdef ghi": "abcdef …", "abcdefgh": "abcdefgh", None: ""}
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    assert {r.x: r.p for r in rows.select("x", spec_preview(F.col("x"), 8).alias("p")).collect()} == texts
