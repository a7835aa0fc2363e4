from pyspark.sql import functions as F

from tendril.sources import workbooks as Wk
from tendril.sources.tables import load
from tendril.streaming.requests import event_rates, quote_stream


def test_workbook_round_trip(spark, tmp_path):
    catalog = spark.createDataFrame([("Весы & <гири>", 10.5, 3.0, 7.0, None, None), ("  ", 1.0, None, None, "кг", None), ("Стол", None, None, 2.0, "кг", 30.0)], "name string, price double, stock double, cost double, unit string, markup double")
    path = str(tmp_path / "catalog.xlsx")
    Wk.write_workbook({"Каталог": catalog, "Другой": catalog.limit(1)}, path)
    rows = Wk.read_catalog(spark, path).filter("sheet = 'Каталог'").orderBy("row_idx").collect()
    assert [(r.row_idx, r.name, r.price, r.cost, r.unit, r.markup) for r in rows] == [(2, "Весы & <гири>", 10.5, 7.0, "шт", None), (4, "Стол", None, 2.0, "кг", 30.0)]
    assert Wk.read_rows(spark, path).count() == 4 + 2


def test_price_lists(spark, tmp_path):
    rows = spark.createDataFrame([("A1", "Весы", "2", 5.0), ("слишком длинный код", "Стол", None, 5.0), ("A2", "Шкаф", None, 0.0)], "code string, name string, rec string, price double")
    path = str(tmp_path / "ООО Ромашка.xlsx")
    Wk.write_workbook({"Прайс": rows, "Лист1": rows}, path)
    assert [(r.code, r.supplier) for r in Wk.read_price_lists(spark, path).collect()] == [("A1", "ООО Ромашка")]


def test_file_kinds(spark):
    data = [(bytearray(b"%PDF-1.7"), None), (bytearray(b"PK\x03\x04..word/document.xml"), None), (bytearray(b"PK\x03\x04..xl/"), None), (bytearray(b"text"), "application/vnd.ms-excel"), (bytearray(b""), None)]
    df = spark.createDataFrame(data, "content binary, media string").withColumn("i", F.monotonically_increasing_id()).orderBy("i")
    assert [r.k for r in df.select(Wk.kind_of(F.col("content"), F.col("media")).alias("k")).collect()] == ["pdf", "docx", "xlsx", "xlsx", None]


def test_streams(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    source = tmp_path / "events"
    load(spark, sf, "events").repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(load(spark, sf, "events").schema).parquet(str(source))
    run = quote_stream(stream, lambda df: df.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "ck"))
    run.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 1000
    q = event_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("rates").agg(F.sum("n")).first()[0] == 1000


def book(spark, path, **sheets):
    """A workbook of (header, rows) by sheet."""
    content = Wk.book_bytes([(name, header, rows) for name, (header, rows) in sheets.items()])
    path.write_bytes(content)
    return str(path)


def test_a_task_for_each_sheet(spark, tmp_path):
    from tendril.sources import xlsx

    xlsx.register(spark)
    sheets = {f"Л{k}": (["a", "b"], [[f"x{k}", k + 0.5], [None, 7]]) for k in range(9)}
    one, two = book(spark, tmp_path / "one.xlsx", **sheets), book(spark, tmp_path / "two.xlsx", Только=(["c"], [["y"]]))
    read = spark.read.format("quote_xlsx").option("path", str(tmp_path)).load()
    assert read.rdd.getNumPartitions() == 10 and read.count() == 9 * 3 + 2
    plain = Wk.read_rows(spark, [one, two])
    key = lambda r: (r.path.removeprefix("file:"), r.sheet_no, r.row_idx)
    assert [(*key(r), r.sheet, r.cells, r.numbers) for r in sorted(read.collect(), key=key)] == [(*key(r), r.sheet, r.cells, r.numbers) for r in sorted(plain.collect(), key=key)]
    some = spark.read.format("quote_xlsx").option("paths", f'["{one}"]').load().filter("sheet IN ('Л2', 'Л5') AND row_idx > 1")
    assert some.rdd.getNumPartitions() == 2 and sorted(r.cells[0] or "" for r in some.collect()) == ["", "", "x2", "x5"]
    assert spark.read.format("quote_xlsx").option("path", one).load().filter("sheet_no = 3").rdd.getNumPartitions() == 1


def test_catalog_rows_know_their_kind(spark, tmp_path):
    head = ["Наименование", "Цена", "Остаток", "Себестоимость", "Ед", "Наценка"]
    rows = [["Комплект приборов составляющие"], ["Комплект приборов", 900], ["Прибор", 150, 2, 100], ["Комплект малый", None, None, 5], ["Раздел"], ["Весы", "нет", None, 7.5, " кг "]]
    path = book(spark, tmp_path / "catalog.xlsx", Каталог=(head, [r + [None] * (6 - len(r)) for r in rows]), Иной=(head, [["Стол", 1, 1, 1, None, None]]))
    got = [(r.name, r.entry_type, r.components_group, r.price, r.unit) for r in Wk.read_catalog(spark, path).orderBy("row_idx").collect()]
    kit = "Комплект приборов составляющие"
    assert got == [(kit, "components_header", kit, None, "шт"), ("Комплект приборов", "kit_total", kit, 900.0, "шт"), ("Прибор", "item", kit, 150.0, "шт"), ("Комплект малый", "sub_kit", kit, None, "шт"), ("Раздел", "section", None, None, "шт"), ("Весы", "item", None, None, "кг")]


def test_goods_reports_of_both_layouts(spark, tmp_path):
    plain = book(spark, tmp_path / "plain.xlsx", Отчёт=(["Наименование", "Поставщик", "Дата", "Себестоимость", "Цена", "Ед"], [["Весы", "ООО А", "01.02.2024", 5, 6, "шт"], [None, "x", None, 1, 1, None], ["Стол", None, None, "нет", 7, None]]))
    rows = [["Период: 01.01.2024 - 31.01.2024"], ["Наименование", "Кол-во", "Ед", "Цена"], ["Гиря", 2, "шт", 10.5], ["ООО Ромашка", None, None, None], ["Лоток", 1, "шт", 3], ["Без цены", 1, "шт", None]]
    two = book(spark, tmp_path / "two.xlsx", Отчёт=(["Отчет по закупкам", None, None, None], [r + [None] * (4 - len(r)) for r in rows]))
    got = sorted((r.name, r.supplier, r.purchase_date, r.cost, r.price, r.procurement) for r in Wk.read_goods(spark, [plain, two]).collect())
    assert got == [("Весы", "ООО А", "01.02.2024", 5.0, 6.0, False), ("Гиря", "ООО Ромашка", "Период: 01.01.2024 - 31.01.2024", 10.5, 10.5, True), ("Лоток", None, "Период: 01.01.2024 - 31.01.2024", 3.0, 3.0, True), ("Стол", None, None, None, 7.0, False)]
    kinds = {r.path.rsplit("/", 1)[1]: r.procurement for r in Wk.is_procurement(Wk.read_rows(spark, [plain, two])).collect()}
    assert kinds == {"plain.xlsx": False, "two.xlsx": True}


def test_registers_and_requests(spark, tmp_path):
    path = book(spark, tmp_path / "registry.xlsx", Реестр=(["Наименование", "Количество", "x", "Состояние", "ф", "ф", "ф", "Ссылка"], [["Весы", 3, None, "новое", None, None, None, "https://a.example/1"], [None] * 8, ["Стол", "много", None, "None", None, None, None, "None"]]))
    got = [(r.name, r.quantity, r.condition, r.link, r.row_pos) for r in Wk.read_registry(spark, path).orderBy("row_idx").collect()]
    assert got == [("Весы", 3.0, "новое", "https://a.example/1", 0), ("Стол", 0.0, None, None, 2)]
    asked = book(spark, tmp_path / "request.xlsx", Заявка=(["Заявка", None, None, None], [["№", "Наименование", "Ед. изм.", "Кол-во"], ["1", "Весы", "шт", 2], ["2.", "Стол", None, "три"], ["итого", None, None, 5]]))
    items = [(r.number, r.name, r.unit, r.quantity) for r in Wk.read_requests(spark, asked).orderBy("number").collect()]
    assert items == [(1, "Весы", "шт", 2.0), (2, "Стол", "шт.", 1.0)]


def test_suppliers_order_and_checks_of_price_lists(spark, tmp_path):
    head = ["Код", "Наименование", "Рек.", "Цена", "Заказ", "Сумма"]
    one = book(spark, tmp_path / "b.xlsx", Прайс=(head, [["A1", "Весы", "2,5", 5, 3, "15,75"], ["A2", "Стол", None, "5", None, None]]))
    two = book(spark, tmp_path / "a.xlsx", Прайс=(head, [[12, "Шкаф", "нет", 7, None, None]]))
    got = sorted((r.source_idx, r.code, r.supplier, r.recommended_qty, r.order_qty, r.order_sum) for r in Wk.read_price_lists(spark, [one, two], {two: "ООО Мебель"}).collect())
    assert got == [(0, "A1", "b", 2.5, 3.0, 15.75), (1, "12", "ООО Мебель", None, None, None)]
    empty = book(spark, tmp_path / "e.xlsx", Прайс=(head, [["A1", "Весы", None, 0, None, None]]))
    (tmp_path / "bad.xlsx").write_bytes(b"nothing")
    assert Wk.check_price_list(spark, one, "x") == (1, None) and Wk.check_price_list(spark, empty, "x") == (0, Wk.REFUSED["empty"])
    assert Wk.check_price_list(spark, "/tmp/a.csv", "x") == (0, Wk.REFUSED["kind"])
    n, why = Wk.check_price_list(spark, str(tmp_path / "bad.xlsx"), "x")
    assert n == 0 and why.startswith(Wk.REFUSED["unread"])


def test_a_workbook_for_each_request(spark, tmp_path):
    first = spark.createDataFrame([(r, k, f"имя & {r}.{k}", k + 0.5, None) for r in range(3) for k in range(1, 4)], "request_id long, row int, name string, price double, note string")
    second = spark.createDataFrame([(1, 1, 7)], "request_id long, row int, n long")
    books = Wk.workbooks({"КП": first.repartition(4), "Сводка": second}, ["request_id"])
    rows = books.collect()
    assert sorted(r.request_id for r in rows) == [0, 1, 2]
    held = {r.request_id: list(Wk.workbook_rows(bytes(r.content))) for r in rows}
    assert held[1] == [("КП", 1, ["name", "price", "note"], [None] * 3), *[("КП", k + 1, [f"имя & 1.{k}", f"{k + 0.5}"], [None, k + 0.5]) for k in (1, 2, 3)], ("Сводка", 1, ["n"], [None]), ("Сводка", 2, ["7"], [7.0])]
    assert held[2][-1] == ("Сводка", 1, ["n"], [None])
