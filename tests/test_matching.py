from pyspark.sql import functions as F

from tendril.functions import intent, pii, pricing
from tendril.functions import text as T
from tendril.functions import web as W
from tendril.functions.similarity import name_score
from tendril.operators import catalog as C
from tendril.operators import matching as M
from tendril.operators import quotes as Q
from tendril.operators import requests as Rq
from tendril.operators import results as R


def one(spark, value, *exprs):
    row = spark.createDataFrame([(value,)], "x string").select(*[e.alias(f"c{k}") for k, e in enumerate(exprs)]).first()
    return list(row)


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, '  Весы "А"  Б ', T.normalize_name(x)) == ["весы а б"]
    assert one(spark, 'a " b', T.normalize_name(x)) == ["a  b"]
    assert one(spark, "1.2. Микрофон JBL – соответствие\nдругое", T.primary_spec_line(x)) == ["Микрофон JBL"]
    assert one(spark, "Набор включает следующие:", T.is_kit_header(T.primary_spec_line(x))) == [True]
    assert one(spark, 'ООО "Ромашка"', T.looks_like_supplier(x)) == [True]
    assert one(spark, "просто имя", T.looks_like_supplier(x)) == [False]
    assert one(spark, " 1,5 ", T.optional_number(x)) == [1.5]
    assert one(spark, "x", T.optional_number(x)) == [None]
    assert one(spark, "микрофон беспроводной shure sm58 шт", T.required_tokens(F.lit("микрофон"), x)) == [["беспроводной", "shure", "sm58"]]
    assert one(spark, "dvd диск", T.category_conflict(F.lit("микрофон"), F.lit(""), x)) == [True]
    assert one(spark, "гипсовая голова", T.distinctive_mismatch(x, F.lit("гипсовый шар"))) == [True]
    assert one(spark, "Прайс 2024!", T.slug(x)) == ["2024"]
    assert one(spark, "Прайс", T.slug(x)) == ["price"]
    assert one(spark, "1234.5", T.money_text(x.cast("double"))) == ["1 234.50 ₽"]


def test_relevance_cases(spark):
    rows = [  # name, specs, choice, score, expected
        ("весы", "", "", 100.0, False),
        ("микрофон", "", "dvd микрофон", 100.0, False),
        ("весы", "", "весы лабораторные", 100.0, True),
        ("колба", "пробирка стеклянная", "стакан пластик", 96.0, False),
        ("колба", "", "кобла", 92.0, False),
        ("колба", "стакан мерный", "стакан мерный", 99.0, True),
        ("колба", "мерный", "нечто", 99.0, False),
    ]
    data = [(n, s, c, r, e, name_score(n, c), name_score(s, c) if s and s != n else None) for n, s, c, r, e in rows]
    df = spark.createDataFrame(data, "name string, specs string, choice string, score double, want boolean, of_name double, of_spec double")
    got = df.withColumn("got", M.is_relevant(F.col("name"), F.col("specs"), F.col("choice"), F.col("of_name"), F.col("of_spec"), F.col("score"))).collect()
    assert [(r.name, r.choice, r.got) for r in got] == [(r.name, r.choice, r.want) for r in got]


def test_candidates_and_blocks(spark):
    items = spark.createDataFrame([(1, "весы", ""), (2, "весы лабораторные", "точность 5 мг"), (3, "нет такого", "")], "item_id int, name string, specifications string")
    rows = spark.createDataFrame([(k, f"Весы лабораторные {k}") for k in range(12)] + [(20, "Стул")], "row_idx int, name string")
    got = [(r.item_id, r.row_idx) for r in M.best_fuzzy(items, rows).orderBy("item_id", "rank").collect()]
    # Equal scores keep the eight lowest rows first; longer names then win the bonus.
    assert {i for i, _ in got} == {1, 2} and len(got) == 10 and all(k < 8 for _, k in got)
    q = spark.createDataFrame([("a b",), ("c",)], "query string")
    c = spark.createDataFrame([("b a d",), ("a",), ("x c",), ("z",)], "choice string")
    assert sorted(map(tuple, M.token_subsets(q, c).collect())) == [("a b", "a"), ("a b", "b a d"), ("c", "x c")]


def test_catalog_and_kits(spark):
    rows = [(1, "Комплект А", None, 10.0), (2, "Составляющие А", None, None), (3, "деталь", 1.0, None), (4, "комплект мал", 2.0, 3.0), (5, "Раздел", None, None), (6, "прочее", 1.0, 1.0)]
    df = C.classify(spark.createDataFrame([("s", *r) for r in rows], "sheet string, row_idx int, name string, cost double, price double"), ["sheet"])
    got = [(r.entry_type, r.components_group) for r in df.orderBy("row_idx").collect()]
    assert got == [("kit_total", None), ("components_header", "Составляющие А"), ("item", "Составляющие А"), ("sub_kit", "Составляющие А"), ("section", None), ("item", None)]
    specs = [("Состав комплекта: гипсовая ваза, гипсовая рука; шар; Шар\nкуб",), ("Комплект:\n1) стол\n2) стул;\nпросто текст",), ("1) стол\n2) стул;\nпросто текст",), (None,)]
    lists = [r.components for r in C.kit_components(spark.createDataFrame(specs, "specifications string")).collect()]
    assert lists == [["гипсовая ваза", "гипсовая рука", "шар", "куб"], ["стол", "стул"], [], []]  # a list of a text that speaks of no kit is none


def test_quotes_and_ladder(spark):
    quotes = spark.createDataFrame([("i", "web", "https://shop.ru/a", 100.0, 5.0, None, 0), ("i", "web", "https://www.ozon.ru/search/?text=a", 100.0, 4.0, None, 1), ("i", "catalog", None, 96.0, 7.0, None, 2), ("i", "price_list", None, 95.0, 8.0, None, 3), ("i", "goods", None, 85.0, 1.0, None, 4)], "item string, source string, url string, match_score double, price double, cost double, pos int")
    assert Q.best_local(quotes, ["item"]).first().source == "price_list"
    assert Q.best_local(quotes, ["item"], Q.RESELECT_PRIORITY).first().source == "catalog"
    assert Q.best_web(quotes, ["item"]).first().pos == 0
    assert [r.pos for r in Q.sorted_quotes(quotes, ["item"]).orderBy("place").collect()] == [2, 3, 4, 0, 1]
    assert sorted(r.pos for r in Q.filter_quotes(quotes, ["price_list"]).collect()) == [0, 2]
    assert sorted(r.pos for r in Q.filter_quotes(quotes, [], ["Shop"]).collect()) == [2, 3]


def test_requests(spark):
    text = "Заявка\n№\tНаименование\tЕд.\tКол-во\nпояснение\n1.\tСтол\t\t2,5\n2\tСтул\tшт\tмного\nИтого\n3\tне входит\tшт\t1"
    got = Rq.text_tables(spark.createDataFrame([("r", text), ("e", None)], "id string, text string"), "id", "text").orderBy("number").collect()
    assert [(r.number, r.name, r.unit, r.quantity) for r in got] == [(1, "Стол", "шт.", 2.5), (2, "Стул", "шт", 1.0)]


def test_web(spark):
    x = F.col("x")
    assert one(spark, "Купить Весы АБ купить в - Магазин", W.clean_title(x)) == ["весы аб купить в"]
    assert one(spark, "1 200,50", W.parse_price(x)) == [1200.5]
    assert one(spark, "1,200.50", W.parse_price(x)) == [1200.5]
    assert one(spark, "5", W.parse_price(x)) == [None]
    assert one(spark, '{"price": "990"} за 1 200,50 ₽ ', W.prices(x)) == [[990.0, 1200.5, 990.0]]
    assert one(spark, "https://d.com/l/?uddg=https%253A%252F%252Fshop.ru%252Fa&x=1", W.unwrap_redirect(x)) == ["https://shop.ru/a"]
    assert one(spark, "https://www.wildberries.ru/catalog/12/detail.aspx", W.is_product_page(x), W.is_marketplace(x)) == [True, True]
    assert one(spark, "Весы лабораторные - купить", W.exact_title(F.lit("Весы лабораторные"), x, F.lit(""), F.lit(0.0))) == [True]


def test_pii_round_trip(spark):
    text = "Пишите a.b@c.ru и a.b@c.ru, тел. +7 912 345-67-89, ИНН 7707083893, IP 10.0.0.1, Иванов Иван Иванович, ул. Мира 5"
    row = pii.anonymize(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id", "text").withColumn("back", pii.restore(F.col("masked"), F.col("tokens"))).orderBy("id").collect()
    assert row[0].back == text and row[1].back == ""
    assert "[EMAIL_1]" in row[0].masked and "[EMAIL_2]" not in row[0].masked
    for secret in ("a.b@c.ru", "912", "7707083893", "10.0.0.1", "Иванович", "Мира"):
        assert secret not in row[0].masked


def test_intents_and_pricing(spark):
    x = F.col("x")
    flags = intent.detect(x, F.lit(True), F.lit(False))
    assert one(spark, "задача 1: только поиск", flags["task_mode"], flags["run_local_search"], flags["run_web_search"]) == ["task1", True, False]
    assert one(spark, "пересчитай позиции 3 и № 4", flags["reprocess_items"]) == [[3, 4]]
    assert one(spark, "отключи интернет", flags["disabled_sources_add"]) == [["web"]]
    assert one(spark, "100", pricing.unit_price(x.cast("double"), F.lit(False)), pricing.unit_price(x.cast("double"), F.lit(True))) == [130.0, 95.0]
    assert one(spark, "2.675", pricing.line_total(x.cast("double"), F.lit(1.0))) == [2.68]


def test_sessions(spark):
    s = spark.sql("SELECT id session_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 600) created_at FROM range(100)")
    alive = R.alive_sessions(s, F.to_timestamp(F.lit("2024-01-01 16:30:00")))
    assert sorted(r.session_id for r in alive.collect()) == list(range(70, 100))


def test_blocks_of_queries_change_no_result(spark, monkeypatch):
    names = ["микрофон", "микрафон", "аудио система", "аудиосистема", "весы лабораторные", "весы лабораторной", "стол письменный белый дуб", "стол дубовый", "стул"]
    items = spark.createDataFrame([(k, n, "") for k, n in enumerate(names)], "item_id int, name string, specifications string")
    rows = spark.createDataFrame(list(enumerate(names)), "row_idx int, name string")
    q = spark.createDataFrame([(n,) for n in names], "query string")
    result = lambda: (sorted(map(tuple, M.scored(M.pairs(q, q.withColumnRenamed("query", "choice"))).collect())), sorted(map(tuple, M.best_fuzzy(items, rows).collect())))
    whole = result()
    monkeypatch.setattr(M, "MOST_QUERIES", 2)
    assert result() == whole and len(whole[0]) == len(names) ** 2
    assert "CartesianProduct" in M.pairs(q, q.withColumnRenamed("query", "choice"))._jdf.queryExecution().toString()


def test_an_address_is_no_code(spark):
    """Of 56.187.231.175 the first three numbers are no item's code."""
    lines = spark.createDataFrame([("56.187.231.175 Keit in lich auf",), ("1.2. Весы",), ("1.2.Весы",)], "x string")
    assert [r[0] for r in lines.select(T.primary_spec_line(F.col("x"))).collect()] == ["56.187.231.175 Keit in lich auf", "Весы", "Весы"]
