"""Registered queries: matching by name, web pages, personal data, chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tendril.functions import intent, pii
from tendril.functions import text as T
from tendril.functions import web as Wb
from tendril.operators import jsonwalk as Jw
from tendril.operators import matching as M
from tendril.operators import quotes as Q
from tendril.operators import requests as Rq
from tendril.operators import results as R
from tendril.plans.quoting import CATALOG_SQL
from tendril.sources.tables import catalog, load, spread

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct part names (queries) with their least key."""
    return load(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("query")).agg(F.min("p_partkey").alias("item_id"))


def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).groupBy(T.normalize_name("name").alias("choice")).agg(F.min("row_idx").alias("row_idx"), F.min("name").alias("name"))


NAMES_SQL = f"""WITH {CATALOG_SQL}, q AS (SELECT lower(p_name) AS query, min(p_partkey) AS item_id FROM part GROUP BY 1),
c AS (SELECT lower(name) AS choice, min(row_idx) AS row_idx FROM catalog GROUP BY 1)"""


@query(
    "token_subset_block",
    NAMES_SQL
    + """, qw AS (SELECT query, unnest(list_distinct(string_split(query, ' '))) AS word FROM q), cw AS (SELECT choice, unnest(list_distinct(string_split(choice, ' '))) AS word FROM c),
qn AS (SELECT query, count(*) AS a FROM qw GROUP BY query), cn AS (SELECT choice, count(*) AS b FROM cw GROUP BY choice),
met AS (SELECT query, choice, count(*) AS n FROM qw JOIN cw USING (word) GROUP BY query, choice)
SELECT m.query, m.choice FROM met m JOIN qn USING (query) JOIN cn USING (choice) WHERE n >= least(a, b)""",
)
def token_subset_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose words hold all of a query's, by an inverted index."""
    return M.token_subsets(part_names(spark, sf_dir), catalog_names(spark, sf_dir))


@query(
    "containment_adjust",
    NAMES_SQL
    + """, p AS (SELECT query, choice, strpos(choice, query) > 0 AS inside, 100.0 * len(list_intersect(list_distinct(string_split(query, ' ')), string_split(choice, ' '))) / len(list_distinct(string_split(query, ' '))) AS base FROM q, c),
s AS (SELECT query, choice, CASE WHEN query = choice THEN 100.0 ELSE least(CASE WHEN inside OR strpos(query, choice) > 0 THEN greatest(base, 95.0) ELSE base END + CASE WHEN inside THEN least(length(choice) - length(query), 20) * 0.3 ELSE 0.0 END, 100.0) END AS score FROM p)
SELECT query, choice, CAST(score AS DOUBLE) AS score FROM s WHERE score >= 70""",
)
def containment_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 over every pair of names, the share of common words being the score
    that is adjusted."""
    met = M.pairs(part_names(spark, sf_dir), catalog_names(spark, sf_dir))
    met = met.withColumn("score", T.adjust_score(F.col("query"), F.col("choice"), 100 * T.token_overlap(F.col("query"), F.col("choice"))))
    return met.filter(F.col("score") >= T.SIMILAR_THRESHOLD).select("query", "choice", "score")


@query(
    "token_overlap_topk",
    NAMES_SQL
    + """, qw AS (SELECT query, unnest(list_distinct(string_split(query, ' '))) AS word FROM q), cw AS (SELECT choice, unnest(list_distinct(string_split(choice, ' '))) AS word FROM c),
qn AS (SELECT query, count(*) AS a FROM qw GROUP BY query), met AS (SELECT query, choice, count(*) AS n FROM qw JOIN cw USING (word) GROUP BY query, choice),
r AS (SELECT query, choice, CAST(n AS DOUBLE) / a AS overlap, row_number() OVER (PARTITION BY query ORDER BY CAST(n AS DOUBLE) / a DESC, length(choice) DESC, choice) AS rank FROM met JOIN qn USING (query))
SELECT query, choice, overlap, rank FROM r WHERE rank <= 5""",
)
def token_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five names with the largest share of a query's words."""
    met = M.blocked_pairs(part_names(spark, sf_dir), catalog_names(spark, sf_dir), share=0.0)
    met = met.withColumn("overlap", T.token_overlap(F.col("query"), F.col("choice"))).filter("overlap > 0")
    return M.top(met, ["query"], [F.desc("overlap"), F.desc(F.length("choice")), F.col("choice")], 5)


@query("fuzzy_topk")
def fuzzy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part name against all part names, best five."""
    names = part_names(spark, sf_dir)
    met = M.scored(M.pairs(names, names.withColumnRenamed("query", "choice")))
    return M.top(met, ["query"], [F.desc("score"), F.col("choice")], 5)


@query("candidate_search")
def candidate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items (part names, a brand as specification) searched in
    the catalog."""
    items = load(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("item_id"), F.min("p_brand").alias("specifications"))
    rows = catalog_names(spark, sf_dir).select("row_idx", "name")
    return M.best_fuzzy(items.select("item_id", F.col("p_name").alias("name"), "specifications"), rows)


@query(
    "required_tokens",
    r"""WITH d AS (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS line, lang FROM documents),
w AS (SELECT doc_id, lower(word) AS word, min(i) AS i FROM (SELECT doc_id, unnest(regexp_extract_all(line, '[A-Za-zА-Яа-яЁё0-9]+')) AS word, generate_subscripts(regexp_extract_all(line, '[A-Za-zА-Яа-яЁё0-9]+'), 1) AS i FROM d WHERE line <> '' AND NOT line LIKE '%:') GROUP BY 1, 2),
t AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM w WHERE length(word) >= 5 OR (length(word) >= 3 AND regexp_matches(word, '[0-9]')))
SELECT doc_id, count(*) AS n_tokens, min(word) AS least_token, max(word) AS last_token FROM t WHERE nth <= 8 GROUP BY doc_id""",
)
def required_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """telling words of a document's first line."""
    found = load(spark, sf_dir, "documents").select("doc_id", T.required_tokens(F.lit("none"), F.col("text")).alias("t")).filter(F.size("t") > 0)
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_min("t").alias("least_token"), F.array_max("t").alias("last_token"))


WEB_SQL = r"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, lower(coalesce(url, '')) AS low, CASE WHEN page_id % 4 = 0 THEN NULL ELSE CAST(page_id AS DOUBLE) END AS price, CASE WHEN page_id % 3 = 0 THEN 90.0 ELSE 100.0 END AS score,
  CASE WHEN page_id % 6 = 0 THEN 'https://www.ozon.ru/product/' || CAST(page_id AS VARCHAR) WHEN page_id % 7 = 0 THEN 'https://www.ozon.ru/search/?text=a' WHEN page_id % 11 = 0 THEN 'https://market.yandex.ru/x' ELSE coalesce(url, '') END AS link, page_id % 20 AS item FROM pages),
k AS (SELECT *, link LIKE '%ozon.ru%' OR link LIKE '%market.yandex.ru%' AS market, link LIKE '%/search?%' OR link LIKE '%/search/%' OR link LIKE '%search?text=%' OR link LIKE '%?q=%' AS listing FROM p),
g AS (SELECT *, NOT listing AND (link LIKE '%ozon.ru/product/%' OR (NOT market AND regexp_matches(lower(link), '^https?://'))) AS product FROM k),
t AS (SELECT *, CASE WHEN listing OR price IS NULL OR score < 100 THEN 9 WHEN NOT market THEN 0 WHEN product THEN 1 ELSE 2 END AS tier FROM g)"""


def web_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as web quotes of twenty items; prices and scores from keys."""
    key = F.col("page_id")
    link = F.when(key % 6 == 0, F.concat(F.lit("https://www.ozon.ru/product/"), key.cast("string"))).when(key % 7 == 0, "https://www.ozon.ru/search/?text=a").when(key % 11 == 0, "https://market.yandex.ru/x")
    return load(spark, sf_dir, "pages").select(
        key.alias("pos"),
        (key % 20).alias("item"),
        F.lit("web").alias("source"),
        F.coalesce(link, F.col("url"), F.lit("")).alias("url"),
        F.when(key % 4 != 0, key.cast("double")).alias("price"),
        F.when(key % 3 == 0, 90.0).otherwise(100.0).alias("match_score"),
    )


@query(
    "web_quote_rank",
    WEB_SQL + " SELECT item, page_id AS pos, tier, row_number() OVER (PARTITION BY item ORDER BY tier, CASE WHEN product THEN 0 ELSE 1 END, -score, CASE WHEN price IS NULL THEN 1 ELSE 0 END, page_id) AS place FROM t",
)
def web_quote_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web quotes of each item, best first."""
    quotes = web_quotes(spark, sf_dir)
    tier = Wb.quote_tier(F.col("url"), F.col("match_score"), F.col("price"))
    return Q.sorted_quotes(quotes, ["item"]).select("item", "pos", tier.alias("tier"), "place")


@query(
    "best_web_quote",
    WEB_SQL
    + """, a AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY tier, CASE WHEN product THEN 0 ELSE 1 END, page_id) AS nth FROM t WHERE score >= 100 AND price IS NOT NULL AND NOT listing AND (NOT market OR product))
SELECT item, page_id AS pos, price, link AS url FROM a WHERE nth = 1""",
)
def best_web_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: the best acceptable web quote of each item."""
    return Q.best_web(web_quotes(spark, sf_dir), ["item"]).select("item", "pos", "price", "url")


@query(
    "preferred_quotes",
    WEB_SQL + " SELECT item, page_id AS pos FROM t WHERE score >= 100 AND NOT listing AND NOT link LIKE '%ozon%'",
)
def preferred_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quotes left when one marketplace is excluded."""
    return Q.filter_quotes(web_quotes(spark, sf_dir), ["registry"], ["Ozon"]).select("item", "pos")


@query(
    "page_title_clean",
    r"""WITH t AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') AS raw FROM pages),
u AS (SELECT page_id, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS title FROM t)
SELECT page_id, title, trim(regexp_replace(regexp_replace(lower(title), '[«»"'']', '', 'g'), '\s*[-|]\s*[^-|]+$', '')) AS cleaned FROM u""",
)
def page_title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without markup, shop words and last part."""
    rows = load(spark, sf_dir, "pages").select("page_id", Wb.page_title(F.coalesce("html", F.lit(""))).alias("title"))
    return rows.select("page_id", "title", Wb.clean_title(F.col("title")).alias("cleaned"))


@query(
    "pages_by_platform",
    r"""WITH h AS (SELECT replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'www.', '') AS host FROM pages)
SELECT CASE WHEN host = '' THEN 'Интернет' ELSE upper(substr(split_part(host, '.', 1), 1, 1)) || substr(split_part(host, '.', 1), 2) END AS platform, count(*) AS n FROM h GROUP BY 1""",
)
def pages_by_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the label of their host."""
    return load(spark, sf_dir, "pages").groupBy(Wb.platform_label(F.col("url")).alias("platform")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "marketplace_links",
    """SELECT p_name, 'https://www.ozon.ru/search/?text=' || replace(p_name, ' ', '+') AS ozon, 'https://market.yandex.ru/search?text=' || replace(p_name, ' ', '+') AS yandex FROM (SELECT DISTINCT p_name FROM part)""",
)
def marketplace_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search addresses of each part name."""
    names = load(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", Wb.marketplace_search("Ozon", F.col("p_name")).alias("ozon"), Wb.marketplace_search("Яндекс.Маркет", F.col("p_name")).alias("yandex"))


@query(
    "page_prices",
    """WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages)
SELECT page_id, 3 + len(regexp_extract_all(html, '(?i)data-price=[\\"'']\\d')) + len(regexp_extract_all(html, '(?i)(?:₽|руб)')) AS n_prices, CAST(page_id + 10 AS DOUBLE) AS price FROM t""",
)
def page_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices on a page and their upper median; pages carry none
    of their own, so three are written in, the key's twice."""
    text = F.concat(F.lit('{"price": "'), (F.col("page_id") + 10).cast("string"), F.lit('"} 1 200,50 ₽ '), F.coalesce("html", F.lit("")))
    rows = load(spark, sf_dir, "pages").select("page_id", Wb.prices(text).alias("prices"))
    return rows.select("page_id", F.size("prices").cast("long").alias("n_prices"), Wb.upper_median(F.col("prices")).alias("price"))


PII_PLAIN = ["EMAIL", "SNILS", "PASSPORT", "CARD", "BANK_ACCOUNT", "IP"]


def _pii_sql() -> str:
    steps, text = [], "text"
    for name, pattern in pii.PATTERNS:
        if name in PII_PLAIN:
            steps.append((name, text, pattern.replace("'", "''")))
            text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '[{name}]', 'g')"
    cols = ", ".join(f"CAST(sum(len(regexp_extract_all({t}, '{p}'))) AS BIGINT) AS {n.lower()}" for n, t, p in steps)
    return f"SELECT lang, {cols} FROM documents GROUP BY lang"


@query("pii_counts", _pii_sql())
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds by category and language, earlier categories masked first."""
    docs = pii.counted(load(spark, sf_dir, "documents").select("lang", "text"), "text", PII_PLAIN, unicode=False)
    return docs.groupBy("lang").agg(*[F.sum(n.lower()).alias(n.lower()) for n in PII_PLAIN])


@query(
    "pii_mask",
    "SELECT doc_id, md5(" + r"""regexp_replace(regexp_replace(text, '\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b', '[EMAIL]', 'g'), '\b\d{1,3}(?:\.\d{1,3}){3}\b', '[IP]', 'g')""" + ") AS masked_md5 FROM documents",
)
def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with e-mail and network addresses masked."""
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(pii.mask(F.col("text"), ["EMAIL", "IP"], unicode=False).cast("binary")).alias("masked_md5"))


#: A piece of text for each category: what stays and what is found.
PII_PIECES = [
    ("URL", "сайт ", "https://shop.example/{k}"), ("EMAIL", "почта ", "user{k}@shop.example"), ("SNILS", "снилс ", "111-222-333 44"), ("INN", "", "ИНН 1234567890"), ("KPP", "", "КПП 111111111"),
    ("OGRN", "", "ОГРН 1111111111111"), ("PASSPORT", "паспорт ", "1234 567890"), ("PHONE", "тел. ", "+7 (999) 123-45-67"), ("CARD", "карта ", "1111 2222 3333 4444"), ("BANK_ACCOUNT", "счёт ", "11111111111111111111"),
    ("BIK", "", "БИК 222222222"), ("USERNAME", "", "@user_{k}"), ("IP", "узел ", "10.0.0.1"), ("ADDRESS", "", "г. Тихвин"), ("FIO", "", "Петров Пётр Петрович"),
]
_PIECES_SQL = ", ".join(f"CASE WHEN (c_custkey >> {j}) % 2 = 0 THEN '{before}[{name}]' END" for j, (name, before, _) in enumerate(PII_PIECES))
_FOUND_SQL = ", ".join(f"CAST((c_custkey >> {j}) % 2 = 0 AS BIGINT) AS {name.lower()}" for j, (name, *_) in enumerate(PII_PIECES))


@query("pii_categories", f"SELECT c_custkey, concat_ws(chr(10), {_PIECES_SQL}) AS masked, {_FOUND_SQL} FROM customer")
def pii_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fifteen categories in Russian text: a sentence of each
    customer with those that its number's bits name."""
    key = F.col("c_custkey")
    pieces = [F.when(F.shiftright(key, j) % 2 == 0, F.concat(F.lit(before), F.replace(F.lit(found), F.lit("{k}"), key.cast("string")))) for j, (_, before, found) in enumerate(PII_PIECES)]
    rows = spread(load(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.concat_ws("\n", *pieces).alias("text"))
    names = [name for name, *_ in PII_PIECES]
    return pii.counted(rows, "text", names, masked="masked").select("c_custkey", "masked", *[n.lower() for n in names])


@query("pii_tokens")
def pii_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered tokens, and whether they restore the text."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    masked = pii.anonymize(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")
    back = pii.restore(F.col("masked"), F.col("tokens"))
    return masked.join(docs, "doc_id").select("doc_id", F.size("tokens").alias("n_tokens"), (F.regexp_replace(back, r"(?U)\s", "") == F.regexp_replace("text", r"(?U)\s", "")).alias("restored"))


PHRASES = ["Найди в каталогах позиции №3 и №12, наценка 12,5%", "сформируй excel", "Запомни правило: без интернета", "задача 1+2, конкуренты", "пересчитай все по составу, убери ozon"]
_PHRASE_SQL = " ".join(f"WHEN {k} THEN '. {p}'" for k, p in enumerate(PHRASES))


@query(
    "chat_intent",
    f"""WITH m AS (SELECT conv_id, turn, turn % 6 AS k, text || CASE turn % 6 {_PHRASE_SQL} ELSE '' END AS message FROM conversations)
SELECT conv_id, turn, CASE WHEN k IN (2, 3, 4) THEN 'task1_task2' END AS task_mode, k IN (0, 2, 3, 4) AS run_local_search, k IN (2, 3, 4) AS run_web_search, k = 1 AS generate_excel,
       CASE k WHEN 0 THEN 12.5 END AS markup_percent, CASE k WHEN 0 THEN 2 ELSE 0 END AS n_reprocess, k = 4 AS reprocess_all, CASE k WHEN 2 THEN trim(substr(message, strpos(message, ':') + 1)) END AS save_rule, CASE k WHEN 4 THEN 'Ozon' ELSE '' END AS excluded
FROM m""",
)
def chat_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X31 over every chat turn's own text, with a request of the engine's
    language behind five of six."""
    message = F.col("text")
    for k, phrase in enumerate(PHRASES):
        message = F.when(F.col("turn") % 6 == k, F.concat("text", F.lit(f". {phrase}"))).otherwise(message)
    flags = intent.detect(message, F.lit(True), F.lit(True))
    return load(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        *[flags[c].alias(c) for c in ("task_mode", "run_local_search", "run_web_search", "generate_excel", "markup_percent", "reprocess_all", "save_rule")],
        F.size(flags["reprocess_items"]).alias("n_reprocess"),
        F.array_join(flags["excluded_platforms_add"], ",").alias("excluded"),
    )


SESSIONS_SQL = "WITH s AS (SELECT user_id AS session_id, min(ts) AS created_at FROM events GROUP BY user_id)"


@query(
    "session_ttl",
    SESSIONS_SQL + " SELECT session_id, created_at FROM s WHERE created_at >= (SELECT max(created_at) FROM s) - INTERVAL 8 HOURS ORDER BY created_at DESC, session_id DESC LIMIT 30",
)
def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions (first event of a user) alive when the last one starts; at
    most thirty."""
    events = load(spark, sf_dir, "events")
    sessions = events.groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("created_at"))
    now = F.lit(sessions.agg(F.max("created_at")).first()[0])
    return R.alive_sessions(sessions, now)


@query(
    "recent_lookups",
    """WITH l AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS place FROM l)
SELECT user_id, event_type, ts, place FROM r WHERE place <= 3""",
)
def recent_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's last distinct event types, newest first."""
    return R.recent_distinct(load(spark, sf_dir, "events"), ["user_id"], "event_type", "ts", "event_id", 3)


@query(
    "request_rows",
    r"""WITH t AS (SELECT l_orderkey AS request_id, CAST(l_linenumber AS VARCHAR) || '.' AS number, 'item ' || CAST(l_partkey AS VARCHAR) AS name, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'кг' END AS unit,
  CASE WHEN l_suppkey % 5 = 0 THEN 'bad' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',5' END AS qty FROM lineitem)
SELECT request_id, CAST(replace(number, '.', '') AS INTEGER) AS number, name, CASE WHEN unit = '' THEN 'шт.' ELSE unit END AS unit, CASE WHEN qty = 'bad' THEN 1.0 ELSE CAST(replace(qty, ',', '.') AS DOUBLE) END AS quantity FROM t""",
)
def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table rows as request items, written out as text first."""
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.array(
            F.concat(F.col("l_linenumber").cast("string"), F.lit(".")),
            F.concat(F.lit("item "), F.col("l_partkey").cast("string")),
            F.when(F.col("l_suppkey") % 4 == 0, "").otherwise("кг"),
            F.when(F.col("l_suppkey") % 5 == 0, "bad").otherwise(F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(",5"))),
        ).alias("cells"),
    )
    return Rq.request_items(rows).select("request_id", "number", "name", "unit", "quantity")


#: Lines that a task puts together as texts.
LINES_A_TASK = 400_000


@query("request_tables", "SELECT l_orderkey AS request_id, count(*) AS n_items, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def request_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables found in plain text; each order is written as one."""
    head = F.lit("№\tНаименование\tЕд.\tКол-во")
    line = F.concat_ws("\t", F.col("l_linenumber").cast("string"), F.concat(F.lit("item "), F.col("l_partkey").cast("string")), F.lit("шт"), F.col("l_quantity").cast("string"))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    # As many tasks as the lines need, so that none holds more at any size.
    rows = rows.repartition(max(8, -(-rows.count() // LINES_A_TASK)), "l_orderkey")
    texts = rows.groupBy(F.col("l_orderkey").alias("request_id")).agg(F.concat_ws("\n", F.lit("Заявка"), head, F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("Итого")).alias("text"))
    return Rq.text_tables(texts, "request_id", "text").groupBy("request_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("quantity").alias("quantity"))


@query(
    "spec_previews",
    r"""WITH s AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS flat FROM documents)
SELECT doc_id, CASE WHEN length(flat) > 200 THEN substr(flat, 1, 199) || '…' ELSE flat END AS preview FROM s""",
)
def spec_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts on one line, cut with an ellipsis."""
    return load(spark, sf_dir, "documents").select("doc_id", T.spec_preview(F.col("text"), 200).alias("preview"))


@query("product_lookup")
def product_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text lookups (part names) in the catalog: the ranked block of
    each, its primary hit first."""
    names = part_names(spark, sf_dir)
    rows = catalog_names(spark, sf_dir)
    met = M.scored(M.pairs(names, rows)).filter(F.col("score") >= T.SIMILAR_THRESHOLD)
    hits = met.join(rows, "choice").withColumn("score", T.adjust_score(F.col("query"), F.col("choice"), F.col("score")))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "row_idx")))
    return M.rank_hits(hits, ["query"]).select("query", "name", "score", "place", (F.col("place") == 1).alias("is_primary"))


@query(
    "json_walk",
    """SELECT p_partkey, '{"deep":[{"a":[' || p_size || ',{"n":"[EMAIL]"}]},[],{}],"item":{"name":"' || p_name || '","price":' || CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END || '},"none":null,"note":"к [IP] \\"x\\""' || CASE WHEN p_partkey % 2 = 0 THEN ',"ok":true' ELSE '' END || '}' AS json FROM part""",
)
def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested document of each part without links and contacts at any
    depth, its texts masked."""
    c, text = F.col, lambda x: x.cast("string")
    price = F.when(c("p_retailprice") == F.floor("p_retailprice"), text(c("p_retailprice").cast("long"))).otherwise(text(c("p_retailprice")))
    doc = F.concat(
        F.lit('{"note": "к 10.0.0.1 \\"x\\"", "URL": "https://a.example", "item": {"price": '), price, F.lit(', "name": "'), c("p_name"), F.lit('", "Contact": {"fio": "x"}}, "none": null, "deep": [{"link": 1, "a": ['), text(c("p_size")),
        F.lit(', {"n": "u@b.example", "email": "y"}]}, [], {"phone": 5}]'), F.when(c("p_partkey") % 2 == 0, ', "ok": true').otherwise(""), F.lit("}"),
    )
    return Jw.anonymize(spread(load(spark, sf_dir, "part"), "p_partkey").select("p_partkey", doc.alias("doc")), "p_partkey", "doc")
