"""Registered queries: kits, close names, sessions, re-runs, preferences,
candidates as nested rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tendril.functions import text as T
from tendril.operators import blocks as B
from tendril.operators import catalog as C
from tendril.operators import fuzzyjoin as Fz
from tendril.operators import preferences as Pf
from tendril.operators.store import ResultStore
from tendril.plans.quoting import CATALOG_SQL
from tendril.plans.texts import catalog_names, part_names
from tendril.sources.shared import new_folder, written
from tendril.sources.tables import catalog, load, price_list, registry, request_lines
from tendril.streaming import sessions as Ss

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


#: How a part's words are written as a specification, and which of them (a, b, c,
#: the words of its name and type) a reader finds; one for each branch.
SPECIFICATIONS = [
    ("Состав комплекта: {a}; {b}; {c}; {a}", "abc"),
    ("Комплектация: 1) {a} 2) {b} 3) {c}", "abc"),
    ("1. {a}\n2. {b}\n{c};", ""),
    ("Комплект приборов:\n1. {a}\n2) {b}\n- {c}\nМасса 5 кг", "ab"),
    ("В комплект входят: {a};\n{b};\n{c}.", "xb"),
    ("Состав комплекта: {a}, гипсовая {b}, {c}", "gh"),
    ("Состав комплекта: 1. {a} 2. {b}", "ab"),
    ("Комплект включает следующее\n1: {a};\n2- {b}\nокпд {c};", "nb"),
    ("{a} {b} {c}", ""),
]
_WORDS = "(SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, lower(p_type) AS c FROM part)"


def _found_sql(letters: str) -> str:
    """The distinct words that a reader finds, in order."""
    cells = {"a": "a", "b": "b", "c": "c", "x": "'ят: ' || a", "n": "'1: ' || a", "g": "a", "h": "'гипсовая ' || b || ', ' || c"}
    return "[" + ", ".join(cells[x] for x in letters) + "]"


@query(
    "kit_components",
    "WITH w AS "
    + _WORDS
    + ", l AS (SELECT p_partkey, CASE p_partkey % 9 "
    + " ".join(f"WHEN {k} THEN {_found_sql(letters)}" for k, (_, letters) in enumerate(SPECIFICATIONS) if letters)
    + """ ELSE [] END AS names FROM w), e AS (SELECT p_partkey, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM l), d AS (SELECT p_partkey, name, min(i) AS i FROM e WHERE length(name) >= 3 GROUP BY 1, 2)
SELECT l.p_partkey, count(d.name) AS n_components, coalesce(string_agg(d.name, '|' ORDER BY d.i), '') AS components FROM l LEFT JOIN d USING (p_partkey) GROUP BY 1""",
)
def kit_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kit contents listed in a specification; every part's own is
    written from its words, in nine ways."""
    words = load(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b"), F.lower("p_type").alias("c"))
    specs = F.lit(None).cast("string")
    for k, (form, _) in enumerate(SPECIFICATIONS):
        text = F.lit(form)
        for x in "abc":
            text = F.replace(text, F.lit(f"{{{x}}}"), F.col(x))
        specs = F.when(F.col("p_partkey") % len(SPECIFICATIONS) == k, text).otherwise(specs)
    out = C.kit_components(words.select("p_partkey", specs.alias("specifications")))
    return out.select("p_partkey", F.size("components").cast("long").alias("n_components"), F.array_join("components", "|").alias("components"))


#: The longest common subsequence of two texts by a row of counts a letter.
_COMMON_SQL = """lcs AS (
  SELECT x, y, 0 AS i, list_transform(range(1, length(y) + 1), lambda j: 0) AS row FROM words
  UNION ALL
  SELECT x, y, i + 1, list_transform(range(1, length(y) + 1), lambda j: list_max(cand[1:j])) FROM (
    SELECT x, y, i, list_transform(range(1, length(y) + 1), lambda j: greatest(row[j], (CASE WHEN j > 1 THEN row[j - 1] ELSE 0 END) + (x[i + 1] = y[j])::INT)) AS cand FROM lcs WHERE i < length(x)
  )
), common AS (SELECT x, y, CASE WHEN y = '' OR x = '' THEN 0 ELSE row[length(y)] END AS n FROM lcs WHERE i = length(x))"""


@query(
    "close_names",
    f"""WITH RECURSIVE {CATALOG_SQL}, n AS (SELECT DISTINCT lower(name) AS t, list_sort(list_distinct(string_split(lower(name), ' '))) AS w FROM catalog),
q AS (SELECT DISTINCT lower(p_name) AS t, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part), every AS (SELECT * FROM q UNION SELECT * FROM n),
p AS (SELECT a.t AS query, b.t AS choice, least(len(a.w), len(b.w)) < 4 AS doubled, list_sort(list_intersect(a.w, b.w)) AS met, array_to_string(list_sort(list_filter(a.w, lambda v: NOT list_contains(b.w, v))), ' ') AS x, array_to_string(list_sort(list_filter(b.w, lambda v: NOT list_contains(a.w, v))), ' ') AS y
  FROM every a, n b WHERE len(list_intersect(a.w, b.w)) > 0),
words AS (SELECT DISTINCT x, y FROM p WHERE x <> '' AND y <> '' AND abs(length(x) - length(y)) <= 4 UNION SELECT query, choice FROM p WHERE x <> '' AND y <> '' AND abs(length(query) - length(choice)) <= 4 AND (len(met) >= 3 OR (len(met) >= 2 AND doubled))),
{_COMMON_SQL},
s AS (SELECT p.*, length(array_to_string(met, ' ')) AS shared, length(array_to_string(met, ' ')) + 1 + length(p.x) AS lx, length(array_to_string(met, ' ')) + 1 + length(p.y) AS ly, c.n AS left_common, d.n AS text_common
  FROM p LEFT JOIN common c ON c.x = p.x AND c.y = p.y LEFT JOIN common d ON d.x = p.query AND d.y = p.choice),
r AS (SELECT query, choice, CASE WHEN x = '' OR y = '' THEN 100.0 ELSE greatest(100.0 * (1 - (length(x) + length(y) - 2 * coalesce(left_common, 0)) / CAST(lx + ly AS DOUBLE)), 100.0 * (1 - (1 + length(x)) / CAST(shared + lx AS DOUBLE)), 100.0 * (1 - (1 + length(y)) / CAST(shared + ly AS DOUBLE)), coalesce(200.0 * text_common / (length(query) + length(choice)), 0)) END AS score FROM s)
SELECT query, choice, round(score, 4) AS score FROM r WHERE score >= 95""",
)
def close_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and catalog names with all catalog names that score 95."""
    names = catalog_names(spark, sf_dir)
    asked = part_names(spark, sf_dir).select("query").union(names.select("choice")).distinct()
    return Fz.close_pairs(asked, names).withColumn("score", F.round("score", 4))


SESSION_STORES = 2
#: Events of a micro-batch, which a store's Python holds at once.
SESSIONS_A_BATCH = 500_000


@query(
    "session_store",
    """WITH RECURSIVE e AS (SELECT CAST(user_id % 2 AS VARCHAR) AS store, CAST(event_id AS VARCHAR) AS session_id, ts AS created_at, row_number() OVER (PARTITION BY user_id % 2 ORDER BY ts, CAST(event_id AS VARCHAR)) AS n FROM events),
r AS (
  SELECT store, n, [{'id': session_id, 'born': created_at}] AS alive, CAST(NULL AS VARCHAR) AS evicted FROM e WHERE n = 1
  UNION ALL
  SELECT store, n, list_append(CASE WHEN len(held) >= 30 THEN held[2:] ELSE held END, {'id': session_id, 'born': created_at}), CASE WHEN len(held) >= 30 THEN held[1].id END
  FROM (SELECT e.store, e.n, e.session_id, e.created_at, list_filter(r.alive, lambda s: s.born >= e.created_at - INTERVAL 8 HOURS) AS held FROM r JOIN e ON e.store = r.store AND e.n = r.n + 1)
), last AS (SELECT store, unnest(alive).id AS session_id FROM r WHERE (store, n) IN (SELECT store, max(n) FROM e GROUP BY store)), now AS (SELECT max(ts) AS now FROM events)
SELECT e.store, e.session_id, e.created_at, CASE WHEN g.evicted IS NOT NULL THEN 'evicted' WHEN l.session_id IS NOT NULL AND e.created_at >= now - INTERVAL 8 HOURS THEN 'alive' ELSE 'expired' END AS state
FROM e CROSS JOIN now LEFT JOIN (SELECT DISTINCT store, evicted FROM r WHERE evicted IS NOT NULL) g ON g.store = e.store AND g.evicted = e.session_id LEFT JOIN last l ON l.store = e.store AND l.session_id = e.session_id""",
)
def session_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event opens a session in one of two stores, which keep thirty
    for eight hours, as a stream; what became of each session."""
    folder = new_folder(spark, "sessions")
    opened = load(spark, sf_dir, "events").select((F.col("user_id") % SESSION_STORES).cast("string").alias("store"), F.col("event_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("created_at"))
    # A file for each stretch of time, written one after another: a stream takes
    # files by age, one a batch, so what is held at once doesn't grow.
    stretches = max(1, -(-opened.count() // SESSIONS_A_BATCH))
    opened.repartitionByRange(stretches, "created_at").write.parquet(f"{folder}/stretches")
    for file in sorted(spark.read.parquet(f"{folder}/stretches").inputFiles()):
        spark.read.schema(opened.schema).parquet(file).coalesce(1).write.mode("append").parquet(f"{folder}/opened")
    stream = spark.readStream.schema(opened.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/opened")
    run = Ss.session_events(stream).writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    now = F.lit(opened.agg(F.max("created_at")).first()[0])
    return Ss.states(spark.read.schema(Ss.OUT).parquet(f"{folder}/events"), now).select("store", "session_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "state")


@query(
    "rerun_results",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS number FROM lineitem)
SELECT l_orderkey AS request_id, number, CASE WHEN l_orderkey % 10 = 3 AND number % 2 = 1 THEN 'similar' ELSE 'exact' END AS status, 'catalog' AS source, CASE WHEN l_orderkey % 10 = 3 AND number % 2 = 1 THEN 95.0 ELSE 100.0 END AS score, l_partkey AS code, CASE WHEN l_orderkey % 10 = 3 AND number % 2 = 1 THEN 2 ELSE 1 END AS version FROM l""",
)
def rerun_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full run of all requests, then some lines of some requests anew;
    what the store holds."""
    # Numbered once: every step reads the numbers from the shared folder.
    numbered = new_folder(spark, "numbered")
    request_lines(spark, sf_dir).select("request_id", "number", "code").write.parquet(numbered)
    items = spark.read.parquet(numbered)
    results = lambda rows, status, score: rows.select("request_id", "number", F.lit(status).alias("status"), F.lit("catalog").alias("source"), F.lit(score).alias("score"), F.col("code").cast("long").alias("code"))
    store = ResultStore(new_folder(spark, "results"))
    store.save(results(items, "exact", 100.0))
    store.rerun(items, items.filter("request_id % 10 = 3 AND number % 2 = 1"), lambda rows: results(rows, "similar", 95.0))
    return store.read(spark)


_TURN_SQL = r"""t AS (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[a-zäöüßàâçéèêëîïôûùœñáíóú]+')[1:8] AS w, text FROM conversations),
p AS (SELECT *, [x FOR x IN w IF length(x) BETWEEN 2 AND 3] AS short, [x FOR x IN w IF length(x) BETWEEN 4 AND 5] AS medium FROM t)"""


@query(
    "conversation_preferences",
    "WITH "
    + _TURN_SQL
    + """, ev AS (
  SELECT conv_id, 'p' AS kind, role <> 'user' AS gone, turn, unnest(short) AS v, generate_subscripts(short, 1) AS k FROM p
  UNION ALL SELECT conv_id, 's', role <> 'user', turn, unnest(medium), generate_subscripts(medium, 1) FROM p
), g AS (SELECT conv_id, kind, v, max(turn) AS last FROM ev WHERE gone GROUP BY ALL),
a AS (SELECT ev.conv_id, ev.kind, ev.v, min(turn * 1000 + k) AS moment FROM ev LEFT JOIN g USING (conv_id, kind, v) WHERE NOT gone AND (last IS NULL OR turn > last) GROUP BY ALL),
f AS (SELECT conv_id, arg_max(contains(text, ','), turn) FILTER (contains(text, ',') OR contains(text, '?')) AS links, arg_max(length(text) % 2 = 0, turn) AS pricing, arg_max(length(text) / 10.0, turn) FILTER (role = 'user') AS markup FROM p GROUP BY conv_id),
ru AS (SELECT conv_id, rule, min(turn) AS moment FROM (SELECT conv_id, turn, w[1] AS rule FROM p WHERE role = 'user') WHERE rule <> '' GROUP BY ALL),
l AS (SELECT conv_id, kind, string_agg(v, ' ' ORDER BY moment) AS words FROM a GROUP BY ALL)
SELECT f.conv_id, coalesce(links, false) AS search_kit_component_links, coalesce(pricing, false) AS force_kit_component_pricing, CAST(markup AS DOUBLE) AS markup_percent, coalesce(lp.words, '') AS excluded_platforms, coalesce(ls.words, '') AS disabled_sources, coalesce((SELECT string_agg(rule, '|' ORDER BY moment) FROM ru WHERE ru.conv_id = f.conv_id), '') AS rules
FROM f LEFT JOIN l lp ON lp.conv_id = f.conv_id AND lp.kind = 'p' LEFT JOIN l ls ON ls.conv_id = f.conv_id AND ls.kind = 's'""",
)
def conversation_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation as patches, folded.  A user's words
    of two and three letters are wanted, an assistant's take them back; words of
    four and five do so in the other list."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-zäöüßàâçéèêëîïôûùœñáíóú]+)"), 1), 1, 8)
    turns = load(spark, sf_dir, "conversations").withColumn("w", words)
    none, user = F.array().cast("array<string>"), F.col("role") == "user"
    of = lambda low, high: F.filter("w", lambda x: F.length(x).between(low, high))
    patches = turns.select(
        "conv_id",
        "turn",
        *[F.when(side, of(*sizes)).otherwise(none).alias(f"{name}_{how}") for name, sizes in (("excluded_platforms", (2, 3)), ("disabled_sources", (4, 5))) for how, side in (("add", user), ("remove", ~user))],
        F.when(F.col("text").contains(","), True).when(F.col("text").contains("?"), False).alias("search_kit_component_links"),
        (F.length("text") % 2 == 0).alias("force_kit_component_pricing"),
        F.when(user, F.length("text") / 10).alias("markup_percent"),
        F.when(user, F.try_element_at("w", F.lit(1))).alias("save_rule"),
    )
    out = Pf.fold(patches, ["conv_id"])
    return out.select("conv_id", *Pf.FLAGS, "markup_percent", *[F.array_join(c, " ").alias(c) for c in Pf.LISTS], F.array_join("rules", "|").alias("rules"))


@query(
    "model_candidates",
    """WITH c AS (SELECT p_name, p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS name, p_retailprice AS cost, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
pr AS (SELECT p_name, row_number() OVER (PARTITION BY p_name ORDER BY price DESC, code, supplier) AS rank, code, price, supplier, 'код ' || CAST(code AS VARCHAR) AS name FROM (SELECT p_name, l_partkey AS code, l_extendedprice / l_quantity AS price, s_name AS supplier FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey) x),
st AS (SELECT l_partkey AS code, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS stock FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
rg AS (SELECT p_name, code, stock, row_number() OVER (PARTITION BY p_name ORDER BY stock DESC, code) AS rank FROM st JOIN part ON p_partkey = code)
SELECT n.p_name AS item, (SELECT count(*) FROM c WHERE c.p_name = n.p_name AND rank <= 8) AS n_catalog, (SELECT count(*) FROM rg WHERE rg.p_name = n.p_name AND rank <= 5) AS n_registry, (SELECT count(*) FROM pr WHERE pr.p_name = n.p_name AND rank <= 8) AS n_price_list,
  (SELECT string_agg(name || '=' || CAST(round(100.0 - rank / 4.0, 1) AS VARCHAR), '|' ORDER BY rank) FROM c WHERE c.p_name = n.p_name AND rank <= 8) AS catalog,
  coalesce((SELECT string_agg('код ' || CAST(code AS VARCHAR) || '=' || CAST(CAST(stock AS BIGINT) AS VARCHAR), '|' ORDER BY rank) FROM rg WHERE rg.p_name = n.p_name AND rank <= 5), '') AS registry,
  coalesce((SELECT string_agg(name || '=' || supplier, '|' ORDER BY rank) FROM pr WHERE pr.p_name = n.p_name AND rank <= 8), '') AS price_list
FROM (SELECT DISTINCT p_name FROM part) n""",
)
def model_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best given hits of each part name in three sources, nested."""
    parts = load(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("item"))
    none = lambda kind: F.lit(None).cast(kind)
    empty = {"cost": "double", "unit": "string", "quantity": "double", "link": "string", "code": "string", "price": "double", "supplier": "string"}

    def side(source: str, rows: DataFrame, order: list, **cells) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
        return rows.withColumn("rank", rank).select("item", F.lit(source).alias("source"), "rank", (100 - F.col("rank") / 4).alias("score"), "name", *[cells.get(c, none(k)).cast(k).alias(c) for c, k in empty.items()])

    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier"))
    prices = price_list(spark, sf_dir).join(suppliers, "supplier_id").join(parts.withColumnRenamed("p_partkey", "code"), "code").withColumn("name", F.concat(F.lit("код "), F.col("code").cast("string")))
    stock = registry(spark, sf_dir).join(parts.withColumnRenamed("p_partkey", "code"), "code").withColumn("name", F.concat(F.lit("код "), F.col("code").cast("string")))
    shelf = catalog(spark, sf_dir).join(parts.withColumnRenamed("p_partkey", "row_idx"), "row_idx")
    hits = side("catalog", shelf, [F.desc("cost"), F.col("row_idx")], cost=F.col("cost"))
    hits = hits.unionByName(side("price_list", prices, [F.desc("price"), F.col("code"), F.col("supplier")], code=F.col("code"), price=F.col("price"), supplier=F.col("supplier")))
    hits = hits.unionByName(side("registry", stock, [F.desc("stock"), F.col("code")], quantity=F.col("stock")))
    out = B.model_candidates(hits, ["item"])
    shown = lambda c, value: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit("="), value(x))), "|").alias(c)
    return out.select("item", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("catalog", "registry", "price_list")], shown("catalog", lambda x: x["score"].cast("string")), shown("registry", lambda x: x["quantity"].cast("long").cast("string")), shown("price_list", lambda x: x["supplier"]))


_HELD_SQL = """names AS (SELECT lower(p_name) AS query, string_split(lower(p_name), ' ') AS w FROM (SELECT DISTINCT p_name FROM part)),
rows AS (SELECT row_idx, name, lower(name) AS choice, cost, price FROM catalog), stock AS (SELECT l_partkey AS row_idx, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
s AS (SELECT 'catalog' AS source, row_idx, name, choice, format('{:,.2f}', cost) AS shown FROM rows UNION ALL SELECT 'price_list', row_idx, name, choice, 'S' || CAST(row_idx % 7 AS VARCHAR) FROM rows UNION ALL SELECT 'registry', row_idx, name, choice, CAST(CAST(quantity AS BIGINT) AS VARCHAR) FROM rows JOIN stock USING (row_idx)),
h AS (SELECT query, source, name, shown, contains(choice, query) AS inside, row_number() OVER (PARTITION BY query, source ORDER BY row_idx) AS rank FROM names JOIN s ON list_has_all(string_split(choice, ' '), w)),
o AS (SELECT *, row_number() OVER (PARTITION BY query, source, name ORDER BY rank) AS same FROM h WHERE rank <= 12),
p AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY inside DESC, length(name) DESC, rank) AS place FROM o WHERE same = 1)"""


@query(
    "lookup_blocks",
    f"""WITH {CATALOG_SQL}, {_HELD_SQL}
SELECT n.query, x.source, count(p.name) > 0 AS found, max(CASE WHEN place = 1 THEN p.name END) AS name, max(CASE WHEN place = 1 THEN replace(shown, ',', ' ') END) AS shown, count(p.name) AS n_items, coalesce(string_agg(p.name, '|' ORDER BY place), '') AS names
FROM names n CROSS JOIN (SELECT unnest(['catalog', 'price_list', 'registry']) AS source) x LEFT JOIN p ON p.query = n.query AND p.source = x.source AND place <= 5 GROUP BY 1, 2""",
)
def lookup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part name looked up in catalog, price list and
    stock: the ranked block of every source."""
    asked, c = part_names(spark, sf_dir).select("query"), F.col
    shelf = catalog(spark, sf_dir).select("row_idx", "name", "cost", "price")
    none = lambda kind: F.lit(None).cast(kind)
    stock = registry(spark, sf_dir).select(c("code").alias("row_idx"), c("stock").alias("quantity")).join(shelf.select("row_idx", "name"), "row_idx")
    sources = {
        "catalog": (shelf.withColumns({"stock": none("double"), "unit": none("string")}), "cost"),
        "price_list": (shelf.drop("cost").withColumns({"code": c("row_idx").cast("string"), "supplier": F.concat(F.lit("S"), (c("row_idx") % 7).cast("string")), **{x: none("double") for x in ("recommended_qty", "order_qty", "order_sum")}}), "supplier"),
        "registry": (stock.withColumns({"condition": none("string"), "link": none("string"), "photo_files": none("array<string>")}), "quantity"),
    }
    near, out = written(Fz.close_pairs(asked, shelf.select(T.normalize_name("name").alias("choice")))), None
    for source, (rows, shown) in sources.items():
        met = near.join(rows.withColumn("choice", T.normalize_name("name")), "choice")
        hits = met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "row_idx")))
        # The keys are the lookups' own texts.
        block = B.lookup_block(hits.withColumn("asked", c("query")), asked.withColumn("asked", c("query")), source, ["asked"])
        value = F.replace(F.replace(c(shown), F.lit(" ₽"), F.lit("")), F.lit(","), F.lit(" "))
        own = block.select(c("asked").alias("query"), F.lit(source).alias("source"), "found", "name", value.alias("shown"), F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda x: x["name"]), "|").alias("names"))
        out = own if out is None else out.unionByName(own)
    return out
