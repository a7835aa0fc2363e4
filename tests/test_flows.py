"""Sessions, re-runs, preferences and nested blocks on hand-made rows."""

import random
from pathlib import Path

import pytest

from tendril.functions.preferences import Preferences
from tendril.functions.similarity import name_score
from tendril.operators import blocks as B
from tendril.operators import flow as Fl
from tendril.operators import preferences as Pf
from tendril.operators.items import local_match
from tendril.operators.store import ResultStore
from tendril.sources.shared import written
from tendril.streaming import sessions as Ss
from test_joins import names

HOUR = 3_600_000_000


def replay(opened):
    """What a store does, session by session: (alive, events)."""
    alive, events = {}, []
    for session, now in opened:
        for old in [s for s, t in alive.items() if t < now - 8 * HOUR]:
            events.append((old, "expired"))
            del alive[old]
        if len(alive) >= 30:
            old = min(alive, key=alive.get)
            events.append((old, "evicted"))
            del alive[old]
        alive[session] = now
        events.append((session, "opened"))
    return alive, events


def test_sessions_over_batches_and_a_restart(spark, tmp_path):
    rng, start = random.Random(4), 1_700_000_000_000_000
    moments = sorted(rng.sample(range(0, 60 * HOUR), 300)) + [61 * HOUR + k for k in range(45)]
    rows = [("a" if k % 3 else "b", f"s{k}", start + t) for k, t in enumerate(moments)] + [("a", "s340", start + 62 * HOUR)]
    schema = "store string, session_id string, t long"

    def put(part):
        spark.createDataFrame(part, schema).selectExpr("store", "session_id", "timestamp_micros(t) AS created_at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema("store string, session_id string, created_at timestamp").parquet(f"{tmp_path}/in")
        query = Ss.session_events(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    for part in (rows[:100], rows[100:101], rows[101:]):  # a new query each: state comes from the checkpoint
        put(part)
        run()
    events = spark.read.schema(Ss.OUT).parquet(f"{tmp_path}/out")
    got = sorted((r.store, r.session_id, r.event) for r in events.collect())
    want, alive = [], set()
    for store in "ab":
        left, told = replay([(s, t) for x, s, t in rows if x == store])
        alive |= {(store, s) for s in left}
        want += [(store, s, e) for s, e in told]
    assert {e for *_, e in want} == {"opened", "expired", "evicted"}
    # Timers may let more go than the openings did; no more is alive than in the replay.
    assert set(want) <= set(got) and all(e == "expired" for *_, e in set(got) - set(want))
    assert {(r.store, r.session_id) for r in Ss.survivors(events).collect()} == alive


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def test_a_rerun_touches_its_partitions_only(spark, tmp_path):
    items = spark.createDataFrame([(r, n, r * 10 + n) for r in range(40) for n in range(3)], "request_id long, number int, code long")
    answer = lambda rows, status: rows.selectExpr("request_id", "number", f"'{status}' AS status", "'catalog' AS source", "100.0D AS score", "code")
    store = ResultStore(f"{tmp_path}/store", buckets=16)
    store.save(answer(items.filter("request_id < 39"), "exact"))
    before = files(store.path)
    numbers = spark.createDataFrame([(7, 1), (7, 2), (11, 0), (99, 0)], "request_id long, number int")
    assert store.rerun(items, numbers, lambda rows: answer(rows, "similar")) == 2
    named = {(7, 1), (7, 2), (11, 0)}
    got = {(r.request_id, r.number): (r.status, r.version, r.code) for r in store.read(spark).collect()}
    assert {k: v for k, v in got.items() if k[0] < 39} == {(r, n): (("similar", 2) if (r, n) in named else ("exact", 1)) + (r * 10 + n,) for r in range(39) for n in range(3)}
    changed = {f.split("/")[0] for f in before ^ files(store.path)}
    assert len(changed) <= 2 and before & files(store.path)
    # A re-run of everything is a full run.
    store.rerun(items, items, lambda rows: answer(rows, "exact"))
    full = {(r.request_id, r.number): r.status for r in store.read(spark).collect()}
    assert full == {(r, n): "exact" for r in range(40) for n in range(3)}
    assert store.rerun(items, numbers.limit(0), lambda rows: answer(rows, "x")) == 4


def test_patches_fold_as_turn_by_turn(spark):
    rng, rows, want = random.Random(2), [], {}
    some = lambda pool: rng.choices(pool, k=rng.randint(0, 3))
    for conv in range(25):
        state, markup = Preferences(), None
        for turn in range(rng.randint(1, 9)):
            patch = {
                "excluded_platforms_add": some(["Ozon", "ozon", "Авито", "", "Wildberries"]), "excluded_platforms_remove": some(["OZON", "авито", "x"]),
                "disabled_sources_add": some(["Web", "web", "catalog"]), "disabled_sources_remove": some(["WEB", "registry"]),
                "search_kit_component_links": rng.choice([None, True, False]), "force_kit_component_pricing": rng.choice([None, None, True, False]),
                "markup_percent": rng.choice([None, 10.0, 20.0]), "save_rule": rng.choice([None, " ", " без интернета ", "по составу", "без интернета"]),
            }
            state, markup = state.merge(patch), patch["markup_percent"] or markup
            rows.append((conv, turn, *patch.values()))
        want[conv] = (state.excluded_platforms, state.disabled_sources, state.component_links, state.component_pricing, state.rules, markup)
    rng.shuffle(rows)
    lists = ", ".join(f"{n}_{h} array<string>" for n in Pf.LISTS for h in ("add", "remove"))
    patches = spark.createDataFrame(rows, f"conv long, turn int, {lists}, search_kit_component_links boolean, force_kit_component_pricing boolean, markup_percent double, save_rule string")
    got = {r.conv: (r.excluded_platforms, r.disabled_sources, r.search_kit_component_links, r.force_kit_component_pricing, r.rules, r.markup_percent) for r in Pf.fold(patches.repartition(5), ["conv"]).collect()}
    assert got == want


REFINED = [
    ("Убери Ozon и Авито", {"excluded_platforms_add": ["Ozon", "Авито"], "reprocess_all": True, "reply": Pf.REPLY}),
    ("не используй яндекс маркет", {"excluded_platforms_add": ["Яндекс.Маркет", "Яндекс.Маркет"], "reprocess_all": True}),
    ("Ozon хорош", {"excluded_platforms_add": [], "reprocess_all": False, "reply": Pf.REPLY}),
    ("посчитай по составу", {"force_kit_component_pricing": True, "search_kit_component_links": None, "reprocess_all": True, "reply": Pf.REPLY_PARTS}),
    ("дай ссылки на состав", {"search_kit_component_links": True, "force_kit_component_pricing": None, "reprocess_all": True}),
    ("отключи интернет", {"disabled_sources_add": ["web"], "reprocess_all": True}),
    ("без интернета", {"disabled_sources_add": [], "reprocess_all": False}),
    ("наценка 12,5% по составу", {"markup_percent": 12.5, "reply": "Наценка изменена на 12.5%."}),
    ("НАЦЕНКУ 20", {"markup_percent": 20.0, "reply": "Наценка изменена на 20.0%.", "reprocess_items": []}),
    ("наценка 5, позиции 3, № 12 и #7", {"markup_percent": 5.0, "reprocess_items": [3, 12, 7], "reply": "Пересчитываю позиции: 3, 12, 7."}),
    ("пересчитай все", {"reprocess_all": True, "reply": Pf.REPLY}),
    (None, {"reprocess_all": False, "reply": Pf.REPLY, "markup_percent": None}),
]


def test_refinements(spark):
    rows = spark.createDataFrame([(k, m) for k, (m, _) in enumerate(REFINED)], "k int, message string")
    got = {r.k: r for r in rows.select("k", *[v.alias(c) for c, v in Pf.refinement(rows.message).items()]).collect()}
    for k, (message, want) in enumerate(REFINED):
        assert {c: got[k][c] for c in want} == want, message


def test_lookup_blocks(spark):
    rows = [
        (1, "весы", "весы", "Весы", 100.0, 1, 10.5, None, 3.0, None), (1, "весы", "весы малые", "Весы малые", 96.04, 2, 1234567.0, 20.0, None, "кг"),
        (1, "весы", "весы", "Весы", 100.0, 3, 1.0, 1.0, 1.0, ""), (2, "стул", "стол", "Стол", 60.0, 1, 1.0, 1.0, 1.0, ""),
    ]
    hits = spark.createDataFrame(rows, "item int, query string, choice string, name string, score double, rank int, cost double, price double, stock double, unit string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "item int")
    got = {r.item: r for r in B.lookup_block(hits, asked, "catalog", ["item"]).collect()}
    first = got[1]
    assert (first.found, first.name, first.match_score, first.cost, first.price, first.stock, first.unit) == (True, "Весы", 100.0, "10.50 ₽", None, "3 шт.", "шт")
    assert [(x.name, x.is_primary, x.match_score, x.cost, x.unit) for x in first["items"]] == [("Весы", True, 100.0, "10.50 ₽", "шт"), ("Весы малые", False, 96.0, "1 234 567.00 ₽", "кг")]
    assert not got[2].found and got[2]["items"] == [] and not got[3].found
    picked = spark.createDataFrame([(1, "Весы малые")], "item int, primary_name string")
    assert B.lookup_block(hits, asked, "catalog", ["item"], picked).filter("item = 1").first().name == "Весы малые"
    lists = spark.createDataFrame([(1, "q", "q", "Товар", 100.0, 1, 5.0, "A1", "ООО", None, 2.5, None), (1, "q", "q z", "Товар z", 95.0, 2, 5.0, "A2", "ООО", 4.0, 0.0, 9.0)], "item int, query string, choice string, name string, score double, rank int, price double, code string, supplier string, recommended_qty double, order_qty double, order_sum double")
    price = {r.item: r for r in B.lookup_block(lists, asked, "price_list", ["item"]).collect()}[1]
    assert (price.recommended_qty, price.order_qty, price.order_sum) == ("—", "2.5 шт.", "0.00 ₽") and price["items"][1].order_sum == "9.00 ₽"
    stock = spark.createDataFrame([], "item int, query string, choice string, name string, score double, rank int, quantity double, condition string, link string, photo_files array<string>")
    assert {r.message for r in B.lookup_block(stock, asked, "registry", ["item"]).collect()} == {B.REGISTRY_NOT_FOUND}


def test_model_candidates(spark):
    rows = [(1, s, k, 90.06, f"{s}{k}", 1.0, "шт", 2.0, "l", "c", 3.0, "ООО") for s in ("catalog", "registry", "price_list") for k in range(1, 12)]
    hits = spark.createDataFrame(rows, "item int, source string, rank int, score double, name string, cost double, unit string, quantity double, link string, code string, price double, supplier string")
    row = B.model_candidates(hits, ["item"]).first()
    assert [len(row[c]) for c in ("catalog", "registry", "price_list")] == [8, 5, 8]
    assert row.registry[4].asDict() == {"name": "registry5", "quantity": 2.0, "link": "l", "score": 90.1} and row.catalog[0].asDict() == {"name": "catalog1", "cost": 1.0, "unit": "шт", "score": 90.1}


@pytest.mark.parametrize("seed", [1, 2])
def test_goods_by_index_equal_all_pairs(spark, seed):
    """Also where only the specification finds a row."""
    rng = random.Random(seed)
    pool = names(seed, 120)
    items = [(k, rng.choice(pool), rng.choice(["", rng.choice(pool), rng.choice(pool) + "\nстрока"]), 1.0) for k in range(60)]
    goods = [(k, rng.choice(pool), f"s{k}", None, float(k), None, False) for k in range(80)]
    asked = spark.createDataFrame(items, "item_id int, name string, specifications string, quantity double")
    rows = spark.createDataFrame(goods, "row_idx int, name string, supplier string, purchase_date string, cost double, price double, procurement boolean")
    good = Fl.judged_pairs(asked, rows, 3).filter("relevance >= 95 AND relevant AND NOT mismatch")
    best = {}
    for r in sorted(good.collect(), key=lambda r: (-r.relevance, -r.of_name, r.row_idx)):
        best.setdefault(r.item_id, (r.name, r.supplier, r.relevance))
    got = {r.item_id: (r.goods_name, r.supplier, r.goods_score) for r in Fl.goods_match(asked, rows).collect()}
    assert got == best and len(best) > 15


#: Shelves where a row of another name scores as the item's own and stands first: all of its words are the item's, or the
#: same words stand in another order.
EQUAL = [(0, "large anvil LARGE Brand#1"), (1, "red anvil LARGE Brand#1"), (2, "small bolt LARGE Brand#10"), (3, "large bolt SMALL Brand#10"), (4, "hot rod PROMO Brand#3")]
ASKED = [(1, "RED ANVIL LARGE BRAND#1"), (2, "large bolt SMALL Brand#10s"), (3, "large bolt SMALL Brand#10"), (4, "hot rod PROMO Brand#3s")]


def first_best(name):
    """The reference's loop over a shelf: a later row must score more."""
    best, most = None, -1.0
    for k, choice in EQUAL:
        score = name_score(name.lower(), choice.lower())
        if score >= 95 and score > most:
            best, most = k, score
    return best, most


def test_direct_catalog_takes_the_first_of_equal_scores(spark):
    items = spark.createDataFrame([(k, name, "") for k, name in ASKED], "item_id int, name string, specifications string")
    shelf = spark.createDataFrame([(k, name, 1.0, None) for k, name in EQUAL], "row_idx int, name string, cost double, price double")
    want = {k: first_best(name) for k, name in ASKED}
    assert {r.item_id: (r.row_idx, r.score) for r in Fl.direct_catalog(items, shelf).collect()} == want
    assert {k: row for k, (row, _) in want.items()} == {1: 0, 2: 2, 3: 2, 4: 4}


def test_goods_match_takes_the_first_of_equal_scores(spark):
    items = spark.createDataFrame([(k, name, "") for k, name in ASKED], "item_id int, name string, specifications string")
    goods = spark.createDataFrame([(k, name, f"s{k}", None, 1.0, None, False) for k, name in EQUAL], "row_idx int, name string, supplier string, purchase_date string, cost double, price double, procurement boolean")
    best = {k: first_best(name) for k, name in ASKED}
    assert {r.item_id: (r.supplier, r.goods_score) for r in Fl.goods_match(items, goods).collect()} == {k: (f"s{row}", score) for k, (row, score) in best.items()}


def test_local_match_takes_the_first_of_equal_scores(spark):
    """Of the name with a letter too many; a price that the catalog lacks is the
    first of the price list."""
    items = spark.createDataFrame([(k, name, "") for k, name in ASKED[:2]], "item_id int, name string, specifications string")
    shelf = spark.createDataFrame([(k, name, 10.0 + k, None if k == 1 else 20.0 + k) for k, name in EQUAL], "row_idx int, name string, cost double, price double")
    prices = spark.createDataFrame([(k, name, f"c{k}", "ООО Весы", 30.0 + k) for k, name in EQUAL], "row_idx int, name string, code string, supplier string, price double")
    stock = spark.createDataFrame([(k, name, 1.0) for k, name in EQUAL], "row_idx int, name string, quantity double")
    hits = written(Fl.find_candidates(items, Fl.Tables(shelf, prices, stock, None, None)))
    got = {r.item_id: (r.matched_name, r.unit_cost, r.unit_base_price) for r in local_match(items, hits).collect()}
    assert got == {1: (EQUAL[1][1], 11.0, 30.0), 2: (EQUAL[2][1], 12.0, 22.0)}
