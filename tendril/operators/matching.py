"""Candidate search: score, adjust, rank, pick.

``best_fuzzy`` scores a stated query set against distinct names.  Names and
queries are made distinct first, so the scorer sees a pair once.  Every pair is
scored at every size: up to ``MOST_QUERIES`` queries are broadcast, more meet the
names block by block, so a change of size never changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.functions import text as T
from tendril.functions.similarity import name_match_score

MOST_QUERIES = 20_000


def pairs(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query, choice) of every distinct query and name; ``query`` and
    ``choice`` are normalised."""
    asked = queries.select("query").filter("query <> ''").distinct()
    names = corpus.select("choice").filter("choice <> ''").distinct()
    # Few rows make many pairs: deal them out before the scorer.
    parts = names.sparkSession.sparkContext.defaultParallelism * 2
    if asked.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES:
        return names.repartition(parts).join(F.broadcast(asked))
    # A task takes one block of each side; none is sent to the driver.
    blocks = -(-asked.count() // MOST_QUERIES)
    parts *= max(1, -(-names.count() // MOST_QUERIES))
    return names.repartition(parts).join(asked.repartition(blocks).hint("shuffle_replicate_nl"))


def blocked_pairs(queries: DataFrame, corpus: DataFrame, share: float = 0.5) -> DataFrame:
    """Pairs of equal text, and pairs where at least ``share`` of the smaller
    word set is in the larger.  Every pair that scores 95 by its words (one's
    words are all in the other's) is among them."""
    words = lambda df, name: df.select(name, F.array_distinct(T.tokens(F.col(name))).alias("w")).select(name, F.size("w").alias(f"{name}_n"), F.explode("w").alias("word"))
    q, c = words(queries.select("query").distinct(), "query"), words(corpus.select("choice").distinct(), "choice")
    met = q.join(c, "word").groupBy("query", "choice").agg(F.count(F.lit(1)).alias("n"), F.first("query_n").alias("a"), F.first("choice_n").alias("b"))
    shared = met.filter(F.col("n") >= share * F.least("a", "b")).select("query", "choice")
    equal = queries.select("query").join(corpus.select("choice"), F.col("query") == F.col("choice"))
    return shared.union(equal).distinct()


def token_subsets(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Pairs where one side's words are all among the other's."""
    return blocked_pairs(queries, corpus, share=1.0)


def scored(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", name_match_score("query", "choice"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def is_relevant(name: Column, specs: Column, choice: Column, name_score: Column, spec_score: Column, score: Column | None = None) -> Column:
    """Whether a candidate (normalised) is about the item, from its scores
    against the item's name and its usable spec line (null for none)."""
    required = T.required_tokens(name, specs)
    spec = F.coalesce(spec_score, F.lit(0.0))
    told = F.greatest(name_score, spec)
    effective = told if score is None else F.least(score, told, name_score)
    return (
        F.when((F.coalesce(choice, F.lit("")) == "") | T.category_conflict(name, specs, choice), False)
        .when(name_score >= T.LOCAL_THRESHOLD, True)
        .when(~T.required_present(required, choice), False)
        .when(spec_score.isNull(), False)
        .when(spec >= T.LOCAL_THRESHOLD, True)
        .when(F.size(required) > 0, False)
        .otherwise(effective >= T.EXACT_THRESHOLD)
    )


def best_fuzzy(items: DataFrame, corpus: DataFrame, limit: int = 5) -> DataFrame:
    """(item_id, row_idx, name, score, rank): the best rows of one table for
    each item (item_id, name, specifications).

    Each of the item's queries keeps its eight best rows (ties by row), rows
    that aren't relevant go, scores are taken anew against name and spec line
    and adjusted, the queries' hits are merged by name, and five stay.
    """
    spec = T.usable_spec(F.col("name"), F.col("specifications"))
    asked = items.select("item_id", F.col("name").alias("asked"), "specifications", F.posexplode(T.search_queries(F.col("name"), F.col("specifications"))).alias("query_pos", "query"), T.normalize_name("name").alias("name_query"), T.normalize_name(spec).alias("spec_query"))
    rows = corpus.withColumn("choice", T.normalize_name("name"))
    # A query's best rows have its best texts, in order of score and first row.
    texts = rows.groupBy("choice").agg(F.min("row_idx").alias("first_row"))
    found = scored(pairs(asked.select("query"), texts)).withColumnRenamed("score", "raw")
    found = top(found.join(texts, "choice"), ["query"], [F.desc("raw"), F.col("first_row")], max(limit, 8), "_text").drop("_text", "first_row")
    hits = asked.join(found, "query").join(rows.select("row_idx", "name", "choice"), "choice")
    hits = top(hits, ["item_id", "query_pos"], [F.desc("raw"), F.col("row_idx")], max(limit, 8))
    hits = hits.withColumns({"of_name": name_match_score("name_query", "choice"), "of_spec": F.when(F.col("spec_query").isNotNull(), name_match_score(F.coalesce("spec_query", F.lit("")), F.col("choice")))})
    hits = hits.filter(is_relevant(F.col("asked"), F.col("specifications"), F.col("choice"), F.col("of_name"), F.col("of_spec"), F.col("raw")))
    hits = hits.withColumn("score", T.adjust_score(F.col("query"), F.col("choice"), F.greatest(F.col("of_name"), F.coalesce("of_spec", F.lit(0.0)))))
    hits = top(hits, ["item_id", "query_pos"], [F.desc("score"), F.col("rank")], limit, "place")
    hits = top(hits, ["item_id", "name"], [F.desc("score"), F.col("query_pos"), F.col("place")], 1, "_one")
    return top(hits, ["item_id"], [F.desc("score"), F.col("query_pos"), F.col("place")], limit).select("item_id", "row_idx", "name", "score", "rank")


def rank_order(query: Column, choice: Column, score: Column, name: Column) -> list[Column]:
    """Best first: score, equality, containment, overlap, longer name."""
    return [F.desc(score), F.desc(query == choice), F.desc(choice.contains(query)), F.desc(T.token_overlap(query, choice)), F.desc(F.length(name)), F.desc(query.contains(choice))]


def rank_hits(hits: DataFrame, by: list[str], limit: int = 5) -> DataFrame:
    """Of the first twelve hits (query, choice, name, score, rank) of each
    group the best ``limit`` with distinct names."""
    some = top(hits.filter(F.col("score") >= T.SIMILAR_THRESHOLD), by, [F.col("rank")], 12, "_first")
    order = rank_order(F.col("query"), F.col("choice"), F.col("score"), F.col("name"))
    one = top(some, [*by, "name"], [*order, F.col("rank")], 1, "_same")
    return top(one, by, [*order, F.col("rank")], limit, "place").drop("_first", "_same")
