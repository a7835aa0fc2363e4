"""Every pair of names that scores 91 to 100, by equi-joins.

The composite score reaches a threshold above 90 in four ways only (partial
matches weigh 0.9 at most): equal texts; few edits between the texts, or between
their words in order; few edits between the words that the other side lacks; or
nearly all of one side's words on the other.  With ``r = 100 - threshold`` and
texts of ``l`` characters the first three leave at most ``floor(2 r l / (100 - r))``
inserted or deleted characters whatever the partner, and the last at most
``floor(2 r l / (100 + r))`` characters of words (each with its space) that the
partner lacks.

Each word gives its padded trigrams, so a text's bag of trigrams doesn't depend
on the order of its words, and words in common cancel.  An edit takes at most
three trigrams away.  So two names of ``e`` edits share all but ``3 e`` of the
larger bag, and among the first ``3 e + 1`` trigrams of each, in any common order,
one is the same.  The order is by rarity, so the lists of names that meet are
short.  The same holds for words: of one side's words, rarest first, one more
than may be lacking must hold one that the other side has.

Pairs that pass are a superset; ``close_pairs`` scores them and keeps those that
reach the threshold.  No pair is lost and none is compared without a trigram or
word in common.  Of the pairs that share a rare trigram, those whose letters
differ by more than their edits go before they are made distinct: where names are
made of a few words, nearly all do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.functions import text as T
from tendril.functions.similarity import name_match_score


def _edits(length: Column, threshold: int) -> Column:
    r = 100 - threshold
    return F.floor(F.lit(2 * r) * length / F.lit(100 - r)).cast("int")


def _trigrams(words: Column) -> Column:
    """Each padded trigram with its number in the bag, so that bags are sets."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), k, F.lit(3)))
    flat = F.array_sort(F.flatten(F.transform(words, grams)))
    numbered = F.transform(flat, lambda g, k: F.concat(g, F.lit("#"), (k - F.array_position(flat, g) + 2).cast("string")))
    return numbered


def _letters(words: Column) -> list[Column]:
    """How often each of 32 classes of letters is in a bag, up to four times, as
    bits of two numbers: bits that differ are letters that differ."""
    letters = F.split(F.array_join(words, ""), "")
    shift = lambda x, n: F.call_function("shiftleft", x, n)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def half(first: int) -> Column:
        held = lambda k: F.least(F.size(F.filter(letters, lambda c: F.ascii(c) % 32 == k + first)), F.lit(4))
        return F.aggregate(F.sequence(F.lit(0), F.lit(15)), none, lambda bits, k: bits.bitwiseOR(shift(shift(one, held(k)) - 1, 4 * k)))

    return [half(0), half(16)]


def _rarest(keyed: DataFrame, count: DataFrame, keep: str) -> DataFrame:
    """(text, key) of each text's first ``keep`` keys, rarest first."""
    order = Window.partitionBy("text", "kind").orderBy("n", "key")
    ranked = keyed.join(count, "key").withColumn("nth", F.row_number().over(order))
    return ranked.filter(F.col("nth") <= F.col(keep)).drop("n", "nth")


def _counted(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _bags(names: DataFrame, threshold: int) -> DataFrame:
    """(text, kind, length, size, grams) of the distinct words and, where words
    repeat, of all words."""
    words = T.tokens(F.col("text"))
    both = names.withColumn("words", words).select("text", F.length("text").alias("length"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.array_distinct("words").alias("w")), F.struct(F.lit(1).alias("kind"), F.col("words").alias("w")))).alias("b"), "words")
    both = both.filter((F.col("b.kind") == 0) | (F.size("b.w") > F.size(F.array_distinct("words"))))
    low, high = _letters(F.col("b.w"))
    bags = both.select("text", "length", "b.kind", _trigrams(F.col("b.w")).alias("grams"), low.alias("low"), high.alias("high"))
    return bags.withColumns({"size": F.size("grams"), "keep": 3 * _edits(F.col("length"), threshold) + 1})


def _met(q: DataFrame, c: DataFrame, threshold: int) -> DataFrame:
    """Bags that share a rare trigram and differ in few letters; a pair for
    each such trigram."""
    own = ["kind", "length", "size", "low", "high"]
    keyed = lambda bags: bags.select("text", "keep", *own, F.explode("grams").alias("key"))
    count = _counted(keyed(q).unionByName(keyed(c)))
    rare = lambda bags, name: _rarest(keyed(bags), count, "keep").select("key", F.col("text").alias(name), *[F.col(x).alias(f"{name}_{x}") for x in own])
    # An edit changes the number of letters (a trigram each) by one at most, and
    # the count of one letter by one.
    most = F.floor(F.lit(100 - threshold) * (F.col("query_length") + F.col("choice_length")) / 100)
    apart = lambda x: F.bit_count(F.col(f"query_{x}").bitwiseXOR(F.col(f"choice_{x}")))
    near = (F.abs(F.col("query_size") - F.col("choice_size")) <= most) & (apart("low") + apart("high") <= most)
    return rare(q, "query").join(rare(c, "choice"), "key").filter(near)


def _near(queries: DataFrame, corpus: DataFrame, threshold: int) -> DataFrame:
    """Pairs with few edits between texts, words, or words not in common."""
    q, c = _bags(queries, threshold), _bags(corpus, threshold)
    met = _met(q, c, threshold).select("query", "query_kind", "choice", "choice_kind").distinct()
    side = lambda bags, name: bags.select(F.col("text").alias(name), F.col("kind").alias(f"{name}_kind"), F.struct("length", "size", "grams").alias(f"{name}_bag"))
    met = met.join(side(q, "query"), ["query", "query_kind"]).join(side(c, "choice"), ["choice", "choice_kind"])
    edits = F.floor(F.lit(100 - threshold) * (F.col("query_bag.length") + F.col("choice_bag.length")) / 100)
    common = F.size(F.array_intersect("query_bag.grams", "choice_bag.grams"))
    return met.filter(common >= F.greatest("query_bag.size", "choice_bag.size") - 3 * edits).select("query", "choice")


def _within(some: DataFrame, all_: DataFrame, threshold: int) -> DataFrame:
    """(inner, outer): nearly all words of the inner text are the outer's."""
    r = 100 - threshold
    words = lambda df: df.withColumn("words", F.array_distinct(T.tokens(F.col("text"))))
    budget = F.floor(F.lit(2 * r) * F.length("text") / (100 + r))
    # As many of the shortest words as the budget lets the other side lack.
    costs = F.array_sort(F.transform("words", lambda w: F.length(w) + 1))
    lack = F.aggregate(costs, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + F.when(a["sum"] + x <= budget, 1).otherwise(0)).alias("n")), lambda a: a["n"])
    inner = words(some).select("text", F.lit(0).alias("kind"), F.explode("words").alias("key"), (lack + 1).alias("keep"))
    outer = words(all_).select("text", F.explode("words").alias("key"))
    count = _counted(inner.select("key").unionByName(outer.select("key")))
    met = _rarest(inner, count, "keep").select(F.col("text").alias("inner"), "key").join(outer.withColumnRenamed("text", "outer"), "key").select("inner", "outer").distinct()
    mine, others = F.array_distinct(T.tokens(F.col("inner"))), T.tokens(F.col("outer"))
    missing = F.aggregate(F.array_except(mine, others), F.lit(0), lambda a, w: a + F.length(w) + 1)
    return met.filter(missing <= F.floor(F.lit(2 * r) * F.length("inner") / (100 + r)))


def candidate_pairs(queries: DataFrame, corpus: DataFrame, threshold: int = 95) -> DataFrame:
    """(query, choice): all pairs of normalised names that may reach the
    threshold; ``queries`` has a column query, ``corpus`` choice."""
    if not 91 <= threshold <= 100:
        raise ValueError("below 91 partial matches count as well")
    q = queries.select(F.col("query").alias("text")).filter("text <> ''").distinct()
    c = corpus.select(F.col("choice").alias("text")).filter("text <> ''").distinct()
    equal = q.join(c, "text").select(F.col("text").alias("query"), F.col("text").alias("choice"))
    held = _within(q, c, threshold).select(F.col("inner").alias("query"), F.col("outer").alias("choice"))
    holds = _within(c, q, threshold).select(F.col("outer").alias("query"), F.col("inner").alias("choice"))
    return equal.union(_near(q, c, threshold)).union(held).union(holds).distinct()


def close_pairs(queries: DataFrame, corpus: DataFrame, threshold: int = 95) -> DataFrame:
    """(query, choice, score) of all pairs that score ``threshold`` or more."""
    return candidate_pairs(queries, corpus, threshold).withColumn("score", name_match_score("query", "choice")).filter(F.col("score") >= threshold)
