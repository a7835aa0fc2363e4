"""Texts that hold a pattern, by an index of short substrings.

A pattern can only lie in a text that has all of its three-letter substrings, so
each pattern waits under the one that fewest texts have (a pattern of one or two
letters under itself) and each text asks for its own.  The two meet in an
equi-join; ``contains`` then confirms each pair.  Patterns that share frequent
substrings cost what the texts that really have the rarest one cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, size: int) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda k: F.substring(text, k, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern): the distinct pairs in which the text holds the pattern;
    nulls and empty patterns are in no pair."""
    held = texts.select("text").filter("text <> ''").distinct()
    wanted = patterns.select("pattern").filter("pattern <> ''").distinct()
    own = F.when(F.length("pattern") < GRAM, F.array("pattern")).otherwise(_grams(F.col("pattern"), GRAM))
    asked = wanted.select("pattern", F.explode(own).alias("gram"))
    every = F.concat(*[_grams(F.col("text"), k) for k in range(1, GRAM + 1)])
    # Only substrings that some pattern has go on.
    posted = held.select("text", F.explode(every).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi")
    rare = asked.join(posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left")
    rare = rare.groupBy("pattern").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rare.join(posted, "gram").filter(F.col("text").contains(F.col("pattern"))).select("text", "pattern")
