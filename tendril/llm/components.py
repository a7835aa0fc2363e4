"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.llm.shared import FIT_ROWS, cut, fitted


def _star(links: DataFrame, small: bool, parts: int) -> DataFrame:
    """Each vertex links its neighbours to the least of them and itself: only
    the larger neighbours (large star) or only the smaller (small star)."""
    if small:
        directed = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        directed = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = directed.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").coalesce(parts).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, component) for each vertex with a link; the component is the least
    vertex reachable.  ``links`` has columns u and v; self-links and repeated
    ones do no harm.  Rounds end when the table of links stays as it is; each
    is cut off its lineage, so a lost executor repeats one round at most.
    """
    links = fitted(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(links)
    for _ in range(most_rounds):
        # A round never has more links than the last.
        parts = max(1, -(-before[0] // FIT_ROWS))
        links = cut(_star(_star(links, False, parts), True, parts).coalesce(parts))
        now = _state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    # Settled: every vertex links to its component's least vertex only.
    return links.select("u", F.col("v").alias("component")).union(links.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
