"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its distinct word shingles.  Documents of equal sets
are one class, its least id stands for it.  Each of ``TREES`` independent trees
branches every representative down paths of selected minwise tokens: a node
selects one or two of the ``COORDS`` minwise positions by a hash of its path
(1/threshold on average, so a pair at the threshold keeps one common child a
level), and a document goes to the child that its token there names.

Small nodes are compared exhaustively, but pairs that are connected already
need no look: first each node picks a pivot and each member meets the likeliest
of its pivots, links are confirmed on full sets and components taken; then, node
by node, members outside the node's main component meet all members of the
others: pair by pair in small nodes, block by block in large ones, at every size:
no node is branched further, for that would cost recall.  So a node of copies
costs its size and not its square, and no pair of a node is left out unless its
ends are connected anyhow; a node of many unconnected members costs members
outside its main component times members.  2-bit minwise sketches and set sizes
(both far below the threshold) spare pairs the look at full sets.

Missed links come from paths only: a pair at 0.8 misses one tree with
probability 0.36.  All twelve would be 4e-6 if the trees were independent, but
they draw from the same ``COORDS`` tokens: over the spread of agreeing positions
(binomial 64, 0.8) it is about 6e-5; more similar pairs miss far less often.

Defined cases: no words (or null text): empty set, linked with nothing; rows of
one id and one text are one vertex, rows of one id and different texts are each
a vertex of their own (all but one under a number from 2^62 on, where no id may
lie), and a row is kept if its id is the least of its component; rows without id
stay unlinked (component_id null, kept); ``drop_near_copies`` drops rows by id and
text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tendril.llm import kernel
from tendril.llm.components import components
from tendril.llm.shared import cut, fitted, fresh, small_batches, sweep

TREES = 12
COORDS = 64
#: Levels that every document descends.
FIRST_LEVEL = 3
#: Members outside the main component above which a node always goes by blocks.
NODE = 4096
#: Members compared at once, and comparisons from which a node is cut into
#: blocks: a mixed one (sketches spare most of its pairs), one of mostly copies.
BLOCK = 256
#: Shingles of the members that are compared at once.
ELEMENTS = 1_000_000
#: Parts in which the rows of one component are dealt.
SALT = 32
GRID = 4_000
#: Vertices of rows whose id other texts have as well are numbered from here.
SURROGATE = 1 << 62
COPIES_GRID = 500
#: Of 64 two-bit positions; a pair at 0.8 has 54.4 in common, with deviation 2.9.
LEAST_MATCHES = 38

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(77))
_MASK = _RNG.integers(0, 2**63, COORDS, dtype=np.uint64)
_FACTOR = _RNG.integers(0, 2**62, COORDS, dtype=np.uint64) * _U(2) + _U(1)


def row_sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By slab: the rows' sets as sorted hashes, joined, and their bounds."""
    for s in kernel.slabs(column):
        values, rows = kernel.shingles(s, s.hashes(fold=True), size)
        yield kernel.distinct_by_row(values, rows, s.rows)


def minwise(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of COORDS 32-bit minwise tokens for each set."""
    out = np.zeros((len(bounds) - 1, COORDS), np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        for k in range(COORDS):
            out[full, k] = np.minimum.reduceat((values ^ _MASK[k]) * _FACTOR[k], bounds[full]) >> _U(32)
    return out


def _reduced(op: np.ufunc, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1, np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = op.reduceat(values, bounds[full])
    return out


def _signer(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = _U(1) << np.arange(COORDS, dtype=np.uint64)
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for values, bounds in row_sets(batch.column("text"), size):
                tokens = minwise(values, bounds)
                mixed = kernel.mix(tokens.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
                low, high = mixed & _U(1), (mixed >> _U(1)) & _U(1)
                cols[0].append(np.diff(bounds))
                cols[1].append(_reduced(np.add, kernel.mix(values), bounds).view(np.int64))
                cols[2].append(_reduced(np.bitwise_xor, kernel.mix(values + _U(1)), bounds).view(np.int64))
                cols[3].append((low * weight).sum(1, dtype=np.uint64).view(np.int64))
                cols[4].append((high * weight).sum(1, dtype=np.uint64).view(np.int64))
                cols[5].append(tokens)
            if not cols[0]:
                continue
            longs = [pa.array(np.concatenate(c), pa.int64()) for c in cols[:5]]
            tokens = np.concatenate(cols[5])
            tokens = kernel.binary_column(tokens.ravel(), np.arange(len(tokens) + 1) * COORDS)
            carried = ["doc_id", "own", "mark"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), *longs, tokens], [*carried, "n", "a", "b", "low", "high", "tokens"])

    return sign


def _children(key: np.ndarray, at: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level down: (key, row) of each child of each (key, row)."""
    first = (kernel.mix(key ^ _U(0xA5A5)) % _U(COORDS)).astype(np.int64)
    second = (first + 1 + (kernel.mix(key ^ _U(0x5A5A)) % _U(COORDS - 1)).astype(np.int64)) % COORDS
    two = np.flatnonzero(kernel.mix(key ^ _U(0x3C3C)) >> _U(62) == 0)
    key, at, pick = np.concatenate([key, key[two]]), np.concatenate([at, at[two]]), np.concatenate([first, second[two]])
    step = tokens[at, pick].astype(np.uint64) | (pick.astype(np.uint64) << _U(32))
    return kernel.mix(kernel.mix(key) + step * _U(0x9E3779B97F4A7C15)), at


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x, np.uint32) for x in column.to_pylist()]).reshape(-1, COORDS)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the roots of all trees to the first level that is looked at."""
    for batch in batches:
        tokens, ids = _matrix(batch.column("tokens")), batch.column("doc_id").to_numpy()
        key = np.repeat(kernel.mix(np.arange(1, TREES + 1, dtype=np.uint64)), len(ids))
        at = np.tile(np.arange(len(ids)), TREES)
        for _ in range(FIRST_LEVEL):
            key, at = _children(key, at, tokens)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[at])], ["key", "rep"])


def _grouped(nodes: DataFrame) -> DataFrame:
    """(key, rep, pivot) for nodes of two members or more; the pivot is a
    member that a hash of node and member picks."""
    nodes = fitted(nodes)
    sizes = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min_by("rep", F.xxhash64("key", "rep")).alias("pivot")).filter("members > 1")
    return fitted(nodes.join(sizes.drop("members"), "key"))


def _parts(nodes: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's members with their component c; each node's main component,
    its number of components and of members outside the main one."""
    placed = nodes.select("key", "rep").join(found.withColumnRenamed("u", "rep"), "rep", "left")
    placed = placed.select("key", "rep", F.coalesce("component", "rep").alias("c"))
    parts = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    return placed, parts.groupBy("key").agg(F.max_by("c", "n").alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("outside"))


def _alike(x: str, y: str, percent: int) -> Column:
    """Whether sizes and sketches leave the pair a chance."""
    apart = (F.col(f"{x}.low").bitwiseXOR(F.col(f"{y}.low"))).bitwiseOR(F.col(f"{x}.high").bitwiseXOR(F.col(f"{y}.high")))
    sizes = F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * percent
    return sizes & (64 - F.bit_count(apart) >= LEAST_MATCHES)


@F.pandas_udf(LongType())
def common(left: pd.Series, right: pd.Series) -> pd.Series:
    """The size of the intersection of two sorted sets."""
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(left, right, strict=True)], dtype="int64")


def _setter(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for values, bounds in row_sets(batch.column("text"), size):
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), kernel.binary_column(values, bounds)], ["doc_id", "members"])
                first += n

    return sets


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (u, v), those that hold on full sets; docs: doc_id, text."""
    ends = pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct()
    sets = cut(docs.join(ends, "doc_id", "left_semi").mapInArrow(_setter(size), "doc_id long, members binary"))
    left = sets.select(F.col("doc_id").alias("u"), F.col("members").alias("left"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("members").alias("right"))
    both = pairs.join(left, "u").join(right, "v").withColumn("shared", common("left", "right"))
    union = (F.octet_length("left") + F.octet_length("right")) / 8 - F.col("shared")
    return both.filter(F.col("shared") * 100 >= union * percent).select("u", "v")


def _vertices(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` (own, text, mark: a hash of the text) with doc_id, the vertex
    of each row, and whether any differs from the row's own id."""
    shared = docs.filter("own IS NOT NULL").groupBy("own").agg(F.min("mark").alias("first"), F.max("mark").alias("last")).filter("first <> last")
    shared = cut(shared.select("own", "first"))
    if shared.isEmpty():
        return docs.withColumn("doc_id", F.col("own")), False
    other = F.xxhash64("own", "mark").bitwiseAND(F.lit(SURROGATE - 1)).bitwiseOR(F.lit(SURROGATE))
    return docs.join(shared, "own", "left").withColumn("doc_id", F.when(F.col("mark") != F.col("first"), other).otherwise(F.col("own"))).drop("first"), True


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, and
    text_hash, which tells rows of one id apart.

    ``size`` words a shingle; a link from ``percent`` of the union in common.
    The trees are laid out for thresholds of 80 per cent and above.
    """
    if percent < 80:
        raise ValueError("the trees are laid out for a similarity of 0.8 or more")
    small_batches(docs.sparkSession)
    rows, several = _vertices(docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark")))
    texts = rows.select("doc_id", "text")
    signed = cut(rows.select("doc_id", "own", "mark", "text").mapInArrow(_signer(size), "doc_id long, own long, mark long, n long, a long, b long, low long, high long, tokens binary"))
    able = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = able.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"))
    reps = able.join(classes, ["a", "b", "n"]).filter("doc_id = rep").dropDuplicates(["doc_id", "a", "b"])
    reps = fitted(reps.select("doc_id", "n", "low", "high", "tokens"))
    nodes = _grouped(reps.select("doc_id", "tokens").mapInArrow(_plant, "key long, rep long"))
    sketch = reps.select(F.col("doc_id").alias("rep"), F.struct("n", "low", "high").alias("s"))

    # Each member and the likeliest of its nodes' pivots, one of each third.
    met = nodes.filter("rep <> pivot").select("rep", "pivot").distinct()
    met = met.join(sketch.withColumnRenamed("s", "x"), "rep").join(sketch.select(F.col("rep").alias("pivot"), F.col("s").alias("y")), "pivot")
    apart = F.bit_count((F.col("x.low").bitwiseXOR(F.col("y.low"))).bitwiseOR(F.col("x.high").bitwiseXOR(F.col("y.high"))))
    third = F.pmod(F.xxhash64("pivot"), F.lit(3))
    pairs = met.filter(_alike("x", "y", percent)).groupBy("rep", third).agg(F.min_by("pivot", apart).alias("v"))
    pairs = pairs.select(F.greatest("rep", "v").alias("u"), F.least("rep", "v").alias("v")).distinct()
    links = fitted(confirmed(fitted(pairs), texts, size, percent))
    sweep(docs.sparkSession)
    found = fitted(components(links))

    # Members outside their node's main component and the members of others.
    placed, parts = _parts(nodes, found)
    seen = fitted(placed.join(parts.filter("parts > 1"), "key"))
    work = F.col("outside") * F.col("members")
    blocked = (F.col("outside") > NODE) | (work > GRID) | ((work > COPIES_GRID) & (F.col("outside") * 2 < F.col("members")))
    sweep(docs.sparkSession)
    rest = fitted(_across(seen.filter(~blocked), sketch, percent))
    more = confirmed(rest, texts, size, percent) if not rest.isEmpty() else None
    large = seen.filter(blocked)
    if not large.isEmpty():
        blocks = _in_blocks(large, sketch, texts, size, percent)
        more = blocks if more is None else more.union(blocks)
    if more is not None:
        more = fitted(more)
        sweep(docs.sparkSession)
        if not more.isEmpty():
            found = fitted(components(more.union(found.select("u", F.col("component").alias("v")))))

    place = F.coalesce(F.col("component"), F.col("rep"), F.col("doc_id"))
    out = (
        signed.select("doc_id", "own", "mark", "n", "a", "b")
        .join(classes, ["a", "b", "n"], "left")
        .join(found.withColumnRenamed("u", "rep"), "rep", "left")
        .select(F.col("own").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, place).otherwise(F.col("doc_id"))).alias("component_id"), F.col("mark").alias("text_hash"))
    )
    if several:  # a component's least id may stand behind another number
        out = cut(out)
        least = out.filter("component_id IS NOT NULL").groupBy("component_id").agg(F.min("doc_id").alias("least")).filter("least <> component_id")
        out = out.join(least, "component_id", "left").withColumn("component_id", F.coalesce("least", "component_id")).drop("least")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash")


def _across(seen: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """Pairs of a node whose ends are in different components."""
    seen = seen.join(sketch, "rep")
    x, y = seen.filter("c <> main").alias("x"), seen.alias("y")
    both = x.join(y, F.col("x.key") == F.col("y.key")).filter(
        (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep"))) & _alike("x.s", "y.s", percent)
    )
    return both.select(F.greatest("x.rep", "y.rep").alias("u"), F.least("x.rep", "y.rep").alias("v")).distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all sets on the left and right."""
    flat = np.concatenate([*left, *right])
    words, place = np.unique(flat, return_inverse=True)
    if (len(left) + len(right)) * len(words) > 1 << 26:
        lengths = np.array([len(s) for s in right])
        joined, bounds = np.concatenate(right), np.cumsum(lengths) - lengths
        rows = []
        for s in left:
            hit = s[np.minimum(np.searchsorted(s, joined), len(s) - 1)] == joined
            rows.append(np.add.reduceat(hit.astype(np.int64), bounds))
        return np.array(rows)
    holds = np.zeros((len(left) + len(right), len(words)), np.float32)
    holds[np.repeat(np.arange(len(holds)), [len(s) for s in (*left, *right)]), place] = 1
    return np.rint(holds[: len(left)] @ holds[len(left) :].T).astype(np.int64)


def _in_blocks(seen: DataFrame, sketch: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) between the members outside their node's main component and
    the members of others: both are cut into blocks of about BLOCK members and
    ELEMENTS shingles, and every
    block of the ones meets every block of the others in a task that returns
    the links only.

    Nodes of one main component hold much the same members, so they are taken
    together where that makes fewer comparisons than node by node.
    """
    out = F.when(F.col("c") != F.col("main"), F.col("rep"))
    # A main component may hold most documents: it is counted by member first,
    # and its rows meet its one line of counts in SALT parts.
    by_rep = seen.groupBy("main", "rep").agg(F.sum(F.when(F.col("c") != F.col("main"), F.col("members"))).alias("apart"), F.max(F.col("c") != F.col("main")).alias("out"))
    mains = by_rep.groupBy("main").agg(F.sum("apart").alias("apart"), (F.count(F.lit(1)) * F.count_if("out")).alias("together"))
    mains = mains.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    key = F.when(F.col("together") <= F.col("apart"), F.xxhash64(F.lit("main"), F.col("main"))).otherwise(F.col("key"))
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("rep", "key"), F.lit(SALT)).cast("int")).join(mains, ["main", "salt"])
    seen = fitted(seen.select(key.alias("key"), "rep", "c", "main").distinct())
    seen = seen.join(sketch.select("rep", F.col("s.n").alias("n")), "rep")
    size_of = lambda c, n: F.greatest(F.count(c) / BLOCK, F.sum(n) / ELEMENTS)
    sizes = seen.groupBy("key").agg(size_of(F.lit(1), F.col("n")).alias("members"), size_of(out, F.when(out.isNotNull(), F.col("n"))).alias("outside"))
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALT)).cast("int")).join(sizes, ["key", "salt"])
    grid = seen.select(
        "key",
        "rep",
        "c",
        (F.col("c") != F.col("main")).alias("out"),
        F.ceil("members").alias("across"),
        F.ceil(F.coalesce("outside", F.lit(0.0))).alias("down"),
    )
    place = lambda n: F.pmod(F.xxhash64("rep", "key"), n)
    # The outsiders' block goes along its row of the grid, the members' down its column.
    grid = grid.filter("down > 0")
    asks = grid.filter("out").select("key", "rep", "c", F.lit(True).alias("asks"), place(F.col("down")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"))
    told = grid.select("key", "rep", "c", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), place(F.col("across")).alias("j"))
    reps = seen.select(F.col("rep").alias("doc_id")).distinct()
    sets = cut(texts.join(reps, "doc_id", "left_semi").mapInArrow(_setter(size), "doc_id long, members binary"))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rep")
        a, b = block[block["asks"]], block[~block["asks"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        left, right = ([np.frombuffer(m, np.uint64) for m in side["members"]] for side in (a, b))
        shared = overlaps(left, right)
        union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None] - shared
        i, j = np.nonzero((shared * 100 >= union * percent) & (a["c"].to_numpy()[:, None] != b["c"].to_numpy()[None]))
        ends = np.stack([a["rep"].to_numpy()[i], b["rep"].to_numpy()[j]]).astype(np.int64).reshape(2, -1)
        # A member's least partner in each other component says it all.
        links = pd.DataFrame({"u": ends[0], "v": ends[1], "c": b["c"].to_numpy()[j]})
        return links.drop_duplicates(["u", "c"])[["u", "v"]]

    rows = asks.union(told).join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    return rows.groupBy("key", "i", "j").applyInPandas(compare, "u long, v long").distinct()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document stays, with all their columns."""
    mark = fresh(docs, "text_hash")
    gone = near_dedup(docs, id_col, text_col, size, percent).filter("NOT kept").select(F.col("doc_id").alias("gone"), "text_hash").distinct()
    rows, gone = docs.withColumn(mark, F.xxhash64(text_col)).alias("r"), gone.alias("g")
    return rows.join(gone, (F.col(f"r.{id_col}") == F.col("g.gone")) & (F.col(f"r.{mark}") == F.col("g.text_hash")), "left_anti").drop(mark)
