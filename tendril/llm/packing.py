"""Packing documents into sequences by a grouping genetic algorithm on islands.

A document's tokens end with ``END``; one that is longer than a sequence is cut
into pieces of a whole sequence and a rest.  Whole pieces are sequences of their
own.  All other pieces are dealt into shards of about ``SHARD`` pieces by a hash
and every shard is bred on ``ISLANDS`` islands at once, each a task of its own:

* a chromosome is a list of bins; of two the one with fewer bins is fitter, and
  of equal ones that with the greater mean squared fill, for the room then lies
  in few bins, which the next turn dissolves;
* crossover injects whole well-filled bins of one parent into the other, removes
  the bins that hold injected pieces already and her ill-filled ones; displaced
  pieces are swapped into the bins that stay where that fills them better, and
  go back by best fit, largest first;
* an island breeds ``GENERATIONS`` generations, or ``POLISH`` once its bins are as
  few as its pieces' sum allows, to gather the room that is left;
* then an island's best chromosome migrates to the
  next island of its shard, and breeding goes on for the remaining epochs.

The best chromosome of a shard wins.  The bins that are less full than
``LEAST_FILL`` are then dissolved over all shards and packed again in fewer,
larger shards, until one shard holds what is left.

Work and memory of a task depend on the shard, never on the corpus; seeds come
from the shard, island and epoch, so a lost task is bred again to the same bins.

Defined cases: null text counts as empty and is one token; repeated rows are
separate documents; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendril.llm import kernel
from tendril.llm.shared import cut, fresh, small_batches

LENGTH = 2048
END = 0
SHARD = 4000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 24
POLISH = 2
POPULATION = 5
#: Swaps of a displaced piece into a bin that are tried a crossover.
SWAPS = 40
LEAST_FILL = 0.995
#: Bins of a shard and shards of a turn: the places of a sequence's number.
MOST_BINS = 1 << 16
MOST_SHARDS = 1 << 32
#: Entries of a worker's memory of encoded chunks, and the longest kept.
MEMORY = 900_000
LONGEST = 48


_CLOSING = np.zeros(256, bool)
_CLOSING[list(b",.;:!?|")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class ChunkEncoder:
    """Token ids of texts, encoding each chunk of non-space text but once.

    The tokenizer lower-cases, splits at white space before it merges, and
    splits an ASCII letter or digit from a mark that follows; so a text's ids
    are those of its chunks in turn, and a worker remembers the chunks it has
    met.  Words of letters are one pre-token each: many are encoded as one text
    and told apart by the tokens that end a word, and if their number doesn't
    fit, each by itself.  Texts that may spell a special token go whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 500):
            some = words[at : at + 500]
            ids = np.asarray(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else ids
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                out += self._one_by_one(some)
                continue
            data, bounds = ids.tobytes(), (cuts * 4).tolist()
            out += [data[a:b] for a, b in zip([0, *bounds], bounds, strict=False)]
        return out

    def _values(self, chunks: list[bytes]) -> list[bytes]:
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > MEMORY:
            # Long words come back least often.
            middle = int(np.median(np.fromiter(map(len, self.known), np.int64, len(self.known)))) if self.known else 0
            self.known = {c: v for c, v in self.known.items() if len(c) <= middle}
            new = [c for c in chunks if c not in self.known]
        # No chunk holds white space, so one line end parts them for sure.
        texts = b"\n".join(new).decode().split("\n") if new else []
        plain = list(map(str.isalpha, texts))
        odd = [not p for p in plain]
        self.known.update(zip(compress(new, plain), self._together(list(compress(texts, plain))), strict=True))
        self.known.update(zip(compress(new, odd), self._one_by_one(list(compress(texts, odd))), strict=True))
        out = list(map(self.known.__getitem__, chunks))
        for c in new:
            if len(c) > LONGEST:
                del self.known[c]
        return out

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text, as little-endian uint32 bytes."""
        whole = np.flatnonzero(pc.match_substring(column.fill_null(""), "<|").to_numpy(zero_copy_only=False))
        own = dict(zip(whole.tolist(), self._one_by_one([column[i].as_py() for i in whole]), strict=True))
        for s in kernel.slabs(column):
            last = np.maximum(s.ends - 1, 0)
            split = (s.ends - s.starts > 1) & _CLOSING[s.data[last]] & _PLAIN[s.data[last - 1]]
            at = np.flatnonzero(split)
            starts, ends = np.insert(s.starts, at + 1, last[at]), np.insert(s.ends, at, last[at])
            low = _LOWER[s.data]
            first, back = kernel.same_spans(low, starts, ends)
            data = low.tobytes()
            values = self._values([data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
            ids = np.frombuffer(b"".join(values), "<u4")
            begin = np.cumsum(sizes) - sizes
            size = sizes[back]
            upto = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=upto[1:])
            ids = ids[np.repeat(begin[back] - upto[:-1], size) + np.arange(upto[-1])]
            bounds = upto[np.searchsorted(starts, s.offsets)]
            for r in range(s.rows):
                yield own[s.first + r] if s.first + r in own else ids[bounds[r] : bounds[r + 1]].tobytes()


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _cutter(path: str, length: int, end: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    last = np.asarray([end], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                ids += last
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:n])

    return pieces


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 (and ids)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return texts.mapInArrow(_cutter(path, length, end, with_ids), schema)


def best_fit(sizes: np.ndarray, order: np.ndarray, room: list[int], bins: list[list[int]], length: int) -> None:
    """Put the pieces into the fullest bins that have room, else new ones."""
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    free = 0  # bit r is set where some bin has room r
    for b, r in enumerate(room):
        by_room[r].append(b)
        free |= 1 << r
    for i in order:
        size = int(sizes[i])
        above = free >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                free ^= 1 << r
        else:
            r, b = length, len(bins)
            bins.append([])
            room.append(length)
        bins[b].append(int(i))
        room[b] = r - size
        by_room[r - size].append(b)
        free |= 1 << (r - size)


def labels_of(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    flat = np.fromiter((i for members in bins for i in members), np.int64, n)
    out[flat] = np.repeat(np.arange(len(bins)), [len(members) for members in bins])
    return out


def _swap(sizes: np.ndarray, free: list[int], room: list[int], bins: list[list[int]], rng: np.random.Generator) -> list[int]:
    """Put displaced pieces in the place of smaller ones, or of pairs, where
    the bin gets fuller and still holds; what they displace is returned with
    the rest.  Bins with little room are tried, for those can be filled."""
    where = {}
    for i in free:
        where.setdefault(int(sizes[i]), []).append(i)
    tried = [b for b in np.argsort(room, kind="stable")[-SWAPS:].tolist() if room[b] > 0]
    for b in tried:
        members = bins[b]
        pairs = [(i,) for i in members] + [(i, j) for k, i in enumerate(members[:8]) for j in members[:k]]
        for out in (pairs[k] for k in rng.permutation(len(pairs))):
            held = int(sum(sizes[i] for i in out))
            for gain in range(room[b], 0, -1):
                if where.get(held + gain):
                    piece = where[held + gain].pop()
                    bins[b] = [i for i in members if i not in out] + [piece]
                    room[b] -= gain
                    for i in out:
                        where.setdefault(int(sizes[i]), []).append(i)
                    break
                if gain < room[b] - 40:
                    break
            else:
                continue
            if bins[b] is not members:
                break
    return [i for same in where.values() for i in same]


def crossover(sizes: np.ndarray, mother: np.ndarray, father: np.ndarray, rng: np.random.Generator, length: int) -> np.ndarray:
    """The mother with a share of the father's best-filled bins."""
    n = len(sizes)
    fill = np.bincount(father, sizes).astype(np.int64)
    chance = rng.random(len(fill)) * (fill >= np.quantile(fill, 0.5))
    injected = np.flatnonzero(chance > 0.5)
    inside = np.isin(father, injected)
    # The mother's bins that hold an injected piece go; what else they hold is displaced.
    hit = np.zeros(mother.max() + 1, bool)
    hit[mother[inside]] = True
    # So do her worst bins, that their pieces may find better places.
    hit |= np.bincount(mother, sizes, minlength=len(hit)) < LEAST_FILL * length
    displaced = np.flatnonzero(hit[mother] & ~inside)
    label = np.full(n, -1, np.int64)
    label[inside] = father[inside]
    stay = ~hit[mother] & ~inside
    label[stay] = mother[stay] + len(fill)
    _, label[label >= 0] = np.unique(label[label >= 0], return_inverse=True)
    placed = np.flatnonzero(label >= 0)
    bins: list[list[int]] = [[] for _ in range(int(label.max(initial=-1)) + 1)]
    for i, b in zip(placed.tolist(), label[placed].tolist(), strict=True):
        bins[b].append(i)
    room = (length - np.bincount(label[placed], sizes[placed], minlength=len(bins)).astype(np.int64)).tolist()
    free = np.array(_swap(sizes, displaced.tolist(), room, bins, rng), np.int64)
    order = free[np.lexsort((rng.random(len(free)), -sizes[free]))]
    best_fit(sizes, order, room, bins, length)
    return labels_of(bins, n)


def evolve(sizes: np.ndarray, seed: list[int], migrants: list[np.ndarray], length: int, generations: int = GENERATIONS, polish: int = POLISH) -> tuple[np.ndarray, int]:
    """The best chromosome (a bin a piece), and the generations bred."""
    rng = np.random.default_rng(seed)

    def score(label: np.ndarray) -> tuple[int, float]:
        fill = np.bincount(label, sizes)
        return -len(fill), float((fill * fill).mean())

    people = list(migrants)
    while len(people) < POPULATION:
        noise = rng.normal(0, 0.08 * length * (len(people) > 0), len(sizes))
        bins: list[list[int]] = []
        best_fit(sizes, np.argsort(-(sizes + noise), kind="stable"), [], bins, length)
        people.append(labels_of(bins, len(sizes)))
    total = int(sizes.sum())
    full, rest = divmod(total, length)
    ideal = -(full + (rest > 0)), (full * length**2 + rest**2) / max(1, full + (rest > 0))
    ranked = sorted(((score(p), k, p) for k, p in enumerate(people)), key=lambda x: (x[0], -x[1]), reverse=True)
    bred = 0
    while bred < (generations if ranked[0][0][0] < ideal[0] else polish) and ranked[0][0] < ideal:
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = crossover(sizes, ranked[min(a, b)][2], ranked[max(a, b)][2], rng, length)
        bred += 1
        told = score(child)
        if all(told != r[0] for r in ranked):  # a twin would only narrow the search
            ranked = sorted([*ranked, (told, POPULATION + bred, child)], key=lambda x: (x[0], -x[1]), reverse=True)[:POPULATION]
    return ranked[0][2], bred


def _breeder(epoch: int, length: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One island and epoch.  Column ``bin`` holds the island's own chromosome
    and ``guest`` the migrant's, both -1 at first."""

    def breed(island: pd.DataFrame) -> pd.DataFrame:
        island = island.sort_values("uid", kind="stable").reset_index(drop=True)
        sizes = island["length"].to_numpy(np.int64)
        migrants = [island[c].to_numpy(np.int32) for c in ("bin", "guest") if (island[c] >= 0).all()]
        seed = [int(island["shard"].iloc[0]) & 0x7FFFFFFF, int(island["island"].iloc[0]), epoch]
        label, _ = evolve(sizes, seed, migrants, length)
        fill = np.bincount(label, sizes)
        # The least is best: fewer bins, then fuller ones.
        return island.assign(bin=label, guest=-1, bins=len(fill), spread=-float((fill * fill).mean()), fill=fill[label].astype(np.int64))

    return breed


def _bred(pieces: DataFrame, shards: int, length: int, turn: int = 0) -> DataFrame:
    """(uid, length, shard, bin, fill): each shard's best chromosome."""
    people = pieces.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(turn)) if turn else F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"))
    people = people.withColumns({"island": F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])), "bin": F.lit(-1), "guest": F.lit(-1)})
    schema = "uid long, length long, shard int, island int, bin int, guest int, bins int, spread double, fill long"
    for epoch in range(EPOCHS):
        out = people.groupBy("shard", "island").applyInPandas(_breeder(epoch, length), schema)
        people = cut(out)
        if epoch < EPOCHS - 1:
            guest = people.select("uid", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("bin").alias("guest"))
            people = people.drop("guest", "bins", "spread", "fill").join(guest, ["uid", "island"])
    best = people.groupBy("shard").agg(F.min(F.struct("bins", "spread", "island")).alias("best"))
    won = people.join(best, "shard").filter(F.col("island") == F.col("best.island"))
    return won.select("uid", "length", "shard", "bin", "fill")


def pack(pieces: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """``pieces`` (with a ``length`` of at most ``length``) with sequence_id
    and offset; every other column is kept.

    Pieces of ill-filled bins are packed again, dealt into other shards; a turn
    that leaves over 70 % of its pieces in such bins has one more after it, and
    what that leaves stays as bred.
    """
    if shard > MOST_BINS // 2:
        raise ValueError(f"a shard may have {MOST_BINS // 2} pieces at most")
    uid, seq = fresh(pieces, "uid"), fresh(pieces, "seq")
    pieces = cut(pieces.withColumn(uid, F.monotonically_increasing_id()))
    # Numbers of sequences: odd ones for whole pieces, even ones for bins.
    number = lambda turn: ((F.lit(turn * MOST_SHARDS).cast("long") + F.col("shard")) * MOST_BINS + F.col("bin")) * 2
    placed = pieces.filter(F.col("length") == length).select(F.col(uid).alias("uid"), (F.col(uid) * 2 + 1).alias("seq"))
    rest, turn, stuck = pieces.filter(F.col("length") < length).select(F.col(uid).alias("uid"), "length"), 0, 0
    left = rest.count()
    while left:
        shards = -(-left // shard)
        bred = cut(_bred(rest, shards, length, turn))
        full = bred if shards == 1 else bred.filter(F.col("fill") >= LEAST_FILL * length)
        placed = placed.union(full.select("uid", number(turn).alias("seq")))
        if shards == 1:
            break
        rest = bred.filter(F.col("fill") < LEAST_FILL * length).select("uid", "length")
        now = rest.count()
        stuck += now > 0.7 * left  # hardly any full bins came out
        if stuck > 1:
            placed = placed.union(bred.filter(F.col("fill") < LEAST_FILL * length).select("uid", number(turn).alias("seq")))
            break
        left, turn = now, turn + 1
    # Offsets within a sequence: at most ``length`` pieces, so a window is small.
    before = Window.partitionBy(seq).orderBy(uid).rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.join(placed.select(F.col("uid").alias(uid), F.col("seq").alias(seq)), uid)
        .withColumns({"sequence_id": F.col(seq), "offset": F.coalesce(F.sum("length").over(before), F.lit(0))})
        .drop(uid, seq)
    )


def report(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row: sequences used, the least that the tokens need, their fill."""
    sizes = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    least = F.ceil(F.sum("tokens") / length)
    return sizes.agg(F.count(F.lit(1)).alias("sequences"), least.alias("least"), (F.sum("tokens") / (F.count(F.lit(1)) * length)).alias("fill"))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences' ids themselves; ``packed`` has ``ids`` (binary)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    return pack(tokenize(docs, path, id_col, text_col, length, end), length)
