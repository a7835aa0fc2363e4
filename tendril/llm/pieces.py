"""SentencePiece encoding with seeded merge-dropout, and decoding.

The model is a merge-type (BPE) SentencePiece vocabulary with byte fallback.  A
text is cut into units, a word with the white space before it; pieces don't
reach from one unit into the next.  A unit's characters are merged by an agenda
of candidate merges, best score first, leftmost of ties; a candidate that comes
up is skipped if a keyed hash of (seed, document, place of the unit, place and
length in it) is below ``dropout``, and isn't tried again unless a neighbour's
merge makes it anew.  So every occurrence of a word is cut by itself, and every
run cuts it the same.

A worker remembers *cuts*: a unit, the candidates to skip, the pieces this gives
and the merges made on the way.  An occurrence starts at its unit's cut without
skips; if its draws skip merges of that, it goes on to the cut that skips those
too, until its draws skip no merge of the cut: just what its agenda would give,
for the agenda then makes these merges and skips nothing else that comes up.

With a dropout of 0 the ids are the library's.  Decoding gives the text back
byte by byte for every dropout; a literal U+2581, which the library reads as a
space, is encoded as bytes here.

Defined cases: null and empty texts have no ids; repeated rows are separate
documents (rows without id share one key); an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.llm import kernel
from tendril.llm.shared import small_batches

DROPOUT = 0.1
SEED = 42
#: Cuts that a worker remembers before it starts anew.
MEMORY = 900_000
#: Units of so many bytes are merged by themselves, shorter ones together: their
#: merges are fewer than the bits of a number.
ALONE = 65
#: Units merged together: what they take stays in a core's cache.
TOGETHER = 8_000
#: A merge is numbered by its place in the unit times this, and its length.
SPAN = 128

_SPACE = "▁"
#: Size of the table of mergeable pairs.
SLOT_BITS = 18
_M64 = (1 << 64) - 1
_U = np.uint64


def _mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M64
    return x ^ (x >> 31)


def _step(place: np.ndarray, length: np.ndarray) -> np.ndarray:
    return place.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + length.astype(np.uint64) * _U(0xD6E8FEB86659FD93)


_STEPS = _step(np.repeat(np.arange(SPAN), SPAN), np.tile(np.arange(SPAN), SPAN))


def _slot(code: np.ndarray) -> np.ndarray:
    return ((code.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - SLOT_BITS)).astype(np.int64)


class Pieces:
    """A vocabulary: scores and ids to encode by, bytes to decode by."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in normal}
        self.id = {model.id_to_piece(i): i for i in normal}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.bytes = [b""] * n
        for piece, i in self.id.items():
            self.bytes[i] = piece.replace(_SPACE, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        # What two pieces merge to, by score; and the pieces of single characters.
        merges = [(self.id[p[:k]] * n + self.id[p[k:]], i) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id]
        merges.sort()
        self.size = n
        self.pairs = np.array([c for c, _ in merges], np.int64)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        free = np.arange(len(self.pairs))
        slot = _slot(self.pairs)
        while len(free):  # a full slot sends the rest to the next
            taken = self.slots[slot[free]] >= 0
            now, first = np.unique(slot[free[~taken]], return_index=True)
            placed = free[~taken][first]
            self.slots[now] = placed
            free = np.setdiff1d(free, placed)
            slot[free] = (slot[free] + 1) & ((1 << SLOT_BITS) - 1)
        self.whole = np.array([i for _, i in merges], np.int64)
        levels = {x: r for r, x in enumerate(sorted({*self.score.values()}, reverse=True))}
        names = {i: p for p, i in self.id.items()}
        self.rank = np.array([levels[self.score[names[i]]] for _, i in merges], np.int64)
        self.char = np.full(0x110000, -1, np.int64)
        for p, i in self.id.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[0x20], self.char[0x2581] = self.id.get(_SPACE, -1), -1
        self.forget()

    def forget(self) -> None:
        """Start the memory anew.  By cut: unit, skips, ids and merges made (as
        bytes); the first cut of each unit; where the draws of one lead."""
        self.names: list[bytes] = []
        self.skips: list[bytes] = []
        self.ids: list[bytes] = []
        self.made: list[bytes] = []
        self.known: dict[bytes, int] = {}
        self.turns: dict[tuple[int, int], int] = {}

    def _pair(self, code: np.ndarray) -> np.ndarray:
        """The merge of each pair of pieces, or -1."""
        slot = _slot(code)
        found = self.slots[slot].astype(np.int64)
        odd = np.flatnonzero((found >= 0) & (self.pairs[found] != code))
        while len(odd):
            slot[odd] = (slot[odd] + 1) & ((1 << SLOT_BITS) - 1)
            found[odd] = self.slots[slot[odd]]
            odd = odd[(found[odd] >= 0) & (self.pairs[found[odd]] != code[odd])]
        return found

    def merge_all(self, texts: list[str], skips: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """The ids of many short units, and the merges made: a round merges the
        candidate of each unit that its agenda would bring up next."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        unit = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbol, length = self.char[points], np.ones(len(unit), np.int64)
        none, made = np.int64(1) << 40, []
        barred = np.frombuffer(b"".join(skips), "<u2").astype(np.int64)
        barred += np.repeat(np.arange(len(texts)), [len(x) // 2 for x in skips]) * SPAN * SPAN
        barred = np.append(np.sort(barred), -1)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # By the left symbol of each pair: what it merges to, and its turn.
        whole, order = np.zeros(len(unit), np.int64), np.full(len(unit), none)
        changed = np.arange(len(unit) - 1)
        while len(unit):
            i = changed[(unit[changed] == unit[changed + 1]) & (symbol[changed] >= 0) & (symbol[changed + 1] >= 0)]
            order[changed] = none
            pair = self._pair(symbol[i] * self.size + symbol[i + 1])
            i, pair = i[pair >= 0], pair[pair >= 0]
            if len(barred) > 1:
                code = (unit[i] * SPAN + place[i]) * SPAN + length[i] + length[i + 1]
                stays = barred[np.searchsorted(barred[:-1], code)] != code
                i, pair = i[stays], pair[stays]
            whole[i], order[i] = self.whole[pair], (self.rank[pair] << 16) | place[i]
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.repeat(np.minimum.reduceat(order, starts), np.diff(np.append(starts, len(unit))))
            over = best == none
            done.append((unit[over], place[over], symbol[over]))
            # Turns of a unit differ by place, so one pair of it has the best.
            win = np.flatnonzero((order == best) & ~over)
            symbol[win] = whole[win]
            length[win] += length[win + 1]
            made.append((unit[win] * SPAN + place[win]) * SPAN + length[win])
            stay = ~over
            stay[win + 1] = False
            moved = np.cumsum(stay)[win] - 1
            unit, place, symbol, length, whole, order = unit[stay], place[stay], symbol[stay], length[stay], whole[stay], order[stay]
            touched = np.zeros(len(unit) + 1, bool)
            touched[moved] = touched[moved - 1] = True  # -1 is the spare last place
            changed = np.flatnonzero(touched[: max(0, len(unit) - 1)])
            if len(unit):
                order[-1] = none
                # A unit's last symbol has no pair of its own.
                order[:-1][unit[:-1] != unit[1:]] = none
        unit, place, symbol = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(unit * (1 << 16) + place)
        unit, place, symbol = unit[order], place[order], symbol[order]
        bounds = np.searchsorted(unit, np.arange(len(texts) + 1))
        data = symbol.astype("<i4").tobytes()
        out = [data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for u in np.unique(unit[symbol < 0]).tolist():
            a, b = bounds[u], bounds[u + 1]
            ids = [[i] if i >= 0 else [self.byte[x] for x in texts[u][k].encode()] for i, k in zip(symbol[a:b].tolist(), place[a:b].tolist(), strict=True)]
            out[u] = np.asarray(sum(ids, []), "<i4").tobytes()
        made = np.sort(np.concatenate(made)) if made else np.zeros(0, np.int64)
        bounds = (2 * np.searchsorted(made, np.arange(len(texts) + 1) * SPAN * SPAN)).tolist()
        data = (made % (SPAN * SPAN)).astype("<u2").tobytes()
        return out, [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _cuts(self, names: list[bytes], skips: list[bytes]) -> range:
        """New cuts of these units and skips."""
        first = len(self.names)
        for at in range(0, len(names), TOGETHER):
            ids, made = self.merge_all([n.decode() for n in names[at : at + TOGETHER]], skips[at : at + TOGETHER])
            self.ids += ids
            self.made += made
        self.names += names
        self.skips += skips
        return range(first, len(self.names))

    def _turn(self, cut: np.ndarray, mask: np.ndarray, skips: Callable[[int], bytes]) -> np.ndarray:
        """The cuts that skip the merges of ``mask`` (bits) too; ``skips`` gives
        an occurrence's merges of its mask."""
        order = np.lexsort((mask, cut))
        new = np.append(True, (np.diff(cut[order]) != 0) | (mask[order][1:] != mask[order][:-1]))
        some = order[new]
        pairs = list(zip(cut[some].tolist(), mask[some].tolist(), strict=True))
        lacking = [(p, k) for p, k in zip(pairs, some.tolist(), strict=True) if p not in self.turns]
        if lacking:
            made = self._cuts([self.names[c] for (c, _), _ in lacking], [self.skips[c] + skips(k) for (c, _), k in lacking])
            self.turns.update(zip([p for p, _ in lacking], made, strict=True))
        out = np.empty(len(cut), np.int64)
        out[order] = np.fromiter(map(self.turns.__getitem__, pairs), np.int64, len(pairs))[np.cumsum(new) - 1]
        return out

    def _draw(self, cut: np.ndarray, keys: np.ndarray, least: int) -> np.ndarray:
        """The cut of each occurrence, from that without skips and its key."""
        live = np.flatnonzero(cut >= 0)
        while len(live):
            used, back = np.unique(cut[live], return_inverse=True)
            made = [self.made[c] for c in used.tolist()]
            sizes = np.fromiter(map(len, made), np.int64, len(made)) // 2
            owner, place = kernel.ranges(sizes[back])
            code = np.frombuffer(b"".join(made), "<u2")[(np.cumsum(sizes) - sizes)[back][owner] + place]
            hit = np.flatnonzero(kernel.mix(keys[live][owner] ^ _STEPS[code]) < _U(least))
            mask = np.zeros(len(live), np.uint64)
            np.bitwise_or.at(mask, owner[hit], _U(1) << place[hit].astype(np.uint64))
            on = np.flatnonzero(mask)
            live, mask = live[on], mask[on]
            if len(live):
                data, bounds = code[hit].tobytes(), (2 * np.append(np.searchsorted(owner[hit], on), len(hit))).tolist()
                cut[live] = self._turn(cut[live], mask, lambda k: data[bounds[k] : bounds[k + 1]])  # noqa: B023
        return cut

    def merge(self, text: str, key: int, dropout: float) -> list[str | None]:
        """The pieces of a unit; None takes the place of a literal U+2581."""
        part: list[str | None] = [_SPACE if c == " " else None if c == _SPACE else c for c in text]
        n, score = len(part), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int]] = []

        def candidate(i: int, j: int) -> None:
            if part[i] and part[j]:
                whole = part[i] + part[j]
                s = score.get(whole)
                if s is not None:
                    heapq.heappush(agenda, (-s, i, len(whole)))

        for i in range(n - 1):
            candidate(i, i + 1)
        least = int(dropout * (1 << 64))
        while agenda:
            _, i, length = heapq.heappop(agenda)
            if not part[i]:
                continue
            j = after[i]
            if j >= n or not part[j] or len(part[i]) + len(part[j]) != length:
                continue
            if least and _mix(key ^ (i * 0x9E3779B97F4A7C15 + length * 0xD6E8FEB86659FD93) & _M64) < least:
                continue
            part[i] += part[j]
            part[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                candidate(i, after[i])
            if before[i] >= 0:
                candidate(before[i], i)
        return [p for p in part if p != ""]

    def unit(self, text: str, key: int, dropout: float) -> bytes:
        ids: list[int] = []
        for p in self.merge(text, key, dropout):
            i = self.id.get(p) if p else None
            ids += [self.byte[b] for b in (p or _SPACE).encode()] if i is None else [i]
        return np.asarray(ids, "<i4").tobytes()

    def encode(self, column: pa.Array, keys: np.ndarray, dropout: float, seed: int) -> Iterator[np.ndarray]:
        """The ids of each text; ``keys`` tell documents apart."""
        for s in kernel.slabs(column):
            ends, starts, row = _units(s)
            first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
            place = np.arange(len(row)) - np.searchsorted(row, row)
            salt = keys[s.first : s.last].astype(np.uint64)[row] * _U(0x9E3779B97F4A7C15) + place.astype(np.uint64)
            keyed = kernel.mix(salt + _U(seed & _M64))
            at, back = kernel.same_spans(s.data, starts, ends, first)
            data = s.data.tobytes()
            names = [b" " + data[a:b] if lead else data[a:b] for a, b, lead in zip(starts[at].tolist(), ends[at].tolist(), first[at].tolist(), strict=True)]
            if len(self.names) > MEMORY:
                self.forget()
            new = [n for n in names if len(n) < ALONE and n not in self.known]
            self.known.update(zip(new, self._cuts(new, [b""] * len(new)), strict=True))
            cut = np.fromiter((self.known.get(n, -1) for n in names), np.int64, len(names))[back]
            if dropout:
                cut = self._draw(cut, keyed, int(dropout * (1 << 64)))
            long = np.flatnonzero(cut < 0)
            used, back[cut >= 0] = np.unique(cut[cut >= 0], return_inverse=True)
            values = [self.ids[c] for c in used.tolist()]
            values += [self.unit(names[k].decode(), int(key), dropout) for k, key in zip(back[long].tolist(), keyed[long].tolist(), strict=True)]
            back[long] = len(used) + np.arange(len(long))
            sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
            ids = np.frombuffer(b"".join(values), "<i4")
            begin, size = np.cumsum(sizes) - sizes, sizes[back]
            upto = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=upto[1:])
            ids = ids[np.repeat(begin[back] - upto[:-1], size) + np.arange(upto[-1])]
            bounds = upto[np.searchsorted(row, np.arange(s.rows + 1))]
            for r in range(s.rows):
                yield ids[bounds[r] : bounds[r + 1]]

    def decode(self, ids: np.ndarray) -> str:
        """The text that the ids are of."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))[1:].decode()


def _units(s: kernel.Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends, starts and rows of the units: words with the white space before
    them, and what white space is left at a row's end."""
    last = np.zeros(s.rows, np.int64) + s.offsets[:-1]
    np.maximum.at(last, s.row, s.ends)
    rest = np.flatnonzero(s.offsets[1:] > last)
    ends, row = np.append(s.ends, s.offsets[1:][rest]), np.append(s.row, rest)
    order = np.lexsort((ends, row))
    ends, row = ends[order], row[order]
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    return ends, np.maximum(starts, s.offsets[row]), row


_loaded: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _encoder(path: str, dropout: float, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            column = batch.column("text")
            keys = batch.column("doc_id").fill_null(-1).to_numpy().astype(np.int64).view(np.uint64)
            rows = list(pieces.encode(column, keys, dropout, seed))
            sizes = np.fromiter(map(len, rows), np.int32, len(rows))
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))
            same = [pieces.decode(r) == (t or "") for r, t in zip(rows, column.to_pylist(), strict=True)]
            crcs = [zlib.crc32(r.tobytes()) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), ids, pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "ids_crc32", "lossless"])

    return encode


def encode_pieces(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, ids, ids_crc32, and whether
    decoding the ids gave the text back."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_encoder(path, dropout, seed), "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, lossless boolean")


def decode_pieces(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids."""
    small_batches(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            texts = [pieces.decode(np.asarray(ids or [], np.int32)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(decode, "doc_id long, text string")
