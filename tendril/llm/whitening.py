"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance is never formed.  A pass over the rows multiplies it by a block:
each task adds up ``Xc' (Xc Q)`` of its centred rows, a partial and a final sum
bring the ``dimensions x block`` numbers together, and only they reach the
driver, which orthogonalises (QR) and takes Ritz vectors (Rayleigh-Ritz).  The
products of earlier blocks are known, so the Ritz vectors are taken from them
too; past ``KEPT`` blocks the space shrinks to its leading Ritz vectors.  Passes
end when the residuals ``|V u - e u|`` of all components are below ``TOLERANCE``
of the largest eigenvalue; a last pass over the finished components measures the
residuals again, the trace, and the covariance of the whitened values.

Entries become whole numbers, ``floor(1024 c) + 100000``.  Their sums are exact,
and rows are centred by the whole and the broken part of the mean apart, so the
large offset costs no digits.  What a task holds is one batch of rows.

Defined cases: rows whose vector is null, empty, or holds null or non-finite
entries go; of vectors of several lengths the commonest length stays (of ties
the longest); repeated ids are separate rows, a null id stays null; components
of no variance (below ``FLAT`` of the largest eigenvalue) are left out, so equal
vectors, or a single one, give no rows, as does an empty table; entries so large
that their squared deviations don't fit a long raise; other columns are not read.
Rows are read once a pass: give a table, or write an expensive plan to one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.llm.shared import small_batches

SCALE, OFFSET = 1024, 100_000
#: Columns that a pass multiplies beyond the components asked for.
SPARE = 8
#: Blocks whose products are kept for Rayleigh-Ritz.
KEPT = 12
TOLERANCE = 1e-13
FLAT = 1e-10
MOST_PASSES = 300
#: Vectors that a task takes at once (fewer if they are long).
BATCH = 4096
#: Whole numbers that a double holds exactly.
EXACT = 2.0**53
DEVIATION_LIMIT = 2.0**63


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a column of ``size`` entries each are finite, and the
    whole numbers of those."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    fine = np.isfinite(values).all(1)
    scaled = np.floor(SCALE * values[fine])
    if len(scaled) and np.abs(scaled).max() + OFFSET > EXACT:
        raise ValueError("an entry is too large for whole numbers")
    return fine, scaled.astype(np.int64) + OFFSET


class Centring:
    """The mean of whole numbers, as a whole part and the rest."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums = n, sums
        self.whole, rest = np.divmod(sums, n)
        self.rest = rest / n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n x - S)^2 of each row, exactly."""
        rough = self(x) * self.n
        if len(x) and (rough * rough).sum(1).max() > 0.99 * DEVIATION_LIMIT:
            raise OverflowError("a squared deviation does not fit a long")
        apart = (x - self.whole) * self.n - (self.sums - self.whole * self.n)
        return (apart * apart).sum(1)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors by length."""
    for batch in batches:
        column = batch.column(0)
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        bad = ~np.isfinite(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
        held = np.zeros(len(bad) + 1, np.int64)
        np.cumsum(bad, out=held[1:])
        ends = np.cumsum(sizes).astype(np.int64)
        fine = held[ends] == held[ends - sizes.astype(np.int64)]
        size, n = np.unique(sizes[fine].astype(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(n)], ["size", "n"])


def _summed(rows: DataFrame, size: int, width: int, work: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all rows of ``work``, a table of ``width`` numbers a line;
    every task sends one such table, the driver gets one."""
    names = [f"v{k}" for k in range(width)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, x = _matrix(batch.column(0), size)
            part = work(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *map(pa.array, total.T)], ["i", *names])

    parts = rows.mapInArrow(add, f"i int, {', '.join(f'{c} {kind}' for c in names)}")
    lines = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).orderBy("i").collect()
    return np.array([list(r[1:]) for r in lines])


def centring(rows: DataFrame, size: int) -> Centring | None:
    """Count and sums of the usable vectors of ``size`` entries."""
    sums = _summed(rows, size, 2, lambda x: np.stack([x.sum(0), np.full(size, len(x))], 1), "long")
    n = int(sums[0, 1]) if len(sums) else 0
    return Centring(n, sums[:, 0].astype(np.int64)) if n else None


def _beyond(block: np.ndarray, basis: np.ndarray, most: int, least: float) -> np.ndarray:
    """An orthonormal basis of what ``block`` holds outside ``basis``: its
    ``most`` strongest directions, those above ``least``."""
    for _ in range(2):  # twice is enough
        block = block - basis @ (basis.T @ block)
    axes, strength, _ = np.linalg.svd(block, full_matrices=False)
    axes = axes[:, :most][:, strength[:most] > least]
    axes = axes - basis @ (basis.T @ axes)
    return np.linalg.qr(axes)[0]


def subspace(product: Callable[[np.ndarray], np.ndarray], size: int, k: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their vectors of a symmetric matrix
    that is only known by its ``product`` with a block."""
    width = min(size, k + SPARE)
    rng = np.random.default_rng(0)
    block = np.linalg.qr(rng.standard_normal((size, width)))[0]
    basis, known = np.zeros((size, 0)), np.zeros((size, 0))
    for _ in range(MOST_PASSES):
        basis, known = np.hstack([basis, block]), np.hstack([known, product(block)])
        inner = basis.T @ known
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = basis @ turn, known @ turn
        wrong = image[:, :k] - ritz[:, :k] * values[:k]
        worst = np.linalg.norm(wrong, axis=0).max()
        if basis.shape[1] == size or worst <= tolerance * max(values[0], 0.0):
            return values[:k], ritz[:, :k]
        if basis.shape[1] >= KEPT * width:
            basis, known = ritz[:, : 2 * width], image[:, : 2 * width]
        # The iteration: what the images of the space add to it.
        room = min(width, size - basis.shape[1])
        block = _beyond(known, basis, room, 0.01 * tolerance * values[0])
        if not block.shape[1]:  # an invariant subspace
            block = _beyond(rng.standard_normal((size, room)), basis, room, 0.0)
    raise ArithmeticError(f"residuals did not settle: {worst:.3g} of {values[0]:.3g}")


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8) -> DataFrame:
    """One row for each usable vector and component, up to ``k``."""
    small_batches(table.sparkSession, BATCH)
    kind = table.schema[id_col].dataType
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = table.sparkSession.createDataFrame([], f"`{id_col}` {kind.simpleString()}, {schema}")
    vectors = table.filter(F.size(vector_col) > 0).select(F.col(vector_col).alias("v"))
    common = vectors.mapInArrow(_lengths, "size long, n long").groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return empty
    size = common["size"]
    rows = vectors.filter(F.size("v") == size)
    centre = centring(rows, size)

    def product(block: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            centred = centre(x)
            return centred.T @ (centred @ block)

        return _summed(rows, size, block.shape[1], work, "double") / centre.n

    values, components = subspace(product, size, min(k, size))
    spread = values > FLAT * max(values[0], 0.0)
    values, components = values[spread], components[:, spread]
    if not len(values):
        return empty

    def measure(x: np.ndarray) -> np.ndarray:
        """Lines: images of the components, whitened products, sums, trace."""
        centred = centre(x)
        along = centred @ components
        white = along / np.sqrt(values)
        square = np.zeros((1, len(values)))
        square[0, 0] = (centred * centred).sum()
        return np.vstack([centred.T @ along, white.T @ white, white.sum(0)[None], square])

    sums = _summed(rows, size, len(values), measure, "double") / centre.n
    image, second, first, trace = sums[:size], sums[size:-2], sums[-2], sums[-1, 0]
    residual = np.linalg.norm(image - components * values, axis=0).max()
    if residual > 1e3 * TOLERANCE * values[0]:
        raise ArithmeticError(f"the components are not certified: residual {residual:.3g} of {values[0]:.3g}")
    error = float(np.abs(second - np.outer(first, first) - np.eye(len(values))).max())
    shares = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(values)
        for batch in batches:
            fine, x = _matrix(batch.column(1), size)
            ids = batch.column(0).filter(pa.array(fine))
            white = centre(x) @ components / np.sqrt(values)
            every = np.repeat(np.arange(len(x)), m)
            columns = [
                ids.take(pa.array(every)),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(every), centre.n)),
                pa.array(centre.deviations(x)[every]),
                pa.array(white.ravel()),
                pa.array(np.tile(shares, len(x))),
                pa.array(np.full(len(every), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    named = table.filter(F.size(vector_col) == size).select(F.col(id_col), F.col(vector_col).alias("v"))
    return named.mapInArrow(project, f"`{id_col}` {kind.simpleString()}, {schema}")
