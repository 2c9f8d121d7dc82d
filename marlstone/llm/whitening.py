"""Whitening of embeddings by matrix-free block subspace iteration.

Vectors become whole numbers, and each distinct one is kept once.  Sums, which
are exact, give the mean and the trace.  Each pass over the centred vectors
multiplies the covariance with a block of directions and sends one small matrix
a task; QR makes the next block orthogonal to all blocks before it, so the
subspace keeps what earlier passes have found, and Rayleigh-Ritz in it gives the
components.  Passes go on until the residuals certify the wanted components or
the subspace is the whole space.  The covariance itself is never formed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkit
from marlstone.llm.store import Scratch

SCALE = 256
COMPONENTS = 4
#: Directions that a pass multiplies at once.
BLOCK = 32
#: Directions that are kept; beyond them the subspace starts anew from its best ones.
KEPT = 1024
#: A component is certain when its residual is so small beside the largest eigenvalue, or beside the gap to its neighbours.
RESIDUAL, ANGLE = 1e-13, 1e-11
PASSES = 200
#: Rows that are multiplied together.
_ROWS = 4096
_LIMIT = 1 << 62


def _whole(column: pa.Array, width: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of ``width`` finite entries, and their whole numbers."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    values = column.flatten()
    valid = np.asarray(values.is_valid())
    x = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
    ends = np.cumsum(np.maximum(sizes, 0))
    bad = np.concatenate([[0], np.cumsum(~(valid & np.isfinite(x)))])
    good = (sizes == width) & (bad[ends] == bad[ends - np.maximum(sizes, 0)])
    at = (ends - width)[good][:, None] + np.arange(width)
    with np.errstate(over="ignore"):
        cells = np.floor(scale * x[at])
    # Beyond 64 bits entries stop at the largest and the smallest number, as a cast in SQL does.
    top = cells >= 2.0**63
    out = np.where(top, 0, np.maximum(cells, -(2.0**63))).astype(np.int64)
    out[top] = np.iinfo(np.int64).max
    return good, out


def fit_list(vectors: DataFrame, vector_col: str, scale: int = SCALE) -> tuple[DataFrame | None, int]:
    """Each distinct vector of whole numbers once, as ``x``, and the number of entries; vectors of another length than most are left out."""
    lengths = vectors.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return None, 0
    width = lengths["d"]

    def rows(batches):
        for b in batches:
            _, x = _whole(b.column(0), width, scale)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.reshape(-1)))], ["x"])

    return vectors.select(F.col(vector_col).cast("array<double>")).mapInArrow(textkit.tidy(rows), "x array<long>").distinct(), width


def _sum(fit: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` over blocks of rows, one array a task, added as a tree."""

    def rows(batches):
        total = None
        for b in textkit.slices(batches, _ROWS):
            if len(b):
                x = np.asarray(b.column(0).flatten()).reshape(-1, width)
                here = part(x)
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    sums = fit.mapInArrow(textkit.tidy(rows), "part binary").rdd.map(lambda r: np.frombuffer(r[0], np.float64))
    return sums.treeReduce(np.add, depth=3)


def _exact(x: np.ndarray) -> list[int]:
    """Per dimension the sum, and then the number of rows and the sum of all squares, as exact integers."""
    largest = int(np.abs(x.astype(np.float64)).max()) + 1
    small = largest * largest * x.size < _LIMIT
    y = x if small else x.astype(object)
    return [*y.sum(0).tolist(), len(x), int((y * y).sum())]


def sums(fit: DataFrame, width: int) -> tuple[int, list[int], int]:
    """Number of vectors, their sum, and the sum of the squares of all entries, exact at any size."""

    def rows(batches):
        total = [0] * (width + 2)
        for b in textkit.slices(batches, _ROWS):
            if len(b):
                total = [p + q for p, q in zip(total, _exact(np.asarray(b.column(0).flatten()).reshape(-1, width)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, total))])], ["total"])

    parts = fit.mapInArrow(textkit.tidy(rows), "total string").rdd.map(lambda r: [int(v) for v in r[0].split(",")])
    total = parts.treeReduce(lambda p, q: [a + b for a, b in zip(p, q, strict=True)], depth=3)
    return total[width], total[:width], total[width + 1]


class Whitening:
    """Mean, components as columns, eigenvalues and trace of a fit list of ``n`` vectors with the sums ``total``."""

    def __init__(self, n: int, total: list[int], components: np.ndarray, values: np.ndarray, trace: float) -> None:
        self.n, self.total, self.components, self.values, self.trace = n, total, components, values, trace
        self.mean = np.array([s / n for s in total])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.values)


def fit_components(fit: DataFrame, width: int, components: int = COMPONENTS, block: int = BLOCK) -> tuple[Whitening | None, int]:
    """The components by falling eigenvalue, and how many passes were multiplied; fewer where the vectors span fewer directions."""
    if fit.isEmpty():
        return None, 0
    n, total, squares = sums(fit, width)
    # Whole numbers until the last division.
    trace = (n * squares - sum(s * s for s in total)) / (n * n)
    mean = np.array([s / n for s in total])
    k = min(components, width)
    empty = np.zeros((width, 0))
    if trace <= 0:
        return Whitening(n, total, empty, np.zeros(0), 0.0), 0
    rng = np.random.default_rng(width)
    fresh = np.linalg.qr(rng.standard_normal((width, min(max(block, 2 * k), width))))[0]
    basis, image = empty, empty
    for passes in range(1, PASSES + 1):
        q = fresh

        def multiply(x, q=q):
            centred = x - mean
            return centred.T @ (centred @ q)

        product = _sum(fit, width, multiply).reshape(width, -1) / n
        basis, image = np.hstack([basis, q]), np.hstack([image, product])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = basis @ turn[:, :k]
        residual = np.linalg.norm(image @ turn[:, :k] - ritz * values[:k], axis=0)
        next_value = np.append(values, 0.0)[1 : k + 1]
        gap = np.minimum(values[:k] - next_value, np.append(np.inf, values[: k - 1] - values[1:k]))
        certain = (residual <= RESIDUAL * values[0]) | (residual <= ANGLE * gap)
        if basis.shape[1] == width or certain.all():
            break
        if basis.shape[1] + block >= width:
            fresh = np.linalg.qr(basis, mode="complete")[0][:, basis.shape[1] :]
            continue
        # The new block: the image of the last one, less what the subspace has already; twice, for rounding.
        fresh = product
        for _ in range(2):
            fresh = np.linalg.qr(fresh - basis @ (basis.T @ fresh))[0]
        if basis.shape[1] + block > KEPT:
            best = turn[:, : max(4 * k, block)]
            basis, image = basis @ best, image @ best
    real = values[:k] > width * np.finfo(float).eps * values[0]
    ritz = ritz / np.linalg.norm(ritz, axis=0)
    return Whitening(n, total, ritz[:, real], values[:k][real], trace), passes


def identity_error(fit: DataFrame, width: int, model: Whitening) -> float:
    """Largest entry by which the covariance of the whitened fit list differs from the identity: one more pass."""
    k = model.components.shape[1]

    def part(x):
        w = model.project(x)
        return np.vstack([w.T @ w, w.sum(0)])

    got = _sum(fit, width, part).reshape(k + 1, k) / model.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 as exact integers; None where that is beyond 64 bits."""
    largest = n * (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) + max(abs(s) for s in total)
    if largest * largest * x.shape[1] < _LIMIT:
        away = n * x - np.array(total, np.int64)
        return (away * away).sum(1).tolist()
    out = (((n * x.astype(object)) - np.array(total, object)) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in out]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """For each row and component: ``id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` and ``passes``.

    Rows whose vector is null, is empty, or has a null or non-finite entry are
    dropped, and so are those of another length than most rows have (of equally
    frequent lengths the shortest counts).  Repeated rows and null ids stay;
    copies count once in the fit.  Vectors that span fewer directions have fewer
    components: a single distinct vector has none and gives no row.  Equal
    eigenvalues have any orthogonal components of their space.  A deviation
    beyond 64 bits is null.  Extra columns are ignored; an empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double, passes int"
    scratch = Scratch(spark)
    bare = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    distinct, width = fit_list(bare, "v", scale)
    if distinct is None:
        return spark.createDataFrame([], schema)
    fit = scratch.keep(distinct, "fit")
    model, passes = fit_components(fit, width, components, block)
    if model is None or not len(model.values):
        scratch.drop()
        return spark.createDataFrame([], schema)
    error = identity_error(fit, width, model)
    scratch.drop()
    k, names = len(model.values), [f.split()[0] for f in schema.split(", ")]
    explained = model.values / model.trace

    def rows(batches):
        for b in textkit.slices(batches, _ROWS):
            good, x = _whole(b.column(1), width, scale)
            m = len(x)
            deviation = pa.array(np.repeat(np.array(_deviation(x, model.n, model.total), object), k), pa.int64())
            ids = b.column(0).filter(pa.array(good)).take(pa.array(np.repeat(np.arange(m), k)))
            cells = [
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation,
                pa.array(model.project(x).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)), pa.array(np.full(m * k, passes, np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(cells, names)

    return bare.mapInArrow(textkit.tidy(rows), schema)
