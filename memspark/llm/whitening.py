"""Operator 12: whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Vectors become whole numbers on a fixed grid, so that their sums, and each row's deviations from
the mean, are exact whatever the order of the rows. Spark sums the centred scatter: each task
sends one triangle of products, and entries are added by their place. The driver gets that
matrix alone, whose size is that of a vector squared, however many rows there are.

The scatter over n is factored with diagonal pivoting, ``P'VP = LL'``; the factor ends where no
pivot is left above rounding. One-sided Jacobi then rotates the columns of ``L`` itself until
they are orthogonal: their squared norms are the eigenvalues, and the normalised columns, put back
in the order of dimensions, are the components. Pairs of a round are disjoint and rotated at once.

Defined cases: rows without vec_id, and vectors that are null, empty, hold null or non-finite
entries, or entries beyond ``LARGEST``, take no part; a zero vector does; vectors of each length
are whitened by themselves; there are as many components as the scatter has rank at most, so
equal vectors or a single one give no rows; equal eigenvalues keep the order in which they
were found; rows that share a vec_id give their own rows each; a deviation that a long can't hold
is null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


COMPONENTS = 32
#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Larger entries can't become longs whose sums are exact.
LARGEST = 1e9
#: Pivots up to this share of the largest one are rounding.
RANK = 1e-13
#: Columns are orthogonal when their cosine is at most this, times the root of their length.
ORTHOGONAL, SWEEPS = 2.3e-16, 60


@dataclass
class Whitening:
    """What was fitted to ``n`` vectors of one length; ``components`` has one in each column."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        return self.n * x - self.sums[None, :]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n) @ (self.components / np.sqrt(self.eigenvalues))


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with ``v[order][:, order] = L @ L.T``; L has a column for each pivot above rounding."""
    rest, n = v.copy(), len(v)
    order = np.arange(n)
    factor = np.zeros((n, n))
    largest = rest.diagonal().max(initial=0.0)
    for k in range(n):
        p = k + int(rest.diagonal()[k:].argmax())
        if not rest[p, p] > RANK * largest:
            return factor[:, :k], order
        if p != k:
            order[[k, p]] = order[[p, k]]
            factor[[k, p]] = factor[[p, k]]
            rest[[k, p]] = rest[[p, k]]
            rest[:, [k, p]] = rest[:, [p, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs below ``n`` in rounds of disjoint ones, as players of a tournament meet."""
    seats = list(range(n + n % 2))
    out = []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], seats[:half - 1 : -1]) if max(a, b) < n]
        out.append((np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of ``factor @ factor.T``, by rotating the columns of ``factor``."""
    g, least = factor.copy(), ORTHOGONAL * np.sqrt(len(factor))
    rounds = _rounds(g.shape[1])
    for _ in range(SWEEPS):
        still = True
        for i, j in rounds:
            a, b = g[:, i], g[:, j]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(gamma) > least * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            still = False
            i, j, a, b, alpha, beta, gamma = i[turn], j[turn], a[:, turn], b[:, turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            g[:, i], g[:, j] = c * (a - t * b), c * (b + t * a)
        if still:
            break
    values = (g * g).sum(0)
    order = np.argsort(-values, kind="stable")
    return values[order], g[:, order] / np.sqrt(values[order])


def on_grid(vector: Column | str) -> Column:
    """Entries as whole numbers."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def _entries(per_task, rows: DataFrame, kind: str) -> DataFrame:
    """Sums by place over all tasks of the arrays that ``per_task`` makes of batches of grid vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = per_task(_whole(batch.slice(start, 4096).column("x")))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64() if kind == "long" else pa.float64()))], ["part"])

    parts = rows.select("x").mapInArrow(run, f"part array<{kind}>").select(F.posexplode("part").alias("at", "value"))
    return parts.groupBy("at").agg(F.sum("value").alias("value"))


def _whole(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _collected(entries: DataFrame, size: int) -> np.ndarray:
    """Entries by their place; as many as a vector or a matrix of its length has."""
    found = entries.toArrow()
    out = np.zeros(size, found.column("value").to_numpy().dtype)
    out[found.column("at").to_numpy()] = found.column("value").to_numpy()
    return out


def fit(rows: DataFrame, dim: int, most: int = COMPONENTS) -> Whitening:
    """The whitening of all grid vectors ``x`` of ``dim`` entries in ``rows``."""
    counted = _collected(_entries(lambda x: np.concatenate([x.sum(0), [len(x)]]), rows, "long"), dim + 1)
    n, sums = int(counted[dim]), counted[:dim]
    upper = np.triu_indices(dim)

    def products(x: np.ndarray) -> np.ndarray:
        y = (n * x - sums[None, :]) / n
        return (y.T @ y)[upper]

    scatter = np.zeros((dim, dim))
    scatter[upper] = _collected(_entries(products, rows, "double"), len(upper[0]))
    v = (np.triu(scatter) + np.triu(scatter, 1).T) / n
    factor, order = pivoted_cholesky(v)
    values, columns = jacobi(factor)
    components = np.empty_like(columns)
    components[order] = columns
    return Whitening(n, sums, values[:most], components[:, :most], float(np.trace(v)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0

    def products(x: np.ndarray) -> np.ndarray:
        z = model.whitened(x)
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    found = _collected(_entries(products, rows, "double"), k + k * k) / model.n
    mean = found[:k]  # rows are centred exactly, so this is rounding
    return float(np.abs(found[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each usable row of ``embeddings`` (vec_id, embedding) and each of the first ``most`` components."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fits = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST)) & (F.size("embedding") > 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(fits, F.lit(False))).select("vec_id", on_grid("embedding").alias("x"))
    dims = [r[0] for r in rows.select(F.size("x").alias("dim")).distinct().orderBy("dim").collect()]
    if not dims:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    return reduce(DataFrame.union, (_whiten_length(rows.filter(F.size("x") == dim), dim, most) for dim in dims))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten_length(rows: DataFrame, dim: int, most: int) -> DataFrame:
    model = fit(rows, dim, most)
    error, k = identity_error(rows, model), len(model.eigenvalues)
    # A sum of squares below this can be made in longs; others are made from Python's whole numbers.
    safe = np.sqrt(2.0**62 / dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows if k else 0, 4096):
                part = batch.slice(start, 4096)
                x, m = _whole(part.column("x")), part.num_rows
                away = model.deviations(x)
                if np.abs(away).max() < safe:
                    deviation = (away * away).sum(1).tolist()
                else:
                    exact = (sum(d * d for d in own) for own in away.tolist())
                    deviation = [d if d < 1 << 63 else None for d in exact]
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
                columns = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.eigenvalues / model.trace, m)) if model.trace else pa.nulls(0, pa.float64()), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)
