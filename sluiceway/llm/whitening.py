"""Whitening of embeddings: float32 eigenvectors of a distributed covariance, refined in higher precision."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluiceway.session import materialize

# An entry c becomes the whole number floor(SCALE * c) + SHIFT; larger entries count as LARGEST.
SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 45)
COMPONENTS = 16
# Refinements of the eigenvectors at most; each doubles the right digits.
ROUNDS = 16
# Components of less than this share of the largest eigenvalue are noise of a space with fewer dimensions.
NOISE = 1e-12
EXACT = 1 << 53


def _refine(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step in the precision of ``v``: new vectors, eigenvalues, the gap resolved, the change."""
    eye = np.eye(len(v), dtype=v.dtype)
    r = eye - x.T @ x
    s = x.T @ (v @ x)
    # What rounding leaves unsymmetric would be divided by the gap and spoil the right angles.
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    resolved = 2 * float(np.sqrt((off * off).sum()) + np.sqrt((v * v).sum()) * np.sqrt((r * r).sum()))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > resolved
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, values, resolved, float(np.abs(e).max())


def _clusters(values: np.ndarray, resolved: float) -> list[np.ndarray]:
    """Places of eigenvalues that stand closer than what a step resolves, two or more at a time."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > resolved) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def refined_eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, right to double precision.

    The start are float32 eigenvectors. Steps of four matrix products correct
    them, first in double and then in extended precision. Where eigenvalues
    stand too close for a step to tell them apart, it yields a basis of their
    common space only; the matrix is then projected on that space, less the
    mean of the cluster, and solved there, which tells apart what the whole
    matrix could not. Equal eigenvalues keep any basis of their space.
    """
    scale = np.abs(v).max()
    if not scale:
        return np.zeros(len(v)), np.eye(len(v))
    v = v / scale
    x = np.linalg.eigh(v.astype(np.float32))[1]
    for kind, rounds in ((np.float64, 3), (np.longdouble, ROUNDS)):
        a, x = v.astype(kind), x.astype(kind)
        settled, before = 64 * float(np.finfo(kind).eps), np.inf
        for _ in range(rounds):
            x, values, resolved, change = _refine(a, x)
            for run in _clusters(values, resolved):
                space = x[:, run]
                inner = space.T @ (a @ space)
                inner = (inner + inner.T) / 2 - np.eye(len(run), dtype=kind) * (np.trace(inner) / len(run))
                size = np.abs(inner).max()
                if size:
                    x[:, run] = space @ np.linalg.eigh((inner / size).astype(np.float64))[1].astype(kind)
            if change < settled or (change < 1e-15 and change >= before):
                break
            before = change
    values = np.diag(x.T @ (v @ x)) / np.diag(x.T @ x)
    order = np.argsort(-values)
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(x))] < 0, -1, 1)
    return (values[order] * scale).astype(np.float64), x.astype(np.float64)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _products(y: np.ndarray) -> np.ndarray:
    """Whole-number sums of products of columns, exact."""
    most, total, at = int(np.abs(y).max(initial=0)), np.zeros((y.shape[1], y.shape[1]), dtype=object), 0
    block = EXACT // max(1, most * most)
    if not block:
        y = y.astype(object)
        return y.T @ y
    while at < len(y):
        part = y[at : at + min(block, 1 << 16)].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
        at += len(part)
    return total


def _scatter(d: int, center: np.ndarray | None):
    """Per task: sums of the vectors, or of products of their centred entries (i <= j), as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros((1, d) if center is None else (d, d), dtype=object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            rows += len(x)
            total += x.sum(axis=0)[None, :] if center is None else _products(x - center)
        if rows:
            at = np.argwhere(np.triu(np.ones(total.shape, dtype=bool)))
            cells = [Decimal(int(total[i, j])) for i, j in at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1, *at[:, 0].tolist()], pa.int32()),
                    pa.array([-1, *at[:, 1].tolist()], pa.int32()),
                    pa.array([Decimal(rows), *cells], pa.decimal128(38, 0)),
                ],
                names=["i", "j", "amount"],
            )

    return run


def _totals(fit: DataFrame, d: int, center: np.ndarray | None) -> dict[tuple[int, int], int]:
    """A number for each cell and the rows at (-1, -1): as many as the square of the dimension, for any data."""
    parts = fit.mapInArrow(_scatter(d, center), "i int, j int, amount decimal(38,0)")
    return {(r.i, r.j): int(r.amount) for r in parts.groupBy("i", "j").agg(F.sum("amount").alias("amount")).collect()}


def covariance(fit: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, exact sums per dimension, and the exact covariance rounded to extended precision.

    ``fit`` has one column, arrays of ``d`` whole numbers. Entries are centred
    on the floor of their mean before they are multiplied; what the floor cut
    off is taken out of the summed products, all in whole numbers, so that the
    result does not depend on how rows are dealt to tasks.
    """
    sums = _totals(fit, d, None)
    n = sums.get((-1, -1), 0)
    total = np.array([sums.get((0, j), 0) for j in range(d)], dtype=object)
    if not n:
        return 0, total, np.zeros((d, d), dtype=np.longdouble)
    center = np.array([t // n for t in total], dtype=np.int64)
    products = _totals(fit, d, center)
    rest = [t - n * int(c) for t, c in zip(total, center)]
    v = np.zeros((d, d), dtype=np.longdouble)
    for i in range(d):
        for j in range(i, d):
            exact = Fraction(n * products[i, j] - rest[i] * rest[j], n * n)
            high = float(exact)
            v[i, j] = v[j, i] = np.longdouble(high) + np.longdouble(float(exact - Fraction(high)))
    return n, total, v


def _moments(d: int, center: np.ndarray, rest: np.ndarray, weights: np.ndarray):
    """Per task: rows, sums and sums of products of whitened vectors; index -1 stands for the constant 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = weights.shape[1] + 1
        total = np.zeros((k, k))
        for batch in batches:
            z = (_matrix(batch.column(0), d) - center - rest) @ weights
            z = np.hstack([np.ones((len(z), 1)), z])
            total += z.T @ z
        if total[0, 0]:
            at = np.argwhere(np.triu(np.ones((k, k), dtype=bool)))
            cells = [pa.array(at[:, 0] - 1, pa.int32()), pa.array(at[:, 1] - 1, pa.int32()), pa.array(total[at[:, 0], at[:, 1]])]
            yield pa.RecordBatch.from_arrays(cells, names=["i", "j", "amount"])

    return run


def _identity_error(fit: DataFrame, d: int, center: np.ndarray, rest: np.ndarray, weights: np.ndarray) -> float:
    parts = fit.mapInArrow(_moments(d, center, rest, weights), "i int, j int, amount double")
    sums = {(r.i, r.j): r.amount for r in parts.groupBy("i", "j").agg(F.sum("amount").alias("amount")).collect()}
    n = sums[-1, -1]
    mean = {k: sums[-1, k] / n for k in range(weights.shape[1])}
    return max(abs(sums[i, j] / n - mean[i] * mean[j] - (i == j)) for i, j in sums if i >= 0)


def _whitened(d: int, n: int, center: np.ndarray, rest_sum: np.ndarray, weights: np.ndarray, explained: np.ndarray, error: float):
    rest = rest_sum.astype(np.float64) / n
    k = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(1), d) - center
            # Products of whole numbers wrap around, so a sum that fits is exact whatever wrapped on the way.
            spread = y * np.int64(n) - rest_sum
            sums = (spread * spread).sum(axis=1)
            large = ((y * float(n) - rest_sum) ** 2).sum(axis=1) >= 2.0**63
            sums[large] = np.iinfo(np.int64).max
            z = (y - rest) @ weights
            rows = len(z)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, dtype=np.int64)),
                    pa.array(np.repeat(sums, k)),
                    pa.array(z.reshape(-1)),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Embeddings projected on their leading components, each with unit variance.

    An entry c becomes the whole number x = floor(64 c) + 1000000. The
    covariance is that of the distinct x vectors. Its eigenvectors are numbered
    from 1 by falling eigenvalue; their largest entry is positive.

    Returns, per row and component, ``id``, component, n (distinct vectors),
    deviation (sum over dimensions of (n x - sum)^2, exact; the largest long
    where it does not fit), whitened, explained (share of the trace) and
    identity_error (of the covariance of the distinct whitened vectors).

    Vectors that are null or hold null, NaN or infinity give no rows; nor do
    vectors of another length than the most common one (the longer of equally
    common ones), as they are of another space. Entries count as 2**45 at most.
    Components without variance are left out, so a table of equal vectors, or
    an empty one, gives no rows. Repeated rows and null ids are rows like any
    other. Broadcast are d by d numbers and less, d being the dimension.
    """
    kind = dict(df.dtypes)[id]
    source = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.floor(F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST)) * SCALE) + SHIFT
    rows = source.where(F.col("v").isNotNull() & finite).select("id", F.transform("v", whole).alias("x"))
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = rows.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    weights, values = np.zeros((0, 0)), np.zeros(0)
    if sizes:
        d = sizes[0].d
        rows = rows.where(F.size("x") == d)
        fit = materialize(rows.select("x").distinct(), "fit")
        n, total, v = covariance(fit, d)
        values, vectors = refined_eigenvectors(v)
        keep = np.flatnonzero(values > NOISE * max(values[0], 0))[:components]
        weights = vectors[:, keep] / np.sqrt(values[keep])
    if not weights.size:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)
    center = np.array([t // n for t in total], dtype=np.int64)
    rest_sum = np.array([t - n * int(c) for t, c in zip(total, center)], dtype=np.int64)
    error = _identity_error(fit, d, center, rest_sum / n, weights)
    explained = (values[keep] / float(np.trace(v))).astype(np.float64)
    return rows.mapInArrow(_whitened(d, n, center, rest_sum, weights, explained, error), schema).withColumnRenamed("id", id)
