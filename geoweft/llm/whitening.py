"""Operator 13: whitening of embeddings by FEAST contour integration.

Two passes over the vectors give n, the sums, and the covariance of the centred
vectors, by partial matrices per task; of these only d x d numbers reach the
driver. There the covariance is made tridiagonal, so that the inertia of a
shifted matrix, which is how many eigenvalues lie above the shift, is a count
of signs. Bisection on these counts cuts the spectrum, from the top down, into
intervals of at most GROUP eigenvalues, each cut in the widest gap at hand.

Every interval is a row of a DataFrame and is solved by itself: quadrature on a
circle around it sums solutions of complex shifted systems, which projects a
block of vectors onto the eigenvectors inside; a Rayleigh-Ritz step extracts
these, until their residuals are small. An interval must find as many as its
inertia counts differ by; else its block grows, and at last it is an error.

Defined cases: rows with a null vector or null or non-finite entries go, as do
empty vectors and those of another length than the most frequent one (of ties,
the longest); rows repeat as they come, null ids included; components whose
eigenvalue is under LEAST of the largest can't be scaled to one and are left
out, so a table of equal vectors gives no rows, like an empty one; entries of
2^40 and more are an error, as is a deviation that passes 64 bits; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import staged

COMPONENTS = 32
#: Longest vectors: their covariance, of this squared times eight bytes, is sent to the tasks.
MAX_DIMENSION = 4096
#: Eigenvalues of an interval, points of the quadrature, relative residual that is small, share of the largest eigenvalue that counts as zero.
GROUP, POINTS, RESIDUAL, LEAST = 8, 16, 1e-13, 1e-12
LARGEST = float(1 << 40)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): long entries floor(64 c) + 1000000 of the vectors without null or non-finite entries."""
    entries = F.transform(column, lambda c: c.cast("double"))
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(finite)
    whole = F.transform(entries, lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * 64) + 1000000).otherwise(F.raise_error(F.lit("an entry is 2^40 or more")).cast("long")))
    return rows.select("vec_id", whole.alias("x"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def column_sums(rows: DataFrame, column: str, width: int, kind: str) -> tuple[int, list]:
    """Number of rows and sum of each entry; longs are summed exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object if kind == "long" else float)
        for part in batches:
            m = _matrix(part.column(0), width)
            n, total = n + len(m), total + m.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([str(v) if kind == "long" else float(v) for v in total])], names=["i", "n", "v"])

    found = rows.select(column).mapInArrow(run, f"i int, n long, v {'string' if kind == 'long' else 'double'}")
    found = found.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)" if kind == "long" else "double")).alias("v")).orderBy("i").collect()
    return (found[0].n, [int(r.v) if kind == "long" else r.v for r in found]) if found else (0, [])


def covariance(rows: DataFrame, column: str, width: int, centred: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Covariance, divisor n, of the centred rows: partial products per task, summed entry by entry."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for part in batches:
            d = centred(_matrix(part.column(0), width))
            total, seen = total + d.T @ d, True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], names=["i", "j", "v"])

    found = rows.select(column).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((width, width))
    out[found["i"], found["j"]] = found["v"] / n
    return out + np.triu(out, 1).T


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squares beside it of a tridiagonal matrix with the eigenvalues of v, by Householder reflections."""
    a = v.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size:
            x[0] += np.copysign(size, x[0])
            x /= np.linalg.norm(x)
            b = a[k + 1 :, k + 1 :]
            p = b @ x
            p -= x * (x @ p)
            b -= 2 * (np.outer(x, p) + np.outer(p, x))
            a[k + 1 :, k] = a[k, k + 1 :] = 0
            a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
    return np.diag(a).copy(), np.diag(a, 1) ** 2


def above(tri: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Inertia: how many eigenvalues are over the shift."""
    diagonal, beside = tri
    tiny = np.finfo(float).tiny
    count, q = 0, 1.0
    for k, x in enumerate(diagonal.tolist()):
        q = x - shift - (beside[k - 1] / q if k else 0.0)
        q = q or tiny
        count += int(q > 0)
    return count


def intervals(v: np.ndarray, components: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues between) from the top down, GROUP each at most but for those that can't be told apart, of the components and maybe some more.

    An interval ends where the gap behind it is wide beside itself, and reaches
    little farther than its eigenvalues; in what lies between intervals is none.
    """
    tri = tridiagonal(v)
    bound = float(np.abs(v).sum(axis=1).max())
    size, top = len(v), bound * 1.01 + np.finfo(float).tiny

    @cache
    def cut(k: int) -> tuple[float, float]:
        """Bounds of the k-th largest eigenvalue, close together."""
        low, high = -top, top
        while high - low > 1e-12 * bound and low < (middle := (low + high) / 2) < high:
            low, high = (middle, high) if above(tri, middle) >= k else (low, middle)
        return low, high

    found, before, behind = [], 0, np.inf
    while before < min(components, size):
        best, k = None, before + 1
        while k <= size and (k <= before + GROUP or best is None):
            gap = cut(k)[0] - cut(k + 1)[1] if k < size else np.inf
            if gap > 0:
                score = (k - before) * (1.0 if gap == np.inf else gap / (cut(before + 1)[1] - cut(k)[0] + gap))
                best = (score, k, gap) if best is None or score >= best[0] else best
            k += 1
        _, last, gap = best
        high, low = cut(before + 1)[1], cut(last)[0]
        room = max((high - low) / 2, 1e-6 * bound)
        low, high = low - min(gap / 2, room), high + min(behind / 2, room)
        found.append((low, high, above(tri, low) - above(tri, high)))
        before, behind = last, gap
    if sum(n for _, _, n in found) != before:
        raise ArithmeticError("the intervals don't hold all eigenvalues")
    return found


def contour(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The count eigenvalues between low and high, falling, and their eigenvectors as columns."""
    size, scale = len(v), max(np.abs(v).max(), np.finfo(float).tiny)
    angles, weights = np.polynomial.legendre.leggauss(POINTS)
    turns = np.exp(1j * np.pi / 2 * (angles + 1))  # the upper half circle; the lower one gives the conjugates
    middle, radius = (low + high) / 2, (high - low) / 2
    for block in (min(size, count + count // 2 + 4), min(size, 2 * count + 16), size):
        q = np.linalg.qr(np.random.default_rng(13).standard_normal((size, block)))[0]
        small = False
        for _ in range(40):
            y = np.zeros(q.shape)
            for turn, weight in zip(turns, weights, strict=True):
                solved = np.linalg.solve((middle + radius * turn) * np.eye(size) - v, q)
                y += weight / 2 * (radius * turn * solved).real
            basis, values, _ = np.linalg.svd(y, full_matrices=False)
            basis = basis[:, values > 1e-14 * values[0]] if values[0] else basis[:, :0]  # what the projection left
            ritz, vectors = np.linalg.eigh(basis.T @ v @ basis)
            q = basis @ vectors
            inside = (ritz > low) & (ritz < high)
            residual = np.linalg.norm(v @ q[:, inside] - q[:, inside] * ritz[inside], axis=0)
            was, small = small, inside.sum() == count and (residual <= RESIDUAL * scale * np.sqrt(size)).all()
            if was and small:  # one more turn takes the vectors to rounding
                order = np.argsort(-ritz[inside])
                return ritz[inside][order], q[:, inside][:, order]
            if q.shape[1] < count:
                break
    raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, {int(inside.sum())} were found")


def components_of(rows: DataFrame, v: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and unit eigenvectors as columns; intervals are solved by tasks."""
    parts = intervals(v, components)
    spark = rows.sparkSession
    ranges = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in parts], "low double, high double, n int").repartition(len(parts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for low, high, n in part.itertuples(index=False):
                e, u = contour(v, low, high, n)
                yield pd.DataFrame({"e": e, "u": list(u.T)})

    found = sorted(ranges.mapInPandas(run, "e double, u array<double>").collect(), key=lambda x: -x.e)
    # Vectors of neighbouring intervals are at right angles as far as their gap is wide; one more Ritz step over all of them makes it exact.
    basis = np.linalg.qr(np.array([x.u for x in found]).T)[0]
    e, turn = np.linalg.eigh(basis.T @ v @ basis)
    e, u = e[::-1][:components], (basis @ turn)[:, ::-1][:, :components]
    return e[e > LEAST * e[0]], u[:, e > LEAST * e[0]]


def whitened(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    rows = staged(usable(vectors, column), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(vectors.schema["vec_id"].dataType.simpleString())
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], empty)
    width = lengths.d
    if width > MAX_DIMENSION:
        raise ValueError(f"vectors of {width} entries; {MAX_DIMENSION} at most")
    rows = rows.where(F.size("x") == width)
    n, sums = column_sums(rows, "x", width, "long")
    middle = [s // n for s in sums]
    rest = [s - m * n for s, m in zip(sums, middle, strict=True)]

    def exact(x: np.ndarray) -> np.ndarray:
        """n x - S as whole numbers, of 64 bits where these are enough."""
        near = x - np.array(middle, np.int64)
        wide = float(np.abs(near).max(initial=0) + 1) * n >= 2**62
        return near.astype(object if wide else np.int64) * n - np.array(rest, object if wide else np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        return (exact(x) / n).astype(float)

    v = covariance(rows, "x", width, centred, n)
    if not v.any():
        return vectors.sparkSession.createDataFrame([], empty)
    e, u = components_of(rows, v, components)
    scaled = u / np.sqrt(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            d = exact(_matrix(part.column(1), width))
            if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * width >= 2**62:
                d = d.astype(object)
            w = (d / n).astype(float) @ scaled
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array((d * d).sum(axis=1).tolist(), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    done = staged(rows.mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>"), "whitened")
    k = len(e)
    mean = np.array(column_sums(done, "w", k, "double")[1]) / n
    error = float(np.abs(covariance(done, "w", k, lambda w: w - mean, n) - np.eye(k)).max())
    shares = (e / np.trace(v)).tolist()
    share: Column = F.get(F.array(*[F.lit(x) for x in shares]), F.col("at"))
    each = done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
