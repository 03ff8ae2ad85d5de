"""Whitening of embeddings: the leading eigenpairs of their covariance by FEAST contour integration.

FEAST finds the eigenpairs of a symmetric matrix V within an interval. The spectral projector onto them is the contour integral of the
resolvent (zI - V)^-1 around the interval; a quadrature over a few complex points z turns it into complex shifted solves, applied to a block
of vectors. Rayleigh-Ritz on the projected block extracts eigenpairs, and the block is projected again until their residuals are at rounding
level. The inertia of V - sI (the signs of the pivots of its symmetric factorisation, by Sylvester's law) counts the eigenvalues
beyond s: it places the interval's ends, in a gap of the spectrum, and confirms at the end that the interval holds exactly the pairs found.

Spark does what grows with the data. Vectors become whole numbers, the fit list (each distinct vector once) is a table, and its sums and products
are added up as whole numbers: each task reduces its rows to one matrix with exact products, Spark adds the entries, so the result is the same however rows
are dealt out. Products are of vectors centred by the rounded mean; what rounding leaves of the mean (under half a unit) is taken off
afterwards. The driver gets one d x d matrix, d being the length of a vector. Two more passes measure the whitened covariance of the
fit list and project every row.

Defined cases: vectors that are null or hold null or non-finite entries are dropped; so are vectors that are not as long as most of the
others (of equally many, the longer count); entries beyond the range of a 64-bit number end at its limits; repeated vectors count once in
the fit and every row is returned; components whose eigenvalue is not over RANK times the largest don't exist (they can't be whitened), so fewer
than `components` come back where the rank is lower, and none where all vectors are alike; repeated eigenvalues get some orthonormal basis,
the same for all rows; a deviation that no 64-bit number holds is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, python_workers

COMPONENTS = 4
#: An entry c becomes floor(SCALE * c).
SCALE = 256
#: Quadrature points of the upper half of the contour (Gauss-Legendre); the lower half is its mirror image.
POINTS = 8
#: Vectors in the projected block for each eigenvalue in the interval, and at least so many more.
BLOCK, SPARE = 1.5, 4
MAX_ROUNDS = 60
#: Residual norms, relative to the largest eigenvalue, that end the iteration.
RESIDUAL = 5e-15
#: Eigenvalues up to this share of the largest are zero.
RANK = 1e-12
#: A gap of the spectrum is at least this wide, relative to the eigenvalue below it.
GAP = 1e-4
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53
_LONG = 1 << 63


# the eigenproblem


def count_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric v exceed shift: the positive pivots of the L D L' factorisation of v - shift I (Bunch-Kaufman)."""
    a = v - shift * np.eye(len(v))
    n, k, positive = len(a), 0, 0
    alpha = (1 + np.sqrt(17)) / 8
    while k < n:
        column = np.abs(a[k + 1 :, k])
        most = column.max() if len(column) else 0.0
        size = 1
        if max(abs(a[k, k]), most) == 0:
            k += 1
            continue
        if abs(a[k, k]) < alpha * most:
            r = k + 1 + int(column.argmax())
            other = np.abs(a[k:, r])
            other[r - k] = 0
            if abs(a[k, k]) * other.max() < alpha * most * most:
                to, size = (k, 1) if abs(a[r, r]) >= alpha * other.max() else (k + 1, 2)
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        end = k + size
        pivot, below = a[k:end, k:end], a[end:, k:end]
        if size == 1:
            positive += int(pivot[0, 0] > 0)
        else:
            det = pivot[0, 0] * pivot[1, 1] - pivot[1, 0] ** 2
            positive += 1 if det < 0 else 2 * int(pivot[0, 0] > 0)
        a[end:, end:] -= below @ np.linalg.solve(pivot, below.T)
        k = end
    return positive


def feast(v: np.ndarray, low: float, high: float, expected: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors (columns) of v within (low, high), of which there are `expected`, and the largest residual norm."""
    n = len(v)
    width = min(n, int(np.ceil(expected * BLOCK)) + SPARE)
    block = np.random.default_rng(0).standard_normal((n, width))
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    middle, radius = (low + high) / 2, (high - low) / 2
    angle = np.pi / 2 * (1 - nodes)  # the upper half circle, from high to low
    points = middle + radius * np.exp(1j * angle)
    shifted = points[:, None, None] * np.eye(n) - v
    scale = np.abs(v).sum(axis=1).max()
    best = None
    for _ in range(MAX_ROUNDS):
        solved = np.linalg.solve(shifted, np.broadcast_to(block.astype(complex), (POINTS, n, width)))
        # 1/(2 pi i) times the integral over both halves is the real part of the upper half's over pi i
        projected = np.einsum("p,pnw->nw", weights / 2 * radius * np.exp(1j * angle), solved).real
        basis, _ = np.linalg.qr(projected)
        values, within = np.linalg.eigh(basis.T @ v @ basis)
        vectors = basis @ within
        inside = np.flatnonzero((values > low) & (values < high))
        if len(inside) >= expected:
            order = inside[np.argsort(-values[inside], kind="stable")]
            residual = np.linalg.norm(v @ vectors[:, order] - vectors[:, order] * values[order], axis=0)
            # a spurious Ritz value inside the interval has a large residual; the true ones have the least
            order = order[np.sort(np.argsort(residual, kind="stable")[:expected])]
            worst = np.sort(residual)[expected - 1]
            if best is None or worst < best[2]:
                best = values[order], vectors[:, order], float(worst)
            elif worst <= 100 * RESIDUAL * scale:
                break  # rounding is reached
            if worst <= RESIDUAL * scale:
                break
        block = vectors
    if best is None:
        raise ArithmeticError(f"the contour around ({low}, {high}) gave fewer than {expected} pairs")
    return best


def leading_pairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the positive semidefinite v (fewer if its rank is lower) and their unit eigenvectors as columns.

    The lower end of the interval lies in the first gap at or below the k-th eigenvalue that bisection by inertia finds, so a repeated one
    is taken whole.
    """
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)
    floor = RANK * top
    k = min(k, count_above(v, floor)) if top > 0 else 0
    if not k:
        return np.zeros(0), np.zeros((len(v), 0))
    low, count = floor, count_above(v, floor)
    after = _bisect(v, k, floor, top)
    for j in range(k, count):
        own, after = after, _bisect(v, j + 1, floor, top)
        if own[0] > after[1] * (1 + GAP):
            low, count = (own[0] + after[1]) / 2, j
            break
    largest = _bisect(v, 1, floor, top)[1]
    high = largest + (largest - low) / 8  # close to the largest, so that those beyond low are far off for the contour's radius
    values, vectors, residual = feast(v, low, high, count)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    slack = max(4 * residual, 64 * np.finfo(float).eps * top)
    found = count_above(v, low), count_above(v, values[-1] - slack)
    if found[0] != count or found[1] != count or count_above(v, values[0] + slack):
        raise ArithmeticError(f"inertia counts {found} eigenvalues where the contour gave {count}")
    return values[:k], vectors[:, :k]


def _bisect(v: np.ndarray, j: int, low: float, high: float) -> tuple[float, float]:
    """Bounds of the j-th largest eigenvalue: below and above."""
    while high > low * (1 + GAP / 10):
        middle = (low + high) / 2 if high < 4 * low else np.sqrt(low * high)
        if count_above(v, middle) >= j:
            low = middle
        else:
            high = middle
    return low, high


# the vectors


def usable(vector: Column) -> Column:
    """True where a vector is not null and all its entries are finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~odd, F.lit(False))


def whole_numbers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x (array of long) of the usable rows."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(F.lit(float(SCALE)) * c)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def _added_up(rows: DataFrame, column: str, size: int, entries) -> list[int]:
    """Whole numbers of every position, summed over rows: entries(matrix of a batch) gives a batch's, as Python or 64-bit integers."""
    d = size

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = entries(_matrix(batch.column(column), d)).astype(object)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"pos": pa.array(range(len(total)), pa.int32()), "value": pa.array([str(int(x)) for x in total], pa.string())})

    found = rows.select(column).mapInArrow(task, "pos int, value string").groupBy("pos").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    out = [0] * (max((r["pos"] for r in found), default=-1) + 1)
    for r in found:
        out[r["pos"]] = int(r["value"])
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    big = max(abs(int(x.max())), abs(int(x.min()))) * len(x) >= _LONG
    return np.concatenate([[len(x)], (x.astype(object) if big else x).sum(axis=0)])


def _products(centre: np.ndarray):
    def products(x: np.ndarray) -> np.ndarray:
        """Sums of products of centred vectors; as doubles where those are exact."""
        far = max(abs(int(x.max())), abs(int(x.min()))) + int(np.abs(centre).max())
        if far * far * len(x) < EXACT:
            z = (x - centre).astype(float)
            return (z.T @ z).astype(np.int64).ravel()
        z = x.astype(object) - centre.astype(object)
        return (z.T @ z).ravel()

    return products


@dataclass
class Whitening:
    """Mean (as whole sums over n), eigenvalues and unit eigenvectors of the fit list's covariance, its trace, and how well the result is white."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of x."""
        mean = np.array([s / self.n for s in self.sums])
        return ((x - mean) @ self.vectors) / np.sqrt(self.values)


def covariance(fit: DataFrame, d: int, column: str = "x") -> tuple[int, list[int], np.ndarray]:
    """n, sums, and covariance (divisor n) of the rows of fit, vectors of d whole numbers."""
    n, *sums = _added_up(fit, column, d, _sums)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=object)
    centre = np.array([int(c) for c in centre], np.int64)
    raw = _added_up(fit, column, d, _products(centre))
    left = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]  # n times what rounding leaves of the mean
    # (n sum(zz') - left left') / n^2, exact until the division
    exact = [[(n * raw[i * d + j] - left[i] * left[j]) / (n * n) for j in range(d)] for i in range(d)]
    return n, sums, np.array(exact, float)


def _white_moments(w: Whitening, d: int, column: str):
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        total = np.zeros(k + k * k)
        for batch in batches:
            y = w.project(_matrix(batch.column(column), d))
            total += np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])
        yield pa.RecordBatch.from_pydict({"pos": pa.array(range(len(total)), pa.int32()), "value": pa.array(total, pa.float64())})

    return moments


def fit_whitening(fit: DataFrame, d: int, components: int = COMPONENTS, column: str = "x") -> Whitening:
    """The whitening of the rows of fit (each distinct vector once)."""
    n, sums, v = covariance(fit, d, column)
    values, vectors = leading_pairs(v, components)
    w = Whitening(n, sums, values, vectors, float(np.trace(v)))
    k = len(values)
    if k:
        found = fit.select(column).mapInArrow(_white_moments(w, d, column), "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(k + k * k)
        for r in found:
            total[r["pos"]] = r["value"]
        mean = total[:k] / n
        w.identity_error = float(np.abs(total[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return w


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None where it is no 64-bit number."""
    far = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in sums)
    if far * far * x.shape[1] < _LONG:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [e if e < _LONG else None for e in exact]


def project(rows: DataFrame, w: Whitening, d: int) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of rows (vec_id, x)."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    k = len(w.values)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not (m and k):
                continue
            x = _matrix(batch.column("x"), d)
            every = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column("vec_id").take(every),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array([w.n] * (m * k), pa.int64()),
                pa.array(_deviations(x, w.n, w.sums), pa.int64()).take(every),
                pa.array(w.project(x).ravel(), pa.float64()),
                pa.array(np.tile(w.values / w.trace, m), pa.float64()),
                pa.array([w.identity_error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(projected, schema)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """project() of every usable row of df, fitted on its distinct vectors."""
    python_workers(df.sparkSession)
    rows = whole_numbers(df, id_col, vector_col)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), F.desc("d")).first()
    if lengths is None or not lengths["d"]:
        return project(rows.filter("false"), Whitening(1, [0], np.zeros(0), np.zeros((1, 0)), 1.0), 1)
    d = lengths["d"]
    rows = rows.filter(F.size("x") == d)
    fit = materialise(rows.select("x").distinct(), "fit")
    w = fit_whitening(fit, d, components)
    discard(fit)
    return project(rows, w, d)


def op13(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
