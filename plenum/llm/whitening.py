"""Whitened principal components by QDWH spectral divide-and-conquer.

Spark gathers the sums and the centred covariance of all vectors, a few numbers per dimension and pair of dimensions. The covariance, whose
size depends on the dimension only, is taken apart on the driver: the orthogonal polar factor of the covariance minus a shift, by the
dynamically weighted Halley iteration (QDWH), is the sign of that matrix, so (factor + identity) / 2 projects on the components above the shift.
Bases of the two invariant subspaces turn the covariance into two smaller ones, which are split again until single components are
left. Their vectors over the roots of their eigenvalues whiten all rows, with the small matrix shipped to each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.shared import mapped, written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries from this size on have no exact scaled integer and count as non-finite.
LARGEST = float(1 << 42)
#: An eigenvalue below this share of the largest is zero but for rounding.
NOTHING = 1e-13
_EPS = np.finfo(np.float64).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH; singular values down to 1e-16 of the largest are followed."""
    n = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.eye(n)
    x, low = a / norm, 1e-16
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            inner = np.linalg.cholesky(np.eye(n) + wc * x.T @ x)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(inner.T, np.linalg.solve(inner, x.T)).T
        new = (new + new.T) / 2
        change, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if low > 1 - 10 * _EPS and change < 1e-8:  # cubic convergence: the next step would change nothing
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift, both not empty; None if all eigenvalues agree to rounding."""
    n, middle = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - middle * np.eye(n))
    if spread <= 8 * _EPS * n * np.linalg.norm(a):
        return None
    random = np.random.default_rng(n)
    shifts = [float(np.median(np.diag(a))), middle, *(middle + f * spread / np.sqrt(n) for f in (0.01, -0.01, 0.1, -0.1, 0.3, -0.3, 0.5, -0.5))]
    for shift in shifts:
        above = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = round(float(np.trace(above)))
        if not 0 < k < n or np.linalg.norm(above @ above - above) > 1e-9:
            continue  # an eigenvalue at the shift, or all on one side
        high, _ = np.linalg.qr(above @ random.standard_normal((n, k)))
        high, _ = np.linalg.qr(above @ high)
        low = random.standard_normal((n, n - k))
        for _ in range(2):
            low, _ = np.linalg.qr(low - above @ low)
        low, _ = np.linalg.qr(low - high @ (high.T @ low))
        if np.linalg.norm(high.T @ a @ low) <= 1e-10 * np.linalg.norm(a):
            return high, low
    return None


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix by recursive splits."""
    n = len(a)
    if n == 1:
        return a[0].copy(), np.ones((1, 1))
    parts = _split(a)
    if parts is None:
        return np.diag(a).copy(), np.eye(n)
    values, vectors = [], []
    for basis in parts:
        inner = basis.T @ a @ basis
        own, turned = eigen((inner + inner.T) / 2)
        values.append(own)
        vectors.append(basis @ turned)
    value, vector = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-value, kind="stable")
    return value[order], vector[:, order] / np.linalg.norm(vector[:, order], axis=0)


def _usable(column: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(numbers of the rows, x as float64 by dimension) of vectors that are not null and hold finite entries only."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = pc.fill_null(pc.cast(flat, pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    bad = ~(np.abs(values) < LARGEST)
    ends = np.cumsum(sizes)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    fine = (sizes > 0) & (wrong[ends] == wrong[ends - sizes])
    out = {}
    for d in np.unique(sizes[fine]).tolist() if dimension is None else [dimension]:
        rows = np.flatnonzero(fine & (sizes == d))
        taken = values[(ends - sizes)[rows][:, None] + np.arange(d)] if len(rows) else np.zeros((0, d))
        out[d] = (rows, np.floor(SCALE * taken) + SHIFT)
    return out


def _sums(vectors: DataFrame) -> tuple[int, int, np.ndarray]:
    """(n, dimension, sums of x); the dimension that most vectors have, the larger of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for d, (rows, x) in _usable(batch.column(0)).items():
                n, total = held.get(d, (0, np.zeros(d, np.int64)))
                held[d] = (n + len(rows), total + x.astype(np.int64).sum(axis=0))
        for d, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(total)], names=["dimension", "place", "n", "total"]
            )

    parts = written(mapped(vectors.select("vector"), run, "dimension int, place int, n long, total long"), "sums")
    most = parts.where("place = 0").groupBy("dimension").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dimension")).first()
    if most is None:
        return 0, 0, np.zeros(0, np.int64)
    found = parts.where(F.col("dimension") == most["dimension"]).groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()  # a row per dimension
    return most["n"], most["dimension"], np.array([r["total"] for r in found], np.int64)


def _products(vectors: DataFrame, dimension: int, of_x, size: int) -> np.ndarray:
    """The sum over all usable vectors of y y', y being `of_x(x)` with `size` entries; added up per task, then in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            _, x = _usable(batch.column(0), dimension)[dimension]
            y = of_x(x)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["place", "total"])

    found = mapped(vectors.select("vector"), run, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()  # size x size
    out = np.zeros(size * size)
    for r in found:
        out[r["place"]] = r["total"]
    return out.reshape(size, size)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(`id_col`, component, n, deviation, whitened, explained, identity_error) for each usable vector and each of the first components.

    Vectors that are null, empty, or hold null, non-finite or entries beyond 2^42 are left out, as are vectors of another dimension than most.
    An entry c counts as x = floor(1024 c) + 100000. Components have rising numbers by falling eigenvalue of x's covariance (divisor n);
    of equal eigenvalues any basis is taken. Eigenvalues that are zero but for rounding have no rows: one vector, or all equal ones, give an empty
    table. `deviation` is null where it does not fit a long. Repeated rows and null ids are vectors like any other. An empty table gives
    an empty table. Other columns are not read.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = source.schema["id"].dataType.simpleString()
    shape = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, dimension, sums = _sums(source)
    weights = None
    if n:
        mean = sums / n
        covariance = _products(source, dimension, lambda x: x - mean, dimension) / n
        values, axes = eigen((covariance + covariance.T) / 2)
        real = int(np.count_nonzero(values[:components] > NOTHING * max(values[0], 0.0))) if values[0] > 0 else 0
        if real:
            weights = axes[:, :real] / np.sqrt(values[:real])
    if weights is None:
        return spark.createDataFrame([], shape).withColumnRenamed("id", id_col)
    explained = values[:real] / np.trace(covariance)
    error = float(np.abs(_products(source, dimension, lambda x: (x - mean) @ weights, real) / n - np.eye(real)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                rows, x = _usable(part.column(1), dimension)[dimension]
                apart = n * x.astype(np.int64) - sums
                if dimension * float(np.abs(apart).max(initial=0)) ** 2 < 2.0**62:
                    deviation = pa.array((apart * apart).sum(axis=1))
                else:
                    exact = [sum(v * v for v in r) for r in apart.tolist()]
                    deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                white = (x - mean) @ weights
                row = pa.array(np.repeat(np.arange(len(rows)), real))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows)).take(row), pa.array(np.tile(np.arange(1, real + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(row), n)), deviation.take(row), pa.array(white.ravel()),
                        pa.array(np.tile(explained, len(rows))), pa.array(np.full(len(row), error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return mapped(source, run, shape).withColumnRenamed("id", id_col)
