"""Whitening of embeddings: distributed centred covariance, eigenvectors from a tridiagonal form.

A vector's entries become integers, and the covariance is fitted on each distinct integer
vector once. Sums of entries are exact; each task centres its vectors and sums up their
products, and the tasks' matrices are added. The matrix, which does not grow with the
data, is reduced to a tridiagonal one by Householder reflections; counting sign changes of
its Sturm sequence bisects to the leading eigenvalues; inverse iteration gives their
vectors, made orthogonal again inside clusters of close eigenvalues and reflected back.
Mean and components, a few vectors, go to the tasks with the function that projects.

Defined results: rows whose vector is null, or holds a null or an entry that is not finite,
are dropped; so are vectors of another length than most rows have (of lengths equally
frequent, the largest stays). A component has a variance above rounding error, so that
fewer distinct vectors than components give fewer of them, and equal vectors none. Null
and repeated identifiers are kept. An entry beyond a long's range becomes the end of that
range, and a deviation beyond it is null. An empty table gives no rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import quoted
from rowtide.session import settle

COMPONENTS = 4
# What a float entry is multiplied with before it is floored.
SCALE = 256
_LOW = (1 << 31) - 1
_MOST = (1 << 63) - 1


def integer_vector(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its entries are numbers."""
    odd = F.exists(
        vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    )
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def points(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> tuple[DataFrame, int]:
    """``vec_id x`` of the rows that remain, and the length of their vectors."""
    vector = F.col(quoted(vector_col))
    good = rows.where(finite(vector))
    lengths = good.groupBy(F.size(vector).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    most = lengths.agg(F.max(F.struct("_n", "_d")).alias("_m")).first()[0]
    dims = most["_d"] if most is not None else 0
    kept = good.where(F.size(vector) == dims)
    return kept.select(F.col(quoted(id_col)).alias("vec_id"), integer_vector(vector, scale).alias("x")), dims


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors ``x`` of a batch as the rows of an integer matrix."""
    return batch.column("x").flatten().to_numpy().reshape(-1, dims)


def exact_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each entry, exact whatever their size."""

    def partial(batches):
        count, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = matrix(batch, dims)
            count += len(x)
            high += (x >> 31).sum(axis=0)
            low += (x & _LOW).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dims)), pa.array(high), pa.array(low), pa.array(np.full(dims, count))],
            ["_i", "_high", "_low", "_count"],
        )

    parts = fit.mapInArrow(partial, "_i long, _high long, _low long, _count long")
    big = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("_high", "_low", "_count")]
    rows = parts.groupBy("_i").agg(*big).collect()  # one row for each dimension
    sums = {r["_i"]: (int(r["_high"]) << 31) + int(r["_low"]) for r in rows}
    return (int(rows[0]["_count"]) if rows else 0), [sums.get(i, 0) for i in range(dims)]


def centred_covariance(fit: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """The covariance of ``x`` with divisor ``n``; vectors are centred before they are multiplied."""
    dims = len(mean)

    def partial(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            centred = matrix(batch, dims) - mean
            total += centred.T @ centred
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dims)), pa.array(list(total), pa.list_(pa.float64()))], ["_i", "_row"]
        )

    parts = fit.mapInArrow(partial, "_i long, _row array<double>")
    cells = parts.select("_i", F.posexplode("_row").alias("_j", "_v"))
    cells = cells.where("_i <= _j").groupBy("_i", "_j").agg(F.sum("_v").alias("_v"))
    found = cells.toPandas()  # dims x dims at most
    out = np.zeros((dims, dims))
    out[found["_i"], found["_j"]] = found["_v"]
    out[found["_j"], found["_i"]] = found["_v"]
    return out / n


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflection vectors of a symmetric matrix."""
    a = a.copy()
    d = len(a)
    reflections = []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = math.copysign(np.linalg.norm(v), v[0])
        v[0] += size
        length = np.linalg.norm(v)
        v = v / length if length > 0 else v
        reflections.append(v)
        if length == 0:
            continue
        block = a[k + 1 :, k + 1 :]
        w = block @ v
        w -= (v @ w) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = -size
        a[k + 2 :, k] = a[k, k + 2 :] = 0
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def count_below(diag: list[float], off2: list[float], x: float, tiny: float) -> int:
    """Eigenvalues below ``x``: negative terms of the Sturm sequence."""
    count, q = 0, 1.0
    for i, value in enumerate(diag):
        q = value - x - (off2[i - 1] / q if i else 0.0)
        if q == 0.0:
            q = tiny
        count += q < 0
    return count


def leading_eigenvalues(diag: np.ndarray, off: np.ndarray, k: int) -> list[float]:
    """The ``k`` largest, falling, each bisected to the last digit."""
    radius = np.concatenate(([0], np.abs(off))) + np.concatenate((np.abs(off), [0]))
    bottom, top = float((diag - radius).min()), float((diag + radius).max())
    tiny = np.finfo(float).tiny * max(1.0, float((off**2).max(initial=0)))
    values, squares, d = diag.tolist(), (off**2).tolist(), len(diag)
    found = []
    for rank in range(k):
        low, high = bottom - abs(bottom) * 1e-15, top + abs(top) * 1e-15
        while True:
            middle = low + (high - low) / 2
            if middle in (low, high):
                break
            if count_below(values, squares, middle, tiny) <= d - 1 - rank:
                low = middle
            else:
                high = middle
        found.append(low + (high - low) / 2)
        top = found[-1]
    return found


def solve_shifted(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, small: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges."""
    d = len(diag)
    main, above, second = (diag - shift).tolist(), [*off.tolist(), 0.0], [0.0] * d
    below, b = off.tolist(), b.tolist()
    for i in range(d - 1):
        if abs(below[i]) > abs(main[i]):
            factor = main[i] / below[i]
            main[i], main[i + 1], above[i] = below[i], above[i] - factor * main[i + 1], main[i + 1]
            second[i], above[i + 1] = above[i + 1], -factor * above[i + 1]
            b[i], b[i + 1] = b[i + 1], b[i] - factor * b[i + 1]
        else:
            main[i] = main[i] if main[i] != 0 else small
            factor = below[i] / main[i]
            main[i + 1] -= factor * above[i]
            b[i + 1] -= factor * b[i]
    x = [0.0] * (d + 2)
    for i in range(d - 1, -1, -1):
        pivot = main[i] if abs(main[i]) > small else math.copysign(small, main[i])
        x[i] = (b[i] - above[i] * x[i + 1] - second[i] * x[i + 2]) / pivot
    return np.array(x[:d])


def tridiagonal_vectors(diag: np.ndarray, off: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit eigenvectors (rows) of given eigenvalues by inverse iteration."""
    d = len(diag)
    scale = float(max(np.abs(diag).max(), np.abs(off).max(initial=0))) or 1.0
    eps = np.finfo(float).eps
    rng = np.random.default_rng(12)
    found: list[np.ndarray] = []
    cluster = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * scale:
            cluster = i
        # equal values are set a little apart, or their systems would be the same
        shift = value - 10 * eps * scale * (i - cluster)
        x = rng.standard_normal(d)
        for _ in range(6):
            x = solve_shifted(diag, off, shift, x / np.linalg.norm(x), eps * scale)
            for _ in range(2):
                for other in found[cluster:i]:
                    x = x - (other @ x) * other
        found.append(x / np.linalg.norm(x))
    return np.array(found).reshape(len(values), d)


def leading_components(covariance: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` falling eigenvalues above rounding error, and their unit eigenvectors as rows."""
    d = len(covariance)
    if d == 0 or not covariance.any():
        return np.zeros(0), np.zeros((0, d))
    diag, off, reflections = tridiagonal(covariance)
    values = leading_eigenvalues(diag, off, min(k, d))
    values = [v for v in values if v > d * np.finfo(float).eps * values[0]]
    vectors = tridiagonal_vectors(diag, off, values)
    for at in range(len(reflections) - 1, -1, -1):
        v = reflections[at]
        vectors[:, at + 1 :] -= 2 * np.outer(vectors[:, at + 1 :] @ v, v)
    return np.array(values), vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; null beyond a long's range."""
    reach = max(n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))), 0) + max(map(abs, sums), default=0)
    if reach * reach * max(1, x.shape[1]) <= _MOST:
        scaled = n * x - np.array(sums, np.int64)
        return (scaled * scaled).sum(axis=1).tolist()
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [e if e <= _MOST else None for e in exact]


def whiten(
    rows: DataFrame,
    components: int = COMPONENTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """``vec_id component n deviation whitened explained identity_error`` per row and component."""
    spark = rows.sparkSession
    kept, dims = points(rows, id_col, vector_col, scale)
    kind = kept.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double"
    )
    if dims == 0:
        return spark.createDataFrame([], schema)
    # copies are reduced before the exchange, so that a vector of a third of all rows is few rows
    fit = settle(kept.select("x").distinct())
    n, sums = exact_sums(fit, dims)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    covariance = centred_covariance(fit, n, mean)
    values, vectors = leading_components(covariance, components)
    k = len(values)
    if k == 0:
        return spark.createDataFrame([], schema)
    explained = values / np.trace(covariance)
    projection = vectors.T / np.sqrt(values)

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                white = (matrix(batch, dims) - mean) @ projection
                yield pa.RecordBatch.from_arrays([pa.array(w) for w in white.T], [f"w{i}" for i in range(k)])

    white = fit.mapInArrow(project, ", ".join(f"w{i} double" for i in range(k)))
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in cells]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(found, cells, strict=True))

    def finish(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix(batch, dims)
            white = (x - mean) @ projection
            far = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(far)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(far)),
                    pa.array(white.reshape(-1)),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.mapInArrow(finish, schema)
