"""Whitening of embeddings: projection on the leading principal components, each scaled to unit variance.

Spark makes the fit list (each distinct vector once), its sums and its covariance; a task adds up a matrix of
``d * d`` numbers at most. The symmetric eigenproblem of that size is solved on the driver: Householder
reflections to tridiagonal form, bisection on Sturm counts for the leading eigenvalues, inverse iteration for
their vectors, which are made orthogonal within clusters. The components, again of bounded size, go out with
the tasks that project the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langmill.llm.table import pick, spread_small, staged

SCALE, SHIFT = 64, 1_000_000  # fixed values
COMPONENTS = 16  # fixed value
#: Largest dimension: the driver holds a covariance matrix of this many rows.
MAX_DIMENSION = 2048
#: Eigenvalues below this share of the largest, for each dimension, are rounding errors of a singular matrix.
NOISE = 2.0**-40
#: Eigenvalues nearer than this share of the matrix norm form a cluster.
CLUSTER = 1e-3
_ENTRIES = 1 << 21  # numbers in a matrix of rows
_BUCKETS = 256  # partial matrices are added up in two steps, by this many tasks for each row first


def quantised(vector: Column) -> Column:
    """Entries as integers."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT))


def usable(vector: Column) -> Column:
    """Neither null nor with an entry that is null or not finite."""
    bound = F.lit(float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < bound, F.lit(False))), F.lit(False))


@dataclass
class Model:
    """What a fit found. ``components`` has a row for each component, ``eigenvalues`` fall."""

    n: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray
    identity_error: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole and broken part of the mean: ``x - whole`` is exact, so little is lost when the rest goes."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        return whole, np.array([(s - self.n * w) / self.n for s, w in zip(self.sums, whole.tolist())])


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``id, x`` of the rows that take part, and the length of their vectors."""
    kept = pick(rows, id=id_col, v=vector_col).where(usable(F.col("v")))
    lengths = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    d = lengths["d"] if lengths else 0
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors have {d} entries, at most {MAX_DIMENSION} are provided for")
    return kept.where(F.size("v") == d).select("id", quantised(F.col("v")).alias("x")), d


def matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """The vectors ``x`` of a few rows at a time as a matrix, with the rows."""
    step = max(1, _ENTRIES // d)
    for batch in batches:
        for first in range(0, len(batch), step):
            part = batch.slice(first, step)
            yield part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), d), part


def _summed(partials: DataFrame, width: int) -> np.ndarray:
    """Sums of the partial rows ``part, i, row`` (doubles as bytes) over all parts, in the order of ``i``."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for value in table.column("row").to_pylist():
            total += np.frombuffer(value)
        return pa.table({"part": pa.array([0], pa.int32()), "i": pa.array([key[0].as_py()], pa.int32()), "row": [total.tobytes()]})

    few = partials.groupBy("i", "part").applyInArrow(add, partials.schema)
    found = few.groupBy("i").applyInArrow(add, partials.schema).collect()  # one row for each dimension
    return np.stack([np.frombuffer(r["row"]) for r in sorted(found, key=lambda r: r["i"])])


def covariance(fit: DataFrame, d: int, width: int, n: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Covariance, divisor ``n``, of ``centred(x)``, whose mean is zero but for rounding."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, task = np.zeros((width + 1, width)), TaskContext.get().partitionId()
        for x, _ in matrices(batches, d):
            c = centred(x)
            total[:width] += c.T @ c
            total[width] += c.sum(axis=0)
        rows = [r.tobytes() for r in total]
        yield pa.RecordBatch.from_arrays(
            [pa.array([task % _BUCKETS] * (width + 1), pa.int32()), pa.array(range(width + 1), pa.int32()), pa.array(rows, pa.binary())], ["part", "i", "row"]
        )

    total = _summed(fit.mapInArrow(add, "part int, i int, row binary"), width) / n
    return total[:width] - np.outer(total[width], total[width])


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, dtype=object), np.zeros(d, dtype=object)
        for x, _ in matrices(batches, d):
            n += len(x)
            high += (x >> 32).sum(axis=0).astype(object)  # halves, so that no sum of a matrix leaves 64 bits
            low += (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        total = [str((int(h) << 32) + int(w)) for h, w in zip(high, low)] + [str(n)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(total)], ["i", "s"])

    parts = fit.mapInArrow(add, "i int, s string")
    found = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one row for each dimension
    by = {r["i"]: int(r["s"]) for r in found}
    return by.get(d, 0), [by.get(i, 0) for i in range(d)]


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflectors: each step clears a column below its subdiagonal."""
    a = a.copy()
    d = len(a)
    reflectors = []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        scale = np.abs(v).max()
        if scale == 0 or not np.any(v[1:]):
            reflectors.append(np.zeros(d - k - 1))
            continue
        v /= scale
        alpha = -np.copysign(np.sqrt(v @ v), v[0])
        v[0] -= alpha
        v /= np.sqrt(v @ v)
        reflectors.append(v)
        a[k + 1 :, k] = 0.0
        a[k, k + 1 :] = 0.0
        a[k + 1, k] = a[k, k + 1] = alpha * scale
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        p -= (v @ p) * v
        rest -= 2.0 * (np.outer(v, p) + np.outer(p, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each point: the negative pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float(np.max(off * off, initial=0.0)))
    pivot = diagonal[0] - at
    count = (pivot < 0).astype(int)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - at - off[i - 1] ** 2 / pivot
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest, falling, each bisected until no number lies between its bounds."""
    d = len(diagonal)
    around = np.abs(np.concatenate((off, [0.0]))) + np.abs(np.concatenate(([0.0], off)))
    low, high = float((diagonal - around).min()), float((diagonal + around).max())
    margin = np.finfo(float).eps * d * max(abs(low), abs(high)) + np.finfo(float).tiny
    lows, highs = np.full(k, low - margin), np.full(k, high + margin)
    rank = d - np.arange(k)  # the j-th largest has d - j below a point right of it
    for _ in range(200):
        middle = lows + (highs - lows) / 2
        if np.all((middle <= lows) | (middle >= highs)):
            break
        right = sturm_counts(diagonal, off, middle) >= rank
        highs, lows = np.where(right, middle, highs), np.where(right, lows, middle)
    return (lows + highs) / 2


def _factor(diagonal: list, off: list, shift: float, smallest: float) -> tuple[list, list, list, list, list]:
    """LU factors, with row exchanges, of the shifted tridiagonal matrix; pivots are ``smallest`` at least."""
    d = len(diagonal)
    u0, u1, u2 = [x - shift for x in diagonal], off + [0.0], [0.0] * d
    factors, swapped = [0.0] * d, [False] * d
    for i in range(d - 1):
        below0, below1 = off[i], u0[i + 1]
        below2 = u1[i + 1]
        if abs(below0) > abs(u0[i]):
            swapped[i] = True
            u0[i], u1[i], u2[i], below0, below1, below2 = below0, below1, below2, u0[i], u1[i], 0.0
        if abs(u0[i]) < smallest:
            u0[i] = smallest if u0[i] >= 0 else -smallest
        factors[i] = below0 / u0[i]
        u0[i + 1] = below1 - factors[i] * u1[i]
        u1[i + 1] = below2 - factors[i] * u2[i]
    if abs(u0[-1]) < smallest:
        u0[-1] = smallest if u0[-1] >= 0 else -smallest
    return u0, u1, u2, factors, swapped


def _solve(lu: tuple[list, list, list, list, list], rhs: np.ndarray) -> np.ndarray:
    u0, u1, u2, factors, swapped = lu
    y = rhs.tolist()
    d = len(y)
    for i in range(d - 1):
        if swapped[i]:
            y[i], y[i + 1] = y[i + 1], y[i]
        y[i + 1] -= factors[i] * y[i]
    y[d - 1] /= u0[d - 1]
    if d > 1:
        y[d - 2] = (y[d - 2] - u1[d - 2] * y[d - 1]) / u0[d - 2]
    for i in range(d - 3, -1, -1):
        y[i] = (y[i] - u1[i] * y[i + 1] - u2[i] * y[i + 2]) / u0[i]
    return np.array(y)


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors, as rows, by inverse iteration; after each step what lies along earlier vectors of the cluster goes."""
    d, eps = len(diagonal), np.finfo(float).eps
    norm = float(max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))) or 1.0
    draw = np.random.default_rng(7)  # a fixed start
    found: list[np.ndarray] = []
    first, previous = 0, np.inf
    for j, value in enumerate(values.tolist()):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        shift = min(value, previous - 2 * eps * norm)  # equal eigenvalues are moved apart
        previous = shift
        lu = _factor(diagonal.tolist(), off.tolist(), shift, eps * norm)
        y = draw.standard_normal(d)
        for step in range(6):
            y = _solve(lu, y / np.abs(y).max())
            y /= np.abs(y).max()
            for _ in range(2):
                for z in found[first:j]:
                    y = y - (z @ y) * z
            y = y / np.sqrt(y @ y)
        found.append(y)
    return np.array(found).reshape(len(values), d)


def decompose(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` leading eigenvalues, falling, and unit eigenvectors as rows; directions without variance are left out."""
    scale = float(np.abs(v).max(initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((0, len(v)))
    diagonal, off, reflectors = tridiagonal(v / scale)
    values = leading_eigenvalues(diagonal, off, min(k, len(v)))
    values = values[values > values[0] * len(v) * NOISE]
    y = eigenvectors(diagonal, off, values).T
    for i in range(len(reflectors) - 1, -1, -1):
        h = reflectors[i]
        y[i + 1 :] -= 2.0 * np.outer(h, h @ y[i + 1 :])
    y /= np.sqrt((y * y).sum(axis=0))
    signs = np.sign(y[np.abs(y).argmax(axis=0), np.arange(y.shape[1])])
    return values * scale, (y * signs).T


def fit(x: DataFrame, d: int, k: int = COMPONENTS) -> Model | None:
    """Components of the distinct vectors of ``x``; None without any vector."""
    distinct = staged(x.select("x").distinct(), "whitening-fit")
    n, sums = column_sums(distinct, d)
    if not n:
        return None
    model = Model(n, sums, 0.0, np.zeros(0), np.zeros((0, d)), 0.0)
    whole, rest = model.centre()
    v = covariance(distinct, d, d, n, lambda m: (m - whole) - rest)
    model.trace = float(np.trace(v))
    model.eigenvalues, model.components = decompose(v, k)
    if len(model.eigenvalues):
        project = (model.components / np.sqrt(model.eigenvalues)[:, None]).T
        got = covariance(distinct, d, len(model.eigenvalues), n, lambda m: ((m - whole) - rest) @ project)
        model.identity_error = float(np.abs(got - np.eye(len(got))).max())
    return model


def deviations(x: np.ndarray, n: int, whole: np.ndarray, rest: list[int]) -> list[int | None]:
    """Exact sums of ``(n * x - S)**2`` by row, with ``n * x - S = n * (x - whole) - rest``; null beyond 64 bits."""
    off = x - whole
    largest = n * int(max(np.abs(off).max(initial=0), 1)) + max(rest, default=0)
    if largest * largest * max(x.shape[1], 1) < 1 << 63:
        y = n * off - np.array(rest, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    wide = (n * off.astype(object) - np.array(rest, dtype=object)) ** 2
    return [s if s < 1 << 63 else None for s in wide.sum(axis=1).tolist()]


def whiten(rows: DataFrame, *, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    Vectors that are null or hold a null or non-finite entry take no part, nor do those whose length is not the most
    frequent one (the greater of equals). Repeated rows and null ids each keep rows of their own; a distinct vector
    counts once in the fit. There are as many components as directions with variance, ``k`` at most: none, and
    so no rows, for an empty table or a single distinct vector. ``deviation`` is null where it leaves 64 bits; an
    entry that leaves them as an integer is an error.
    """
    x, d = vectors(rows, id_col, vector_col)
    kind = x.schema["id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(x, d, k) if d else None
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], schema)
    whole, rest = model.centre()
    left = [s - model.n * w for s, w in zip(model.sums, whole.tolist())]
    project = (model.components / np.sqrt(model.eigenvalues)[:, None]).T
    explained = model.eigenvalues / model.trace
    c, n, error = len(explained), model.n, model.identity_error

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, batch in matrices(batches, d):
            m = len(x)
            whitened = ((x - whole) - rest) @ project
            places = pa.array(np.repeat(np.arange(m), c))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(places), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, n)),
                    pa.array(deviations(x, n, whole, left), pa.int64()).take(places), pa.array(whitened.ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * c, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return spread_small(x).mapInArrow(apply, schema)
