"""Whitening against plain numpy and whole-number sums."""

from __future__ import annotations

import math

import numpy as np
import pytest

from langmill.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def whitened(spark, tmp_path, rows, more=""):
    table = spark.createDataFrame(rows, SCHEMA)
    if more:
        table = table.selectExpr("*", *[f"1 AS {name}" for name in more.split()])
    table.repartition(5).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op12_embedding_whitening(spark, str(tmp_path))
    assert found.columns == COLUMNS
    return found.toPandas()


def plain(rows):
    """Integers of the rows that take part, the fit list, and the spectrum of its covariance."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v, _ in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    return kept, n, sums, y, y.T @ y / n


def check(got, rows, components):
    kept, n, sums, y, v = plain(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    assert len(got) == len(kept) * components and (got.n == n).all()
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    exact = sorted(((i if i is not None else -1), sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in kept)
    one = got[got.component == 1]
    assert sorted(zip(one.vec_id.fillna(-1).astype(int), one.deviation)) == exact
    for c in range(components):
        part = got[got.component == c + 1]
        assert np.allclose(part.explained, values[c] / np.trace(v), rtol=1e-9)
        want = {}
        for i, x in kept:
            centred = np.array([(n * a - s) / n for a, s in zip(x, sums)])
            want.setdefault(i if i is not None else -1, []).append(centred @ vectors[:, c] / math.sqrt(values[c]))
        mine = {}
        for i, w in zip(part.vec_id.fillna(-1).astype(int), part.whitened):
            mine.setdefault(i, []).append(w)
        ids = sorted(want)
        a, b = (np.array([x for i in ids for x in sorted(m[i])]) for m in (want, mine))
        other = np.array([x for i in ids for x in sorted(-w for w in want[i])])
        assert np.allclose(a, b, atol=1e-8) or np.allclose(other, b, atol=1e-8)


def drawn(n, d, seed=0):
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((n, d)) * np.linspace(4, 0.5, d)
    return [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(base)]


def test_whitening(spark, tmp_path):
    rows = drawn(300, 24)
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (None, rows[7][1], None), (None, rows[8][1], None)]
    rows += [(900, None, 0), (901, [1.0, None] + [0.0] * 22, 0), (902, [float("nan")] * 24, 0), (903, [float("inf")] + [0.0] * 23, 0)]
    check(whitened(spark, tmp_path, rows, "id v x _row component whitened n"), rows, 16)


def test_hot_copies_count_once(spark, tmp_path):
    """A vector that a third of the rows hold has the weight of one."""
    rows = drawn(200, 20, 3)
    rows += [(1000 + i, rows[0][1], 0) for i in range(100)]
    check(whitened(spark, tmp_path, rows), rows, 16)


def test_fewer_directions_than_components(spark, tmp_path):
    rows = drawn(5, 20, 1)
    check(whitened(spark, tmp_path, rows), rows, 4)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, [], 0)]])
def test_nothing_to_whiten(spark, tmp_path, rows):
    assert len(whitened(spark, tmp_path, rows)) == 0


def test_rarer_lengths_take_no_part(spark, tmp_path):
    rows = drawn(30, 6, 2)
    got = whitened(spark, tmp_path, rows + [(77, [1.0], 0), (78, [0.0] * 7, 0)])
    check(got, rows, 6)


def test_deviation_beyond_64_bits():
    x = np.array([[1 << 40, 0], [0, 0], [3, 4]])
    n, sums = 3, [(1 << 40) + 3, 4]
    whole = np.array([s // n for s in sums])
    left = [s - n * int(w) for s, w in zip(sums, whole)]
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, n, whole, left) == [e if e < 1 << 63 else None for e in exact]


@pytest.mark.parametrize("v", [
    np.eye(20), np.diag([1.0, 1 + 1e-13, 1 + 2e-13, 0.5, 0.5, 0.5]), np.kron(np.eye(4), np.ones((5, 5))) * 1e6, np.zeros((3, 3)), np.array([[2.0]]),
])
def test_decompose_equal_eigenvalues(v):
    values, vectors = whitening.decompose(v, 16)
    want = np.linalg.eigvalsh(v)[::-1][: len(values)]
    top = max(want.max(initial=0), 1e-300)
    assert np.allclose(values, want, rtol=1e-12) and len(values) == min(16, (np.linalg.eigvalsh(v) > 1e-9 * top).sum())
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12) and np.allclose(v @ vectors.T, vectors.T * values, atol=1e-9 * top)
