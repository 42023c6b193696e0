"""Class similarity, negative sampling and loss against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from langmill.operators import similarity

CLASSES = [f"c{i}" for i in range(6)]


def scale(m):
    low, high = m.min(axis=1, keepdims=True), m.max(axis=1, keepdims=True)
    return np.where(high > low, (m - low) / np.where(high > low, high - low, 1), 0)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    return rng.normal(size=(6, 4)), rng.integers(0, 2, size=(6, 3)).astype(float)


def frame(spark, matrix, missing=()):
    rows = [(c, None if i in missing else [float(v) for v in matrix[i]]) for i, c in enumerate(CLASSES)]
    return spark.createDataFrame(rows, "label string, vector array<double>")


def as_matrix(rows):
    m = np.full((6, 6), np.nan)
    for r in rows:
        m[CLASSES.index(r.label_a), CLASSES.index(r.label_b)] = r.sim
    return m


@pytest.mark.parametrize("block", [512, 2])
def test_similarity(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    got = as_matrix(similarity.class_similarity(frame(spark, vectors[0])).collect())
    assert np.allclose(got, scale(vectors[0] @ vectors[0].T))


def test_fallback_is_pairwise(spark, vectors):
    got = as_matrix(similarity.class_similarity(frame(spark, vectors[0], {1, 4}), frame(spark, vectors[1])).collect())
    first = vectors[0].copy()
    first[[1, 4]] = 0
    known = np.array([i not in {1, 4} for i in range(6)])
    want = np.where(np.outer(known, known), scale(first @ first.T), scale(vectors[1] @ vectors[1].T))
    assert np.allclose(got, want)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(a, b, 1.0 if a == b else (0.9 if {a, b} == {"c0", "c1"} else 0.1)) for a in CLASSES for b in CLASSES]
    return spark.createDataFrame(rows, "label_a string, label_b string, sim double")


def test_mean_similarity(spark, table):
    items = spark.createDataFrame([(1, ["c0", "c2"]), (2, [])], "id int, gold array<string>")
    got = {r.id: r.mean_sim for r in similarity.mean_similarity(items, table, CLASSES).collect()}
    assert got[1] == pytest.approx([0.55, 0.5, 0.55, 0.1, 0.1, 0.1]) and got[2] == [0.0] * 6


def test_negative_samples(spark, table):
    items = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.array(F.lit("c0"))).otherwise(F.array(F.lit("c0"), F.lit("c1"))).alias("gold"))
    rows = similarity.negative_samples(items, table, CLASSES, "id", 5, ratio=1.0).collect()
    assert all(len(r.negatives) == len(r.gold) and not set(r.negatives) & set(r.gold) for r in rows)
    single = [r.negatives[0] for r in rows if len(r.gold) == 1]
    # c1 resembles c0 and has weight 0.1 against 0.9 for each of the four others.
    assert abs(single.count("c1") / len(single) - 0.1 / 3.7) < 0.015
    for c in CLASSES[2:]:
        assert abs(single.count(c) / len(single) - 0.9 / 3.7) < 0.04


def test_negative_samples_are_even_without_weights_and_never_exceed_the_candidates(spark):
    ones = spark.createDataFrame([(a, b, 1.0) for a in CLASSES for b in CLASSES], "label_a string, label_b string, sim double")
    items = spark.range(3000).select("id", F.array(F.lit("c3")).alias("gold"))
    rows = similarity.negative_samples(items, ones, CLASSES, "id", 5, ratio=1.5).collect()
    assert all(len(r.negatives) == 1 for r in rows)
    assert all(abs(sum(r.negatives == [c] for r in rows) / 3000 - 0.2) < 0.04 for c in CLASSES if c != "c3")
    everything = similarity.negative_samples(items.limit(5), ones, CLASSES, "id", 5, ratio=50.0).collect()
    assert all(len(r.negatives) == 5 for r in everything)
    none = spark.createDataFrame([(1, [])], "id int, gold array<string>")
    assert len(similarity.negative_samples(none, ones, CLASSES, "id", 5).first().negatives) == 5


def test_zero_weight_classes_come_last(spark):
    rows = [(a, b, 1.0 if b in ("c0", "c1") else 0.0) for a in CLASSES for b in CLASSES]
    table = spark.createDataFrame(rows, "label_a string, label_b string, sim double")
    items = spark.range(200).select("id", F.array(F.lit("c0")).alias("gold"))
    got = similarity.negative_samples(items, table, CLASSES, "id", 5, ratio=4.0).collect()
    assert all(sorted(r.negatives) == ["c2", "c3", "c4", "c5"] for r in got)


def test_masked_loss(spark):
    df = spark.sql("""select array('a') gold, array('b') negatives,
        array(named_struct('label','a','logit',2D), named_struct('label','b','logit',-1D), named_struct('label','c','logit',9D)) logits""")
    got = similarity.masked_loss(df).first()
    assert got.n_terms == 2 and got.loss == pytest.approx((np.log1p(np.exp(-2)) + np.log1p(np.exp(-1))) / 2)
