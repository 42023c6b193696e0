"""Counts and scores against brute force on random label sets."""

import random

import pytest
from pyspark.sql import functions as F

from langmill.functions import ratios
from langmill.operators import confusion, contingency, hierarchy

LABELS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    pick = lambda: rng.sample(LABELS[:4], rng.randint(0, 3))
    # Section l1=x holds most rows, as a hot key would.
    return [("x" if rng.random() < 0.7 else "y", str(rng.randint(0, 2)), pick(), pick()) for _ in range(300)]


@pytest.fixture(scope="module")
def items(spark, rows):
    return spark.createDataFrame(rows, "l1 string, l2 string, pred array<string>, gold array<string>").repartition(5)


def brute(rows, label):
    tp = sum(label in p and label in g for *_, p, g in rows)
    fp = sum(label in p and label not in g for *_, p, g in rows)
    fn = sum(label not in p and label in g for *_, p, g in rows)
    return tp, fp, fn, len(rows) - tp - fp - fn


def f1_of(tp, fp, fn, tn):
    return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0


def test_counts(items, rows):
    got = {r.label: (r.tp, r.fp, r.fn, r.tn) for r in contingency.contingency(items).collect()}
    assert got == {label: brute(rows, label) for label in LABELS[:4]}


def test_counts_by_key(items, rows):
    for r in contingency.contingency(items, ["l1"]).collect():
        assert (r.tp, r.fp, r.fn, r.tn) == brute([x for x in rows if x[0] == r.l1], r.label)


def test_null_predictions_are_items_but_no_labels(spark):
    df = spark.createDataFrame([(["a"], [None]), (["a"], ["a"])], "gold array<string>, pred array<string>")
    got = contingency.contingency(df).collect()
    assert [(r.label, r.n_items, r.tp, r.fp, r.fn, r.tn) for r in got] == [("a", 2, 1, 0, 1, 0)]


def test_micro_macro_and_hamming(spark, items, rows):
    classes = spark.createDataFrame([(label,) for label in LABELS], "label string")
    got = contingency.micro_macro(contingency.contingency(items), classes).first()
    counts = [brute(rows, label) for label in LABELS]
    tp, fp, fn, tn = map(sum, zip(*counts))
    assert got.f1_micro == pytest.approx(f1_of(tp, fp, fn, tn))
    assert got.f1_macro == pytest.approx(sum(f1_of(*c) for c in counts) / 5)
    assert got.hamming_loss == pytest.approx((fp + fn) / (len(rows) * 5))


def test_f1_of_fixed_labels_scores_absent_label_zero(spark, items, rows):
    classes = spark.createDataFrame([("a",), ("e",)], "label string")
    got = {r.label: r.F1 for r in contingency.f1_of(contingency.contingency(items), classes).collect()}
    assert got == {"a": pytest.approx(f1_of(*brute(rows, "a"))), "e": 0.0}


def test_long_metrics_only_has_tested_labels_and_their_mean(spark):
    df = spark.createDataFrame([(["a"], ["a", "z"]), (["a"], [])], "gold array<string>, pred array<string>")
    got = {(r.metric, r.label): r.score for r in contingency.long_metrics(contingency.contingency(df)).collect()}
    assert got[("Recall", "a")] == 0.5 and got[("Precision", "a")] == 1.0 and ("F1", "z") not in got
    assert got[("FPR", "a")] is None and got[("FPR", "all")] is None  # the label is gold on every item
    assert got[("F1", "all")] == got[("F1", "a")]


def test_metric_plug_in(items):
    support = {"support": lambda tp, fp, fn, tn: tp + fn}
    got = contingency.scores(contingency.contingency(items), support)
    assert got.columns == ["label", "support"]


def test_membership_and_frequency(spark):
    df = spark.createDataFrame([("f", ["a", "b"]), ("f", []), ("g", [None])], "file string, pred array<string>")
    got = {r.file: (r.correct, r.total, r.accuracy) for r in contingency.membership_accuracy(df, F.lit("a"), ["file"]).collect()}
    assert got == {"f": (1, 2, 0.5), "g": (0, 1, 0.0)}
    counts = contingency.most_common(contingency.label_frequency(df), 1).collect()
    assert [(r.label, r.n) for r in counts] == [("a", 1)]


def test_confusion_and_report(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", None)]
    df = spark.createDataFrame(pairs, "gold string, pred string")
    matrix = confusion.confusion(df)
    assert sorted((r.gold, r.pred, r.n) for r in matrix.collect()) == [("a", "a", 1), ("a", "b", 1), ("b", "b", 1)]
    assert [r.label for r in confusion.axis_labels(matrix).collect()] == ["a", "b"]
    wide = {r.gold: (r.a, r.b) for r in confusion.wide(matrix, ["a", "b"]).collect()}
    assert wide == {"a": (1, 1), "b": (0, 1)}
    rates = {r.label: (r.tp, r.fp, r.fn, r.tn) for r in confusion.rates(matrix).collect()}
    assert rates == {"a": (1, 0, 1, 1), "b": (1, 1, 0, 1)}
    sets = df.select(F.array("gold").alias("gold"), F.array_compact(F.array("pred")).alias("pred"))
    report = {r["class"]: r for r in confusion.classification_report(contingency.contingency(sets)).collect()}
    assert report["accuracy"].f1 == 0.5 and report["weighted avg"].support == 4
    assert report["macro avg"].recall == pytest.approx((0.5 + 1 + 0) / 3)
    assert report["weighted avg"].recall == pytest.approx((2 * 0.5 + 1 * 1 + 1 * 0) / 4)
    assert contingency.single_accuracy(df).first().accuracy == 0.5


def test_set_valued_confusion(spark):
    df = spark.createDataFrame([(["a"], ["c", "a"]), (["a"], ["c", "b"]), (["b"], [])], "gold array<string>, pred array<string>")
    got = sorted((r.gold, r.pred, r.n) for r in confusion.confusion_of_sets(df).collect())
    assert got == [("a", "a", 1), ("a", "b", 1)]


def test_hierarchy_levels_agree_with_separate_evaluation(items, rows):
    counts = hierarchy.rollup_counts(items)
    scores = {(r.level, r.l1, r.l2, r.label): r.f1 for r in hierarchy.section_scores(counts).collect()}
    accuracy = {(r.level, r.l1, r.l2): (r.n_items, r.loose_accuracy, r.exact_accuracy) for r in hierarchy.section_accuracies(counts).collect()}
    sections = {("overall", None, None): rows}
    for l1 in {r[0] for r in rows}:
        sections[("parent", l1, None)] = [r for r in rows if r[0] == l1]
        for l2 in {r[1] for r in rows}:
            part = [r for r in rows if r[0] == l1 and r[1] == l2]
            if part:
                sections[("leaf", l1, l2)] = part
    assert set(accuracy) == set(sections)
    for key, part in sections.items():
        loose = sum((not p and not g) or bool(set(p) & set(g)) for *_, p, g in part) / len(part)
        exact = sum(set(p) == set(g) for *_, p, g in part) / len(part)
        assert accuracy[key] == (len(part), pytest.approx(loose), pytest.approx(exact))
        present = {label for *_, g in part for label in g}
        assert {k[3] for k in scores if k[:3] == key} == present
        for label in present:
            assert scores[(*key, label)] == pytest.approx(f1_of(*brute(part, label)))
    labels = {(r.level, r.l1, r.l2): r.labels for r in hierarchy.section_labels(counts).collect()}
    assert labels[("overall", None, None)] == sorted({label for *_, g in rows for label in g})
    report = {r.section: r for r in hierarchy.report(items).collect()}
    assert report["Overall"].n_items == 300 and "x (combined)" in report and [s.label for s in report["Overall"].scores] == LABELS[:4]


def test_false_positive_rate_is_undefined_without_negatives(spark):
    row = spark.range(1).select(ratios.false_positive_rate(F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("x"), ratios.finite(F.lit(float("nan"))).alias("y")).first()
    assert row.x is None and row.y == 0.0
