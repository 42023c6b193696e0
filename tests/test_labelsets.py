"""The edge rows on which the five accuracies differ, and label mappings."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from langmill.functions import labelsets, scores
from langmill.operators import contingency, labels, scoring, seeds

# gold, pred, then: overlap with both-empty accepted, overlap, subset, same set, same list
EDGE_ROWS = [
    (["a"], ["a"], 1, 1, 1, 1, 1),
    ([], [], 1, 0, 1, 1, 1),
    (["a"], [], 0, 0, 1, 0, 0),
    ([], ["a"], 0, 0, 0, 0, 0),
    (["a"], ["a", "b"], 1, 1, 0, 0, 0),
    (["a", "b"], ["a"], 1, 1, 1, 0, 0),
    (["a", "b"], ["b", "a"], 1, 1, 1, 1, 0),
    (["a"], ["a", "a"], 1, 1, 1, 1, 0),
    (["a"], [None], 0, 0, 0, 0, 0),
    ([], [None], 0, 0, 0, 0, 0),
]


def test_edge_rows(spark):
    schema = "gold array<string>, pred array<string>, a int, b int, c int, d int, e int"
    df = spark.createDataFrame(EDGE_ROWS, schema)
    p, g = F.col("pred"), F.col("gold")
    tests = [
        labelsets.overlap(p, g, both_empty=True), labelsets.overlap(p, g), labelsets.subset(p, g),
        labelsets.same_set(p, g), labelsets.same_list(p, g),
    ]
    for row in df.select("*", F.array(*[t.cast("int") for t in tests]).alias("got")).collect():
        assert row.got == list(row[2:7]), row


def test_accuracies_average_the_edge_rows(spark):
    df = spark.createDataFrame([(g, p) for g, p, *_ in EDGE_ROWS], "gold array<string>, pred array<string>")
    got = contingency.accuracies(df).first()
    columns = ["loose_overlap", "loose_overlap_strict", "loose_subset", "exact_set", "exact_ordered"]
    for i, name in enumerate(columns):
        assert got[name] == pytest.approx(sum(r[2 + i] for r in EDGE_ROWS) / 10)


def test_map_known_drops_and_map_all_raises(spark):
    df = spark.createDataFrame([(["nb", "xx", "da"],)], "codes array<string>")
    known = df.select(labelsets.map_known(F.col("codes"), seeds.SLIDE_CODES).alias("x")).first().x
    assert known == ["nob_Latn", "dan_Latn"]
    with pytest.raises(PySparkException, match="unknown label code: xx"):
        df.select(labelsets.map_all(F.col("codes"), seeds.SLIDE_CODES)).collect()


def test_canonicalise(spark):
    df = spark.createDataFrame([("__label__eng_Latn",), ("eng_Latn",), ("__label__xyz_Latn",), (None,)], "raw string")
    got = [r.x for r in df.select(labels.canonicalise(F.col("raw")).alias("x")).collect()]
    assert got == ["eng_Latn", "eng_Latn", None, None]


def test_detector_map(spark):
    df = spark.createDataFrame([("gcld3", "en"), ("gcld3", "co"), ("gcld3", "zz")], "detector string, raw string")
    mapping = seeds.label_map(spark)
    soft = {r.raw: r.label for r in labels.map_detector_labels(df, mapping, on_miss="null").collect()}
    assert soft == {"en": "eng_Latn", "co": None, "zz": None}
    with pytest.raises(PySparkException, match="unmapped label: zz"):
        labels.map_detector_labels(df, mapping).collect()
    fixed = seeds.label_map(spark, {"co": "ita_Latn"})
    assert {r.raw: r.label for r in labels.map_detector_labels(df, fixed, on_miss="null").collect()}["co"] == "ita_Latn"


def test_seed_sizes(spark):
    assert len(seeds.CANONICAL_LABELS) == len(set(seeds.CANONICAL_LABELS)) == 200
    assert seeds.CANONICAL_LABELS == sorted(seeds.CANONICAL_LABELS)
    assert len(seeds.GCLD3_LABELS) == 109 and sum(v is None for v in seeds.GCLD3_LABELS.values()) == 6
    assert {k: len(v) for k, v in seeds.TIER_LANGUAGES.items()} == {0: 50, 1: 98, 2: 16, 3: 29, 4: 18, 5: 7}
    assert {r.iso: r.tier for r in seeds.tiers(spark).collect()} == {iso: t for t in range(5, -1, -1) for iso in seeds.TIER_LANGUAGES[t]}


def test_classes_and_encoding(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "id int, lang string")
    classes = labels.fit_classes(df, "lang")
    assert [(r.class_idx, r.label) for r in classes.orderBy("class_idx").collect()] == [(0, "a"), (1, "b")]
    encoded = {r.id: r.class_idx for r in labels.encode_labels(df, classes).collect()}
    assert encoded == {1: 1, 2: 0, 3: None, 4: 1}
    with pytest.raises(PySparkException, match="outside the classes: b"):
        labels.encode_labels(df, classes.where("label = 'a'")).collect()
    sets = spark.createDataFrame([(1, ["b", "zz"])], "id int, gold array<string>")
    assert [(r.id, r.class_idx) for r in labels.encode_label_sets(sets, classes, "id").collect()] == [(1, 1)]
    assert sets.select(labelsets.multi_hot(F.col("gold"), ["a", "b"]).alias("h")).first().h == [0, 1]


def test_thresholds_at_the_border(spark):
    df = spark.sql("select array(named_struct('label','a','score',0.5D), named_struct('label','b','score',0.6D)) s")
    row = df.select(scores.labels(scores.above(F.col("s"), 0.5)).alias("strict"), scores.labels(scores.at_least(F.col("s"), 0.5)).alias("soft")).first()
    assert row.strict == ["b"] and row.soft == ["a", "b"]


def test_ranking_keeps_class_order_on_ties(spark):
    entries = ",".join(f"named_struct('label','{c}','score',{s}D)" for c, s in [("a", 0.2), ("b", 0.4), ("c", 0.4)])
    df = spark.sql(f"select array({entries}) s")
    row = df.select(scores.labels(scores.by_confidence(F.col("s"))).alias("r"), scores.decision(F.col("s")).alias("d")).first()
    assert row.r == ["b", "c", "a"] and row.d.prediction == "b" and row.d.all_probabilities["a"] == 0.2


def test_softmax_sigmoid_and_loss(spark):
    df = spark.sql("select array(1000D, 1001D) z, array(0D, 0D) zero")
    row = df.select(scores.softmax(F.col("z")).alias("p"), scores.normalise(F.col("zero")).alias("n")).first()
    assert row.p == pytest.approx([0.26894142, 0.73105858]) and row.n == [0.0, 0.0]
    loss = spark.sql("select 800D z").select(scores.binary_cross_entropy(F.col("z"), F.lit(0.0)).alias("l")).first().l
    assert loss == 800.0


def test_multilabel_needs_a_threshold(spark):
    with pytest.raises(ValueError, match="needs a threshold"):
        scoring.predict(spark.createDataFrame([("a",)], "text string"), lambda df: df, None)


def test_external_scorer_and_fallbacks(spark):
    def load():
        def run(texts):
            return [None if t == "boom" else [("x", 0.9), ("y", 0.4)] for t in texts]

        return run

    df = spark.createDataFrame([("ok",), ("boom",)], "text string")
    scorer = scoring.external_scorer(load)
    many = {r.text: (r.pred, r.failed) for r in scoring.predict(df, scorer, 0.3).collect()}
    assert many == {"ok": (["x", "y"], False), "boom": ([], True)}
    one = {r.text: (r.pred, r.confidences) for r in scoring.predict(df, scorer, multilabel=False).collect()}
    assert one == {"ok": (["x"], [0.9]), "boom": (["eng_Latn"], [1.0])}
    explained = scoring.explain(df.where("text = 'ok'"), scorer, k=1).first()
    assert explained.prediction == "x" and len(explained.ranked) == 1 and len(explained.all_probabilities) == 2


def test_a_failing_text_fails_alone(spark):
    """A model that raises on two of many texts, or returns too few results: all others are scored."""
    def load():
        def predict(texts):
            if any(t == "bad" for t in texts):
                raise RuntimeError("no score for bad")
            return [[("a", 1.0)] for t in texts if t != "short"]

        return predict

    texts = [f"t{i}" for i in range(900)] + ["bad", "bad", "short", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    found = {r.id: r for r in scoring.predict(rows, scoring.external_scorer(load, errors="why"), 0.5).collect()}
    assert len(found) == len(texts)
    assert [i for i, r in found.items() if r.failed] and {i for i, r in found.items() if r.failed} == {900, 901, 902, 903}
    assert found[900].why == "RuntimeError: no score for bad" and found[902].why == "ValueError: 0 results for 1 texts" and found[903].why is None
    assert found[0].pred == ["a"] and found[904].pred == ["a"] and found[900].pred == []


def test_isolation_cost():
    calls = []

    def predict(texts):
        calls.append(len(texts))
        if "x" in texts:
            raise ValueError("x")
        return [[("a", 1)] for _ in texts]

    found = scoring.isolated(predict, ["t"] * 500 + ["x"] + ["t"] * 523)
    assert [i for i, (r, e) in enumerate(found) if e] == [500] and len(calls) <= 2 * 10 + 1
    assert scoring.isolated(predict, []) == []
