"""Functions on scored labels: ``array<struct<label:string, score:double>>`` in class order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from langmill.functions.binding import let

SCORES_TYPE = "array<struct<label:string,score:double>>"


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def softmax(logits: Column) -> Column:
    """Array of logits to probabilities, shifted by the maximum so that exp cannot overflow."""
    shifted = let(F.array_max(logits), lambda top: F.transform(logits, lambda z: F.exp(z - top)))
    return let(shifted, normalise)


def normalise(weights: Column) -> Column:
    """Divide by the sum. An array of zeros stays zeros."""
    total = F.aggregate(weights, F.lit(0.0), lambda acc, z: acc + z)
    return let(total, lambda t: F.transform(weights, lambda z: F.coalesce(F.try_divide(z, t), F.lit(0.0))))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, z: acc + z)


def binary_cross_entropy(logit: Column, target: Column) -> Column:
    """Loss of one logit against a 0/1 target in the form that is stable for large logits."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def above(scores: Column, threshold: float) -> Column:
    """Strictly above the threshold."""
    return F.filter(scores, lambda s: s["score"] > F.lit(threshold))


def at_least(scores: Column, threshold: float) -> Column:
    """At or above the threshold."""
    return F.filter(scores, lambda s: s["score"] >= F.lit(threshold))


def positive_logits(logits: Column) -> Column:
    """Labels whose logit is above zero, i.e. whose sigmoid is above one half."""
    return F.filter(logits, lambda s: s["logit"] > 0)


def by_confidence(scores: Column) -> Column:
    """Descending score; equal scores keep class order."""
    indexed = F.transform(scores, lambda s, i: F.struct((-s["score"]).alias("k"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(indexed), lambda t: t["s"])


def top_k(scores: Column, k: int | None = 10) -> Column:
    ranked = by_confidence(scores)
    return ranked if k is None else F.slice(ranked, 1, k)


def best(scores: Column) -> Column:
    """Highest-scoring entry; the first class wins ties, an empty array gives null."""
    return F.try_element_at(by_confidence(scores), F.lit(1))


def labels(scores: Column) -> Column:
    return F.transform(scores, lambda s: s["label"])


def confidences(scores: Column) -> Column:
    return F.transform(scores, lambda s: s["score"])


def probability_map(scores: Column) -> Column:
    return F.map_from_entries(scores)


def decision(scores: Column) -> Column:
    """Prediction, its confidence and the probabilities of all classes as one struct."""
    top = best(scores)
    return F.struct(
        top["label"].alias("prediction"),
        top["score"].alias("confidence"),
        probability_map(scores).alias("all_probabilities"),
    )


def with_fallback(scores: Column, multilabel: bool) -> Column:
    """Replace a failed (null) scoring: no labels, or the fixed default of single-label scorers."""
    default = F.array(F.struct(F.lit("eng_Latn").alias("label"), F.lit(1.0).alias("score")))  # fixed value
    empty = F.array().cast(SCORES_TYPE)
    return F.coalesce(scores, empty if multilabel else default.cast(SCORES_TYPE))
