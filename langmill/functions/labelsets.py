"""Predicates and mappings on arrays of labels.

A null element is a prediction that could not be mapped to a known label: it counts as a wrong,
non-empty prediction, so the set tests use ``array_intersect`` and ``array_except``, which keep
a plain true or false where ``arrays_overlap`` would turn null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_set(label: Column) -> Column:
    """A single label as a set; an abstention (null) becomes the empty set."""
    return F.array_compact(F.array(label))


def overlap(pred: Column, gold: Column, both_empty: bool = False) -> Column:
    """Sets share a label. ``both_empty`` also accepts two empty sets."""
    hit = F.size(F.array_intersect(pred, gold)) > 0
    if not both_empty:
        return hit
    return ((F.size(pred) == 0) & (F.size(gold) == 0)) | hit


def subset(pred: Column, gold: Column) -> Column:
    """Every predicted label is correct; an empty prediction qualifies."""
    return F.size(F.array_except(pred, gold)) == 0


def same_set(pred: Column, gold: Column) -> Column:
    return F.array_sort(F.array_distinct(pred)) == F.array_sort(F.array_distinct(gold))


def same_list(pred: Column, gold: Column) -> Column:
    """Equal including order and repetitions."""
    return pred == gold


def contains(pred: Column, label: Column) -> Column:
    return F.coalesce(F.array_contains(pred, label), F.lit(False))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def iso_code(label: Column) -> Column:
    """Language part of a label such as ``eng_Latn``."""
    return F.substring(label, 1, 3)


def literal_map(mapping: dict) -> Column:
    keys = list(mapping)
    return F.map_from_arrays(
        F.array(*[F.lit(k) for k in keys]), F.array(*[F.lit(mapping[k]).cast("string") for k in keys])
    )


def map_known(codes: Column, mapping: dict) -> Column:
    """Map the codes that are in ``mapping`` and leave the others out."""
    table = literal_map(mapping)
    return F.transform(F.filter(codes, lambda c: c.isin(list(mapping))), lambda c: table[c])


def map_all(codes: Column, mapping: dict) -> Column:
    """Map every code; an unknown one is an error."""
    table = literal_map(mapping)
    return F.transform(
        codes,
        lambda c: F.when(c.isin(list(mapping)), table[c]).otherwise(
            F.raise_error(F.concat(F.lit("unknown label code: "), F.coalesce(c, F.lit("null")))).cast("string")
        ),
    )


def resolve_single(pred: Column, gold_label: Column) -> Column:
    """One label for a set-valued prediction: the gold label if predicted, else the first by name."""
    return F.when(contains(pred, gold_label), gold_label).otherwise(F.array_min(pred))


def multi_hot(labels: Column, classes: list[str]) -> Column:
    """0/1 indicator over ``classes``; labels outside the list are ignored."""
    return F.transform(
        F.array(*[F.lit(c) for c in classes]), lambda c: F.coalesce(F.array_contains(labels, c), F.lit(False)).cast("int")
    )
