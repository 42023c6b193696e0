"""Per-label counts for set-valued predictions, and the scores derived from them.

``label_counts`` is the one aggregation behind every metric. An item contributes one row per label
in its gold and predicted sets, plus one row (null label) that carries the item itself, so a
single scan and a single shuffle of partial sums give both the label counts and the item counts.
True negatives follow by subtraction; items are never expanded over all classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langmill.functions import labelsets, ratios

COUNTS = ["n_items", "tp", "fp", "fn"]


def label_counts(
    items: DataFrame, keys: list[str] | None = None, pred: str = "pred", gold: str = "gold",
    measures: dict[str, Column] | None = None,
) -> DataFrame:
    """Additive counts by ``keys`` and label; the null-label row holds the item totals.

    ``measures`` are boolean or numeric columns summed over the items on that row.
    """
    keys, measures = keys or [], measures or {}
    base = items.select(
        *keys,
        F.array_compact(F.col(pred)).alias("_p"),
        F.array_compact(F.col(gold)).alias("_g"),
        *[expr.cast("bigint").alias(name) for name, expr in measures.items()],
    )
    zero = F.lit(0).cast("bigint")
    item_row = F.struct(
        F.lit(None).cast("string").alias("label"), F.lit(1).cast("bigint").alias("n_items"),
        zero.alias("tp"), zero.alias("fp"), zero.alias("fn"), *[F.col(name).alias(name) for name in measures],
    )

    def label_row(label: Column) -> Column:
        in_pred = F.array_contains(F.col("_p"), label)
        in_gold = F.array_contains(F.col("_g"), label)
        return F.struct(
            label.alias("label"), zero.alias("n_items"),
            (in_pred & in_gold).cast("bigint").alias("tp"),
            (in_pred & ~in_gold).cast("bigint").alias("fp"),
            (~in_pred & in_gold).cast("bigint").alias("fn"),
            *[zero.alias(name) for name in measures],
        )

    rows = F.concat(F.array(item_row), F.transform(F.array_union("_p", "_g"), label_row))
    sums = [F.sum(name).alias(name) for name in [*COUNTS, *measures]]
    return base.select(*keys, F.inline(rows)).groupBy(*keys, "label").agg(*sums)


def with_item_totals(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Drop the item rows and attach their total, with true negatives, to every label row.

    The window runs over the aggregated table: at most one row per label in a partition.
    """
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    total = F.sum("n_items").over(window)
    return (
        counts.withColumn("n_items", total)
        .where(F.col("label").isNotNull())
        .withColumn("tn", F.col("n_items") - F.col("tp") - F.col("fp") - F.col("fn"))
    )


def contingency(items: DataFrame, keys: list[str] | None = None, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """tp, fp, fn, tn and item count by ``keys`` and label."""
    return with_item_totals(label_counts(items, keys, pred, gold), keys)


def over_classes(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """Restrict to, and complete with zeros over, a fixed table of classes (no extra keys)."""
    total = F.max("n_items").over(Window.partitionBy(F.lit(0)))
    filled = classes.select("label").join(counts, "label", "left")
    for name in ("tp", "fp", "fn"):
        filled = filled.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("bigint")))
    return filled.withColumn("n_items", F.coalesce(total, F.lit(0).cast("bigint"))).withColumn(
        "tn", F.col("n_items") - F.col("tp") - F.col("fp") - F.col("fn")
    )


def scores(counts: DataFrame, metrics: dict[str, Callable[..., Column]] | None = None, keys: list[str] | None = None) -> DataFrame:
    """One column per metric; ``metrics`` maps a name to a function of (tp, fp, fn, tn)."""
    metrics = metrics or ratios.STANDARD
    args = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    return counts.select(*(keys or []), "label", *[fn(*args).alias(name) for name, fn in metrics.items()])


def long_metrics(counts: DataFrame, metrics: dict[str, Callable[..., Column]] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows (metric, label, score) for the labels with gold support, plus their plain mean as ``all``."""
    keys = keys or []
    metrics = metrics or ratios.STANDARD
    tested = counts.where(F.col("tp") + F.col("fn") > 0)
    wide = scores(tested, metrics, keys)
    # Grouping sets over the per-label table: the mean costs no second pass over the items.
    per_label = wide.unpivot([*keys, "label"], list(metrics), "metric", "score")
    grouped = per_label.groupingSets(
        [[*keys, "metric", "label"], [*keys, "metric"]], *keys, "metric", "label"
    ).agg(F.avg("score").alias("score"), F.grouping("label").alias("_all"))
    return grouped.select(
        *keys, "metric", F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("label")).alias("label"), "score"
    )


def micro_macro(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """Micro and macro precision, recall and F1 over all classes, and the Hamming loss, as one row."""
    full = over_classes(counts, classes)
    args = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    macro = [
        F.avg(fn(*args)).alias(f"{name}_macro")
        for name, fn in (("f1", ratios.f1), ("precision", ratios.precision), ("recall", ratios.recall))
    ]
    totals = full.agg(*macro, F.max("n_items").alias("n_items"), F.count(F.lit(1)).alias("n_classes"), *sums)
    return totals.select(
        ratios.f1(*args).alias("f1_micro"), "f1_macro",
        ratios.precision(*args).alias("precision_micro"), "precision_macro",
        ratios.recall(*args).alias("recall_micro"), "recall_macro",
        ratios.ratio(F.col("fp") + F.col("fn"), F.col("n_items") * F.col("n_classes")).alias("hamming_loss"),
    )


def f1_of(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """F1 for a fixed list of labels; a label that never occurs scores 0."""
    return scores(over_classes(counts, classes), {"F1": ratios.f1})


def accuracies(items: DataFrame, keys: list[str] | None = None, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """The three loose and two exact accuracies in one pass."""
    p, g = F.col(pred), F.col(gold)
    tests = {
        "loose_overlap": labelsets.overlap(p, g, both_empty=True),
        "loose_overlap_strict": labelsets.overlap(p, g),
        "loose_subset": labelsets.subset(p, g),
        "exact_set": labelsets.same_set(p, g),
        "exact_ordered": labelsets.same_list(p, g),
    }
    return items.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_items"), *[F.avg(t.cast("int")).alias(name) for name, t in tests.items()]
    )


def membership_accuracy(items: DataFrame, label: Column, keys: list[str] | None = None, pred: str = "pred") -> DataFrame:
    """Share of items whose predicted set contains ``label``, with the counts behind it."""
    hit = labelsets.contains(F.col(pred), label).cast("bigint")
    return (
        items.groupBy(*(keys or []))
        .agg(F.sum(hit).alias("correct"), F.count(F.lit(1)).alias("total"))
        .withColumn("accuracy", F.try_divide("correct", "total"))
    )


def single_accuracy(items: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Share of items whose single label is right; an abstention counts as wrong."""
    return items.agg(F.avg(F.col(pred).eqNullSafe(F.col(gold)).cast("int")).alias("accuracy"))


def label_frequency(items: DataFrame, pred: str = "pred") -> DataFrame:
    """How often each label was predicted."""
    # The outer form keeps the optimizer from adding a filter on the array, which would score texts twice.
    labels = items.select(F.explode_outer(pred).alias("label"))
    return labels.where(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def most_common(frequency: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most frequent labels; ties go to the label that sorts first."""
    return frequency.orderBy(F.col("n").desc(), F.col("label")).limit(n)
