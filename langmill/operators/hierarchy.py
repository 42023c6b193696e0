"""Evaluation of sectioned sets at leaf, parent and overall level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langmill.functions import labelsets, ratios
from langmill.operators import contingency

LEVELS = ["leaf", "parent", "overall"]


def rollup_counts(items: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Counts per level, section and label.

    Items are aggregated once, at leaf level; the two coarser levels are grouping sets over that
    small table, so the corpus is neither rescanned nor expanded threefold.
    """
    p, g = F.col(pred), F.col(gold)
    leaf = contingency.label_counts(
        items, ["l1", "l2"], pred, gold,
        {"loose": labelsets.overlap(p, g, both_empty=True), "exact": labelsets.same_set(p, g)},
    )
    sums = [F.sum(c).alias(c) for c in [*contingency.COUNTS, "loose", "exact"]]
    grouped = leaf.groupingSets([["l1", "l2", "label"], ["l1", "label"], ["label"]], "l1", "l2", "label").agg(
        (F.grouping("l1") + F.grouping("l2")).cast("int").alias("level"), *sums
    )
    names = F.array(*[F.lit(name) for name in LEVELS])
    return grouped.withColumn("level", names[F.col("level")])


SECTION = ["level", "l1", "l2"]


def section_accuracies(counts: DataFrame) -> DataFrame:
    """Sample count and the two accuracies per section; a section without items has no row."""
    return counts.where(F.col("label").isNull()).select(
        *SECTION, "n_items",
        F.try_divide("loose", "n_items").alias("loose_accuracy"),
        F.try_divide("exact", "n_items").alias("exact_accuracy"),
    )


def section_scores(counts: DataFrame) -> DataFrame:
    """Per-label F1, precision and recall for labels with gold support in the section."""
    full = contingency.with_item_totals(counts, SECTION).where(F.col("tp") + F.col("fn") > 0)
    args = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    return full.select(
        *SECTION, "label", ratios.f1(*args).alias("f1"), ratios.precision(*args).alias("precision"),
        ratios.recall(*args).alias("recall"),
    )


def section_labels(counts: DataFrame) -> DataFrame:
    """Sorted gold labels of each section (bounded by the number of classes)."""
    present = counts.where(F.col("label").isNotNull() & (F.col("tp") + F.col("fn") > 0))
    return present.groupBy(*SECTION).agg(F.array_sort(F.collect_set("label")).alias("labels"))


def section_name() -> Column:
    """Heading of a section in reports."""
    return (
        F.when(F.col("level") == "leaf", F.concat_ws("/", "l1", "l2"))
        .when(F.col("level") == "parent", F.concat(F.col("l1"), F.lit(" (combined)")))
        .otherwise(F.lit("Overall"))
    )


def report(items: DataFrame, pred: str = "pred", gold: str = "gold", digits: int = 4) -> DataFrame:
    """Everything a printed report shows, one row per section, label scores nested in label order."""
    counts = rollup_counts(items, pred, gold)
    args = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    tested = F.col("label").isNotNull() & (F.col("tp") + F.col("fn") > 0)
    entry = F.struct(
        "label", F.round(ratios.f1(*args), digits).alias("f1"),
        F.round(ratios.precision(*args), digits).alias("precision"), F.round(ratios.recall(*args), digits).alias("recall"),
    )
    with_tn = counts.withColumn("tn", F.lit(0).cast("bigint"))
    return (
        with_tn.groupBy(*SECTION)
        .agg(
            F.sum("n_items").alias("n_items"),
            F.round(F.try_divide(F.sum("loose"), F.sum("n_items")), digits).alias("loose_accuracy"),
            F.round(F.try_divide(F.sum("exact"), F.sum("n_items")), digits).alias("exact_accuracy"),
            F.array_sort(F.collect_list(F.when(tested, entry))).alias("scores"),
        )
        .select(section_name().alias("section"), "*")
    )
