"""Evaluation runs: score a gold-labelled set and derive all of its report tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmill.functions import labelsets
from langmill.operators import confusion, contingency, hierarchy, tiers as tier_ops
from langmill.operators.scoring import Scorer, predict
from langmill.session import stage


def scored_items(items: DataFrame, scorer: Scorer, threshold: float | None = 0.5, multilabel: bool = True, inclusive: bool = False) -> DataFrame:
    """Predictions next to gold labels, written once: every table below reads this and no text again."""
    return stage(predict(items, scorer, threshold, inclusive, multilabel).drop("text"), "scored")


def evaluate_sections(items: DataFrame, scorer: Scorer, threshold: float = 0.5, multilabel: bool = True, inclusive: bool = False) -> dict[str, DataFrame]:
    """Sectioned multilabel evaluation of (l1, l2, pos, text, gold)."""
    scored = scored_items(items, scorer, threshold, multilabel, inclusive)
    counts = hierarchy.rollup_counts(scored)
    return {
        "report": hierarchy.report(scored),
        "accuracies": hierarchy.section_accuracies(counts),
        "scores": hierarchy.section_scores(counts),
        "instances": scored.select("l1", "l2", "pos", "pred", "gold"),
    }


def evaluate_languages(texts: DataFrame, scorer: Scorer, threshold: float = 0.5, multilabel: bool = True, classes: list[str] | None = None) -> dict[str, DataFrame]:
    """Per-language evaluation of (lang, text): the language of a text is its only gold label.

    ``classes`` are the labels the model knows; predictions outside them cannot be counted.
    """
    labelled = texts.withColumn("gold", F.array("lang"))
    scored = scored_items(labelled, scorer, threshold, multilabel)
    if classes:
        known = F.array(*[F.lit(c) for c in classes])
        scored = scored.withColumn("pred", F.array_intersect("pred", known))
    metrics = contingency.long_metrics(contingency.contingency(scored))
    if multilabel:
        matrix = confusion.confusion_of_sets(scored)
    else:
        matrix = confusion.confusion(scored.select(F.try_element_at("pred", F.lit(1)).alias("pred"), F.col("lang").alias("gold")))
    return {"metrics": metrics, "confusion": matrix}


@dataclass(frozen=True)
class SetProtocol:
    """How an evaluation set counts an item as loosely right, and which labels it reports."""

    loose: str
    labels: tuple[str, ...]


SCANDINAVIAN = SetProtocol("loose_subset", ("nob_Latn", "nno_Latn", "swe_Latn", "dan_Latn"))
SOUTH_SLAVIC = SetProtocol("loose_overlap_strict", ("srp_Cyrl", "hrv_Latn", "mkd_Cyrl", "bos_Latn"))


def evaluate_set(items: DataFrame, scorer: Scorer, protocol: SetProtocol, threshold: float = 0.5, multilabel: bool = False) -> dict[str, DataFrame]:
    """Loose and exact accuracy and the F1 of the protocol's labels for (text, gold)."""
    scored = scored_items(items, scorer, threshold, multilabel)
    spark = items.sparkSession
    classes = spark.createDataFrame([(label,) for label in protocol.labels], "label string")
    accuracy = contingency.accuracies(scored).select(
        "n_items", F.col(protocol.loose).alias("loose_accuracy"), F.col("exact_ordered").alias("exact_accuracy")
    )
    return {"accuracies": accuracy, "f1": contingency.f1_of(contingency.contingency(scored), classes)}


def summarise_tiers(metrics: DataFrame, tiers: DataFrame) -> DataFrame:
    """Mean per input file, metric and tier of rows (source, metric, label, score)."""
    return tier_ops.average_by_tier(metrics, tiers, ["source"])


def summarise_speakers(metrics: DataFrame, speakers: DataFrame) -> DataFrame:
    """Speaker-weighted sum per input file and metric."""
    return tier_ops.weighted_sum(metrics, tier_ops.speaker_weights(speakers), ["source"])


def transfer_accuracy(predictions: DataFrame) -> DataFrame:
    """Membership accuracy per file of (file, pred, gold_label)."""
    return contingency.membership_accuracy(predictions, F.col("gold_label"), ["file"])


def single_label(items: DataFrame, lang: str = "lang") -> DataFrame:
    """Wrap the language of a row as its one-element gold set."""
    return items.withColumn("gold", labelsets.as_set(F.col(lang)))
