"""Batch scoring of lines, files and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmill.operators import contingency
from langmill.operators.scoring import Scorer, predict
from langmill.session import stage
from langmill.sources import readers, writers


def score_file(spark: SparkSession, source: str, target: str, scorer: Scorer, threshold: float = 0.5, multilabel: bool = True,
               correct_label: str | None = None, most_common: int = 5) -> dict[str, DataFrame]:
    """Score lines, write predictions, and return the language counts and, on request, the accuracy."""
    scored = stage(predict(readers.text_lines(spark, source), scorer, threshold, multilabel=multilabel), "lines")
    writers.write_predictions(scored, target)
    tables = {"counts": contingency.most_common(contingency.label_frequency(scored), most_common)}
    if correct_label:
        tables["accuracy"] = contingency.membership_accuracy(scored, F.lit(correct_label))
    return tables


def score_tree(spark: SparkSession, source: str, target: str, scorer: Scorer, threshold: float = 0.5, multilabel: bool = True) -> None:
    """Score all text files below a folder, keeping the predictions of each file together."""
    scored = predict(readers.text_tree(spark, source), scorer, threshold, multilabel=multilabel)
    writers.write_prediction_tree(scored, target)
