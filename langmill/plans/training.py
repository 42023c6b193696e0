"""Training run: cap, split, fit, evaluate, save, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmill.functions import labelsets
from langmill.operators import classifier, ngrams, sampling
from langmill.session import stage
from langmill.sources import writers

EVAL_SHARE = 0.001  # fixed value


def prepare(corpus: DataFrame, per_language: int | None, eval_share: float, seed, id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Rows with text, capped per language and split; staged, because the cap decides what is split."""
    present = corpus.where(F.col("text").isNotNull())
    if per_language:
        present = stage(sampling.cap_per_group(present, lang, id_col, per_language, seed), "capped")
    split = sampling.split_corpus(present, id_col, eval_share, seed)
    return stage(split.withColumn("gold", labelsets.as_set(F.col(lang))), "split")


def train(
    corpus: DataFrame, output: str, per_language: int | None = 10_000, eval_share: float = EVAL_SHARE,
    multilabel: bool = False, n: int = ngrams.NGRAM_SIZE, c: float = classifier.INVERSE_REGULARISATION,
    threshold: float = 0.5, seed=42, max_iter: int = classifier.MAX_ITERATIONS,
) -> tuple[classifier.NgramClassifier, DataFrame]:
    """Fit and save a model under ``output`` and write one JSON row with parameters and scores."""
    rows = prepare(corpus, per_language, eval_share, seed)
    train_rows, eval_rows = (rows.where(F.col("split") == part) for part in ("train", "eval"))
    model = classifier.fit(train_rows, multilabel, n=n, c=c, threshold=threshold, seed=seed, max_iter=max_iter)
    model.save(f"{output}/model")
    summary = model.evaluate(eval_rows)["summary"]
    n_train, n_eval = train_rows.count(), eval_rows.count()
    result = summary.select(
        F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss").alias("timestamp"),
        F.lit("multilabel" if multilabel else "multiclass").alias("model_type"),
        F.lit(n).alias("ngram_size"), F.lit(c).alias("C"), F.lit(threshold).alias("threshold"),
        F.lit(n_train).alias("num_train"), F.lit(n_eval).alias("num_test"),
        "*", F.lit(f"{output}/model").alias("model_path"),
    )
    writers.write_run(result, f"{output}/results")
    return model, result
