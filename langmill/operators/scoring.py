"""Scorer plug-ins. A scorer is a function DataFrame -> DataFrame that adds a column ``scores``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langmill.functions import scores as score_fn, text as text_fn

Scorer = Callable[[DataFrame], DataFrame]


def isolated(predict: Callable[[list[str]], list], texts: list[str]) -> list[tuple[list | None, str | None]]:
    """Result and error of each text. A batch that fails is halved until the texts that fail stand alone.

    A batch fails as a whole if the model raises or returns another number of results than texts. The halves are kept on a
    list, so that a batch of any length needs no recursion; ``k`` failing texts among ``n`` cost about ``2 k log2 n`` more calls.
    """
    out: list[tuple[list | None, str | None]] = [(None, None)] * len(texts)
    todo = [(0, len(texts))] if texts else []
    while todo:
        first, end = todo.pop()
        try:
            results = predict(texts[first:end])
            if len(results) != end - first:
                raise ValueError(f"{len(results)} results for {end - first} texts")
            converted = [(None if r is None else [{"label": label, "score": float(score)} for label, score in r], None) for r in results]
        except Exception as error:  # whatever the model raises belongs to its texts, not to the task
            if end - first == 1:
                out[first] = (None, f"{type(error).__name__}: {error}")
            else:
                middle = (first + end) // 2
                todo += [(middle, end), (first, middle)]
            continue
        out[first:end] = converted
    return out


def external_scorer(load: Callable[[], Callable[[list[str]], list]], text: str = "text", batch_size: int = 256, errors: str | None = None) -> Scorer:
    """Scorer around a model that lives outside Spark.

    ``load`` runs once per task and returns a function from a batch of texts to a list of
    ``[(label, score), ...]``; None for a text marks a failure. A text whose scoring raises has null scores and the message
    in the column ``errors``, if that is named; the other texts of its batch are scored. An error of ``load`` itself ends the
    task. A null text is not shown to the model and fails without a message. Rows are not shuffled.
    """

    def scorer(df: DataFrame) -> DataFrame:
        entry = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
        more = [T.StructField("scores", T.ArrayType(entry))] + ([T.StructField(errors, T.StringType())] if errors else [])
        schema = T.StructType([*df.schema.fields, *more])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            predict = load()
            kind = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))
            for whole in batches:
                for start in range(0, len(whole), batch_size):
                    batch = whole.slice(start, batch_size)
                    texts = batch.column(text).to_pylist()
                    known = [i for i, t in enumerate(texts) if t is not None]
                    found: list = [(None, None)] * len(texts)
                    for i, result in zip(known, isolated(predict, [texts[i] for i in known])):
                        found[i] = result
                    made = [pa.array([r for r, _ in found], kind)] + ([pa.array([e for _, e in found], pa.string())] if errors else [])
                    yield pa.RecordBatch.from_arrays([*batch.columns, *made], [f.name for f in schema.fields])

        return df.mapInArrow(run, schema)

    return scorer


def predict(df: DataFrame, scorer: Scorer, threshold: float | None = 0.5, inclusive: bool = False, multilabel: bool = True) -> DataFrame:
    """Columns ``scores`` (kept entries, best first), ``pred`` (their labels) and ``failed``.

    Multilabel keeps the labels beyond the threshold, single-label keeps the best one. A failed
    scoring becomes the empty set, or the fixed default label.
    """
    if multilabel and threshold is None:
        raise ValueError("a multilabel prediction needs a threshold")
    scored = scorer(df).withColumn("failed", F.col("scores").isNull())
    filled = score_fn.with_fallback(F.col("scores"), multilabel)
    if multilabel:
        kept = score_fn.at_least(filled, threshold) if inclusive else score_fn.above(filled, threshold)
        chosen = score_fn.by_confidence(kept)
    else:
        chosen = score_fn.top_k(filled, 1)
    result = scored.withColumn("scores", chosen)
    return result.withColumn("pred", score_fn.labels(F.col("scores"))).withColumn("confidences", score_fn.confidences(F.col("scores")))


def explain(df: DataFrame, scorer: Scorer, k: int | None = 10, text: str = "text") -> DataFrame:
    """Preview, decision, confidence, ranked and complete probabilities of every text."""
    scored = scorer(df)
    decided = scored.withColumn("_d", score_fn.decision(F.col("scores")))
    return decided.select(
        *df.columns,
        text_fn.preview(F.col(text)).alias("preview"),
        F.col("_d.prediction").alias("prediction"),
        F.col("_d.confidence").alias("confidence"),
        score_fn.top_k(F.col("scores"), k).alias("ranked"),
        F.col("_d.all_probabilities").alias("all_probabilities"),
    )
