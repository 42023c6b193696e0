"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio.

Every document gets base statistics and the mean log-likelihood ratio of its hashed 1- and 2-grams
between two multinomials: the raw corpus (all documents) and the trusted target (labelled good ones).
Thresholds are fixed numbers, so a document is judged alike wherever and whenever it is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmill.llm import spans
from langmill.llm.table import draw, pick, spread_small, staged, tasks
from langmill.session import broadcast_if_small

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Model:
    """``ratio[b]``: shrunken log ratio of bucket b; documents with a mean below ``threshold`` are rejected."""

    ratio: np.ndarray
    threshold: float


def _text_grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    start, end, row = spans.words(data, offsets)
    word = spans.Prints(data).of(start, end)
    first, pair = spans.grams(word, row, 2)
    bucket = np.concatenate((word, pair)) % np.uint64(buckets)
    return bucket.astype(np.int64), np.concatenate((row, row[first]))


def labelled(labels: DataFrame) -> DataFrame:
    """``id, trusted`` of all labelled ids. A null label or id takes no part; an id is trusted if all its labels are."""
    rows = pick(labels, id="doc_id", quality="quality", toxic="toxic").dropna()
    return rows.groupBy("id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("trusted"))


def fit(docs: DataFrame, labels: DataFrame, *, buckets: int = 1 << 18, shrink: float = 20.0,
        seed: str = "trusted", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count n-grams of all ``docs`` and of the trusted ones among all labelled rows.

    Half of the labelled ids, by hash draw, gives the target counts; the threshold is set on the other half, whose
    words the target has not seen. ``shrink`` is the count added to observed and expected target counts, so buckets without
    evidence get 0. The threshold is the middle of the score gap that loses fewest trusted documents
    (weight 5) plus keeps fewest of the others; without both kinds it is minus infinity.
    """
    ids = staged(labelled(labels).withColumn("target", draw(f"{seed}-half", "id") < 0.5), "quality-labelled")
    docs = pick(docs, id=id_col, text=text_col)
    rows = docs.join(broadcast_if_small(ids)[0], "id", "left")

    def count(batches):
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            trusted = batch.column("trusted").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in spans.blocks(batch.column("text")):
                bucket, row = _text_grams(data, offsets, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[trusted[a:b][row]], minlength=buckets)
        used = np.flatnonzero(raw)
        for i in range(0, len(used), 65536):
            at = used[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counts = (
        spread_small(rows.select("text", F.coalesce(F.expr("trusted and target"), F.lit(False)).alias("trusted"))).mapInArrow(count, "bucket long, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    )  # one row for each bucket at most
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counts.bucket], target[counts.bucket] = counts.raw, counts.target
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    ratio = np.log((target + shrink) / (expected + shrink)).astype(np.float32)
    judged = rows.where("not target")
    scores = score(judged.select(F.struct("trusted", "id").alias("id"), "text"), Model(ratio, -np.inf), id_col="id")
    return Model(ratio, _threshold(scores.where("not base_failed").select("id.trusted", F.col("ratio").alias("value"))))


def _threshold(scores: DataFrame) -> float:
    """The threshold from ``trusted, value`` of all judged rows: the driver gets a few numbers for each task."""
    kinds = [F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("bad")]
    values = staged(scores.groupBy("value").agg(*kinds), "quality-scores")
    whole = values.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not whole.good or not whole.bad:
        return float("-inf")
    parts = staged(values.repartitionByRange(tasks(values), "value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()), "quality-ordered")
    sums = parts.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("value").alias("low")).orderBy("part").collect()
    before = dict(zip([r.part for r in sums], np.cumsum([[0, 0], *[[r.good, r.bad] for r in sums]], axis=0)))
    after = dict(zip([r.part for r in sums], [r.low for r in sums[1:]] + [np.inf]))

    def cheapest(key: tuple, table: pa.Table) -> pa.Table:
        """The best threshold above the first value of a part, up to the middle of the gap that follows it."""
        part = key[0].as_py()
        table = table.sort_by("value")
        value, good, bad = (table.column(c).to_numpy() for c in ("value", "good", "bad"))
        lost = (before[part][0] + np.cumsum(good)) / whole.good
        kept = 1 - (before[part][1] + np.cumsum(bad)) / whole.bad
        edges = np.concatenate(((value[1:] + value[:-1]) / 2, [(value[-1] + after[part]) / 2]))
        at = int(np.argmin(cost := 5 * lost + kept))
        return pa.table({"cost": [float(cost[at])], "edge": [float(edges[at])]})

    found = parts.groupBy("part").applyInArrow(cheapest, "cost double, edge double").collect()  # one row for each task
    return min([(1.0, float("-inf")), *map(tuple, found)])[1]


_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, kept boolean"
)
NAMES = ["id", *[x.split()[0] for x in _SCHEMA.split(", ")]]


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50,
          max_repeat_percent: int = 50) -> DataFrame:
    """One row for each row of ``docs``: its id, the statistics, ``ratio`` (mean, 0 without words) and ``kept``.

    A null or empty text has no words and fails the base rules. Extra columns are left out; rows with
    null or repeated ids keep their rows.
    """
    rows = pick(docs, id=id_col, text=text_col)
    judge = _judge(model, min_words, max_repeat_percent)

    def scored(batches):
        for batch in batches:
            for a, b, columns in judge(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), *map(pa.array, columns)], NAMES)

    kind = rows.schema["id"].dataType.simpleString()
    return spread_small(rows).mapInArrow(scored, f"id {kind}, {_SCHEMA}").withColumnRenamed("id", id_col)


def _statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    start, end, row = spans.words(data, offsets)
    prints = spans.Prints(data)
    if not len(data):
        return [np.zeros(n, dtype=np.int64) for _ in range(5)]
    # a code point has one byte that is no continuation byte; separators are single bytes
    first = ((data & 0xC0) != 0x80) & ~spans._SEPARATOR[data]
    total = np.concatenate(([0], np.cumsum(first)))
    chars = total[offsets[1:]] - total[offsets[:-1]]
    table = np.zeros(256, dtype=bool)
    table[list(SYMBOLS)] = True
    total = np.concatenate(([0], np.cumsum(table[data])))
    symbols = total[offsets[1:]] - total[offsets[:-1]]
    return [np.bincount(row, minlength=n), chars, symbols, _repeated_lines(data, offsets, prints, start), _repeated_words(start, end, row, prints, n)]


def _repeated_lines(data, offsets, prints, word_start) -> np.ndarray:
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    from_ = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    to = np.sort(np.concatenate((offsets[1:], breaks)), kind="stable")
    # a line has a word if a word starts in it
    some = np.searchsorted(word_start, to) > np.searchsorted(word_start, from_)
    from_, to = from_[some], to[some]
    row, line = spans.rows_at(from_, offsets), prints.of(from_, to)
    order = np.lexsort((line, row))
    row, line = row[order], line[order]
    again = (row[1:] == row[:-1]) & (line[1:] == line[:-1])
    return np.bincount(row[1:][again], minlength=n)


def _repeated_words(start, end, row, prints, n) -> np.ndarray:
    first, gram = spans.grams(prints.of(start, end), row, 3)
    if not len(first):
        return np.zeros(n, dtype=np.int64)
    order = np.lexsort((gram, row[first]))
    same = (gram[order][1:] == gram[order][:-1]) & (row[first][order][1:] == row[first][order][:-1])
    often = np.zeros(len(order), dtype=bool)
    often[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    change = np.zeros(len(row) + 1, dtype=np.int64)
    change[first[often]] += 1
    change[first[often] + 3] -= 1
    return np.bincount(row[np.cumsum(change[:-1]) > 0], minlength=n)


def keep(docs: DataFrame, model: Model, *, text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the base rules and the ratio accept."""
    judge, position = _judge(model, min_words, max_repeat_percent), docs.columns.index(text_col)

    def accepted(batches):
        for batch in batches:
            for a, b, columns in judge(batch.column(position)):
                yield batch.slice(a, b - a).filter(pa.array(columns[-1]))

    return spread_small(docs).mapInArrow(accepted, docs.schema)


def _judge(model: Model, min_words: int, max_repeat_percent: int):
    """Function from a text column to blocks: first row, end row, statistics columns."""
    ratio, threshold = model.ratio, model.threshold

    def judge(texts):
        for a, b, data, offsets in spans.blocks(texts):
            columns = _statistics(data, offsets)
            bucket, row = _text_grams(data, offsets, len(ratio))
            mean = np.bincount(row, ratio[bucket], minlength=b - a) / np.maximum(np.bincount(row, minlength=b - a), 1)
            failed = (columns[0] < min_words) | (100 * columns[4] > max_repeat_percent * columns[0])
            yield a, b, [*columns, failed, mean, ~failed & (mean >= threshold)]

    return judge


def _statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    start, end, row = spans.words(data, offsets)
    prints = spans.Prints(data)
    if not len(data):
        return [np.zeros(n, dtype=np.int64) for _ in range(5)]
    # a code point has one byte that is no continuation byte; separators are single bytes
    first = ((data & 0xC0) != 0x80) & ~spans._SEPARATOR[data]
    total = np.concatenate(([0], np.cumsum(first)))
    chars = total[offsets[1:]] - total[offsets[:-1]]
    table = np.zeros(256, dtype=bool)
    table[list(SYMBOLS)] = True
    total = np.concatenate(([0], np.cumsum(table[data])))
    symbols = total[offsets[1:]] - total[offsets[:-1]]
    return [np.bincount(row, minlength=n), chars, symbols, _repeated_lines(data, offsets, prints, start), _repeated_words(start, end, row, prints, n)]


def _repeated_lines(data, offsets, prints, word_start) -> np.ndarray:
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    from_ = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    to = np.sort(np.concatenate((offsets[1:], breaks)), kind="stable")
    # a line has a word if a word starts in it
    some = np.searchsorted(word_start, to) > np.searchsorted(word_start, from_)
    from_, to = from_[some], to[some]
    row, line = spans.rows_at(from_, offsets), prints.of(from_, to)
    order = np.lexsort((line, row))
    row, line = row[order], line[order]
    again = (row[1:] == row[:-1]) & (line[1:] == line[:-1])
    return np.bincount(row[1:][again], minlength=n)


def _repeated_words(start, end, row, prints, n) -> np.ndarray:
    first, gram = spans.grams(prints.of(start, end), row, 3)
    if not len(first):
        return np.zeros(n, dtype=np.int64)
    order = np.lexsort((gram, row[first]))
    same = (gram[order][1:] == gram[order][:-1]) & (row[first][order][1:] == row[first][order][:-1])
    often = np.zeros(len(order), dtype=bool)
    often[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    change = np.zeros(len(row) + 1, dtype=np.int64)
    change[first[often]] += 1
    change[first[often] + 3] -= 1
    return np.bincount(row[np.cumsum(change[:-1]) > 0], minlength=n)
