"""Writers. All of them write in parallel from the tasks that hold the rows."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmill.operators import confusion
from langmill.sources.named_files import write_named


def prediction_lines(scored: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One line ``text<TAB>label,label`` per row."""
    return scored.select(*(keep or []), F.concat_ws("\t", "text", F.array_join("pred", ",")).alias("value"))


def write_predictions(scored: DataFrame, path: str, mode: str = "overwrite") -> None:
    prediction_lines(scored).write.mode(mode).text(path)


def write_prediction_tree(scored: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder ``file=<dir>-<name>`` per input file. Rows are not gathered per file first, so one huge
    input file is written by many tasks."""
    named = scored.withColumn("file", F.concat_ws("-", "dir", "name"))
    prediction_lines(named, ["file"]).write.mode(mode).partitionBy("file").text(path)


def write_named_predictions(scored: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One file ``<dir>-<name>`` per input file of ``text_tree(..., blocks=True)``, its lines in their order.

    An input that was read in several blocks gives numbered parts. ``scored`` should not have been shuffled.
    """
    named = scored.select(F.concat_ws("-", "dir", "name").alias("_name"), F.col("file").alias("source"), "block", "text", "pred")
    lines = prediction_lines(named, ["_name", "source", "block"])
    write_named(lines.withColumnRenamed("_name", "name"), path, mode)


def write_named_summaries(summary: DataFrame, path: str, order: list[str], mode: str = "overwrite") -> None:
    """One CSV file per input result file, named like it, rows sorted by ``order``. A summary has few rows a file."""
    columns = [c for c in summary.columns if c != "source"]
    rows = summary.repartition("source").sortWithinPartitions("source", *order)
    lines = rows.select(F.col("source").alias("name"), "source", F.lit(0).alias("block"), F.to_csv(F.struct(*columns)).alias("value"))
    write_named(lines, path, mode)


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows ``metric,label,score``."""
    metrics.select("metric", "label", "score").write.mode(mode).csv(path)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Section report with nested label scores as JSON lines."""
    report.write.mode(mode).json(path)


def write_instances(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Prediction and gold labels of every instance with its place in its section."""
    items.select("l1", "l2", "pos", "pred", "gold").write.mode(mode).parquet(path)


def write_confusion(matrix: DataFrame, labels: list[str], path: str, mode: str = "overwrite") -> None:
    """Wide matrix with a header row."""
    confusion.wide(matrix, labels).write.mode(mode).option("header", True).csv(path)


def write_run(result: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row of parameters and scores of a run as JSON."""
    result.coalesce(1).write.mode(mode).json(path)


def write_by_source(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Summaries of several result files, one folder per input."""
    summary.write.mode(mode).partitionBy("source").csv(path)


def _document(batches):
    """Lines of one JSON document over the sorted rows (keys, instance) of a task."""
    path, lines = [], []

    def close(depth):
        """Close what is open below the first ``depth`` keys."""
        marks = ["]"] + ["}"] * (len(path) - 1 - depth) if path else []
        del path[depth:]
        return "".join(marks)

    first = True
    for batch in batches:
        lines = ["{"] if first and batch.num_rows else []
        first = first and not batch.num_rows
        for keys, instance in zip(batch.column("keys").to_pylist(), batch.column("instance").to_pylist()):
            if keys == path:
                lines.append("," + instance)
                continue
            same = 0
            while same < min(len(keys), len(path)) - 1 and keys[same] == path[same]:
                same += 1
            begun = bool(path)
            end = close(same) + ("," if begun else "")
            lines.append(end + ":{".join(json.dumps(key) for key in keys[same:]) + ":[" + instance)
            path.extend(keys[same:])
        yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
    if path:
        yield pa.RecordBatch.from_pydict({"value": pa.array([close(0) + "}"], pa.string())})


def write_sections(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sectioned JSON documents from (l1, l2, text, gold), one per task; ``l2/l3`` becomes two levels.

    A section with many items is spread over the documents of many tasks.
    """
    keys = F.concat(F.array("l1"), F.split("l2", "/", 2))
    rows = items.select(keys.alias("keys"), F.to_json(F.struct("text", F.col("gold").alias("label"))).alias("instance"))
    rows.sortWithinPartitions("keys").mapInArrow(_document, "value string").write.mode(mode).text(path)


def write_bcms(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headerless TSV from (codes, text): comma-joined codes, quoted text with its line breaks."""
    rows = items.select(F.array_join("codes", ",").alias("codes"), "text")
    rows.write.mode(mode).csv(
        path, sep="\t", quote='"', escape='"', quoteAll=True, emptyValue="", header=False,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
