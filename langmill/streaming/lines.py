"""Score lines as they arrive.

Scoring is a stateless projection, so the streaming result equals the batch result. The running
counts keep one row of state per label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from langmill.operators import contingency
from langmill.operators.scoring import Scorer, predict
from langmill.sources.readers import clean_lines


def line_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of text files as they are added to a folder."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return clean_lines(reader.text(path))


def table_stream(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Rows of parquet files as they are added to a folder. A folder of the name ``glob`` in it is a table of many files, all read."""
    inner = f"{path}/{glob}"
    if _store(spark, path).isDirectory(_path(spark, inner)):
        return spark.readStream.schema(spark.read.parquet(inner).schema).parquet(inner)
    schema = spark.read.option("pathGlobFilter", glob).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def scored(stream: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    return predict(stream, scorer, threshold)


def _checkpoint_of(path: str) -> str:
    """Where the stream that writes ``path`` keeps its progress: the same place at every start."""
    return f"{path.rstrip('/')}.checkpoint"


def write_scored(stream: DataFrame, path: str, checkpoint: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Append to parquet files. The checkpoint lives beside them unless named, so a restart on other machines
    continues where the query stopped."""
    location = checkpoint or _checkpoint_of(path)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def running_counts(stream: DataFrame) -> DataFrame:
    """(label, n) over everything scored so far; write it in update or complete mode."""
    return contingency.label_frequency(stream)


def write_counts(stream: DataFrame, path: str, checkpoint: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Replace the table of running counts at ``path`` after every batch.

    Any reader can open the table, but not while it is replaced; ``publish_counts`` is for readers at any time.
    """
    location = checkpoint or _checkpoint_of(path)

    def replace(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return _start_counts(stream, location, replace, available_now)


def _start_counts(stream: DataFrame, location: str, write: Callable[[DataFrame, int], None], available_now: bool) -> StreamingQuery:
    writer = running_counts(stream).writeStream.outputMode("complete").option("checkpointLocation", location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(write).start()


def publish_counts(stream: DataFrame, path: str, checkpoint: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Write the running counts after every batch as a version of their own; ``read_counts`` reads the last complete one.

    A version is announced by a pointer that is written after it, so a reader never meets a missing or partial table, and
    a batch that is run again after a crash finds its pointer and changes nothing. The two last versions are kept, for readers
    that have just opened the one before.
    """
    location = checkpoint or _checkpoint_of(path)

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        announced = _announced(spark, path)
        if batch_id in announced:
            return
        batch.write.mode("overwrite").parquet(f"{path}/version-{batch_id}")  # what a crash left of it goes
        store = _store(spark, path)
        store.create(_path(spark, f"{path}/{_POINTER}{batch_id}"), True).close()
        for old in sorted(announced)[:-1]:
            store.delete(_path(spark, f"{path}/{_POINTER}{old}"), False)  # the pointer first
            store.delete(_path(spark, f"{path}/version-{old}"), True)

    return _start_counts(stream, location, publish, available_now)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The running counts of the last batch that was written to its end; no rows before the first."""
    announced = _announced(spark, path)
    if not announced:
        return spark.createDataFrame([], "label string, n bigint")
    return spark.read.parquet(f"{path}/version-{max(announced)}")


_POINTER = "_complete-"


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _announced(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose pointers are there."""
    store, folder = _store(spark, path), _path(spark, path)
    if not store.exists(folder):
        return []
    names = [f.getPath().getName() for f in store.listStatus(folder)]
    return sorted(int(name.removeprefix(_POINTER)) for name in names if name.startswith(_POINTER))
