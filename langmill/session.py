"""Session-level helpers: shared storage for staged tables and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a computed table may have before we stop broadcasting it. A million rows of
# (short string, number) is below 100 MB on each executor.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables that every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``; only a session of one machine gets a fresh
    temporary folder without the setting, any other raises an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if current is None and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if current is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


_collecting: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("collecting", default=None)


def staging_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/langmill/{name}-{uuid.uuid4().hex}"
    if (collected := _collecting.get()) is not None:
        collected.append(path)
    return path


@contextlib.contextmanager
def collect_staged():
    """List of the paths that are staged inside the block, for ``release`` when their reader is written."""
    paths: list[str] = []
    token = _collecting.set(paths)
    try:
        yield paths
    finally:
        _collecting.reset(token)


def release(df: DataFrame, paths: list[str]) -> list[str]:
    """Remove the staged tables that ``df`` does not read; returns those that it does."""
    if not paths:
        return []
    files = df.inputFiles()
    # Names end in a random id, so a folder's name is enough whatever the scheme before it.
    read = [path for path in paths if any(f"/{path.rsplit('/', 1)[1]}/" in file for file in files)]
    for path in paths:
        if path not in read:
            drop_staged(df.sparkSession, path)
    return read


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession):
    """Inside the block Spark removes the shuffle files of a query when that query ends.

    For queries that write a table: what is read later is the table, and a lost executor costs a re-read of it.
    Without it shuffle files wait for a collection of garbage in the driver.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to shared storage, with the writer's ``options``, and continue from the written table.

    Used where a result feeds several branches or an iterative fit: the lineage ends at
    reliable storage, so a lost executor costs one re-read instead of a recomputation, and
    later branches read only the columns they need.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, path: str) -> None:
    """Remove a table that this library staged and no later step reads."""
    jvm = spark.sparkContext._jvm
    table, folder = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{shared_dir(spark)}/langmill"))
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.makeQualified(table).getParent().equals(store.makeQualified(folder)):
        raise ValueError(f"{path} is no staged table")
    store.delete(table, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for small results that are used more than once or whose size is checked."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Hint a broadcast only when the table has at most ``max_rows`` rows.

    ``df`` should be staged, so that the check reads footers and not the whole lineage.
    Returns the (possibly hinted) table and whether it was hinted; without the hint the join
    shuffles and adaptive execution splits skewed keys.
    """
    small = df.count() <= max_rows
    return (F.broadcast(df) if small else df), small


def spread(df: DataFrame, *keys: str, always: bool = False) -> DataFrame:
    """Spread rows over the cores when the scan has fewer tasks than cores.

    A scan splits files by bytes, so an input of any size has tasks enough and is left alone: a shuffle
    would only add cost. ``always`` is for operators that need the rows partitioned by ``key`` in any case.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if not always and df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores), *keys)


def inline_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A constant table built in the JVM from literals; its size is fixed by the source code."""
    fields = [field.strip().split(" ", 1) for field in schema.split(",")]
    literals = [
        F.struct(*[_typed(value, kind).alias(name) for value, (name, kind) in zip(row, fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*literals)))


def _typed(value, kind: str) -> Column:
    return F.lit(value).cast(kind)
