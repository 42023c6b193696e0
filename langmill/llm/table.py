"""Input handling that every operator of this package shares: columns, row keys, staging."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langmill.session import freeing_shuffles, staging_path

#: Name of the row key that ``keyed`` adds. Documents are told apart by it, never by their ids, so null
#: and repeated ids keep their rows.
ROW = "_row"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``alias=column`` by exact name, whatever other columns clash with it."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    missing = [name for name in columns.values() if name not in df.columns]
    if missing:
        raise ValueError(f"no column {missing} among {df.columns}")
    return plain.select([F.col(f"c{df.columns.index(name)}").alias(alias) for alias, name in columns.items()])


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and go on from the written table, so a lost executor costs a re-read."""
    path = staging_path(df.sparkSession, name)
    with freeing_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, name: str) -> DataFrame:
    """Stage ``df`` with a row key that stays the same however often later jobs read it."""
    return staged(df.withColumn(ROW, F.monotonically_increasing_id()), f"{name}-rows")


def bucketed(df: DataFrame, name: str) -> DataFrame:
    """Like ``keyed``, and dealt to buckets by the row key, so that joins on it move only the other side."""
    n = tasks(df)
    rows = df.withColumn(ROW, F.monotonically_increasing_id()).repartition(n, ROW)
    table = fresh(f"langmill_{name}")
    writer = rows.write.bucketBy(n, ROW).sortBy(ROW).option("compression", "zstd").format("parquet")
    with freeing_shuffles(df.sparkSession):
        writer.option("path", staging_path(df.sparkSession, f"{name}-buckets")).saveAsTable(table)
    return df.sparkSession.table(table)


def tasks(df: DataFrame) -> int:
    """Shuffle partitions of the session, at least one for each core."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread_small(df: DataFrame) -> DataFrame:
    """Spread an input of fewer scan tasks than cores; a larger one stays where it is."""
    spark = df.sparkSession
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(2 * spark.sparkContext.defaultParallelism)


def draw(seed: str, *columns: str) -> Column:
    """Uniform in [0, 1), decided by the seed and the columns alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))).cast("double")


def fresh(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


def starts(df: DataFrame, group: list[str], size: str, seed: str, order: list[str]) -> DataFrame:
    """Running sum of ``size`` before each row of its group in seeded order, as ``start``; its total, as ``total``.

    Rows are dealt to slices by hash, so the largest group is summed by many tasks: only the sums of the
    slices are put in order. ``df`` should be staged; it is counted and read twice.
    """
    slices = max(64, df.count() // 10_000)
    rows = df.withColumn("_draw", F.xxhash64(F.lit(seed), *order)).withColumn("_slice", F.pmod("_draw", F.lit(slices)))
    sums = rows.groupBy(*group, "_slice").agg(F.sum(size).alias("_sum"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *group, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(whole).alias("total")
    )
    names = [f"_g{i}" for i in range(len(group))]
    same = F.col("_slice") == F.col("_s")
    for name, g in zip(names, group):
        same &= F.col(g).eqNullSafe(F.col(name))
    rows = rows.join(sums.toDF(*names, "_s", "_before", "total"), same)
    inside = Window.partitionBy(*group, "_slice").orderBy("_draw", *order, ROW).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("_before") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return rows.drop("_draw", "_slice", "_before", "_s", *names)
