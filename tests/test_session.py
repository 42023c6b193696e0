"""Staged tables and the files of finished shuffles."""

import glob

import pytest
from pyspark.sql import functions as F

from langmill import session

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_ids(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.rsplit("/", 1)[1].split("_")[1] for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*")}


def test_shuffle_files_go_when_the_query_ends(spark):
    before = shuffle_ids(spark)
    with session.freeing_shuffles(spark):
        out = session.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "freed")
    assert not shuffle_ids(spark) - before
    assert {r["count"] for r in out.collect()} == {142, 143}


def test_the_setting_is_put_back(spark):
    before = spark.conf.get(KEY, None)
    with pytest.raises(RuntimeError):
        with session.freeing_shuffles(spark):
            assert spark.conf.get(KEY) == "true"
            raise RuntimeError
    assert spark.conf.get(KEY, None) == before
