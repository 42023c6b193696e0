"""The corpus pipeline: quality rules, near-duplicate join, personal data, mixing, packing.

Every stage takes all rows its predecessor kept, written as Parquet and read again. Rows are told apart by
position, so null and repeated ids are rows of their own in every stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmill.llm import jaccard, mixing, packing, pii, quality
from langmill.llm.table import ROW, keyed, staged
from langmill.session import collect_staged, release

#: Tables that the operators of earlier stages staged, by application.
_STAGED: dict[str, list[str]] = {}


def releasing(stage):
    """A stage that begins by removing what earlier stages staged, so that disk holds one stage's tables.

    The result of a stage is written before the next one starts; tables that ``docs`` still reads, as after a
    call without that write, are kept.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        kept = release(docs, _STAGED.pop(application, []))
        with collect_staged() as paths:
            result = stage(spark, docs, sf_dir)
        _STAGED[application] = kept + paths
        return result

    return run_stage


@releasing
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@releasing
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5 words, 0.8) the document with the smallest id stays."""
    rows = keyed(docs, "pipeline")
    found = jaccard.near_duplicates(rows, id_col=ROW).select(ROW, "component_id")
    first = found.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first"))
    return rows.join(first.select(f"first.{ROW}"), ROW, "left_semi").drop(ROW)


@releasing
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates; n_chars follows the text."""
    return pii.surrogates(docs)[0].withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@releasing
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, once or twice.

    The draw goes by doc_id, so that the order of rows does not change it; rows with one id go by size, then position.
    """
    rows = keyed(docs, "pipeline")
    taken = mixing.mix(rows.select(F.struct("doc_id", ROW).alias("key"), "text", "source"), id_col="key", draw_by="id.doc_id").docs
    uses = taken.where("taken > 0").select(F.col(f"key.{ROW}").alias(ROW), (F.col("taken") / F.col("size")).cast("int").alias("uses"))
    return rows.join(uses, ROW).withColumn("uses", F.explode(F.sequence(F.lit(1), "uses"))).select(*docs.columns)


@releasing
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", jaccard_join),
    ("pii", personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The likelihood ratio, the tokenizer and the surrogates are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage read or staged is removed once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with collect_staged() as written:
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(docs, before + _STAGED.pop(spark.sparkContext.applicationId, []))
        before = written
    return docs
