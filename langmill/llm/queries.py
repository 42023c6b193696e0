"""Registered queries of this package; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmill.llm import bpe, edits, jaccard, merkle, mixing, neighbours, packing, pii, quality, recompress, statements, suffixes, template, whitening
from langmill.llm.table import pick


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document before and after three edits drawn by hash."""
    docs = table(spark, folder, "documents")
    docs = docs.select("doc_id", "text", edits.drawn_edits(F.col("text"), F.col("doc_id")).alias("edits"))
    return edits.counts(edits.trees(docs, edits_col="edits"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics and likelihood-ratio verdict of every document."""
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


def op1_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every 20th one by largest inner product."""
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken from every document by the mix."""
    return mixing.with_sources(mixing.mix(table(spark, folder, "documents")))


def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Number of 3-word shingles and component of every document, at a Jaccard similarity of 0.9."""
    found = jaccard.near_duplicates(table(spark, folder, "documents"), words=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op4_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document left when repeated strings of 400 bytes are removed."""
    return suffixes.remove_repeats(table(spark, folder, "documents")).drop("kept")


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return template.main_text(table(spark, folder, "pages"))


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with surrogates in place of personal data."""
    return pii.surrogates(table(spark, folder, "documents"))[0].select("doc_id", "text", "n_entities")


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document left when repeated windows of 20 words are removed."""
    return recompress.remove_repeats(table(spark, folder, "documents")).drop("kept")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    return packing.pack(table(spark, folder, "documents"))


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, and the bytes that they stand for."""
    coded = bpe.decode(bpe.encode(table(spark, folder, "documents")))
    return coded.select(
        F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors on the 16 leading components of the distinct ones, whitened."""
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that its text, line breaks deleted from some, leads to."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = pick(table(spark, folder, "documents"), **{name: name for name in fields})
    broken = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    later = F.when(broken, F.translate("text", "\n", "")).otherwise(F.col("text"))
    docs = docs.withColumn("later", merkle.leaf_hash(*[F.col(name) for name in fields[:-1]], later))
    found = merkle.manifest(docs, fields, carry=["later"])
    rows = found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_hash(F.col("path")).alias("proof_sha256"),
        merkle.fold(F.col("later"), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours, op2_mixing, op3_ngram_jaccard_join, op4_suffix_array_dedup, op5_html_extraction, op6_pii,
        op7_substring_dedup, op8_packing, op9_token_counts, op10_quality_rules, op11_byte_bpe,
        op12_embedding_whitening, op13_merkle_manifest,
    )
}
#: The rest is beyond SQL, or too slow for it; tests compare it with plain versions.
ORACLES: dict[str, str] = {"op13_merkle_manifest": statements.MERKLE}
