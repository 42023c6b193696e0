"""Streams over tables that are one file, or a folder of files."""

from langmill.plans import catalog
from langmill.streaming import lines


def test_a_stream_reads_a_table_of_one_file_or_many(spark, tmp_path):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et la maison", "fr"), (3, None, "en"), (4, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.write.parquet(str(tmp_path / "many" / "others.parquet"))
    (tmp_path / "one").mkdir()
    docs.toPandas().to_parquet(tmp_path / "one" / "documents.parquet")
    assert lines.table_stream(spark, str(tmp_path / "many"), "documents.parquet").isStreaming
    for query in (catalog.stream_scores, catalog.stream_counts):
        many, one = (sorted(map(tuple, query(spark, str(tmp_path / kind)).collect())) for kind in ("many", "one"))
        assert many == one and many
