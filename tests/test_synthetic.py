"""Synthetic rows, and streaming equal to batch."""

import string

import pytest
from pyspark.sql import functions as F

from langmill.functions import text
from langmill.operators import scoring, synthetic
from langmill.operators.lexicon import lexicon_scorer
from langmill.session import staging_path
from langmill.streaming import lines


@pytest.fixture(scope="module")
def corpus(spark):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.col("id") % 9 + 2), lambda i: F.concat(F.lit("w"), F.col("id"), F.lit("é"), i)))
    return spark.range(200).select(F.col("id").alias("doc_id"), words.alias("text"), F.concat(F.lit("l"), F.col("id") % 3).alias("lang"))


@pytest.fixture(scope="module")
def rows(corpus):
    return synthetic.synthetic_rows(corpus, 0.9, 11).collect()


def test_slots(rows):
    kinds = [r.kind for r in sorted(rows, key=lambda r: r.row_no)]
    assert kinds == ["mixed"] * 80 + ["transliterated"] * 80 + ["random"] * 20


def test_same_rows_in_another_partitioning(corpus, rows):
    again = synthetic.synthetic_rows(corpus.repartition(7), 0.9, 11).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixed_rows_are_two_fragments(corpus, rows):
    source = {r.doc_id: (r.text.split(" "), r.lang) for r in corpus.collect()}
    for r in (r for r in rows if r.kind == "mixed"):
        tokens = r.text.split(" ")
        ids = []
        for t in tokens:
            i = int(t[1:t.index("é")])
            if not ids or ids[-1] != i:
                ids.append(i)
        assert 1 <= len(ids) <= 3 and set(r.gold) == {source[i][1] for i in ids} and r.gold == sorted(r.gold)
        if len(ids) == 2:
            for i in ids:
                words = source[i][0]
                part = [t for t in tokens if t.startswith(f"w{i}é")]
                assert " ".join(part) in " ".join(words)
                n = len(words)
                assert len(part) == n if n <= 3 else max(1, n // 2) <= len(part) < n


def test_transliterated_rows_are_ascii(rows):
    picked = [r for r in rows if r.kind == "transliterated"]
    assert all(r.text.isascii() and len(r.gold) == 1 for r in picked) and len({r.text for r in picked}) > 30


def test_random_rows(spark):
    rows = synthetic.random_rows(spark.range(3000).withColumnRenamed("id", "row_no"), 5).collect()
    tokens = [t for r in rows for t in r.text.split(" ")]
    assert all(r.gold == [] and 1 <= len(r.text.split(" ")) <= 10 for r in rows)
    numbers = [t for t in tokens if t.isdigit()]
    assert abs(len(numbers) / len(tokens) - 0.05) < 0.01 and all(1 <= len(t) <= 5 for t in numbers)
    others = [t for t in tokens if not t.isdigit()]
    assert all(2 <= len(t.rstrip(string.punctuation)) <= 7 and len(t) <= 8 for t in others)
    assert abs(sum(t[-1] in string.punctuation for t in others) / len(others) - 0.1) < 0.015
    rest = [t for r in rows for t in r.text.split(" ")[1:] if not t.isdigit()]
    assert abs(sum(t[0].isupper() for t in rest) / len(rest) - 0.1) < 0.015


def test_words(spark):
    df = spark.createDataFrame([(" a  b\tc ",), ("中文😀",), ("",)], "t string")
    assert [r.w for r in df.select(text.words(F.col("t")).alias("w")).collect()] == [["a", "b", "c"], ["中", "文", "😀"], []]


def test_extended_corpus_keeps_all_rows(corpus):
    counts = {r.kind: r.n for r in synthetic.extended_corpus(corpus, 0.5, 3).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert counts["real"] == 200 and sum(counts.values()) == 300


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("the cat and the dog\n\nle chat et la souris\n")
    (folder / "b.txt").write_text("  der hund und die katze \nthe end\n")
    stream = lines.scored(lines.line_stream(spark, str(folder), files_per_trigger=1), lexicon_scorer())
    out, counts = staging_path(spark, "t"), staging_path(spark, "t")
    checkpoint = staging_path(spark, "t")
    lines.write_scored(stream, out, checkpoint, available_now=True).awaitTermination()
    lines.write_counts(stream, counts, available_now=True).awaitTermination()
    from langmill.sources import readers

    batch = scoring.predict(readers.text_lines(spark, str(folder)), lexicon_scorer())
    as_set = lambda df: {(r.text, tuple(r.pred)) for r in df.collect()}
    assert as_set(spark.read.parquet(out)) == as_set(batch) and len(as_set(batch)) == 4
    assert {r.label: r.n for r in spark.read.parquet(counts).collect()} == {"eng_Latn": 2, "fra_Latn": 1, "deu_Latn": 1}
    # A new file after a restart from the checkpoint is appended, nothing is scored twice.
    (folder / "c.txt").write_text("la casa de los perros\n")
    again = lines.scored(lines.line_stream(spark, str(folder)), lexicon_scorer())
    lines.write_scored(again, out, checkpoint, available_now=True).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_counts_are_published_by_version(spark, tmp_path):
    """A reader finds the last complete version; a batch run again changes nothing, the rest of a crash is replaced."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("the cat and the dog\nle chat et la souris\n")
    path, checkpoint = staging_path(spark, "t"), staging_path(spark, "t")
    counts = lambda: {r.label: r.n for r in lines.read_counts(spark, path).collect()}
    assert counts() == {}

    def run():
        stream = lines.scored(lines.line_stream(spark, str(folder), files_per_trigger=1), lexicon_scorer())
        lines.publish_counts(stream, path, checkpoint, available_now=True).awaitTermination()

    run()
    assert counts() == {"eng_Latn": 1, "fra_Latn": 1}
    opened = lines.read_counts(spark, path)
    spark.range(3).write.parquet(f"{path}/version-1")  # what a crash left: written, but never announced
    assert counts() == {"eng_Latn": 1, "fra_Latn": 1}
    (folder / "b.txt").write_text("the end of it\n")
    run()
    assert counts() == {"eng_Latn": 2, "fra_Latn": 1}
    assert opened.count() == 2  # the version before is still there
    run()
    assert counts() == {"eng_Latn": 2, "fra_Latn": 1} and lines._announced(spark, path) == [0, 1]
