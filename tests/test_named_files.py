"""Files under the names of their inputs."""

import os

import pytest
from pyspark.sql import functions as F

from langmill.operators.lexicon import lexicon_scorer
from langmill.operators import scoring
from langmill.sources import readers, writers


def content(folder):
    return {name: (folder / name).read_text() for name in sorted(os.listdir(folder)) if not name.startswith(("_", "."))}


@pytest.fixture
def tree(tmp_path):
    for place, lines in {"a/x.txt": ["the cat", "", "le chat"], "b/x.txt": ["the"], "b/long.txt": [f"the {i}" for i in range(300)], "b/no.csv": ["x"]}.items():
        (tmp_path / "in" / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / place).write_text("\n".join(lines) + "\n")
    return str(tmp_path / "in")


def scored(lines):
    return scoring.predict(lines, lexicon_scorer(), 0.3).withColumn("pred", F.array(F.lit("p")))


def test_one_file_per_input(spark, tree, tmp_path):
    writers.write_named_predictions(scored(readers.text_tree(spark, tree, blocks=True)), str(tmp_path / "out"))
    got = content(tmp_path / "out")
    assert list(got) == ["a-x.txt", "b-long.txt", "b-x.txt"] and got["a-x.txt"] == "the cat\tp\nle chat\tp\n"
    assert got["b-long.txt"] == "".join(f"the {i}\tp\n" for i in range(300))
    assert not [name for name in os.listdir(tmp_path / "out") if name.startswith("_pending")]
    shorter = readers.text_tree(spark, tree + "/a", blocks=True)
    writers.write_named_predictions(scored(shorter), "file://" + str(tmp_path / "out"))
    assert list(content(tmp_path / "out")) == ["a-x.txt"]


def test_large_input_in_parts(spark, tree, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        writers.write_named_predictions(scored(readers.text_tree(spark, tree + "/b", blocks=True)), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = content(tmp_path / "out")
    parts = [got[name] for name in got if name.startswith("b-long.txt.part-")]
    assert len(parts) > 3 and "".join(parts) == "".join(f"the {i}\tp\n" for i in range(300)) and got["b-x.txt"] == "the\tp\n"


def test_clashing_names_and_failing_tasks_leave_nothing(spark, tree, tmp_path):
    lines = readers.text_tree(spark, tree, blocks=True)
    with pytest.raises(Exception, match="no name for one output file"):
        writers.write_named_predictions(scored(lines).withColumn("dir", F.lit("same")), str(tmp_path / "out"))
    with pytest.raises(Exception, match="broken row"):
        bad = F.when(F.col("text") == "the 299", F.raise_error(F.lit("broken row"))).otherwise(F.col("text"))
        writers.write_named_predictions(scored(lines).withColumn("text", bad), str(tmp_path / "out"))
    assert not os.listdir(tmp_path / "out")


def test_summary_per_result_file(spark, tmp_path):
    rows = [("m1.csv", "tier", 2, 0.5), ("m1.csv", "tier", 1, 0.25), ("m2.csv", "a,b", 1, None)]
    summary = spark.createDataFrame(rows, "source string, kind string, tier int, score double")
    writers.write_named_summaries(summary, str(tmp_path / "out"), ["tier"])
    assert content(tmp_path / "out") == {"m1.csv": "tier,1,0.25\ntier,2,0.5\n", "m2.csv": '"a,b",1,\n'}
    writers.write_named_summaries(summary.limit(0), str(tmp_path / "none"), ["tier"])
    assert content(tmp_path / "none") == {}
