"""Formats whose records cross line ends, read in blocks of a few bytes."""

import csv
import json
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from langmill.sources import readers, splits, writers


@pytest.fixture
def small_blocks(spark):
    """Files are cut every 100 to 300 bytes, far within most records."""
    names = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "8"}
    old = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in old.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


WORDS = ["cat", 'say "hi"', "tab\there", "two\nlines", "\n\n", "", "back\\slash", '"', '""', "\\", "{[:,]}", "é", "日本", '\\"', "x" * 400]


def some_text(draw):
    return " ".join(draw.choices(WORDS, k=draw.randint(0, 8)))


def document(draw, depth):
    """Sections with lists of instances, other values between them."""
    instances = [
        draw.choice([
            {"text": some_text(draw), "label": draw.choices(["eng_Latn", "fra_Latn"], k=draw.randint(0, 2))},
            {"label": ["a"], "more": {"x": [{"text": "no instance"}]}, "text": some_text(draw)}, "s" + some_text(draw), 3, None, [{"text": "nested"}], {},
        ])
        for _ in range(draw.randint(0, 6))
    ]
    if depth == 0:
        return instances
    keys = draw.sample(["a", 'q"k', "k{", "é", "back\\", "long" * 60, "n\nl"], k=draw.randint(1, 3))
    return {key: document(draw, depth - 1) if draw.random() < 0.85 else draw.choice([3, "text", None, {}]) for key in keys}


def walk(node, keys=()):
    if isinstance(node, dict):
        for key, value in node.items():
            yield from walk(value, (*keys, key))
    elif isinstance(node, list):
        objects = [e for e in node if isinstance(e, dict)]
        yield from ((keys, pos, e) for pos, e in enumerate(objects))


@pytest.mark.parametrize("seed", range(2))
def test_json_blocks(spark, tmp_path, small_blocks, seed):
    draw = random.Random(seed)
    want = Counter()
    for i in range(6):
        found = {"top": document(draw, i % 4), "z": document(draw, 2)}
        (tmp_path / f"{i}.json").write_text(json.dumps(found, indent=draw.choice([None, 2]), ensure_ascii=draw.random() < 0.5))
        want.update((f"{i}.json", keys, pos, json.dumps(e)) for keys, pos, e in walk(found))
    rows = splits.json_instances(spark, str(tmp_path)).collect()
    assert Counter((r.file.rsplit("/", 1)[1], tuple(r["keys"]), r.pos, json.dumps(json.loads(r.value))) for r in rows) == want and want
    a, b = readers.read_large_sections(spark, str(tmp_path)), readers.read_sections(spark, str(tmp_path))
    as_set = lambda df: Counter((r.l1, r.l2, r.pos, r.text, tuple(r.gold or ["none"])) for r in df.collect())
    assert a.schema.simpleString() == b.schema.simpleString() and as_set(a) == as_set(b)


def test_one_line_document_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    found = {"l1": {"l2": [{"text": f"t{i}", "label": []} for i in range(2000)]}}
    (tmp_path / "one.json").write_text(json.dumps(found))
    assert splits._pieces(spark, str(tmp_path), '"').select("block").distinct().count() > 50
    rows = readers.read_large_sections(spark, str(tmp_path)).collect()
    assert sorted((r.pos, r.text) for r in rows) == [(i, f"t{i}") for i in range(2000)]
    assert readers.large_instances_at_any_depth(spark, str(tmp_path)).count() == 2000


@pytest.mark.parametrize("text", ['{"a": {"b": [{"text": "cut', '{"a": [1}', '{"a": 1}}', '{"a": {"b": [{"text": "x"}]}', '"a'])
def test_broken_documents(spark, tmp_path, small_blocks, text):
    (tmp_path / "broken.json").write_text(text)
    (tmp_path / "good.json").write_text('{"a": {"b": [{"text": "x"}]}}')
    (tmp_path / "empty.json").write_text("")
    with pytest.raises(PySparkException, match="not a whole JSON document: .*broken"):
        readers.read_large_sections(spark, str(tmp_path)).collect()
    assert [r.text for r in readers.read_large_sections(spark, str(tmp_path), strict=False).collect()] == ["x"]


@pytest.mark.parametrize("seed", range(2))
def test_tsv_blocks(spark, tmp_path, small_blocks, seed):
    draw = random.Random(seed)
    for i in range(3):
        with open(tmp_path / f"{i}.tsv", "w", newline="") as file:
            writer = csv.writer(file, delimiter="\t", lineterminator="\n", quoting=draw.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
            for _ in range(60):
                writer.writerow([draw.choice(["sr", "hr,bs", "me"]), some_text(draw)])
            file.write('sr\tplain "middle" quote" here\nhr\t"closed"rest\n\nme\tlast')
    assert splits._pieces(spark, str(tmp_path), "\n").select("file", "block").distinct().count() > 30
    as_set = lambda df: Counter((tuple(r.gold), r.text) for r in df.collect())
    got = as_set(readers.large_bcms_items(spark, str(tmp_path)))
    assert got == as_set(readers.bcms_items(spark, str(tmp_path))) and sum(got.values()) == 3 * 63


def test_tsv_open_quote_and_carriage_returns(spark, tmp_path, small_blocks):
    (tmp_path / "a.tsv").write_bytes(b'sr\ta\r\n\r\nhr\t"b\nnever closed\nme\tx\n')
    assert sorted(r.value for r in splits.tsv_records(spark, str(tmp_path)).collect()) == ['hr\t"b\nnever closed\nme\tx', "sr\ta"]


def test_quotes_at_line_ends():
    assert not splits.quoted_after('a\t"b"', False) and splits.quoted_after('a\t"b', False)
    assert splits.quoted_after('b"" c', True) and not splits.quoted_after('b""" c"', True)
    assert not splits.quoted_after('a "b', False) and splits.quoted_after('x"\t"', True)


def test_written_sections_and_tsv(spark, tmp_path, small_blocks):
    rows = [(l1, l2, f"{l1} {l2} {i}\n\"x", ["a"]) for l1 in ("n", 'q"') for l2 in ("1", "p/1", "p/2", "p/2/3") for i in range(7)]
    items = spark.createDataFrame(rows, "l1 string, l2 string, text string, gold array<string>")
    for frame, name in ((items.coalesce(1), "one"), (items.repartition(5), "five"), (items.limit(0), "none")):
        writers.write_sections(frame, str(tmp_path / name))
    for name in ("one", "five"):
        got = readers.read_large_sections(spark, str(tmp_path / name)).drop("pos").collect()
        assert sorted(map(tuple, got)) == sorted(rows)
        assert readers.read_sections(spark, str(tmp_path / name), strict=False).count() == len(rows)
    assert readers.read_large_sections(spark, str(tmp_path / "none")).count() == 0
    writers.write_bcms(items.select(F.array(F.lit("sr"), F.lit("bs")).alias("codes"), "text"), str(tmp_path / "tsv"))
    assert sorted(r.text for r in readers.large_bcms_items(spark, str(tmp_path / "tsv")).collect()) == sorted(r[2] for r in rows)
