"""Readers and writers on hand-made files."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from langmill.functions import labelsets, text
from langmill.operators import contingency, hierarchy, labels, tiers
from langmill.operators.lexicon import lexicon_scorer
from langmill.plans import evaluation, inference
from langmill.sources import readers, writers

SECTIONS = {
    "news": {
        "short": [{"text": "the cat", "label": ["eng_Latn"]}, "broken", {"text": "le chat", "label": ["fra_Latn"]}],
        "deep": {"one": [{"text": "x [y]", "label": []}], "two": {"not": "a list"}, "three": [{"text": "t", "label": ["a", "b"]}]},
        "empty": [],
        "odd": 3,
    },
    "list": [1, 2],
    "text": "hello",
    "none": None,
}


@pytest.fixture
def sections_file(tmp_path):
    path = tmp_path / "set.json"
    path.write_text(json.dumps(SECTIONS, indent=1))
    return str(path)


def test_sections(spark, sections_file):
    rows = {(r.l1, r.l2, r.pos): (r.text, r.gold) for r in readers.read_sections(spark, sections_file).collect()}
    assert rows == {
        ("news", "short", 0): ("the cat", ["eng_Latn"]),
        ("news", "short", 1): ("le chat", ["fra_Latn"]),
        ("news", "deep/one", 0): ("x [y]", []),
        ("news", "deep/three", 0): ("t", ["a", "b"]),
    }


def test_section_problems(spark, sections_file):
    raw = spark.read.text(sections_file, wholetext=True)
    got = {(r.l1, r.l2, r.problem): r.n for r in readers.section_problems(raw).collect()}
    assert got == {
        ("news", "short", "instance is not an object"): 1,
        ("news", "deep/two", "level 3 is not a list"): 1,
        ("news", "odd", "level 2 is neither list nor object"): 1,
        ("list", "", "level 1 is not an object"): 1,
        ("text", "", "level 1 is not an object"): 1,
        ("none", "", "level 1 is not an object"): 1,
    }


def test_instances_at_any_depth(spark):
    raw = spark.createDataFrame([('{"a":[{"text":"1","label":["x"]}],"b":{"c":{"d":[{"text":"2","label":[]}]}}}',)], "value string")
    assert sorted((r.text, r.gold) for r in readers.instances_at_any_depth(raw).collect()) == [("1", ["x"]), ("2", [])]


def test_instances_below_eight_sections(spark):
    nested = [{"text": "deep", "label": ["x"]}]
    for level in range(8):
        nested = {f"s{level}": nested}
    raw = spark.createDataFrame([(json.dumps(nested),), ("[1]",)], "value string")
    assert [(r.text, r.gold) for r in readers.instances_at_any_depth(raw).collect()] == [("deep", ["x"])]


def test_unreadable_documents(spark, tmp_path):
    raw = spark.createDataFrame([('{"a": {"b": [',), ("[1, 2]",), ("",), ("{}",)], "value string")
    assert readers.sections(raw).count() == 0
    assert [(r.l1, r.problem, r.n) for r in readers.section_problems(raw).collect()] == [(None, "document is not a JSON object", 3)]
    (tmp_path / "broken.json").write_text('{"a": {"b": [')
    with pytest.raises(PySparkException, match="not a JSON object"):
        readers.read_sections(spark, str(tmp_path / "broken.json")).collect()
    assert readers.read_sections(spark, str(tmp_path / "broken.json"), strict=False).count() == 0


def test_prediction_line_without_tab(spark):
    raw = spark.createDataFrame([("a text",)], "value string")
    with pytest.raises(PySparkException, match="without tab: a text"):
        readers.parse_predictions(raw).collect()


def test_matrix_is_square(spark):
    from langmill.operators import confusion

    matrix = spark.createDataFrame([("a", "b", 2), ("c", "c", 1)], "gold string, pred string, n long")
    assert [tuple(r) for r in confusion.wide(matrix, ["a", "d"]).collect()] == [("a", 0, 2, 0, 0), ("b", 0, 0, 0, 0), ("c", 0, 0, 1, 0), ("d", 0, 0, 0, 0)]


def test_labelled_corpus(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = [("a", "eng_Latn", "s", 1), (None, "eng_Latn", "s", 2)]
    spark.createDataFrame(rows, readers.CORPUS_SCHEMA).write.parquet(path)
    got = readers.labelled_corpus(spark, path).collect()
    assert [(r.doc_id, r.text, r.lang, r.source) for r in got] == [(1, "a", "eng_Latn", "s")]


def test_parallel_corpus(spark, tmp_path, capsys):
    wide = spark.createDataFrame([(1, "u", "hello", "hallo", "salut")], "id int, url string, sentence_eng_Latn string, sentence_deu_Latn string, sentence_fra_Latn string")
    wide.write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    assert readers.parallel_corpus(wide).count() == 3
    some = readers.parallel_corpus(wide, ["deu_Latn", "xxx_Latn"])
    assert [(r.lang, r.text) for r in some.collect()] == [("deu_Latn", "hallo")]
    some.explain("formatted")
    assert "ReadSchema: struct<sentence_deu_Latn:string>" in capsys.readouterr().out


def test_slide_and_bcms(spark, tmp_path):
    slide = tmp_path / "s.jsonl"
    lines = [{"text": "a", "languages": ["nb", "xx", "sv"], "original": "nb"}, {"text": "b", "languages": ["nb"], "original": "fi", "id": "7"}]
    slide.write_text("\n\n".join(json.dumps(line) for line in lines) + "\n")
    got = readers.slide_items(spark, str(slide)).collect()
    assert [(r.text, r.gold, r.id) for r in got] == [("a", ["nob_Latn", "swe_Latn"], None)]
    bcms = tmp_path / "b.tsv"
    bcms.write_text('sr,hr\t"say ""hi""\tnow"\nme\tplain\n')
    got = readers.bcms_items(spark, str(bcms)).collect()
    assert [(r.gold, r.text) for r in got] == [(["srp_Cyrl", "hrv_Latn"], 'say "hi"\tnow'), (["mkd_Cyrl"], "plain")]
    bcms.write_text("sr,qq\tx\n")
    with pytest.raises(PySparkException, match="unknown label code: qq"):
        readers.bcms_items(spark, str(bcms)).collect()


def test_lines_and_trees(spark, tmp_path):
    folder = tmp_path / "in" / "sub dir"
    folder.mkdir(parents=True)
    (folder / "x-eng.txt").write_text("  the cat and the dog  \n\n \t \nle chat et la souris des champs\n")
    (folder / "skip.md").write_text("no\n")
    lines = [r.text for r in readers.text_lines(spark, str(folder / "x-eng.txt")).collect()]
    assert lines == ["the cat and the dog", "le chat et la souris des champs"]
    tree = readers.text_tree(spark, str(tmp_path / "in")).collect()
    assert {(r.dir, r.name) for r in tree} == {("sub dir", "x-eng.txt")} and len(tree) == 2
    assert readers.whole_text(spark, str(folder / "x-eng.txt")).first().text.count("\n") == 4

    out = str(tmp_path / "out")
    inference.score_tree(spark, str(tmp_path / "in"), out, lexicon_scorer())
    written = spark.read.text(out)
    assert {r.file for r in written.collect()} == {"sub dir-x-eng.txt"}
    scored = readers.prediction_tree(spark, f"{out}/*", glob="*.txt", label_code=lambda path: F.regexp_extract(path, r"x-(\w+)\.txt", 1))
    accuracy = evaluation.transfer_accuracy(scored).collect()
    assert [(r.correct, r.total) for r in accuracy] == [(1, 2)]


def test_score_file(spark, tmp_path):
    source = tmp_path / "lines.txt"
    source.write_text("the cat and the dog\nthe end\n\nle chat et la souris des champs\n12345\n")
    tables = inference.score_file(spark, str(source), str(tmp_path / "pred"), lexicon_scorer(), correct_label="eng_Latn")
    assert [(r.label, r.n) for r in tables["counts"].collect()] == [("eng_Latn", 2), ("fra_Latn", 1)]
    assert tables["accuracy"].first()[:2] == (2, 4)
    back = {r.text: r.pred for r in readers.predictions(spark, str(tmp_path / "pred")).collect()}
    assert back == {"the cat and the dog": ["eng_Latn"], "the end": ["eng_Latn"], "le chat et la souris des champs": ["fra_Latn"], "12345": []}


def test_parse_predictions_with_tab_in_text(spark):
    raw = spark.createDataFrame([("a\tb\tx,y",), ("c\t",)], "value string")
    assert [(r.text, r.pred) for r in readers.parse_predictions(raw).collect()] == [("a\tb", ["x", "y"]), ("c", [])]


def test_file_label_code(spark):
    paths = ["/a/news-2020-engX.txt", "/a/rus.pred.txt", "cs"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.c for r in df.select(labels.file_label_code(F.col("p")).alias("c")).collect()] == ["eng", "rus", "cs"]


def test_metric_rows_and_tiers(spark, tmp_path):
    source = tmp_path / "m.csv"
    source.write_text("F1,eng_Latn,0.5\nF1,kin_Latn,0.25\nF1,zzz_Latn,0.75\nF1,all,0.9\n=== Confusion matrix ===\n   eng_Latn kin_Latn\n")
    rows = readers.metric_rows(spark, str(source))
    assert rows.count() == 4
    from langmill.operators import seeds

    got = {r.tier: r.score for r in evaluation.summarise_tiers(rows, seeds.tiers(spark)).collect()}
    assert got == {5: 0.5, 1: 0.5}
    speakers = spark.createDataFrame([("eng", 30), ("kin", 10)], "iso string, speakers bigint")
    weighted = evaluation.summarise_speakers(rows, speakers)
    assert weighted.first().score == pytest.approx(0.75 * 0.5 + 0.25 * 0.25)
    writers.write_by_source(weighted, str(tmp_path / "w"))
    assert (tmp_path / "w" / "source=m.csv").exists()
    writers.write_metrics(rows, str(tmp_path / "again"))
    assert readers.metric_rows(spark, str(tmp_path / "again")).count() == 4


def test_script_weights_can_be_split(spark):
    metrics = spark.createDataFrame([("F1", "ace_Arab", 1.0), ("F1", "ace_Latn", 0.5)], "metric string, label string, score double")
    weights = spark.createDataFrame([("ace", 0.4)], "iso string, weight double")
    assert tiers.weighted_sum(metrics, weights).first().score == pytest.approx(0.6)
    assert tiers.weighted_sum(metrics, weights, split_scripts=True).first().score == pytest.approx(0.3)


def test_speaker_reports(spark, tmp_path):
    def binding(iso, n, point):
        return {"iso_code": {"value": iso}, "speakers": {"value": str(n)}, "point": {"value": point}}

    bindings = [binding("eng", 1, "2001-01-01"), binding("eng", 2, "2011-01-01"), binding("eng", 3, "2011-01-01"), binding("yue", 9, "1999-01-01")]
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"head": {}, "results": {"bindings": bindings}}, indent=1))
    latest = tiers.latest_speakers(readers.speaker_reports(spark, str(path)))
    assert {r.iso: r.speakers for r in latest.collect()} == {"eng": 2, "yue": 9}
    languages = spark.createDataFrame([("eng", "Q1"), ("ekk", ""), ("zul", "Q9")], "iso string, entity string")
    counts = spark.createDataFrame([("Q1", 5)], "entity string, speakers bigint")
    assert {r.iso: r.speakers for r in tiers.speakers_by_entity(languages, counts).collect()} == {"eng": 5, "ekk": 0, "zul": 0}


def test_report_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 0, ["x"], ["x"])], "l1 string, l2 string, pos int, pred array<string>, gold array<string>")
    writers.write_report(hierarchy.report(df), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3
    writers.write_instances(df, str(tmp_path / "instances"))
    assert spark.read.parquet(str(tmp_path / "instances")).columns == ["l1", "l2", "pos", "pred", "gold"]
    from langmill.operators import confusion

    writers.write_confusion(confusion.confusion_of_sets(df), ["x", "y"], str(tmp_path / "matrix"))
    assert spark.read.csv(str(tmp_path / "matrix"), header=True).first().asDict() == {"gold": "x", "x": "1", "y": "0"}


def test_evaluation_runs(spark):
    scorer = lexicon_scorer({"eng_Latn": "the", "fra_Latn": "le"})
    texts = spark.createDataFrame([("eng_Latn", "the the"), ("fra_Latn", "le the"), ("fra_Latn", "zzz")], "lang string, text string")
    tables = evaluation.evaluate_languages(texts, scorer, 0.4, classes=["eng_Latn", "fra_Latn"])
    got = {(r.metric, r.label): r.score for r in tables["metrics"].collect()}
    assert got[("Recall", "fra_Latn")] == 0.5 and got[("Precision", "eng_Latn")] == 0.5
    assert {(r.gold, r.pred): r.n for r in tables["confusion"].collect()} == {("eng_Latn", "eng_Latn"): 1, ("fra_Latn", "fra_Latn"): 1}
    items = spark.createDataFrame([("the", ["nob_Latn"]), ("le", ["swe_Latn", "dan_Latn"])], "text string, gold array<string>")
    nordic = lexicon_scorer({"nob_Latn": "the", "swe_Latn": "le"})
    result = evaluation.evaluate_set(items, nordic, evaluation.SCANDINAVIAN)
    assert result["accuracies"].first().asDict() == {"n_items": 2, "loose_accuracy": 1.0, "exact_accuracy": 0.5}
    assert {r.label: r.F1 for r in result["f1"].collect()} == {"nob_Latn": 1.0, "nno_Latn": 0.0, "swe_Latn": 1.0, "dan_Latn": 0.0}
    sectioned = texts.select(F.lit("a").alias("l1"), F.col("lang").alias("l2"), F.lit(0).alias("pos"), "text", F.array("lang").alias("gold"))
    tables = evaluation.evaluate_sections(sectioned, scorer, 0.4)
    assert tables["report"].count() == 4 and tables["instances"].count() == 3


def test_text_functions(spark):
    df = spark.createDataFrame([("\x1c  A  \n b　",)], "t string")
    row = df.select(text.strip(F.col("t")).alias("s"), text.normalise(F.col("t")).alias("n"), text.preview(F.lit("x" * 101)).alias("p")).first()
    assert row.s == "A  \n b" and row.n == " a b　" and row.p == "x" * 100 + "..."
    df = spark.createDataFrame([("Żółć Čau Straße œuvre",), ("Привет Ελλάδα",), ("中 ok",)], "t string")
    kept = [r.x for r in df.select(text.transliterate(F.col("t")).alias("x")).collect()]
    assert kept == ["Zolc Cau Strasse oeuvre", "Privet Ellada", "中 ok"]
    assert df.select(text.transliterate(F.col("t"), "drop").alias("x")).collect()[2].x == " ok"
    assert spark.range(1).select(labelsets.iso_code(F.lit("eng_Latn")).alias("x")).first().x == "eng"


def test_counts_of_empty_input(spark):
    empty = spark.createDataFrame([], "pred array<string>, gold array<string>")
    assert contingency.contingency(empty).count() == 0


def test_transliterate_alphabets(spark):
    spelled = {
        "שלום עולם": "shlvm `vlm", "مرحبا، ٣": "mrhba, 3", "پنج گل": "pnj gl", "नमस्ते १": "nmste 1", "বাংলা": "baanlaa", "தமிழ்": "tmilll",
        "한국어 값": "hangugeo gabs", "ひらがな カタカナー": "hiragana katakana-", "漢字 ok": "漢字 ok", "𝔸 кот": "𝔸 kot", "": "", "a b": "a b",
    }
    df = spark.createDataFrame([(k, v) for k, v in spelled.items()], "t string, want string")
    rows = df.select("t", "want", text.transliterate(F.col("t")).alias("x"), text.transliterate(F.col("t"), "drop").alias("dropped")).collect()
    assert [(r.t, r.x) for r in rows] == [(r.t, r.want) for r in rows] and all(r.dropped.isascii() for r in rows)
