"""Readers. Every schema is declared, so no file is scanned for inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmill.functions import labelsets, text as text_fn
from langmill.operators import labels as label_ops, seeds
from langmill.session import stage
from langmill.sources import splits

CORPUS_SCHEMA = "text string, language string, source string, __index_level_0__ bigint"
SLIDE_SCHEMA = "text string, languages array<string>, original string, id string"
INSTANCE_SCHEMA = "text string, label array<string>"
METRIC_SCHEMA = "metric string, label string, score double"
SPEAKER_SCHEMA = (
    "results struct<bindings: array<struct<iso_code: struct<value: string>, speakers: struct<value: string>, "
    "point: struct<value: string>>>>"
)
SENTENCE_PREFIX = "sentence_"  # fixed value


def labelled_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, lang, source) of the rows that have a text."""
    raw = spark.read.schema(CORPUS_SCHEMA).parquet(path)
    return raw.where(F.col("text").isNotNull()).select(
        F.col("__index_level_0__").alias("doc_id"), "text", F.col("language").alias("lang"), "source"
    )


def parallel_corpus(wide: DataFrame, known_languages: list[str] | None = None, prefix: str = SENTENCE_PREFIX) -> DataFrame:
    """(lang, text) from one column per language. Unwanted columns are dropped before the unpivot, so
    they are not even read."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    if known_languages:
        columns = [c for c in columns if c[len(prefix):] in known_languages]
    long = wide.select(*columns).unpivot([], columns, "_column", "text")
    return long.select(F.substring(F.col("_column"), F.lit(len(prefix) + 1), F.length("_column")).alias("lang"), "text")


def slide_items(spark: SparkSession, path: str, codes: dict[str, str] = seeds.SLIDE_CODES) -> DataFrame:
    """JSON lines; items whose original language is known, their known codes mapped to labels."""
    raw = spark.read.schema(SLIDE_SCHEMA).json(path)
    kept = raw.where(F.col("original").isin(list(codes)))
    return kept.select("id", "text", "original", labelsets.map_known(F.col("languages"), codes).alias("gold"))


def bcms_items(spark: SparkSession, path: str, codes: dict[str, str] = seeds.BCMS_CODES) -> DataFrame:
    """Tab-separated file without header: comma-joined codes, text. An unknown code is an error."""
    raw = spark.read.csv(
        path, schema="codes string, text string", sep="\t", quote='"', escape='"', multiLine=True,
        maxCharsPerColumn=-1, header=False,
    )
    return raw.select(labelsets.map_all(F.split("codes", ","), codes).alias("gold"), "text")


def large_bcms_items(spark: SparkSession, path: str, codes: dict[str, str] = seeds.BCMS_CODES) -> DataFrame:
    """Rows of ``bcms_items`` from files that are read by many tasks each, line breaks within quotes included."""
    options = {"sep": "\t", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    row = F.from_csv("value", "codes string, text string", options)
    raw = splits.tsv_records(spark, path).select(row.alias("row")).select("row.codes", "row.text")
    return raw.select(labelsets.map_all(F.split("codes", ","), codes).alias("gold"), "text")


# --- sectioned sets --------------------------------------------------------------------------

def _is_object(node):
    return F.coalesce(F.ltrim(node).startswith("{"), F.lit(False))


def _is_list(node):
    return F.coalesce(F.ltrim(node).startswith("["), F.lit(False))


def _children(node):
    return F.from_json(node, "map<string,string>")


def _document(value):
    """Sections of a whole document, or null if it is cut off or no object."""
    return F.when(_is_object(value), _children(value))


def section_nodes(raw: DataFrame, value: str = "value") -> DataFrame:
    """(l1, l2, node, problem) of JSON documents with two or three levels of sections.

    Levels are opened one at a time and keep their content as JSON text, because one schema cannot
    describe both depths. Three-level keys are joined as ``l2/l3``. ``problem`` tells why a node was
    skipped and is null for instance lists.
    """
    opened = raw.select(_document(F.col(value)).alias("_sections"))
    # What is no section keeps one row with null keys to carry its problem.
    first = opened.select(F.col("_sections").isNull().alias("unreadable"), F.explode_outer("_sections").alias("l1", "n1"))
    second = first.select("unreadable", "l1", "n1", F.explode_outer(F.when(_is_object(F.col("n1")), _children(F.col("n1")))).alias("l2", "n2"))
    third = second.select(
        "unreadable", "l1", "l2", "n1", "n2",
        F.explode_outer(F.when(_is_object(F.col("n2")), _children(F.col("n2")))).alias("l3", "n3"),
    )
    node = F.when(F.col("l3").isNotNull(), F.col("n3")).otherwise(F.col("n2"))
    problem = (
        F.when(F.col("unreadable"), "document is not a JSON object")
        .when(F.col("l1").isNotNull() & ~_is_object(F.col("n1")), "level 1 is not an object")
        .when(F.col("l3").isNotNull() & ~_is_list(F.col("n3")), "level 3 is not a list")
        .when(F.col("l3").isNull() & F.col("l2").isNotNull() & ~_is_list(F.col("n2")) & ~_is_object(F.col("n2")), "level 2 is neither list nor object")
    )
    return third.select("l1", F.concat_ws("/", "l2", "l3").alias("l2"), node.alias("node"), problem.alias("problem"))


def sections(raw: DataFrame, value: str = "value") -> DataFrame:
    """(l1, l2, pos, text, gold); ``pos`` counts the well-formed instances of a section."""
    lists = section_nodes(raw, value).where(F.col("problem").isNull() & _is_list(F.col("node")))
    instances = F.filter(F.from_json("node", "array<string>"), _is_object)
    items = lists.select("l1", "l2", F.posexplode(instances).alias("pos", "instance"))
    parsed = items.withColumn("instance", F.from_json("instance", INSTANCE_SCHEMA))
    return parsed.select("l1", "l2", "pos", F.col("instance.text").alias("text"), F.col("instance.label").alias("gold"))


def section_problems(raw: DataFrame, value: str = "value") -> DataFrame:
    """(l1, l2, problem, n): what ``sections`` left out."""
    nodes = section_nodes(raw, value)
    skipped = nodes.where(F.col("problem").isNotNull()).select("l1", "l2", "problem")
    lists = nodes.where(F.col("problem").isNull() & _is_list(F.col("node")))
    elements = lists.select("l1", "l2", F.explode(F.from_json("node", "array<string>")).alias("e"))
    malformed = elements.where(~_is_object(F.col("e"))).select("l1", "l2", F.lit("instance is not an object").alias("problem"))
    return skipped.unionByName(malformed).groupBy("l1", "l2", "problem").agg(F.count(F.lit(1)).alias("n"))


def read_sections(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Sectioned JSON files. A file is one JSON document and one row; many files are read in parallel.

    An unreadable file is an error; without ``strict`` it has no items and ``section_problems`` counts it.
    """
    raw = spark.read.text(path, wholetext=True)
    if strict:
        error = F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("_metadata.file_path")))
        raw = raw.select(F.when(_document(F.col("value")).isNull(), error).otherwise(F.col("value")).alias("value"))
    return sections(raw)


def read_large_sections(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rows of ``read_sections`` from documents of any size: a document is read by many tasks.

    Sections of other depths than two and three are left out, as there. Brackets and strings are checked, commas are not.
    """
    found = splits.json_instances(spark, path, strict).where(F.size("keys").between(2, 3))
    parsed = found.withColumn("instance", F.from_json("value", INSTANCE_SCHEMA))
    l2 = F.array_join(F.slice("keys", 2, 2), "/")
    return parsed.select(
        F.get("keys", F.lit(0)).alias("l1"), l2.alias("l2"), F.col("pos").cast("int").alias("pos"),
        F.col("instance.text").alias("text"), F.col("instance.label").alias("gold"),
    )


def large_instances_at_any_depth(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rows of ``instances_at_any_depth`` from documents of any size, in three scans whatever the depth."""
    found = splits.json_instances(spark, path, strict).where(F.size("keys") > 0)
    parsed = found.select(F.from_json("value", INSTANCE_SCHEMA).alias("i"))
    return parsed.select(F.col("i.text").alias("text"), F.col("i.label").alias("gold"))


def instances_at_any_depth(raw: DataFrame, value: str = "value") -> DataFrame:
    """(text, gold) of all instances, whatever the nesting of their sections.

    Levels are opened and staged one at a time until no section holds another.
    """
    level, found = raw.select(F.col(value).alias("node")), None
    while True:
        opened = level.where(_is_object(F.col("node"))).select(F.explode(_children(F.col("node"))).alias("key", "node"))
        level = stage(opened.select("node"), "nested")
        lists = level.where(_is_list(F.col("node"))).select(F.explode(F.from_json("node", "array<string>")).alias("e"))
        found = lists if found is None else found.unionAll(lists)
        if level.where(_is_object(F.col("node"))).isEmpty():
            break
    parsed = found.where(_is_object(F.col("e"))).select(F.from_json("e", INSTANCE_SCHEMA).alias("i"))
    return parsed.select(F.col("i.text").alias("text"), F.col("i.label").alias("gold"))


# --- lines, files, results -------------------------------------------------------------------

def clean_lines(raw: DataFrame, value: str = "value") -> DataFrame:
    """Stripped lines without the blank ones; works on batch and streaming frames."""
    return raw.withColumn("text", text_fn.strip(F.col(value))).where(F.col("text") != "").drop(value)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return clean_lines(spark.read.text(path))


def text_tree(spark: SparkSession, path: str, glob: str = "*.txt", blocks: bool = False) -> DataFrame:
    """(file, dir, name, text) for the lines of all matching files below ``path``; ``blocks`` adds where the block of a line starts."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    block = [F.col("_metadata.file_block_start").alias("block")] if blocks else []
    located = raw.select("value", F.url_decode(F.col("_metadata.file_path")).alias("file"), *block)
    parts = F.split("file", "/")
    return clean_lines(located).select(
        "file", F.element_at(parts, -2).alias("dir"), F.element_at(parts, -1).alias("name"), "text", *["block"] * blocks
    )


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): each file is one text."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def parse_predictions(raw: DataFrame, value: str = "value") -> DataFrame:
    """Columns ``text`` and ``pred`` from lines ``text<TAB>label,label``.

    The split is at the last tab, since texts may contain tabs; a blank label field is an empty set. A line
    without tab is an error.
    """
    pattern = r"(?s)^(.*)\t([^\t]*)$"
    error = F.raise_error(F.concat(F.lit("prediction line without tab: "), F.substring(F.col(value), 1, 100)))
    line = F.when(F.contains(F.col(value), F.lit("\t")), F.col(value)).otherwise(error)
    fields = text_fn.strip(F.regexp_extract(line, pattern, 2))
    pred = F.when(fields == "", F.array().cast("array<string>")).otherwise(F.split(fields, ","))
    return raw.withColumn("text", text_fn.strip(F.regexp_extract(line, pattern, 1))).withColumn("pred", pred).drop(value)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return parse_predictions(spark.read.text(path))


def prediction_tree(spark: SparkSession, path: str, code_map: DataFrame | None = None, label_code=label_ops.file_label_code, glob: str = "*.txt") -> DataFrame:
    """(file, text, pred, gold_label) where the gold label comes from the file name.

    ``label_code`` is a function of the path column.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    located = raw.select("value", F.url_decode(F.col("_metadata.file_path")).alias("file"))
    coded = parse_predictions(located).withColumn("code", label_code(F.col("file")))
    mapped = label_ops.map_codes(coded, code_map if code_map is not None else seeds.code_map(spark), label="gold_label")
    return mapped.select("file", "text", "pred", "gold_label")


def metric_rows(spark: SparkSession, path: str) -> DataFrame:
    """(source, metric, label, score); lines that are no metric row are skipped."""
    raw = spark.read.schema(METRIC_SCHEMA).csv(path)
    tagged = raw.select(F.col("_metadata.file_name").alias("source"), "metric", "label", "score")
    return tagged.where(F.col("score").isNotNull())


def speaker_reports(spark: SparkSession, path: str) -> DataFrame:
    """(seq, iso, speakers, point) from saved query results in SPARQL JSON."""
    raw = spark.read.schema(SPEAKER_SCHEMA).json(path, multiLine=True)
    rows = raw.select(F.posexplode("results.bindings").alias("seq", "b"))
    return rows.select(
        "seq", F.col("b.iso_code.value").alias("iso"), F.col("b.speakers.value").cast("bigint").alias("speakers"),
        F.col("b.point.value").alias("point"),
    )
