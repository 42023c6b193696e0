"""Runnable queries over the driver tables, one or more per operator.

Each query is a function (spark, table folder) -> DataFrame over whole tables. Ratios are rounded
to six places, because sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from langmill.functions import draws, labelsets, ratios, scores as score_fn, text as text_fn
from langmill.operators import (
    byte_rules, byte_tokens, classifier, confusion, contingency, hierarchy, labels as label_ops, ngrams, profile, sampling, scoring,
    similarity, synthetic, tiers as tier_ops,
)
from langmill.operators.lexicon import lexicon_scorer
from langmill.operators.seeds import BCMS_CODES, label_map, tiers as tier_table
from langmill.session import checkpoint, inline_table, spread, stage, staging_path
from langmill.sources import readers, writers
from langmill.streaming import lines as stream_lines

Query = Callable[[SparkSession, str], DataFrame]

# Codes of the driver tables and the labels they stand for.
LANGUAGES = {"de": "deu_Latn", "en": "eng_Latn", "es": "spa_Latn", "fr": "fra_Latn"}
LABELS = sorted(LANGUAGES.values())
THRESHOLD = 0.3
SEED = 42


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


KEYS = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"]}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows, *KEYS[name]) if name in KEYS else rows


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text, lang, source) with ``lang`` as canonical label."""
    label = labelsets.literal_map(LANGUAGES)[F.col("lang")]
    rows = table(spark, folder, "documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", "text", label.alias("lang"), "source")


def predicted(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scoring.predict(df, lexicon_scorer(), threshold).drop("text")


def single_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, gold, pred) with one label per text, or null when no listed word occurs."""
    top = score_fn.best(score_fn.above(F.col("scores"), 0.0))["label"]
    return lexicon_scorer()(documents(spark, folder)).select("doc_id", F.col("lang").alias("gold"), top.alias("pred"))


def set_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, gold, pred): every text with its language as gold set."""
    return predicted(documents(spark, folder)).withColumn("gold", labelsets.as_set(F.col("lang")))


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """As ``set_predictions`` with gold sets of none, one or two labels.

    Rejected texts (quality 0) have no gold label; marked ones (toxic 1) also count as German.
    """
    marks = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    rows = set_predictions(spark, folder).join(marks, "doc_id", "left")
    extra = F.when(F.col("toxic") == 1, F.array(F.lit("deu_Latn"))).otherwise(F.array().cast("array<string>"))
    gold = F.when(F.col("quality") == 0, F.array().cast("array<string>")).otherwise(labelsets.union(F.col("gold"), extra))
    return rows.withColumn("gold", gold)


def class_table(spark: SparkSession) -> DataFrame:
    """All classes of a model, including two that never occur in the tables."""
    return inline_table(spark, "label string", [(label,) for label in [*LABELS, "ces_Latn", "rus_Cyrl"]])


# --- evaluation ------------------------------------------------------------------------------

def per_label_prf(spark, folder):
    metrics = contingency.long_metrics(contingency.contingency(set_predictions(spark, folder)))
    return metrics.select("metric", "label", r6("score").alias("score"))


def fpr_by_label(spark, folder):
    rates = confusion.rates(confusion.confusion(single_predictions(spark, folder)))
    fpr = ratios.false_positive_rate(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return rates.select("label", "tp", "fp", "fn", "tn", r6(fpr).alias("fpr"))


def micro_macro(spark, folder):
    summary = contingency.micro_macro(contingency.contingency(judged(spark, folder)), class_table(spark))
    return summary.select(*[r6(c).alias(c) for c in summary.columns if c != "hamming_loss"])


def hamming(spark, folder):
    summary = contingency.micro_macro(contingency.contingency(judged(spark, folder)), class_table(spark))
    return summary.select(r6("hamming_loss").alias("hamming_loss"))


def fixed_label_f1(spark, folder):
    """F1 over a fixed list of labels, of which one never occurs."""
    classes = inline_table(spark, "label string", [(label,) for label in (*LABELS, "dan_Latn")])
    return contingency.f1_of(contingency.contingency(judged(spark, folder)), classes).select("label", r6("F1").alias("f1"))


def _accuracy(name: str) -> Query:
    def query(spark, folder):
        rows = contingency.accuracies(judged(spark, folder), ["source"])
        return rows.select("source", "n_items", r6(name).alias("accuracy"))

    return query


def membership_accuracy(spark, folder):
    """Pages by the language their markup declares, against the label of that code."""
    pages = table(spark, folder, "pages").select("page_id", F.col("html").alias("text"))
    coded = pages.withColumn("code", F.regexp_extract("text", '<html lang="([a-z]+)"', 1))
    known = inline_table(spark, "code string, label string", list(LANGUAGES.items()))
    labelled = label_ops.map_codes(predicted(coded), known, label="gold_label")
    rows = contingency.membership_accuracy(labelled, F.col("gold_label"), ["code"])
    return rows.select("code", "correct", "total", r6("accuracy").alias("accuracy"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as a sectioned set (l1 = role, l2 = turn).

    The gold set of a turn is what the first turn of its conversation scores at least one half in: empty
    without a first turn, the set that sorts first if there are several.
    """
    raw = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    scored = lexicon_scorer()(raw).drop("text")
    first = scored.where(F.col("turn") == 0).groupBy("conv_id").agg(
        F.min(score_fn.labels(score_fn.at_least(F.col("scores"), 0.5))).alias("gold")
    )
    kept = score_fn.by_confidence(score_fn.above(F.col("scores"), THRESHOLD))
    items = scored.select(
        "conv_id", F.col("role").alias("l1"), F.col("turn").cast("string").alias("l2"), F.col("conv_id").alias("pos"),
        score_fn.labels(kept).alias("pred"),
    )
    return items.join(first, "conv_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))


def hierarchy_rollup(spark, folder):
    counts = hierarchy.rollup_counts(turns(spark, folder))
    accuracy = hierarchy.section_accuracies(counts).select(
        "level", "l1", "l2", F.lit("*").alias("label"), F.col("n_items").cast("double").alias("a"),
        r6("loose_accuracy").alias("b"), r6("exact_accuracy").alias("c"),
    )
    per_label = hierarchy.section_scores(counts).select(
        "level", "l1", "l2", "label", r6("f1").alias("a"), r6("precision").alias("b"), r6("recall").alias("c")
    )
    return accuracy.unionByName(per_label)


def section_report(spark, folder):
    rows = hierarchy.report(turns(spark, folder))
    joined = F.array_join(F.transform("scores", lambda s: s["label"]), ",")
    return rows.select("section", "n_items", "loose_accuracy", "exact_accuracy", joined.alias("labels"))


def instance_dump(spark, folder):
    return turns(spark, folder).select(
        "l1", "l2", "pos", F.array_join("pred", ",").alias("pred"), F.array_join("gold", ",").alias("gold")
    )


def nested_sections(spark, folder):
    """Each turn as a sectioned JSON document (odd conversations two levels deep, even ones three), read back.

    The instances of a section are the lines of the turn; every document also has a malformed section.
    """
    raw = table(spark, folder, "conversations")
    instances = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("text"), F.array(F.lit("eng_Latn")).alias("label")))
    by_turn = F.create_map(F.col("turn").cast("string"), instances)
    flat = F.to_json(F.create_map("role", by_turn))
    deep = F.to_json(F.create_map("role", F.create_map(F.lit("part"), by_turn)))
    document = F.concat(F.lit('{"malformed":1,'), F.substr(F.when(F.col("conv_id") % 2 == 1, flat).otherwise(deep), F.lit(2)))
    items = readers.sections(raw.select(document.alias("value")))
    return items.groupBy("l1", "l2").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"), F.sum("pos").cast("bigint").alias("pos_sum"),
        F.sum(F.size("gold")).alias("n_labels"),
    )


def large_sections(spark, folder):
    """Turns as sectioned JSON documents, one per task (odd conversations two levels deep, even ones three), read back in blocks."""
    raw = table(spark, folder, "conversations")
    turn = F.col("turn").cast("string")
    items = raw.select(
        F.col("role").alias("l1"), F.when(F.col("conv_id") % 2 == 1, turn).otherwise(F.concat(F.lit("part/"), turn)).alias("l2"),
        "text", F.array(F.lit("eng_Latn")).alias("gold"),
    )
    path = staging_path(spark, "large-sections")
    writers.write_sections(items, path)
    back = readers.read_large_sections(spark, path)
    return back.groupBy("l1", "l2", F.md5(F.encode("text", "UTF-8")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("gold")).alias("n_labels"))


def quoted_tsv(spark, folder):
    """Documents as TSV with line breaks in quoted fields, read back in blocks: how often each text has each label."""
    rows = table(spark, folder, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select(F.array("lang").alias("codes"), "text")
    path = staging_path(spark, "quoted-tsv")
    writers.write_bcms(rows, path)
    back = readers.large_bcms_items(spark, path, LANGUAGES)
    return back.groupBy(F.array_join("gold", ",").alias("gold"), F.md5(F.encode("text", "UTF-8")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


def confusion_long(spark, folder):
    return confusion.confusion(single_predictions(spark, folder))


def single_accuracy(spark, folder):
    return contingency.single_accuracy(single_predictions(spark, folder)).select(r6("accuracy").alias("accuracy"))


def confusion_multilabel(spark, folder):
    """Square matrix over the seen labels and one that never occurs."""
    return confusion.wide(confusion.confusion_of_sets(set_predictions(spark, folder)), [*LABELS, "rus_Cyrl"])


def classification_report(spark, folder):
    single = single_predictions(spark, folder).select(
        labelsets.as_set(F.col("gold")).alias("gold"), labelsets.as_set(F.col("pred")).alias("pred")
    )
    rows = confusion.classification_report(contingency.contingency(single))
    return rows.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


def language_counts_topn(spark, folder):
    return contingency.most_common(contingency.label_frequency(set_predictions(spark, folder)), 3)


def joined_scores(scores: Column) -> Column:
    parts = F.transform(scores, lambda s: F.concat(s["label"], F.lit(":"), F.round(s["score"] * 1000000).cast("bigint").cast("string")))
    return F.array_join(parts, ",")


def topk_scores(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    rows = lexicon_scorer()(docs).withColumn("_d", score_fn.decision(F.col("scores")))
    return rows.select(
        "doc_id", text_fn.preview(F.col("text")).alias("preview"), F.col("_d.prediction").alias("prediction"),
        r6("_d.confidence").alias("confidence"), r6(F.col("_d.all_probabilities")["fra_Latn"]).alias("p_french"),
        joined_scores(score_fn.top_k(F.col("scores"), 3)).alias("top3"),
        joined_scores(score_fn.above(F.col("scores"), 0.25)).alias("above"),
        joined_scores(score_fn.at_least(F.col("scores"), 0.25)).alias("at_least"),
    )


def masked_bce(spark, folder):
    """Loss of centroid logits on vectors, over the gold class and five sampled negatives."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    centroids = class_vectors(spark, folder)
    logits = similarity_logits(vectors, centroids)
    items = logits.withColumn("gold", F.array("label"))
    sims = similarity.class_similarity(centroids)
    sampled = similarity.negative_samples(items, sims, class_ids(centroids), "vec_id", SEED)
    loss = similarity.masked_loss(sampled)
    return loss.select("n_terms", F.round("loss", 5).alias("loss"))


def class_ids(centroids: DataFrame) -> list[str]:
    """The labels of the vector table in order, one row per class."""
    return [row["label"] for row in label_ops.fit_classes(centroids).orderBy("class_idx").collect()]


def class_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(label, vector): mean vector per label, summed per dimension with map-side combine."""
    rows = table(spark, folder, "embeddings").select(F.col("label").cast("string").alias("label"), F.posexplode("embedding").alias("dim", "x"))
    means = rows.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return checkpoint(means.groupBy("label").agg(F.transform(ordered, lambda e: e["x"]).alias("vector")))


def similarity_logits(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    matrix = centroids.agg(F.array_sort(F.collect_list(F.struct("label", "vector")))).scalar()
    logits = F.transform(
        "_matrix", lambda c: F.struct(c["label"].alias("label"), score_fn.dot(F.col("embedding"), c["vector"]).alias("logit"))
    )
    return vectors.withColumn("_matrix", matrix).withColumn("logits", logits).drop("embedding", "_matrix")


def positive_logits(spark, folder):
    """Sigmoid and softmax of centroid logits, and the labels with a positive logit."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    rows = similarity_logits(vectors, class_vectors(spark, folder))
    logits = F.transform("logits", lambda e: e["logit"])
    return rows.select(
        "vec_id", F.size(score_fn.positive_logits(F.col("logits"))).cast("bigint").alias("n_positive"),
        F.round(F.array_max(F.transform(logits, score_fn.sigmoid)), 5).alias("top_sigmoid"),
        F.round(F.array_max(score_fn.softmax(logits)), 5).alias("top_softmax"),
    )


# --- tiers and speakers ----------------------------------------------------------------------

# Labels of four tiers stand in for the four languages of the tables.
TIER_LABELS = {"deu_Latn": "nld_Latn", "eng_Latn": "eng_Latn", "fra_Latn": "kin_Latn", "spa_Latn": "glg_Latn"}


def tier_metrics(spark: SparkSession, folder: str) -> DataFrame:
    metrics = contingency.long_metrics(contingency.contingency(set_predictions(spark, folder), ["source"]), keys=["source"])
    renamed = labelsets.literal_map({**TIER_LABELS, "all": "all"})[F.col("label")]
    return metrics.withColumn("label", renamed)


def tier_average(spark, folder):
    rows = tier_ops.average_by_tier(tier_metrics(spark, folder), tier_table(spark), ["source"])
    return rows.select("source", "metric", F.col("tier").cast("bigint").alias("tier"), r6("score").alias("score"))


def speaker_weighted(spark, folder):
    """Weights by the number of characters per language, with one language left out."""
    iso = labelsets.iso_code(labelsets.literal_map(TIER_LABELS)[F.col("lang")])
    volume = documents(spark, folder).groupBy(iso.alias("iso")).agg(F.sum(F.length("text")).alias("speakers"))
    languages = volume.select("iso", F.when(F.col("iso") == "kin", F.lit("")).otherwise(F.col("iso")).alias("entity"))
    speakers = tier_ops.speakers_by_entity(languages, volume.select(F.col("iso").alias("entity"), "speakers"))
    rows = tier_ops.weighted_sum(tier_metrics(spark, folder), tier_ops.speaker_weights(speakers), ["source"])
    return rows.select("source", "metric", r6("score").alias("score"))


def latest_speakers(spark, folder):
    """Documents as reports: the newest (by source name) report per language, the first of equals.

    The languages are of tiers 4, 5 and 1; the fourth is left out of the tier table.
    """
    labels = {code: TIER_LABELS[label] for code, label in LANGUAGES.items()}
    reports = table(spark, folder, "documents").select(
        F.col("doc_id").alias("seq"), labelsets.iso_code(labelsets.literal_map(labels)[F.col("lang")]).alias("iso"),
        F.col("n_chars").alias("speakers"), F.col("source").alias("point"),
    )
    names = inline_table(spark, "iso string, name string", [("eng", "English"), ("kin", "Kinyarwanda")])
    known = tier_table(spark).where(F.col("iso") != "glg")
    rows = tier_ops.describe_languages(tier_ops.latest_speakers(reports), names, known)
    return rows.select("iso", "name", F.col("tier").cast("bigint").alias("tier"), "speakers")


# --- labels ----------------------------------------------------------------------------------

def label_canonicalise(spark, folder):
    """Raw labels of two detectors, one that prefixes labels and one with codes of its own."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    prefixed = F.concat(F.lit("__label__"), F.col("lang"), F.lit("_"), F.col("source"))
    raw = F.when(F.col("source") < "src2", F.concat(F.lit("__label__"), labelsets.literal_map(LANGUAGES)[F.col("lang")])).otherwise(prefixed)
    rows = docs.select("doc_id", raw.alias("prefixed"), F.lit("gcld3").alias("detector"), F.when(F.col("source") == "src9", "co").otherwise(F.col("lang")).alias("raw"))
    mapped = label_ops.map_detector_labels(rows, label_map(spark))
    return mapped.groupBy(label_ops.canonicalise(F.col("prefixed")).alias("canonical"), "raw", "label").agg(F.count(F.lit(1)).alias("n"))


def label_arrays(spark, folder):
    """Codes of words mapped inside arrays: known codes only, and class positions of the mapped labels."""
    docs = table(spark, folder, "documents").where(F.col("lang").isin("en", "es"))
    codes = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) == 2))
    mapping = {"is": "isl_Latn", **BCMS_CODES, "be": "bel_Cyrl", "es": "spa_Latn", "el": "ell_Grek"}
    rows = docs.select("doc_id", F.array_sort(labelsets.map_known(codes, mapping)).alias("gold"))
    classes = label_ops.fit_classes(rows.select(F.explode("gold").alias("label")))
    return label_ops.encode_label_sets(rows, classes, "doc_id").select("doc_id", F.col("class_idx").cast("bigint").alias("class_idx"))


def class_index(spark, folder):
    docs = documents(spark, folder)
    classes = label_ops.fit_classes(docs, "lang")
    encoded = label_ops.encode_labels(docs.select("doc_id", "lang"), classes)
    hot = labelsets.multi_hot(F.array("lang"), LABELS)
    return encoded.select("doc_id", F.col("class_idx").cast("bigint").alias("class_idx"), F.array_join(hot, "").alias("multi_hot"))


def unpivot_parallel(spark, folder):
    """Texts as a wide table with one column per language, three of them known."""
    docs = documents(spark, folder)
    columns = [F.when(F.col("lang") == label, F.col("text")).alias(readers.SENTENCE_PREFIX + label) for label in LABELS]
    long = readers.parallel_corpus(docs.select("doc_id", *columns), [label for label in LABELS if label != "spa_Latn"])
    return long.where(F.col("text").isNotNull()).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("text")).alias("n_chars")
    )


# --- corpus ----------------------------------------------------------------------------------

def _profile(step: int) -> Query:
    def query(spark, folder):
        rows = profile.length_profile(table(spark, folder, "documents"), step=step, seed=SEED)
        exact = [c for c in rows.columns if not c.startswith("percent")]
        return rows.select(*[F.col(c).cast("bigint").alias(c) for c in exact], *[r6(c).alias(c) for c in rows.columns if c not in exact])

    return query


def length_histogram(spark, folder):
    rows = profile.length_histogram(table(spark, folder, "documents"))
    return rows.select(*[F.col(c).cast("bigint").alias(c) for c in rows.columns])


def cap_per_language(spark, folder):
    capped = sampling.cap_per_group(table(spark, folder, "documents").select("doc_id", "text", "lang"), "lang", "doc_id", 120, SEED)
    return capped.select("doc_id", "lang", F.md5("text").alias("text_md5"))


def train_eval_split(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sampling.split_corpus(docs, "doc_id", 0.05, SEED)


def train_without_eval(spark, folder):
    """Training rows as the corpus minus the rows of a separate evaluation table."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sampling.without_rows(docs, table(spark, folder, "labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def texts_by_language(spark, folder):
    rows = sampling.by_language(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    return rows.select("doc_id", "lang", "n_texts")


def dense_index(spark, folder):
    return sampling.dense_index(table(spark, folder, "documents"), "doc_id", SEED)


def line_predictions(spark, folder):
    """Lines of all texts, stripped and without blanks, scored and written as prediction lines; read back and counted."""
    raw = table(spark, folder, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    scored = predicted_lines(readers.clean_lines(raw))
    back = readers.parse_predictions(writers.prediction_lines(scored))
    return back.groupBy(F.array_join("pred", ",").alias("pred")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars")
    )


def named_predictions(spark, folder):
    """Lines of all texts as a tree of files by language, scored into one file of predictions per input file and read back.

    ``n_unnamed`` counts the lines in files whose name no input file asks for.
    """
    rows = table(spark, folder, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    tree, out = staging_path(spark, "line-tree"), staging_path(spark, "named-predictions")
    rows.select("lang", F.explode(F.split("text", "\n")).alias("value")).write.partitionBy("lang").text(tree)
    lines = readers.text_tree(spark, tree, blocks=True)
    writers.write_named_predictions(predicted_lines(lines), out)
    file = F.url_decode(F.col("_metadata.file_path"))
    raw = spark.read.text(out).select("value", F.regexp_replace(F.substring_index(file, "/", -1), r"\.part-\d+$", "").alias("name"))
    back = readers.parse_predictions(raw).groupBy("name", F.array_join("pred", ",").alias("pred")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    inputs = spark.read.text(tree).select(F.element_at(F.split(F.url_decode(F.col("_metadata.file_path")), "/"), -1).alias("part"), "lang").distinct()
    known = inputs.select(F.concat(F.lit("lang="), "lang", F.lit("-"), "part").alias("name"), F.lit(True).alias("known"))
    lang = F.regexp_extract("name", "^lang=(.*?)-part-", 1)
    return back.join(known, "name", "left").groupBy(lang.alias("lang"), "pred").agg(
        F.sum("n").alias("n_lines"), F.sum("chars").alias("n_chars"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("n_unnamed"))


def predicted_lines(df: DataFrame) -> DataFrame:
    return scoring.predict(df, lexicon_scorer(), THRESHOLD)


# Letters of other alphabets that are spelled like the Latin letters in their place, the first of each like two.
ALPHABETS = {
    "hebrew": ("ts", "צ", "bglmnrs", "בגלמנרס"), "arabic": ("sh", "ش", "bfkmnrl", "بفكمنرل"), "devanagari": ("th", "थ", "bgmnrst", "बगमनरसत"),
    "kana": ("na", "な", "aeiou", "あエいオう"), "hangul": ("na", "나", "", ""),
}


def spelled_alphabets(spark, folder):
    """Documents with some letters written in one of five alphabets, by their id, spelled in ASCII again."""
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text")
    written = F.col("text")
    for i, (two, letter, latin, other) in enumerate(ALPHABETS.values()):
        text = F.translate(F.replace("text", F.lit(two), F.lit(letter)), latin, other)
        written = F.when(F.col("doc_id") % len(ALPHABETS) == i, text).otherwise(written)
    spelled = rows.select("doc_id", text_fn.transliterate(written).alias("spelled"))
    return spelled.select("doc_id", F.md5(F.encode("spelled", "UTF-8")).alias("digest"), F.length("spelled").cast("long").alias("n_chars"))


def _synthetic_part(kind: str) -> Query:
    def query(spark, folder):
        docs = documents(spark, folder).select("doc_id", "text", "lang")
        n = docs.count()
        planned = synthetic.plan_rows(spark, n).where(F.col("kind") == kind)
        if kind == "random":
            rows = synthetic.random_rows(planned, SEED)
        else:
            rows = getattr(synthetic, kind)(docs, planned, n, SEED)
        return rows.select("row_no", "text", F.array_join("gold", ",").alias("gold"))

    return query


def extended_corpus(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    rows = synthetic.extended_corpus(docs, 0.5, SEED)
    return rows.groupBy("kind", F.size("gold").cast("bigint").alias("n_labels")).agg(F.count(F.lit(1)).alias("n"))


# --- features and models ---------------------------------------------------------------------

def ngram_df(spark, folder):
    return ngrams.vocabulary(table(spark, folder, "documents")).select("ngram", "df")


def tfidf_weights(spark, folder):
    _, weights = ngrams.fit_tfidf(table(spark, folder, "documents"))
    return weights.select("doc_id", "ngram", r6("weight").alias("weight"))


def class_similarity(spark, folder):
    """Centroid similarity; two classes are unknown to the first source and use the second."""
    features = class_vectors(spark, folder)
    partial = features.withColumn("vector", F.when(~F.col("label").isin("3", "7"), F.col("vector")))
    backup = features.withColumn("vector", F.slice("vector", 1, 16))
    rows = similarity.class_similarity(partial, backup)
    return rows.select("label_a", "label_b", F.round("sim", 5).alias("sim"))


def negative_samples(spark, folder):
    """Negatives for texts whose gold set has no, one or two of the ten classes."""
    classes = labelsets.literal_map({label: str(i) for i, label in enumerate(LABELS)})
    items = judged(spark, folder).select("doc_id", F.transform("gold", lambda g: classes[g]).alias("gold"))
    centroids = class_vectors(spark, folder)
    sims = similarity.class_similarity(centroids)
    rows = similarity.negative_samples(items, sims, class_ids(centroids), "doc_id", SEED, ratio=2.0)
    return rows.select("doc_id", F.array_join(F.array_sort("negatives"), ",").alias("negatives"))


def ovr_scores(spark, folder):
    """Multiclass model: fitted on the training part, prediction and confidence for each held-out text."""
    docs = documents(spark, folder).withColumn("gold", labelsets.as_set(F.col("lang")))
    scored = _fitted(spark, docs, multilabel=False)
    top = score_fn.best(F.col("scores"))
    return scored.select(
        "doc_id", "lang", top["label"].alias("prediction"), F.round(top["score"], 3).alias("confidence"),
        F.array_join("pred", ",").alias("pred"),
    )


def ovr_multilabel(spark, folder):
    """Multilabel model: every second text, by hash, is followed by the next document, and has the labels of both."""
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    follower = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("more"), F.col("lang").alias("other"))
    paired = docs.join(follower, "doc_id", "left").withColumn("_two", (F.xxhash64("doc_id") % 2 == 0) & F.col("more").isNotNull())
    own = labelsets.as_set(F.col("lang"))
    mixed = paired.select(
        "doc_id", F.when(F.col("_two"), F.concat_ws(" ", "text", "more")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_two"), labelsets.union(own, labelsets.as_set(F.col("other")))).otherwise(own).alias("gold"),
    )
    scored = _fitted(spark, mixed, multilabel=True)
    return scored.select(
        "doc_id", F.array_join(F.array_sort("gold"), ",").alias("gold"), F.array_join("pred", ",").alias("pred"),
        F.round(score_fn.best(F.col("scores"))["score"], 3).alias("confidence"),
    )


def _fitted(spark: SparkSession, docs: DataFrame, multilabel: bool) -> DataFrame:
    """Split, fit, save, load, and predict the held-out rows."""
    split = stage(sampling.split_corpus(docs, "doc_id", 0.2, SEED), "split")
    model = classifier.fit(split.where("split = 'train'").drop("split"), multilabel, seed=SEED)
    path = staging_path(spark, "model")
    model.save(path)
    loaded = classifier.NgramClassifier.load(spark, path)
    return loaded.predict(split.where("split = 'eval'").drop("split"))


def _share_of_spaces() -> Callable[[list[str]], list]:
    """A model that fails, with its whole batch, on texts whose length is a multiple of 20."""

    def predict(texts: list[str]) -> list:
        wrong = [len(t) for t in texts if len(t) % 20 == 0]
        if wrong:
            raise ValueError(f"cannot read {wrong[0]} characters")
        shares = [t.count(" ") / len(t) for t in texts]
        return [[("spaces", share), ("others", 1.0 - share)] for share in shares]

    return predict


def failing_scorer(spark, folder):
    """Texts scored by a plug-in that raises on some: only those fail, each with its own message."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = scoring.predict(docs, scoring.external_scorer(_share_of_spaces, errors="error"), 0.15)
    return scored.select("doc_id", "failed", "error", F.array_join("pred", ",").alias("pred"))


# --- tokens ----------------------------------------------------------------------------------

def byte_token_corpus(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = byte_tokens.tokenise(docs)
    return rows.select(
        "doc_id", F.size("input_ids").cast("bigint").alias("n_ids"), F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
        (F.length(F.encode("text", "utf-8")) + 1).cast("bigint").alias("n_bytes_and_end"),
    )


def pad_truncate(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = byte_tokens.tokenise(docs, max_length=512)
    return rows.select(
        "doc_id", F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
        F.aggregate("attention_mask", F.lit(0), lambda acc, x: acc + x).cast("bigint").alias("n_real"),
        F.size("input_ids").cast("bigint").alias("n_ids"),
    )


# Rules for the letters of the tables: accents become a marker byte and a letter, frequent endings one byte.
DECOMPOSE = {"c3 a9": "01 65", "c3 a8": "02 65", "c3 bc": "03 75", "c3 a4": "03 61", "c3 b6": "03 6f", "c3 9f": "04 73"}
MERGE = {"74 68": "05", "74 68 65": "06", "65 6e": "07", "01 65": "08", "73 63 68": "0b"}


def rule_table(spark: SparkSession, rules: dict[str, str]) -> DataFrame:
    return inline_table(spark, byte_rules.RULES, [(i, *rule) for i, rule in enumerate(rules.items())])


def byte_rewrite(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rules = rule_table(spark, DECOMPOSE), rule_table(spark, MERGE)
    rows = byte_rules.decode(byte_rules.encode(docs, "text", *rules), "bytes", *rules)
    return rows.select(
        "doc_id", F.octet_length("bytes").cast("bigint").alias("n_tokens"), F.md5(F.lower(F.hex("bytes"))).alias("tokens_md5"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


# --- streaming -------------------------------------------------------------------------------

def stream_scores(spark, folder):
    """Documents arriving as files, scored by a streaming query that ends when all are read."""
    stream = stream_lines.table_stream(spark, folder, "documents.parquet").where(F.col("text").isNotNull())
    scored = stream_lines.scored(stream.select("doc_id", "text"), lexicon_scorer(), THRESHOLD).drop("text")
    path = staging_path(spark, "stream-out")
    stream_lines.write_scored(scored, path, available_now=True).awaitTermination()
    return spark.read.parquet(path).select("doc_id", F.array_join("pred", ",").alias("pred"))


def stream_counts(spark, folder):
    stream = stream_lines.table_stream(spark, folder, "documents.parquet").where(F.col("text").isNotNull())
    scored = stream_lines.scored(stream.select("doc_id", "text"), lexicon_scorer(), THRESHOLD)
    path = staging_path(spark, "stream-counts")
    stream_lines.publish_counts(scored, path, available_now=True).awaitTermination()
    return stream_lines.read_counts(spark, path)


QUERIES: dict[str, Query] = {
    "per_label_prf": per_label_prf,
    "fpr_by_label": fpr_by_label,
    "micro_macro": micro_macro,
    "hamming": hamming,
    "fixed_label_f1": fixed_label_f1,
    "masked_bce": masked_bce,
    "positive_logits": positive_logits,
    "loose_overlap": _accuracy("loose_overlap"),
    "loose_overlap_strict": _accuracy("loose_overlap_strict"),
    "loose_subset": _accuracy("loose_subset"),
    "exact_set": _accuracy("exact_set"),
    "exact_ordered": _accuracy("exact_ordered"),
    "membership_accuracy": membership_accuracy,
    "hierarchy_rollup": hierarchy_rollup,
    "section_report": section_report,
    "instance_dump": instance_dump,
    "nested_sections": nested_sections,
    "large_sections": large_sections,
    "quoted_tsv": quoted_tsv,
    "confusion_long": confusion_long,
    "single_accuracy": single_accuracy,
    "confusion_multilabel": confusion_multilabel,
    "classification_report": classification_report,
    "language_counts_topn": language_counts_topn,
    "topk_scores": topk_scores,
    "tier_average": tier_average,
    "speaker_weighted": speaker_weighted,
    "latest_speakers": latest_speakers,
    "label_canonicalise": label_canonicalise,
    "label_arrays": label_arrays,
    "class_index": class_index,
    "unpivot_parallel": unpivot_parallel,
    "length_profile": _profile(1),
    "systematic_profile": _profile(100),
    "length_histogram": length_histogram,
    "cap_per_language": cap_per_language,
    "train_eval_split": train_eval_split,
    "train_without_eval": train_without_eval,
    "texts_by_language": texts_by_language,
    "dense_index": dense_index,
    "line_predictions": line_predictions,
    "named_predictions": named_predictions,
    "ngram_df": ngram_df,
    "tfidf_weights": tfidf_weights,
    "synthetic_random": _synthetic_part("random"),
    "synthetic_mixed": _synthetic_part("mixed"),
    "synthetic_transliterated": _synthetic_part("transliterated"),
    "spelled_alphabets": spelled_alphabets,
    "extended_corpus": extended_corpus,
    "class_similarity": class_similarity,
    "negative_samples": negative_samples,
    "byte_token_corpus": byte_token_corpus,
    "pad_truncate": pad_truncate,
    "byte_rewrite": byte_rewrite,
    "failing_scorer": failing_scorer,
    "ovr_scores": ovr_scores,
    "ovr_multilabel": ovr_multilabel,
    "stream_scores": stream_scores,
    "stream_counts": stream_counts,
}
