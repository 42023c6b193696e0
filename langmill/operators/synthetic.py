"""Synthetic rows: mixed-language, transliterated and random texts.

Row ``i`` of ``m`` belongs to one of nine equal slots: four mixed, four transliterated, one random.
Every choice is a hash draw on ``i``, so the rows are the same whenever and wherever they are made.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from langmill.functions import draws, labelsets, text as text_fn
from langmill.operators import sampling

SLOTS = 9  # fixed value
MIXED_SLOTS = 4  # fixed value
TRANSLITERATED_SLOTS = 4  # fixed value


def plan_rows(spark: SparkSession, m: int) -> DataFrame:
    """(row_no, kind) for ``m`` synthetic rows."""
    slot = F.floor(F.col("id") * SLOTS / F.lit(max(m, 1)))
    kind = (
        F.when(slot < MIXED_SLOTS, "mixed")
        .when(slot < MIXED_SLOTS + TRANSLITERATED_SLOTS, "transliterated")
        .otherwise("random")
    )
    return spark.range(m).select(F.col("id").alias("row_no"), kind.alias("kind"))


def _drawn_rows(wanted: DataFrame, corpus: DataFrame, id_col: str, text: str, lang: str, n: int, seed) -> DataFrame:
    """Attach a random corpus row to each (row_no, part). Ids are matched first, texts travel once.

    The join with the texts is kept a shuffle join: its partitions are then sized by the texts, which
    cost the work that follows, and not by the far smaller ids.
    """
    index = sampling.dense_index(corpus, id_col, seed)
    pick = F.floor(draws.uniform(seed, F.lit("row"), F.col("row_no"), F.col("part")) * F.lit(n)).cast("bigint")
    picked = wanted.withColumn("row_idx", pick).join(index, "row_idx").drop("row_idx")
    texts = corpus.select(id_col, F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    return picked.join(texts.hint("merge"), id_col)


def fragment(words: Column, seed, *keys: Column) -> Column:
    """Random run of words when there are more than three: at least half of them, never all."""
    n = F.size(words)
    size = draws.integer(F.greatest(F.lit(1), F.floor(n / 2)), n - 1, seed, F.lit("size"), *keys).cast("int")
    start = draws.integer(F.lit(0), n - size, seed, F.lit("start"), *keys).cast("int")
    return F.when(n > 3, F.slice(words, start + 1, size)).otherwise(words)


def mixed(corpus: DataFrame, rows: DataFrame, n: int, seed, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fragments of two random rows in sequence, labelled with both languages."""
    wanted = rows.select("row_no", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"))
    drawn = _drawn_rows(wanted, corpus, id_col, text, lang, n, seed)
    words = drawn.select("row_no", "part", F.col("_lang"), text_fn.words(F.col("_text")).alias("_words"))
    pieces = words.select(
        "row_no", F.struct("part", fragment(F.col("_words"), seed, F.col("row_no"), F.col("part")).alias("words"), F.col("_lang").alias("lang")).alias("piece")
    )
    # Exactly two pieces per row number.
    both = pieces.groupBy("row_no").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    p = F.col("p")
    return both.select(
        "row_no",
        F.array_join(F.flatten(F.transform(p, lambda x: x["words"])), " ").alias("text"),
        labelsets.union(F.array(p[0]["lang"]), F.array(p[1]["lang"])).alias("gold"),
    )


def transliterated(corpus: DataFrame, rows: DataFrame, n: int, seed, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A random row spelled in ASCII, with its own label."""
    drawn = _drawn_rows(rows.select("row_no", F.lit(0).alias("part")), corpus, id_col, text, lang, n, seed)
    return drawn.select("row_no", text_fn.transliterate(F.col("_text")).alias("text"), F.array("_lang").alias("gold"))


def _pick_char(alphabet: str, seed, *keys: Column) -> Column:
    position = draws.integer(F.lit(1), F.lit(len(alphabet)), seed, *keys).cast("int")
    return F.substr(F.lit(alphabet), position, F.lit(1))


def _pick_chars(alphabet: str, count: Column, seed, *keys: Column) -> Column:
    chars = F.transform(F.sequence(F.lit(1), count.cast("int")), lambda i: _pick_char(alphabet, seed, *keys, i))
    return F.array_join(chars, "")


def random_number(seed, *keys: Column) -> Column:
    """One to five digits."""
    count = draws.integer(F.lit(1), F.lit(5), seed, F.lit("digits"), *keys)
    return _pick_chars(string.digits, count, seed, F.lit("digit"), *keys)


def random_word(seed, *keys: Column) -> Column:
    """Two to seven lower-case letters; one in ten ends in punctuation, one in ten is title case."""
    count = draws.integer(F.lit(2), F.lit(7), seed, F.lit("letters"), *keys)
    letters = _pick_chars(string.ascii_lowercase, count, seed, F.lit("letter"), *keys)
    tail = F.when(
        draws.uniform(seed, F.lit("punct?"), *keys) < 0.1, _pick_char(string.punctuation, seed, F.lit("punct"), *keys)
    ).otherwise("")
    word = F.concat(letters, tail)
    return F.when(draws.uniform(seed, F.lit("title?"), *keys) < 0.1, text_fn.title_case(word)).otherwise(word)


def random_text(row: Column, seed) -> Column:
    """One to ten words or, one time in twenty, numbers; half of the texts start in title case."""
    count = draws.integer(F.lit(1), F.lit(10), seed, F.lit("words"), row).cast("int")

    def item(i: Column) -> Column:
        is_number = draws.uniform(seed, F.lit("number?"), row, i) < 0.05
        token = F.when(is_number, random_number(seed, row, i)).otherwise(random_word(seed, row, i))
        capital = (i == 1) & (draws.uniform(seed, F.lit("first?"), row) < 0.5)
        return F.when(capital, text_fn.title_case(token)).otherwise(token)

    return F.array_join(F.transform(F.sequence(F.lit(1), count), item), " ")


def random_rows(rows: DataFrame, seed) -> DataFrame:
    """Random texts that belong to no language."""
    return rows.select(
        "row_no", random_text(F.col("row_no"), seed).alias("text"), F.array().cast("array<string>").alias("gold")
    )


def synthetic_rows(corpus: DataFrame, proportion: float, seed, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(row_no, kind, text, gold) for ``int(proportion * n)`` synthetic rows."""
    n = corpus.count()
    planned = plan_rows(corpus.sparkSession, int(proportion * n))

    def of(kind: str) -> DataFrame:
        return planned.where(F.col("kind") == kind)

    parts = {
        "mixed": mixed(corpus, of("mixed"), n, seed, id_col, text, lang),
        "transliterated": transliterated(corpus, of("transliterated"), n, seed, id_col, text, lang),
        "random": random_rows(of("random"), seed),
    }
    tagged = [df.select("row_no", F.lit(kind).alias("kind"), "text", "gold") for kind, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def extended_corpus(corpus: DataFrame, proportion: float, seed, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Real rows followed by synthetic ones: (row_id, kind, text, gold)."""
    real = corpus.select(
        F.concat(F.lit("r"), F.col(id_col)).alias("row_id"), F.lit("real").alias("kind"),
        F.col(text).alias("text"), F.array(lang).alias("gold"),
    )
    made = synthetic_rows(corpus, proportion, seed, id_col, text, lang)
    return real.unionByName(made.select(F.concat(F.lit("s"), F.col("row_no")).alias("row_id"), "kind", "text", "gold"))
