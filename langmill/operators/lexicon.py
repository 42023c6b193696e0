"""A word-list scorer: the simplest plug-in that turns texts into scored labels.

It stands in for an external detector wherever results have to be repeatable in another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langmill.functions import scores as score_fn
from langmill.functions.binding import let

# Function words per label, chosen for this library; some words are shared between languages.
FUNCTION_WORDS = {
    "deu_Latn": "der die und den zu von das mit sich auf des ist nicht ein en in",
    "eng_Latn": "the of and to a in is that it for was on with be",
    "fra_Latn": "de la le et les des un une que qui pour dans en",
    "spa_Latn": "de la que el en los se del las por un una",
}
SEPARATOR = r"[^\p{L}]+"  # anything but letters of any script


def _count_in(words: Column, listed: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(listed)))


def lexicon_scores(text: Column, lexicon: dict[str, str] | None = None) -> Column:
    """Share of each label's words among all lexicon hits; zeros when there is none."""
    lexicon = dict(sorted((lexicon or FUNCTION_WORDS).items()))

    def count_hits(words: Column) -> Column:
        return F.array(*[_count_in(words, listed.split()).cast("double") for listed in lexicon.values()])

    shares = let(let(F.split(F.lower(text), SEPARATOR), count_hits), score_fn.normalise)
    names = F.array(*[F.lit(label) for label in lexicon])
    return F.zip_with(names, shares, lambda label, score: F.struct(label.alias("label"), score.alias("score")))


def lexicon_scorer(lexicon: dict[str, str] | None = None, text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """Scorer plug-in: adds the column ``scores``."""
    return lambda df: df.withColumn("scores", lexicon_scores(F.col(text), lexicon))
