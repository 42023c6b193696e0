"""Summaries of metric tables by language tier and by number of speakers.

All tables here have a row per label or language, so joins are left to the planner, which broadcasts
by measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from langmill.functions import labelsets


def without_mean_row(metrics: DataFrame) -> DataFrame:
    """The ``all`` row is a mean, not a language, and must not enter another mean."""
    return metrics.where(F.col("label") != "all")


def with_tier(metrics: DataFrame, tiers: DataFrame, default: int = 1) -> DataFrame:
    """Tier of each label's language; languages outside the table get ``default``."""
    keyed = metrics.withColumn("iso", labelsets.iso_code(F.col("label")))
    return (
        keyed.join(tiers.select("iso", "tier"), "iso", "left")
        .withColumn("tier", F.coalesce("tier", F.lit(default)))
        .drop("iso")
    )


def average_by_tier(metrics: DataFrame, tiers: DataFrame, keys: list[str] | None = None, default: int = 1) -> DataFrame:
    """Mean score per metric and tier; a tier without labels has no row."""
    tiered = with_tier(without_mean_row(metrics), tiers, default)
    return tiered.groupBy(*(keys or []), "metric", "tier").agg(F.avg("score").alias("score"))


def speakers_by_entity(languages: DataFrame, counts: DataFrame) -> DataFrame:
    """(iso, speakers) for every language; a blank entity or no reported count gives 0.

    ``languages`` is (iso, entity), ``counts`` is (entity, speakers). Both are bounded by the
    number of languages.
    """
    known = counts.select("entity", "speakers")
    joined = languages.join(known, "entity", "left")
    return joined.select("iso", F.coalesce(F.col("speakers").cast("bigint"), F.lit(0).cast("bigint")).alias("speakers"))


def latest_speakers(reports: DataFrame) -> DataFrame:
    """Count of the newest report per language; the first of equally new reports wins.

    ``reports`` is (seq, iso, speakers, point). ``max_by`` combines on the map side, so a
    language with very many reports needs no sort in one task.
    """
    order = F.struct(F.col("point"), -F.col("seq"))
    return reports.groupBy("iso").agg(F.max_by("speakers", order).alias("speakers"))


def describe_languages(latest: DataFrame, names: DataFrame, tiers: DataFrame) -> DataFrame:
    """Attach name and tier; an unknown language is ``Unknown`` in tier 0."""
    return (
        latest.join(names.select("iso", "name"), "iso", "left")
        .join(tiers.select("iso", "tier"), "iso", "left")
        .select("iso", F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce("tier", F.lit(0)).alias("tier"), "speakers")
    )


def speaker_weights(speakers: DataFrame) -> DataFrame:
    """Share of all speakers per language; the total is a scalar subquery, not a window."""
    total = speakers.agg(F.sum("speakers").alias("total")).scalar()
    return speakers.select("iso", F.try_divide(F.col("speakers"), total).alias("weight"))


def weighted_sum(metrics: DataFrame, weights: DataFrame, keys: list[str] | None = None, split_scripts: bool = False) -> DataFrame:
    """Speaker-weighted sum per metric; a language without speakers weighs 0.

    Weights are not renormalised. A language written in two scripts uses its weight for each,
    unless ``split_scripts`` divides it among its labels.
    """
    keys = keys or []
    keyed = without_mean_row(metrics).withColumn("iso", labelsets.iso_code(F.col("label")))
    joined = keyed.join(weights.select("iso", "weight"), "iso", "left")
    weight = F.coalesce("weight", F.lit(0.0))
    if split_scripts:
        weight = weight / F.count(F.lit(1)).over(Window.partitionBy(*keys, "metric", "iso"))
    product = joined.withColumn("_w", F.col("score") * weight)
    return product.groupBy(*keys, "metric").agg(F.sum("_w").alias("score"))
