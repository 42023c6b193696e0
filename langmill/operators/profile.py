"""Length profile of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmill.operators import sampling

LIMITS = (1024, 512, 256)
BIN_WIDTH = 100
LAST_EDGE = 2100


def length_profile(corpus: DataFrame, id_col: str = "doc_id", text: str = "text", step: int = 1, seed=0) -> DataFrame:
    """Longest text and, per limit, how many are strictly longer, scaled to a share of all rows."""
    total = corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    sampled = sampling.systematic_sample(corpus.select(id_col, text), id_col, step, seed)
    length = F.length(text)
    profiled = sampled.where(F.col(text).isNotNull() & (F.col(text) != "")).agg(
        F.count(F.lit(1)).alias("n_texts"), F.max(length).alias("longest"),
        *[F.count_if(length > limit).alias(f"over_{limit}") for limit in LIMITS],
    )
    shares = [
        F.try_divide(F.col(f"over_{limit}") * F.lit(step) * F.lit(100.0), total).alias(f"percent_over_{limit}")
        for limit in LIMITS
    ]
    return profiled.select("*", *shares)


def length_histogram(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Bins of width 100 from 0 to 2100 with empty bins kept; the last bin includes its upper edge."""
    n_bins = LAST_EDGE // BIN_WIDTH
    length = F.length(text)
    present = corpus.where(F.col(text).isNotNull() & (F.col(text) != "") & (length <= LAST_EDGE))
    bin_no = F.least(F.floor(length / F.lit(BIN_WIDTH)), F.lit(n_bins - 1)).cast("int")
    counts = present.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = corpus.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.col("bin") * BIN_WIDTH).alias("low"), ((F.col("bin") + 1) * BIN_WIDTH).alias("high"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )
