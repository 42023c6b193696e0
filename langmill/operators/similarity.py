"""Similarity of classes, and negative samples that avoid similar classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langmill.functions import draws, scores
from langmill.session import checkpoint

BLOCK = 512  # classes per block of the pairwise product


def _min_max_rows(pairs: DataFrame, value: str) -> DataFrame:
    """Scale each row of the matrix to 0..1; a constant row becomes 0. A row holds one value per class."""
    row = Window.partitionBy("label_a")
    low, high = F.min(value).over(row), F.max(value).over(row)
    scaled = F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0))
    return pairs.withColumn(value, scaled)


def pairwise_dot(features: DataFrame, name: str = "sim") -> DataFrame:
    """(label_a, label_b, dot product) for all pairs of classes of (label, vector).

    The matrix is the result, so its size is given; the work is cut into blocks of at most about
    ``BLOCK`` classes and every class meets every block through an equi-join on the block number.
    """
    n_blocks = max(1, -(-features.count() // BLOCK))
    block = F.pmod(F.xxhash64("label"), F.lit(n_blocks)).cast("int")
    blocks = features.groupBy(block.alias("_block")).agg(
        F.collect_list(F.struct(F.col("label").alias("label"), F.col("vector").alias("vector"))).alias("_members")
    )
    left = features.select(
        F.col("label").alias("label_a"), F.col("vector").alias("_va"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block"),
    )
    products = F.transform(
        "_members", lambda m: F.struct(m["label"].alias("label_b"), scores.dot(F.col("_va"), m["vector"]).alias(name))
    )
    return left.join(blocks, "_block").select("label_a", F.inline(products))


def class_similarity(features: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(label_a, label_b, sim): row-scaled dot products, with a second source where the first is missing.

    ``features`` and ``fallback`` are (label, vector). A null vector means the class is unknown
    to the first source: it takes part as a zero vector, and pairs with such a class use the fallback.
    """
    features = checkpoint(features)  # one row per class, read by both sides of the product
    width = features.where(F.col("vector").isNotNull()).agg(F.max(F.size("vector")).alias("w")).scalar()
    filled = features.select(
        "label", F.coalesce("vector", F.array_repeat(F.lit(0.0), width.cast("int"))).alias("vector")
    )
    first = _min_max_rows(pairwise_dot(filled), "sim")
    if fallback is None:
        return first
    known = features.select("label", F.col("vector").isNotNull().alias("known"))
    second = _min_max_rows(pairwise_dot(checkpoint(fallback), "backup"), "backup")
    a = known.select(F.col("label").alias("label_a"), F.col("known").alias("_ka"))
    b = known.select(F.col("label").alias("label_b"), F.col("known").alias("_kb"))
    joined = first.join(second, ["label_a", "label_b"], "left").join(a, "label_a").join(b, "label_b")
    return joined.select(
        "label_a", "label_b", F.when(F.col("_ka") & F.col("_kb"), F.col("sim")).otherwise(F.col("backup")).alias("sim")
    )


def _similarity_rows(similarity: DataFrame, classes: list[str]) -> Column:
    """The matrix as one map label -> similarities in class order, evaluated once as a scalar subquery."""
    rows = similarity.groupBy("label_a").agg(F.map_from_entries(F.collect_list(F.struct("label_b", "sim"))).alias("m"))
    order = F.array(*[F.lit(c) for c in classes])
    aligned = rows.select(
        F.struct(F.col("label_a").alias("k"), F.transform(order, lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0))).alias("v")).alias("e")
    )
    return aligned.agg(F.map_from_entries(F.collect_list("e")).alias("rows")).scalar()


def mean_similarity(items: DataFrame, similarity: DataFrame, classes: list[str], gold: str = "gold") -> DataFrame:
    """Column ``mean_sim``: mean similarity of an item's labels to every class, in class order.

    The class matrix is a constant of the plan, so items are neither joined nor shuffled. An item
    without labels gets zeros.
    """
    matrix = _similarity_rows(similarity, classes)
    zeros = F.array_repeat(F.lit(0.0), len(classes))
    positives = F.array_sort(F.array_intersect(F.col(gold), F.array(*[F.lit(c) for c in classes])))
    rows = F.transform("_positives", lambda g: F.coalesce(F.try_element_at(F.col("_matrix"), g), zeros))
    total = F.aggregate(rows, zeros, lambda acc, row: F.zip_with(acc, row, lambda x, y: x + y))
    counted = (
        items.withColumn("_positives", positives).withColumn("_n", F.greatest(F.size("_positives"), F.lit(1)))
        .withColumn("_matrix", matrix)
    )
    return counted.withColumn("mean_sim", F.transform(total, lambda x: x / F.col("_n"))).drop("_positives", "_n", "_matrix")


def negative_samples(
    items: DataFrame, similarity: DataFrame, classes: list[str], id_col: str, seed,
    gold: str = "gold", ratio: float = 5.0,
) -> DataFrame:
    """Column ``negatives``: labels drawn without replacement, unlike classes more often.

    ``floor(max(positives, 1) * ratio)`` labels are drawn with weight 1 - mean similarity, or
    evenly when all weights are 0: the smallest exponential keys ``-ln(u) / weight`` win. All of it
    happens inside the row, because a row has no more candidates than there are classes.
    """
    order = F.array(*[F.lit(c) for c in classes])
    with_mean = mean_similarity(items, similarity, classes, gold)
    candidates = F.filter(
        F.zip_with(order, F.col("mean_sim"), lambda c, s: F.struct(c.alias("label"), (F.lit(1.0) - s).alias("w"))),
        lambda e: ~F.coalesce(F.array_contains(F.col(gold), e["label"]), F.lit(False)),
    )
    weight_sum = F.aggregate(F.col("_cand"), F.lit(0.0), lambda acc, e: acc + e["w"])
    keyed = F.transform(
        "_cand",
        lambda e: F.struct(
            F.try_divide(
                -F.log(draws.uniform(seed, F.col(id_col), e["label"])),
                F.when(F.col("_total") == 0, F.lit(1.0)).otherwise(e["w"]),
            ).alias("key"),
            e["label"].alias("label"),
        ),
    )
    # A class with weight 0 (null key) is drawn only after all others.
    ranked = F.array_sort(F.transform(keyed, lambda e: F.struct(F.coalesce(e["key"], F.lit(float("inf"))).alias("key"), e["label"].alias("label"))))
    n_positive = F.size(F.array_intersect(F.col(gold), order))
    quota = F.floor(F.greatest(n_positive, F.lit(1)) * F.lit(ratio)).cast("int")
    return (
        with_mean.withColumn("_cand", candidates).withColumn("_total", weight_sum)
        .withColumn("negatives", F.transform(F.slice(ranked, F.lit(1), quota), lambda e: e["label"]))
        .drop("_cand", "_total", "mean_sim")
    )


def masked_loss(logits: DataFrame, gold: str = "gold", negatives: str = "negatives", column: str = "logits") -> DataFrame:
    """Mean binary cross-entropy over each item's positives and sampled negatives.

    ``logits`` has an ``array<struct<label,logit>>`` per item; entries outside both sets are masked.
    """
    kept = F.filter(
        F.col(column),
        lambda e: F.coalesce(F.array_contains(F.col(gold), e["label"]), F.lit(False))
        | F.coalesce(F.array_contains(F.col(negatives), e["label"]), F.lit(False)),
    )
    rows = logits.select(F.col(gold).alias("_g"), F.explode(kept).alias("_e"))
    target = F.coalesce(F.array_contains("_g", F.col("_e.label")), F.lit(False)).cast("double")
    loss = scores.binary_cross_entropy(F.col("_e.logit"), target)
    return rows.agg(F.sum(loss).alias("loss_sum"), F.count(F.lit(1)).alias("n_terms")).withColumn(
        "loss", F.try_divide("loss_sum", "n_terms")
    )
