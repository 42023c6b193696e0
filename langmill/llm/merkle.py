"""Merkle manifest of a dataset: a hash for every row, a root for every source and for the whole, a proof for every row.

The leaves of a source are put in order by range partitions and cut into aligned blocks of ``FAN ** DEPTH``
leaves. A block keeps each level of its tree as one string of concatenated hex digests: parents are the
hashes of its substrings of ``FAN`` digests, and the siblings of a node are what flanks it in its substring.
The roots of the blocks are the leaves of the next round, so a source of any size needs a few rounds, and no
task holds more than one block. The roots of the sources form one more tree of the same kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langmill.llm.table import ROW, keyed, pick, spread_small, staged, tasks

FAN = 3  # fixed value
DEPTH = 6
BLOCK = FAN**DEPTH
_DIGITS = 64  # of a digest in hex

#: Sibling digests to the left and to the right of a node, from the leaf up to the root.
PATH = "array<struct<l:binary,r:binary>>"


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 over the fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def proof_hash(path: Column) -> Column:
    """SHA-256 over all siblings of a path, level by level, left to right."""
    flat = F.aggregate(path, F.lit("").cast("binary"), lambda acc, s: F.concat(acc, s["l"], s["r"]))
    return F.sha2(flat, 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    up = F.aggregate(path, F.encode(leaf, "UTF-8"), lambda acc, s: _digest(F.concat(s["l"], acc, s["r"])))
    return up.cast("string")


def manifest(docs: DataFrame, fields: list[str], *, id_col: str = "doc_id", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """``id``, the ``carry`` columns, ``leaf``, ``subroot``, ``root`` and ``path`` (see ``PATH``) of every row.

    Leaves of a source ascend by id (null first, then by leaf; equal leaves are interchangeable, so repeated rows
    and ids each keep a leaf of their own). Sources ascend bytewise, null first. A null field is hashed as such,
    an empty one as an empty value; texts of any length are hashed whole. An empty table gives no rows.
    """
    carry = carry or []
    names = {f"f{i}": name for i, name in enumerate(fields)} | {f"x{i}": name for i, name in enumerate(carry)}
    rows = pick(docs, id=id_col, source=source_col, **names)
    # The prefix keeps the order of sources and puts null, the empty string here, before all of them.
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = spread_small(rows).select(
        group.alias("g"), "id", leaf_hash(*[F.col(f"f{i}") for i in range(len(fields))]).alias("hash"), *[f"x{i}" for i in range(len(carry))],
    )
    # Staged before they are put in order, because range partitions read their input twice.
    leaves = positions(keyed(leaves, "merkle"), ["g"], ["id", "hash", ROW], "leaves").drop(ROW)
    rounds = _grow(leaves, "source")
    if not rounds:
        kinds = [f"{name} {leaves.schema[f'x{i}'].dataType.simpleString()}" for i, name in enumerate(carry)]
        schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *kinds, f"leaf string, subroot string, root string, path {PATH}"])
        return docs.sparkSession.createDataFrame([], schema)
    # Trees over the sources: their leaves are the subroots.
    tops = _roots(rounds[-1]).withColumnRenamed("g", "of")
    whole = _grow(positions(tops.withColumn("g", F.lit("")), ["g"], ["of"], "subroots"), "sources")
    root = _roots(whole[-1]).select(F.col("hash").alias("root"))
    above = _down(whole, whole[-1].select("g", "block", F.array().cast(PATH).alias("above")))
    # One row in ``root``: a scalar subquery, not a join.
    start = above.select(F.col("item.of").alias("g"), F.lit(0).cast("long").alias("block"), F.col("path").alias("above"),
                         F.struct(F.col("item.hash").alias("subroot"), root.scalar().alias("root")).alias("tops"))
    found = _down(rounds, start)
    return found.select(
        F.col("item.id").alias("id"), *[F.col(f"item.x{i}").alias(name) for i, name in enumerate(carry)],
        F.col("item.hash").alias("leaf"), F.col("tops.subroot").alias("subroot"), F.col("tops.root").alias("root"), "path",
    )


def positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``pos``, the place of a row in its group in the given order, and ``total``, the rows of its group.

    Rows are dealt to key ranges and written with the number of their range. Only the counts of the ranges are put in
    order for each group, so a group of any size is numbered by many tasks.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    ranged = staged(df.repartitionByRange(tasks(df), *keys).withColumn("_range", F.spark_partition_id()), f"merkle-{name}")
    sums = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    inside = Window.partitionBy(*group, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = ranged.withColumn("_in", F.row_number().over(inside))
    return numbered.join(sums, [*group, "_range"]).withColumn("pos", F.col("_before") + F.col("_in") - 1).drop("_range", "_in", "_before")


def _digest(value: Column) -> Column:
    return F.encode(F.sha2(value, 256), "UTF-8")


def _part(level: Column, first: Column, n: Column) -> Column:
    """``n`` digests of a level from place ``first`` on, fewer at its end."""
    return F.substring(level, (first * _DIGITS + 1).cast("int"), (n * _DIGITS).cast("int"))


def _parents(level: Column) -> Column:
    """The next level: the digest of every ``FAN`` digests."""
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / F.lit(FAN * _DIGITS)).cast("int") - 1)
    return F.encode(F.array_join(F.transform(runs, lambda i: F.sha2(_part(level, i * FAN, F.lit(FAN)), 256)), ""), "UTF-8")


def _height(total: Column) -> Column:
    """Levels above the nodes of a block whose group has ``total`` nodes: while more than one is left, at most ``DEPTH``."""
    return reduce(lambda acc, k: acc + (total > FAN**k).cast("int"), range(DEPTH), F.lit(0))


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """``g, block, total, items, levels``: the nodes of every aligned block in order and the levels of its tree."""
    rest = [c for c in nodes.columns if c not in ("g", "pos", "total")]
    grouped = nodes.groupBy("g", F.floor(F.col("pos") / F.lit(BLOCK)).alias("block")).agg(
        F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("items")
    )
    level = F.encode(F.array_join(F.transform("items", lambda x: x["hash"]), ""), "UTF-8")
    grouped = grouped.withColumn("_leaves", F.array(level)).withColumn("_height", _height(F.col("total")))
    climbed = F.aggregate(
        F.sequence(F.lit(1), F.col("_height")), F.col("_leaves"), lambda acc, _: F.concat(acc, F.array(_parents(F.element_at(acc, -1)))),
    )
    levels = F.when(F.col("_height") > 0, climbed).otherwise(F.col("_leaves"))
    return staged(grouped.withColumn("levels", levels).drop("_leaves", "_height"), f"merkle-{name}")


def _grow(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Blocks of all rounds, from the leaves to the round with one block for each group."""
    rounds, n = [], None
    while n is None or n > 1:
        rounds.append(_blocks(nodes, f"{name}-{len(rounds)}"))
        n = rounds[-1].agg(F.max("block")).first()[0]
        if n is None:
            return []
        n += 1
        nodes = _tops(rounds[-1]).withColumn("total", F.ceil(F.col("total") / F.lit(BLOCK)))
    return rounds


def _tops(blocks: DataFrame) -> DataFrame:
    """The last level of every block as a node of the next round."""
    return blocks.select("g", F.col("block").alias("pos"), "total", F.element_at("levels", -1).cast("string").alias("hash"))


def _roots(blocks: DataFrame) -> DataFrame:
    return _tops(blocks).select("g", "hash")


def _down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """All leaves with their paths; ``above`` holds ``g, block, above`` (and more) of the blocks of the last round.

    The path of an item is put together within the row of its block, so only finished paths leave it.
    """
    for blocks in reversed(rounds):
        more = [c for c in above.columns if c not in ("g", "block", "above")]

        def path(place: Column) -> Column:
            def flanks(level: Column, k: Column) -> Column:
                at = F.floor(place / F.pow(F.lit(FAN), k)).cast("int")
                inside = at % FAN
                return F.struct(_part(level, at - inside, inside).alias("l"), _part(level, at + 1, FAN - 1 - inside).alias("r"))

            return F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), flanks)

        item = F.explode(F.transform("items", lambda x, i: F.struct(x.alias("item"), F.concat(path(i), F.col("above")).alias("path"))))
        found = blocks.join(above, ["g", "block"]).select("g", *more, item.alias("_i")).select("g", *more, "_i.item", "_i.path")
        above = found.select("g", F.col("item.pos").alias("block"), F.col("path").alias("above"), *more)
    return found
