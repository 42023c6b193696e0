"""Connected components of a table of links, by hooking on the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmill.llm.table import staged


def follow(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``df`` with the values of ``column`` that are nodes of ``roots`` (``node``, ``root``) replaced by their roots."""
    found = df.join(roots.toDF(column, "_root"), column, "left")
    return found.withColumn(column, F.coalesce("_root", column)).select(df.columns)


def components(links: DataFrame) -> DataFrame:
    """Staged ``node, root`` for every node of ``links`` (``a``, ``b``) but the roots: root is its component's smallest node.

    Each round hangs every node on its smallest neighbour if that is smaller, follows these pointers to their ends and goes
    on with the links between different ends, far fewer than before; it ends when there are none. Sums by
    node and joins on unique keys only, so neither a large component nor a node of many links meets in one task.
    """
    links = staged(links.where("a != b").select("a", "b"), "links")
    roots = links.toDF("node", "root").limit(0)
    while links.head(1):
        both = links.union(links.select("b", "a"))
        hung = both.groupBy("a").agg(F.min("b").alias("b")).where("b < a").toDF("node", "root")
        ends = _ends(staged(hung, "hung"))
        links = staged(follow(follow(links, "a", ends), "b", ends).where("a != b"), "links")
        roots = staged(follow(roots, "root", ends).union(ends), "components")
    return roots


def _ends(pointers: DataFrame) -> DataFrame:
    """``node, root`` with the end of every node's pointers: each write follows twice as far, and once more."""
    while True:
        one, two = pointers.toDF("root", "one"), pointers.toDF("one", "two")
        further = pointers.join(one, "root", "left").join(two, "one", "left").select("node", F.coalesce("two", "one", "root").alias("root"), F.col("two").isNotNull().alias("open"))
        further = staged(further, "ends")
        pointers = further.select("node", "root")
        if not further.where("open").head(1):
            return pointers
