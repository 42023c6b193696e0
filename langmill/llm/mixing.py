"""Mixing overlapping sources to target weights by min-cost flow.

Documents with the same set of sources form a pattern. Capacity flows from patterns to source quotas;
a pattern's words cost more with every further repetition. The network has one node for each pattern
and source, never one for each document; documents are then selected in seeded order.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmill.llm import spans
from langmill.llm.table import ROW, pick, spread_small, staged, starts

#: Patterns plus sources that the driver solves for; beyond that ``mix`` raises an error.
MAX_NODES = 100_000
#: Source key of a null source; other keys begin with "=".
NULL_SOURCE = ""


@dataclass(frozen=True)
class Mix:
    """``docs``: rows with taken words; ``flows``: words from pattern to source; ``sources``: sizes and targets."""

    docs: DataFrame
    flows: dict[tuple[tuple[str, ...], str], int]
    sources: dict[str, tuple[int, float]]


def sized(docs: DataFrame, sources: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged ``id, pattern, size``: words of the text and the sorted set of source keys, by row.

    ``sources`` is a string column (one source, possibly null) or an array of strings (nulls in it and
    repeats are left out; an empty or null array has no source).
    """
    rows = pick(docs, id=id_col, text=text_col, src=sources)
    if rows.schema["src"].dataType.simpleString().startswith("array"):
        named = F.transform(F.array_compact(F.coalesce("src", F.array().cast("array<string>"))), lambda x: F.concat(F.lit("="), x))
    else:
        named = F.array(F.coalesce(F.concat(F.lit("="), "src"), F.lit(NULL_SOURCE)))
    rows = rows.select("id", F.array_sort(F.array_distinct(named)).alias("pattern"), "text")

    def count(batches):
        for batch in batches:
            for a, b, data, offsets in spans.blocks(batch.column("text")):
                row = spans.words(data, offsets)[2]
                cut = spans.per_row(row, b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), batch.column("pattern").slice(a, b - a), pa.array(cut[1:] - cut[:-1])],
                    ["id", "pattern", "size"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    counted = spread_small(rows).mapInArrow(count, f"id {kind}, pattern array<string>, size long")
    return staged(counted.withColumn(ROW, F.monotonically_increasing_id()), "mix-sizes")


def capped_targets(sizes: dict[str, int], weights: dict[str, float], total: float, most: float) -> dict[str, float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is cut off is shared again."""
    target, open_, left = {}, [s for s in sizes if weights[s] > 0], total
    target = {s: 0.0 for s in sizes}
    while open_:
        weight = sum(weights[s] for s in open_)
        above = [s for s in open_ if left * weights[s] / weight > most * sizes[s]]
        if not above:
            return target | {s: left * weights[s] / weight for s in open_}
        for s in above:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in above)
        open_ = [s for s in open_ if s not in set(above)]
    return target


def route(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], costs: tuple[int, ...]) -> dict[tuple[tuple[str, ...], str], int]:
    """Cheapest maximal flow: pattern p offers ``patterns[p]`` words at each of the rising ``costs``."""
    begin, sink = 0, 1
    node = {name: i + 2 for i, name in enumerate([*sorted(patterns), *sorted(quotas)])}
    arcs: list[list[int]] = []  # to, capacity left, cost; arc i ^ 1 goes back
    out: list[list[int]] = [[] for _ in range(len(node) + 2)]

    def arc(a: int, b: int, capacity: int, cost: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, capacity, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    used = {}
    for p, size in sorted(patterns.items()):
        for cost in costs:
            arc(begin, node[p], size, cost)
        for s in p:
            used[p, s] = arc(node[p], node[s], sum(quotas.values()), 0)
    for s, quota in sorted(quotas.items()):
        arc(node[s], sink, quota, 0)
    while True:  # each round fills a cheapest path
        cost, via, waiting = {begin: 0}, {}, deque([begin])
        while waiting:
            a = waiting.popleft()
            for i in out[a]:
                b, capacity, c = arcs[i]
                if capacity > 0 and cost[a] + c < cost.get(b, 1 << 60):
                    cost[b], via[b] = cost[a] + c, i
                    waiting.append(b)
        if sink not in cost:
            return {key: arcs[i ^ 1][1] for key, i in used.items() if arcs[i ^ 1][1]}
        path, at = [], sink
        while at != begin:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        amount = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= amount
            arcs[i ^ 1][1] += amount


def mix(docs: DataFrame, *, sources: str = "source", weights=(3.0, 1.0, 2.0), share: float = 1.5, most: int = 2,
        costs: tuple[int, ...] = (1, 3), seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", draw_by: str = "id") -> Mix:
    """Take ``share`` of all words so that sources come near their targets.

    ``weights`` go to the sources by code point (null last), repeating. ``costs`` holds the price of a
    first, second, ... use of a pattern's words and so bounds how often a document is taken; ``most``
    bounds a target by its source's size. A document's ``taken`` is its size times its number of uses.
    Empty tables and texts without words take nothing; ties in the draw go by id, then row. ``draw_by`` names
    the part of the id that decides the draw (``id.part`` of a struct); it is all of it by default.
    """
    rows = sized(docs, sources, id_col, text_col)
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_NODES + 1).collect()
    patterns = {tuple(r["pattern"]): r["size"] for r in found}
    sizes: dict[str, int] = {}
    for p, size in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + size
    if len(found) + len(sizes) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} patterns and sources; join rare sources first")
    names = sorted(sizes, key=lambda s: (s == NULL_SOURCE, s))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    targets = capped_targets(sizes, weight, share * sum(patterns.values()), most)
    flows = route({p: n for p, n in patterns.items() if p}, {s: round(t) for s, t in targets.items()}, costs)
    taken: dict[tuple[str, ...], int] = {}
    for (p, _), amount in flows.items():
        taken[p] = taken.get(p, 0) + amount
    plan = [(list(p), divmod(taken.get(p, 0), n) if n else (0, 0)) for p, n in patterns.items()]
    plan = rows.sparkSession.createDataFrame([(p, int(uses), int(rest)) for p, (uses, rest) in plan], "p array<string>, uses long, rest long")
    chosen = starts(rows, ["pattern"], "size", seed, [draw_by, "size"]).join(F.broadcast(plan), F.col("pattern") == F.col("p"))  # at most MAX_NODES rows
    once_more = (F.col("start") + F.col("size") / 2 <= F.col("rest")).cast("long")
    chosen = chosen.select(F.col("id").alias(id_col), "pattern", "size", ((F.col("uses") + once_more) * F.col("size")).alias("taken"), ROW)
    return Mix(chosen, flows, {s: (sizes[s], targets[s]) for s in names})


def with_sources(result: Mix) -> DataFrame:
    """Documents of one source each with their source's size and target (at most ``MAX_NODES`` sources)."""
    spark = result.docs.sparkSession
    rows = [([s], size, target) for s, (size, target) in result.sources.items()]
    table = spark.createDataFrame(rows, "p array<string>, source_size long, target double")
    return result.docs.join(F.broadcast(table), F.col("pattern") == F.col("p")).drop("p", "pattern", ROW)
