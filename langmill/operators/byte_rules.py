"""Greedy longest-match rewriting of bytes by a table of rules.

The sources of the rules form a prefix tree that goes to the tasks as arrays. A batch of texts is one byte
buffer: all its positions walk down the tree together, one byte a step, so the cost of a byte depends on the
length of what matches there and not on the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmill.functions import grams as gram_fn, text as text_fn

#: Bytes of text handled at once; one longer text is handled alone.
BLOCK = 1 << 20
#: Bytes of all rules together that are sent to the tasks; more is an error.
MAX_RULE_BYTES = 256 << 20

RULES = "n long, src string, dst string"  # bytes as two hex digits each, separated by spaces


class Automaton:
    """Prefix tree over the sources, with the bytes that take their place."""

    def __init__(self, rules: list[tuple[bytes, bytes]]):
        children: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i, (source, _) in enumerate(rules):
            node = 0
            for byte in source:
                node = children.setdefault((node, byte), len(children) + 1)
            if source:
                ends[node] = i  # of two rules with one source the later wins
        self.rule = np.full(len(children) + 1, -1, dtype=np.int32)
        self.rule[list(ends)] = list(ends.values())
        keys = np.array([node << 8 | byte for node, byte in children], dtype=np.int64)
        nodes = np.array(list(children.values()), dtype=np.int32)
        self.mask = (1 << max(4, (2 * len(keys)).bit_length())) - 1
        self.keys, self.nodes = np.full(self.mask + 1, -1, dtype=np.int64), np.zeros(self.mask + 1, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # one of the keys that want a free slot gets it, the others go on
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.nodes[slot[free]] = keys[todo[free]], nodes[todo[free]]
            lost = self.keys[slot] != keys[todo]
            todo, slot = todo[lost], (slot[lost] + 1) & self.mask
        self.first = self.step(np.zeros(256, dtype=np.int64), np.arange(256))
        self.size = np.array([len(s) for s, _ in rules], dtype=np.int64)
        self.width = np.array([len(d) for _, d in rules], dtype=np.int64)
        self.pool = np.frombuffer(b"".join(d for _, d in rules), dtype=np.uint8)
        self.place = np.cumsum(self.width) - self.width

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (gram_fn.mix(keys.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Child of each node, or 0."""
        out = np.zeros(len(node), dtype=np.int64)
        keys = node.astype(np.int64) << 8 | byte
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            there = self.keys[slot]
            same = there == keys[todo]
            out[todo[same]] = self.nodes[slot[same]]
            on = ~same & (there >= 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def longest(self, data: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rule of the longest source that begins at each position and ends before ``end`` of it, or -1."""
        node = self.first[data]
        at = np.flatnonzero(node)
        node, depth = node[at], 1
        found = np.full(len(data), -1, dtype=np.int32)
        while len(at):
            rule = self.rule[node]
            found[at[rule >= 0]] = rule[rule >= 0]
            inside = at + depth < end[at]
            at, node = at[inside], node[inside]
            node = self.step(node, data[at + depth])
            at, node, depth = at[node > 0], node[node > 0], depth + 1
        return found

    def rewrite(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the rows after replacement, from the left in every row."""
        if not len(data) or not len(self.size):
            return data, offsets
        rule = self.longest(data, np.repeat(offsets[1:], np.diff(offsets)))
        at = np.flatnonzero(rule >= 0)
        at = at[_from_left(at, at + self.size[rule[at]])]
        rule = rule[at]
        width = np.ones(len(data), dtype=np.int64)
        covered = _ragged(at, self.size[rule])
        width[covered] = 0
        width[at] = self.width[rule]
        start = np.concatenate(([0], np.cumsum(width)))
        out = np.zeros(start[-1], dtype=np.uint8)
        plain = np.ones(len(data), dtype=bool)
        plain[covered] = False
        out[start[:-1][plain]] = data[plain]
        out[_ragged(start[at], self.width[rule])] = self.pool[_ragged(self.place[rule], self.width[rule])]
        return out, start[offsets]


def _ragged(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices place, place + 1, ..., ``size`` of them, for each item."""
    total = np.concatenate(([0], np.cumsum(size)))
    return np.arange(total[-1]) + np.repeat(place - total[:-1], size)


def _from_left(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the matches are used if each begins at or after the end of the one used before."""
    used = np.ones(len(start), dtype=bool)
    if not len(start):
        return used
    reach = np.maximum.accumulate(end)
    overlaps = np.concatenate((start[1:] < reach[:-1], [False]))
    # Only runs of matches that overlap need to be walked; the others are used as they are.
    first = np.flatnonzero(overlaps & ~np.concatenate(([False], overlaps[:-1])))
    last = np.flatnonzero(~overlaps & np.concatenate(([False], overlaps[:-1])))
    for a, b in zip(first.tolist(), last.tolist()):
        free = 0
        for k, (x, y) in enumerate(zip(start[a : b + 1].tolist(), end[a : b + 1].tolist()), a):
            if x < free:
                used[k] = False
            else:
                free = y
    return used


def automaton(rules: DataFrame, reverse: bool = False) -> Broadcast:
    """Rules (see ``RULES``) in the tasks, or those in the other direction; ``n`` decides which of two with one source is later.

    A null source or target is no rule. The rules are read once, and not above ``MAX_RULE_BYTES``.
    """
    source, target = ("dst", "src") if reverse else ("src", "dst")
    chosen = rules.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    size = chosen.agg(F.coalesce(F.sum(F.length("src") + F.length("dst")), F.lit(0))).first()[0]
    if size > MAX_RULE_BYTES:
        raise ValueError(f"the rules take {size} bytes, at most {MAX_RULE_BYTES} are sent to the tasks")
    found = chosen.select("n", source, target).toArrow().sort_by("n")
    pairs = zip(found.column(source).to_pylist(), found.column(target).to_pylist())
    return rules.sparkSession.sparkContext.broadcast(Automaton([(bytes.fromhex(s), bytes.fromhex(t)) for s, t in pairs]))


def rewritten(df: DataFrame, column: str, steps: list[Broadcast], into: str) -> DataFrame:
    """``df`` with the bytes of a text or binary column after each of the automata in turn, as binary ``into``.

    Rows stay where they are; null stays null, an empty text empty. ``df`` may be a stream.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column)
            nulls = values.is_null()
            values = pc.fill_null(values.cast(pa.large_binary()), b"")
            n, (_, offsets, data) = len(values), values.buffers()
            if not n:
                continue
            offsets = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + n + 1]
            data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
            first = 0
            while first < n:
                end = min(max(int(np.searchsorted(offsets, offsets[first] + BLOCK, side="right")) - 1, first + 1), n)
                block, cuts = data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
                for step in steps:
                    block, cuts = step.value.rewrite(block, cuts)
                made = pa.Array.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(np.ascontiguousarray(cuts)), pa.py_buffer(np.ascontiguousarray(block))])
                made = pc.if_else(nulls.slice(first, end - first), pa.scalar(None, pa.binary()), made.cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, made], [*batch.schema.names, into])
                first = end

    schema = df.withColumn(into, F.lit(None).cast("binary")).schema
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str, decompose: DataFrame, merge: DataFrame, into: str = "bytes") -> DataFrame:
    """Bytes of a text: decomposed, then merged."""
    return rewritten(df, text, [automaton(decompose), automaton(merge)], into)


def decode(df: DataFrame, data: str, decompose: DataFrame, merge: DataFrame, into: str = "decoded") -> DataFrame:
    """Text of the bytes: the merge undone, then the decomposition; bytes that are not valid UTF-8 are left out."""
    plain = rewritten(df, data, [automaton(merge, reverse=True), automaton(decompose, reverse=True)], into)
    valid = F.col(into).cast("string")
    digits = F.regexp_extract_all(F.lower(F.hex(into)), F.lit("(..)"), F.lit(1))
    return plain.withColumn(into, F.when(F.is_valid_utf8(valid), valid).otherwise(text_fn.decode_tokens(digits)))
