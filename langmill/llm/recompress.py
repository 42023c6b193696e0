"""Repeated word windows by recompression.

Rounds of recompression name runs of one symbol and pairs of neighbours by fingerprint. Names depend on
content alone, so equal passages get equal symbols but for a few at their ends, in whatever task they
are. High-level symbols that Spark finds on several places reveal long repeats. What such symbols leave
(the ends of passages, short repeats) is searched by the low-level boundaries: every window holds some
that its own words decide, one of them is its anchor, and only windows whose anchor is repeated are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmill.llm import spans
from langmill.llm.table import ROW, bucketed, pick, staged
from langmill.session import collect_staged, release

ROUNDS = 13
_U = np.uint64


def pair_round(symbol: np.ndarray, row: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Name pairs of a left symbol and a right one behind it; a hash bit deals symbols to the sides."""
    if len(symbol) < 2:
        return symbol, np.arange(len(symbol))
    left = (spans.mix(symbol, salt) >> _U(63)) == 0
    joins = np.zeros(len(symbol), dtype=bool)
    joins[:-1] = left[:-1] & ~left[1:] & (row[:-1] == row[1:])
    kept = np.ones(len(symbol), dtype=bool)
    kept[1:] = ~joins[:-1]
    at = np.flatnonzero(joins)
    named = symbol.copy()
    named[at] = spans.mix(spans.mix(symbol[at], salt + 1) + symbol[at + 1], salt + 2)
    kept = np.flatnonzero(kept)
    return named[kept], kept


def run_round(symbol: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name runs of one symbol by the symbol and their length."""
    if len(symbol) < 2:
        return symbol, np.arange(len(symbol))
    first = np.ones(len(symbol), dtype=bool)
    first[1:] = (symbol[1:] != symbol[:-1]) | (row[1:] != row[:-1])
    kept = np.flatnonzero(first)
    size = np.diff(np.concatenate((kept, [len(symbol)]))).astype(_U)
    return np.where(size > _U(1), spans.mix(symbol[kept] ^ spans.mix(size, 77), 78), symbol[kept]), kept


def recompress(symbol: np.ndarray, row: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after the rounds and the word at which each begins."""
    at = np.arange(len(symbol))
    for k in range(rounds):
        symbol, kept = run_round(symbol, row)
        at, row = at[kept], row[kept]
        symbol, kept = pair_round(symbol, row, 10 * k + 100)
        at, row = at[kept], row[kept]
    return symbol, at


class Block:
    """Words of a block of texts: fingerprints, rows, offsets by row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.start, self.end, self.row = spans.words(data, offsets)
        self.word = spans.Prints(data).of(self.start, self.end)
        self.cut = spans.per_row(self.row, len(offsets) - 1)

    def long_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, end word and name of every two neighbouring high-level symbols of a text."""
        symbol, at = recompress(self.word, self.row, ROUNDS)
        if not len(at):
            return at, at, symbol
        row, end = self.row[at], np.concatenate((at[1:], [len(self.word)]))
        i = np.flatnonzero(row[:-1] == row[1:])
        return at[i], end[i + 1], spans.mix(spans.mix(symbol[i], 5) + symbol[i + 1], 6)

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all windows, the anchor of each and the fingerprint of the words behind every place."""
        n, reach = len(self.word), width - 14  # a window decides the boundaries from its 5th to its 17th word
        first = np.flatnonzero(self.row[: max(n - width + 1, 0)] == self.row[width - 1 :]) if n >= width else np.zeros(0, dtype=np.int64)
        if not len(first):
            return first, first, self.word[:0]
        symbol, kept = pair_round(self.word, self.row, 1)
        boundary = np.zeros(n, dtype=bool)
        boundary[kept[pair_round(symbol, self.row[kept], 4)[1]]] = True
        print_ = np.zeros(n, dtype=_U)
        at, gram = spans.grams(self.word, self.row, 6)
        print_[at] = gram
        order = np.where(boundary, print_ | _U(1), np.iinfo(np.uint64).max)
        best, place = order[first + 4].copy(), first + 4
        for k in range(5, 4 + reach + 4):
            better = order[first + k] < best
            best[better], place[better] = order[first + k][better], first[better] + k
        return first, place, print_

    def windows(self, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Two fingerprints of the windows that begin at the given words."""
        out = []
        for salt in (1, 2):
            h = spans.mix(self.word, salt)
            total = np.zeros(len(h) + 1, dtype=_U)
            up, down = spans._powers(len(h) + 1)
            np.cumsum(h * down[: len(h)], out=total[1:])
            out.append(spans.mix((total[first + width] - total[first]) * up[first], salt).astype(np.int64))
        return out[0], out[1]


def _inside(spans_: list, cut: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which words begin a window that lies in one of the given spans (start, end) of its row."""
    change = np.zeros(n + 1, dtype=np.int64)
    for row, found in enumerate(spans_):
        for s in found or ():
            if s["to"] - s["from"] >= width:
                change[cut[row] + s["from"]] += 1
                change[cut[row] + s["to"] - width + 1] -= 1
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, *, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_removed, kept_sha256, kept`` of every row of ``docs``.

    A word goes if a window of ``width`` (20 or more) words over it has the same words as a window that
    starts earlier: in a smaller id, or an earlier row of the same id, or earlier in the row. Nulls come
    first among ids; a null text has no words. ``kept`` is the text of the words left, joined by spaces.
    """
    if width < 20:
        raise ValueError("windows shorter than 20 words have no boundary that is theirs alone")
    rows = bucketed(pick(docs, id=id_col, text=text_col), "recompress")

    def find_spans(batches):
        for batch in batches:
            for a, b, data, offsets in spans.blocks(batch.column("text")):
                block = Block(data, offsets)
                from_, to, name = block.long_spans()
                row = block.row[from_]
                long = to - from_ >= width
                from_, to, name, row = from_[long], to[long], name[long], row[long]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(a + row)), batch.column(ROW).take(pa.array(a + row)), pa.array((from_ - block.cut[row]).astype(np.int32)),
                     pa.array((to - block.cut[row]).astype(np.int32)), pa.array(name.astype(np.int64))], ["id", ROW, "from", "to", "name"])

    kind = rows.schema["id"].dataType.simpleString()
    with collect_staged() as once:
        long = staged(rows.mapInArrow(find_spans, f"id {kind}, {ROW} long, from int, to int, name long"), "recompress-spans")
    place = F.struct("id", ROW, "from")
    earliest = long.groupBy("name").agg(F.min(place).alias("place"), F.count("*").alias("times")).where("times > 1").drop("times")
    again = long.join(earliest, "name").where(place != F.col("place"))
    again = staged(again.groupBy(ROW).agg(F.collect_list(F.struct("from", "to")).alias("spans")), "recompress-again")
    release(again, once)
    left = rows.join(again, ROW, "left")

    def find_anchors(batches):
        for batch in batches:
            known = batch.column("spans").to_pylist()
            for a, b, data, offsets in spans.blocks(batch.column("text")):
                block = Block(data, offsets)
                first, place, print_ = block.anchors(width)
                open_ = ~_inside(known[a:b], block.cut, len(block.word), width)
                at = np.unique(place[open_[first]])
                row = block.row[at] if len(at) else at
                yield pa.RecordBatch.from_arrays(
                    [batch.column(ROW).take(pa.array(a + row)), pa.array((at - block.cut[row]).astype(np.int32)), pa.array(print_[at].astype(np.int64))], [ROW, "at", "print"])

    with collect_staged() as once:
        anchors = staged(left.select(ROW, "text", "spans").mapInArrow(find_anchors, f"{ROW} long, at int, print long"), "recompress-anchors")
    repeated = anchors.groupBy("print").count().where("count > 1").select("print")
    marked = anchors.join(repeated, "print").groupBy(ROW).agg(F.collect_list("at").alias("anchors"))

    def find_windows(batches):
        for batch in batches:
            known, flagged = batch.column("spans").to_pylist(), batch.column("anchors").to_pylist()
            for a, b, data, offsets in spans.blocks(batch.column("text")):
                block = Block(data, offsets)
                first, place, _ = block.anchors(width)
                hot = np.zeros(len(block.word) + 1, dtype=bool)
                for r in range(a, b):
                    hot[block.cut[r - a] + np.array(flagged[r], dtype=np.int64)] = True
                first = first[hot[place] & ~_inside(known[a:b], block.cut, len(block.word), width)[first]]
                row = block.row[first]
                one, two = block.windows(first, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(a + row)), batch.column(ROW).take(pa.array(a + row)), pa.array((first - block.cut[row]).astype(np.int32)), pa.array(one), pa.array(two)],
                    ["id", ROW, "from", "one", "two"])

    windows = left.join(marked, ROW).select("id", ROW, "text", "spans", "anchors")
    windows = staged(windows.mapInArrow(find_windows, f"id {kind}, {ROW} long, from int, one long, two long"), "recompress-windows")
    release(windows, once)
    earliest = windows.groupBy("one", "two").agg(F.min(place).alias("place"), F.count("*").alias("times")).where("times > 1").drop("times")
    short = windows.join(earliest, ["one", "two"]).where(place != F.col("place"))
    short = short.groupBy(ROW).agg(F.collect_list("from").alias("windows"))

    def cut(batches):
        for batch in batches:
            known, more = batch.column("spans").to_pylist(), batch.column("windows").to_pylist()
            for a, b, data, offsets in spans.blocks(batch.column("text")):
                block = Block(data, offsets)
                starts = _inside(known[a:b], block.cut, len(block.word), width)
                for r in range(a, b):
                    if more[r]:
                        starts[block.cut[r - a] + np.array(more[r], dtype=np.int64)] = True
                change = np.zeros(len(block.word) + width + 1, dtype=np.int64)
                at = np.flatnonzero(starts)
                change[at] += 1
                change[at + width] -= 1
                gone = np.cumsum(change)[: len(block.word)] > 0
                raw, kept = data.tobytes(), []
                for r in range(b - a):
                    x, y = block.cut[r], block.cut[r + 1]
                    keep = x + np.flatnonzero(~gone[x:y])
                    kept.append(b" ".join([raw[i:j] for i, j in zip(block.start[keep].tolist(), block.end[keep].tolist())]))
                n = np.diff(block.cut)
                removed = np.bincount(block.row[gone], minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(n), pa.array(removed), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                     pa.array([k.decode() for k in kept], pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = left.join(short, ROW, "left").select("id", "text", "spans", "windows")
    return out.mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string").withColumnRenamed("id", id_col)
