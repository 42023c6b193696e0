"""Edit-aware token counts: a tree of text leaves per document, re-encoding only what an edit touches.

A leaf ends where the tokenizer splits whatever stands around it: after a character that is no white
space and before a single space with a word behind it. The tree above the leaves adds up characters and
tokens. An edit re-encodes the leaves it touches, with a neighbour where it comes within two characters
of a leaf's edge, and updates the sums on the way to the root.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langmill.llm import tokens
from langmill.llm.table import pick, spread_small

_SAFE = re.compile(r"(?<=\S) (?=\S)")


def leaves(text: str, width: int) -> list[str]:
    """Cut ``text`` at the first safe place after every ``width`` characters."""
    cuts, at = [0], 0
    while m := _SAFE.search(text, at + width):
        at = m.start()
        cuts.append(at)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


class Tree:
    """Leaves of one document with sums of characters and tokens in a complete binary tree."""

    def __init__(self, parts: list[str], counts: list[int]):
        self.base = 1 << max(0, (len(parts) - 1).bit_length())
        self.parts = parts + [""] * (self.base - len(parts))
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        self.chars[self.base : self.base + len(parts)] = map(len, parts)
        self.tokens[self.base : self.base + len(parts)] = counts
        for i in range(self.base - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaf(self, position: int) -> tuple[int, int]:
        """Leaf that holds the character at ``position`` (the last one behind the end) and its offset in it."""
        i = 1
        while i < self.base:
            i *= 2
            if position >= self.chars[i] and self.chars[i + 1]:
                position -= self.chars[i]
                i += 1
        return i - self.base, position

    def set(self, leaf: int, text: str, count: int) -> None:
        self.parts[leaf] = text
        i = leaf + self.base
        self.chars[i], self.tokens[i] = len(text), count
        while i > 1:
            i //= 2
            self._add(i)

    def _next(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < self.base and not self.parts[leaf]:
            leaf += step
        return leaf if 0 <= leaf < self.base else None

    def edit(self, start: int, length: int, text: str, count) -> int:
        """Replace ``length`` characters from ``start``; returns the characters that were encoded again."""
        start = min(max(start, 0), self.chars[1])
        end = min(start + max(length, 0), self.chars[1])
        first, offset = self.leaf(start)
        last, behind = self.leaf(end)
        if offset < 2 and (near := self._next(first, -1)) is not None:
            first, offset = near, offset + len(self.parts[near])
        if behind > len(self.parts[last]) - 2 and (near := self._next(last, 1)) is not None:
            last = near
        region = "".join(self.parts[first : last + 1])
        region = region[:offset] + text + region[offset + end - start :]
        for i in range(first + 1, last + 1):
            if self.parts[i]:
                self.set(i, "", 0)
        self.set(first, region, count(region))
        return len(region)


def trees(docs: DataFrame, *, width: int = 512, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          edits_col: str | None = None) -> DataFrame:
    """``id, text, leaf_chars, leaf_tokens`` (and ``edits``) of every row: the tree's leaves, ready to be stored.

    A null text counts as empty; it has one empty leaf. Extra columns are left out.
    """
    path = tokenizer or tokens.default_path()
    more = {"edits": edits_col} if edits_col else {}
    rows = pick(docs, id=id_col, text=text_col, **more)

    def build(batches):
        coder = tokens.encoder(path)
        for batch in batches:
            parts = [leaves(t or "", width) for t in batch.column("text").to_pylist()]
            flat = pa.array([p for x in parts for p in x], pa.large_string())
            sizes = np.concatenate([np.diff(cut) for *_, cut in coder.column(flat)]) if len(flat) else np.zeros(0, dtype=np.int64)
            cut = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in parts]))), pa.int32())
            chars = pa.array([len(p) for x in parts for p in x], pa.int32())
            lists = [pa.ListArray.from_arrays(cut, v) for v in (chars, pa.array(sizes, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "leaf_chars", "leaf_tokens"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return spread_small(rows).mapInArrow(build, f"{schema}, leaf_chars array<int>, leaf_tokens array<int>")


def counts(built: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Token counts before and after the edits of every row of ``trees``.

    ``edits`` is an array of (start, length, text) in characters, applied one after the other to what the
    earlier ones left; places beyond the text are moved to its end, a null array or field changes nothing.
    """
    path = tokenizer or tokens.default_path()

    def apply(batches):
        coder = tokens.encoder(path)
        count = lambda text: len(coder.strings([text])[0])
        for batch in batches:
            out = []
            for text, chars, sizes, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", "edits"))):
                ends = np.cumsum(chars).tolist()
                tree = Tree([(text or "")[b - n : b] for n, b in zip(chars, ends)], sizes)
                before, again, done = tree.tokens[1], 0, 0
                for e in edits or ():
                    if e and None not in e.values():
                        again += tree.edit(e["start"], e["length"], e["text"], count)
                        done += 1
                out.append((before, done, tree.tokens[1], tree.chars[1], again))
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in columns)], NAMES)

    kind = built.schema["id"].dataType.simpleString()
    return built.mapInArrow(apply, f"id {kind}, " + ", ".join(f"{n} long" for n in NAMES[1:])).withColumnRenamed("id", id_col)


NAMES = ["id", "n_tokens_before", "n_edits", "n_tokens", "n_chars", "n_encoded_again"]


def drawn_edits(text: Column, id_: Column, seed: str = "edit") -> Column:
    """Three edits of every text at places drawn by hash: an insertion, a deletion and a replacement."""
    place = lambda k: F.pmod(F.xxhash64(F.lit(seed), id_, F.lit(k)), F.length(text) + 1)
    edit = lambda start, length, new: F.struct(start.alias("start"), F.lit(length).cast("long").alias("length"), F.lit(new).alias("text"))
    return F.array(edit(place(0), 0, " inserted words"), edit(place(1), 12, ""), edit(place(2), 7, "new\n text"))
