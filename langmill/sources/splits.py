"""Splittable reading of formats whose records cross line ends: quoted TSV and sectioned JSON.

Spark cuts a file into blocks at a separator (a line end, a quotation mark) whatever the separator's meaning.
What a piece means depends on all before it in its file, so reading takes two steps: every block is summed up
without knowing how it begins, the summaries of a file (one narrow row a block) are put in order, and a second
scan starts each block in its true state. Records inside a block are finished where they are read; only the
pieces of a record that a border cuts are brought together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from langmill.session import broadcast_if_small, stage

BATCH_CHARS = 8 << 20


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, value) in file order within a block; a block is read by one task."""
    raw = spark.read.text(path, lineSep=separator)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return raw.select(*place, "value")


def _begin(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """``pieces`` with the ``state`` in which their block begins, in file order within a block.

    A block missing from ``blocks`` means that the second scan was cut at other places than the first.
    """
    table, small = broadcast_if_small(blocks.select("file", "block", "state"))
    numbered = pieces if small else pieces.withColumn("_n", F.monotonically_increasing_id())
    joined = numbered.join(table, ["file", "block"], "left")
    if not small:
        joined = joined.repartition("file", "block").sortWithinPartitions("file", "block", "_n").drop("_n")
    error = F.raise_error(F.concat(F.lit("cut at other places than before, set spark.sql.files.minPartitionNum: "), F.col("file")))
    return joined.select("file", "block", "value", F.coalesce("state", error).alias("state"))


def _by_block(batches: Iterator[pa.RecordBatch]):
    """(file, block, state, values) for the run of rows of one block in a batch."""
    for batch in batches:
        files, blocks, values = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
        states = batch.column("state").to_pylist() if "state" in batch.schema.names else [None] * len(values)
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or blocks[i] != blocks[start] or files[i] != files[start]:
                yield files[start], blocks[start], states[start], values[start:i]
                start = i


class _Rows:
    """Rows of a task, given out in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, *row):
        self.rows.append(row)
        self.size += 100 + sum(len(v) for v in row if isinstance(v, str))

    def full(self) -> bool:
        return self.size >= BATCH_CHARS

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in self.schema]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.size = [], 0
        return batch


def _joined(cut: DataFrame, keys: list[str], separator: str) -> DataFrame:
    """Cut records, their pieces put together in file order."""
    parts = F.sort_array(F.collect_list(F.struct("block", "value")))
    return cut.groupBy(*keys).agg(F.concat_ws(separator, F.transform(parts, lambda p: p["value"])).alias("value"))


# --- quoted TSV ------------------------------------------------------------------------------

def quoted_after(line: str, quoted: bool, sep: str = "\t", quote: str = '"') -> bool:
    """Is a field still within quotes at the end of ``line``, when one was (or was not) at its begin?

    A quote opens a field only as its first character; within, a doubled quote is text. After the closing quote
    the rest of the field is plain.
    """
    at = 0
    while True:
        if quoted:
            end = line.find(quote, at)
            if end < 0:
                return True
            at = end + 1
            if line.startswith(quote, at):
                at += 1
                continue
            quoted = False
        elif line.startswith(quote, at):
            at, quoted = at + 1, True
            continue
        end = line.find(sep, at)
        if end < 0:
            return False
        at = end + 1


def _line_effects(batches):
    """How each block ends when it begins outside (``plain``) or within quotes (``inside``)."""
    out = _Rows(pa.schema([("file", pa.string()), ("block", pa.int64()), ("plain", pa.bool_()), ("inside", pa.bool_())]))
    place, plain, inside = None, False, True
    for file, block, _, lines in _by_block(batches):
        if place != (file, block):
            if place:
                out.add(*place, plain, inside)
            place, plain, inside = (file, block), False, True
        for line in lines:
            if '"' in line:
                plain, inside = quoted_after(line, plain), quoted_after(line, inside)
    if place:
        out.add(*place, plain, inside)
    yield out.take()


def _line_states(effects: DataFrame) -> DataFrame:
    """(file, block, state): ``state`` is 1 for a block that begins within quotes.

    Ends that do not depend on the begin are known; from the last of them on, blocks keep or turn the state.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("plain") == F.col("inside"), F.col("plain").cast("int"))
    turns = (F.col("plain") & ~F.col("inside")).cast("int")
    known = effects.withColumn("fixed", fixed).withColumn("turns", F.sum(turns).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns")), ignorenulls=True).over(before)
    turned = F.coalesce(F.last("turns").over(before), F.lit(0))
    state = (F.coalesce(last["fixed"], F.lit(0)) + turned - F.coalesce(last["turns"], F.lit(0))) % 2
    return known.select("file", "block", state.alias("state"))


def _records(batches):
    """Whole records of a block, and the two pieces that its borders may cut: ``head`` goes on from before."""
    out = _Rows(pa.schema([("file", pa.string()), ("block", pa.int64()), ("head", pa.bool_()), ("tail", pa.bool_()), ("value", pa.string())]))
    place, held, head, quoted = None, [], False, False
    for file, block, state, lines in _by_block(batches):
        if place != (file, block):
            if held:
                out.add(*place, head, quoted, "\n".join(held))
            place, held, head, quoted = (file, block), [], bool(state), bool(state)
        for line in lines:
            held.append(line)
            quoted = quoted_after(line, quoted) if '"' in line else quoted
            if not quoted:
                out.add(file, block, head, False, "\n".join(held))
                held, head = [], False
                if out.full():
                    yield out.take()
    if held:
        out.add(*place, head, quoted, "\n".join(held))
    yield out.take()


def tsv_records(spark: SparkSession, path: str) -> DataFrame:
    """(value): records of a TSV file with line breaks in quoted fields, read by as many tasks as a plain file.

    A record ends at a line end outside quotes, or with its file. Blank lines are no records. A carriage return before a
    line end belongs to the line.
    """
    effects = stage(_pieces(spark, path, "\n").mapInArrow(_line_effects, "file string, block long, plain boolean, inside boolean"), "tsv-blocks")
    pieces = _begin(_pieces(spark, path, "\n"), stage(_line_states(effects), "tsv-states"))
    found = stage(pieces.mapInArrow(_records, "file string, block long, head boolean, tail boolean, value string"), "tsv-records")
    cut = found.where("head OR tail")
    # A piece that goes on belongs to the record begun in the last block whose tail was no head as well. Only places are put in order.
    order = Window.partitionBy("file").orderBy("block", F.col("head").desc())
    start = F.last(F.when(~F.col("head"), F.col("block")), ignorenulls=True).over(order)
    begun = cut.join(cut.select("file", "block", "head", start.alias("start")), ["file", "block", "head"])
    whole = found.where("NOT head AND NOT tail").select("value").unionAll(_joined(begun, ["file", "start"], "\n").select("value"))
    return whole.select(F.regexp_replace("value", "\r$", "").alias("value")).where("value != ''")


# --- sectioned JSON --------------------------------------------------------------------------

_STRUCTURE = re.compile(r"[{}\[\]:]")


class Walk:
    """Follows the structure of a JSON text given as pieces between quotation marks.

    ``stack`` holds the open containers as [kind, key, objects]: ``{`` or ``[``, the key being read, and the number of objects
    met directly inside. With ``base`` the first entry is the unknown container in which a block begins, ``pops`` lists
    the marks that closed it and those around it, and a key that began before the block is a list of its rest.
    """

    def __init__(self, stack: list | None = None, inside: bool = False, string: str = ""):
        self.base = stack is None
        self.stack = [["?", None, 0]] if self.base else stack
        self.pops, self.inside, self.bad = "", inside, False
        self.parts = [string]  # of the string being read, or the last one
        self.fresh = False  # whether that string began in this block
        self.depth = self._list_depth()

    def _list_depth(self) -> int:
        """Stack size at which objects of the innermost section list lie directly inside it; 0 outside any."""
        for i, frame in enumerate(self.stack):
            if frame[0] == "[":
                return i + 1
        return 0

    def capturing(self) -> bool:
        """Is an instance of a section list open?"""
        return bool(self.depth) and len(self.stack) > self.depth and self.stack[self.depth][0] == "{"

    def keys(self) -> list[str]:
        return [json.loads(f'"{frame[1]}"', strict=False) for frame in self.stack[: max(0, self.depth - 1)]]

    def string(self) -> str:
        return "".join(self.parts)

    def _key(self):
        return [self.string()] if self.base and not self.fresh else self.string()

    def step(self, piece: str):
        """Take one piece and the quotation mark after it. Yields (begin, end, keys, position) of instances: begin or
        end is None where the instance goes beyond the piece."""
        if self.inside:
            self.parts.append(piece)
            trailing = len(piece) - len(piece.rstrip("\\"))
            if trailing % 2:
                self.parts.append('"')
            else:
                self.inside = False
            return
        for match in _STRUCTURE.finditer(piece):
            mark, at = match.group(), match.start()
            if mark in "{[":
                top = self.stack[-1] if self.stack else None
                if mark == "{" and top is not None:
                    top[2] += 1
                self.stack.append([mark, None, 0])
                if not self.base:
                    if mark == "[" and not self.depth:
                        self.depth = len(self.stack)
                    elif mark == "{" and self.depth and len(self.stack) == self.depth + 1:
                        yield at, None, None, None
            elif mark in "}]":
                if self.base and len(self.stack) == 1:
                    self.pops += mark
                    self.stack[0] = ["?", None, 0]
                    continue
                if not self.stack or self.stack[-1][0] + mark not in ("{}", "[]"):
                    self.bad = True
                    return
                if not self.base and self.capturing() and len(self.stack) == self.depth + 1:
                    yield None, at + 1, self.keys(), self.stack[self.depth - 1][2] - 1
                if not self.base and self.depth == len(self.stack):
                    self.depth = 0
                self.stack.pop()
            elif mark == ":" and self.stack:
                self.stack[-1][1] = self._key()
        self.inside, self.parts, self.fresh = True, [], True


def _quote_effects(batches):
    """How each block turns the state of being within a string: it ends ``plain`` or ``inside``, by its begin."""
    out = _Rows(pa.schema([("file", pa.string()), ("block", pa.int64()), ("plain", pa.bool_()), ("inside", pa.bool_())]))
    place, plain, inside = None, False, True
    for file, block, _, pieces in _by_block(batches):
        if place != (file, block):
            if place:
                out.add(*place, plain, inside)
            place, plain, inside = (file, block), False, True
        for piece in pieces:
            escaped = piece.endswith("\\") and (len(piece) - len(piece.rstrip("\\"))) % 2 == 1
            plain, inside = not plain or escaped, not inside or escaped
    if place:
        out.add(*place, plain, inside)
    yield out.take()


def _structure(batches):
    """What each block does to the open containers, as JSON: containers closed, the container it ends in, those opened."""
    out = _Rows(pa.schema([("file", pa.string()), ("block", pa.int64()), ("effect", pa.string())]))

    def effect(walk):
        base, *opened = walk.stack
        return json.dumps([walk.bad, walk.pops, base[1], base[2], opened, walk.inside, walk.fresh, walk.string()])

    place, walk = None, None
    for file, block, state, pieces in _by_block(batches):
        if place != (file, block):
            if place:
                out.add(*place, effect(walk))
            place, walk = (file, block), Walk(inside=bool(state))
        for piece in pieces:
            for _ in walk.step(piece):
                pass
    if place:
        out.add(*place, effect(walk))
    yield out.take()


def _fold(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of one file begins, and whether the file holds one whole JSON object."""
    blocks = blocks.sort_values("block")
    stack, inside, string, start, states, starts = [], False, "", None, [], []
    good = True
    for block, text in zip(blocks["block"], blocks["effect"]):
        states.append(json.dumps([stack, inside, string]))
        starts.append(start)
        if not good:
            continue
        bad, pops, key, objects, opened, inside, fresh, tail = json.loads(text)
        closed = "".join({"{": "}", "[": "]"}[frame[0]] for frame in reversed(stack[max(0, len(stack) - len(pops)):]))
        good = not bad and pops == closed
        if not good:
            continue
        key = string + key[0] if isinstance(key, list) else key
        string = tail if fresh else string + tail
        stack = [list(frame) for frame in stack[: len(stack) - len(pops)]]
        below = len(stack)
        if stack:
            stack[-1] = [stack[-1][0], stack[-1][1] if key is None else key, stack[-1][2] + objects]
        stack += opened
        list_at = next((i for i, frame in enumerate(stack) if frame[0] == "["), len(stack))
        if list_at + 1 < len(stack) and list_at + 1 >= below:
            start = block
    # The last piece has no quotation mark behind it, so a whole document seems to open a string after its end.
    whole = good and not stack and inside and not string and len(blocks) > 0
    return pd.DataFrame({"file": blocks["file"], "block": blocks["block"], "state": states, "start": pd.array(starts, dtype="Int64"), "whole": whole})


def _instances(batches):
    """Instances of section lists: whole ones, and pieces of those that borders cut."""
    out = _Rows(pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("head", pa.bool_()), ("tail", pa.bool_()),
        ("keys", pa.list_(pa.string())), ("pos", pa.int64()), ("value", pa.string()),
    ]))
    place, walk, held, head, failed = None, None, [], False, False
    for file, block, state, pieces in _by_block(batches):
        if place != (file, block):
            if held:
                out.add(*place, head, True, None, None, '"'.join(held))
            stack, inside, string = json.loads(state)
            place, walk, failed = (file, block), Walk(stack, inside, string), False
            head = walk.capturing()
            held = []
        for piece in [] if failed else pieces:
            begin = 0 if walk.capturing() else None
            for opened, closed, keys, pos in walk.step(piece):
                if opened is not None:
                    begin = opened
                else:
                    held.append(piece[begin:closed])
                    out.add(file, block, head, False, keys, pos, '"'.join(held))
                    held, head, begin = [], False, None
            if walk.bad:
                failed, held = True, []  # the fold has found the file broken
                break
            if begin is not None:
                held.append(piece[begin:])
        if out.full():
            yield out.take()
    if held:
        out.add(*place, head, True, None, None, '"'.join(held))
    yield out.take()


def json_instances(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file, keys, pos, value): the objects in the lists of sectioned JSON documents, as JSON text.

    ``keys`` are the sections down to the list (empty for a list on top), ``pos`` counts the objects of a list. A
    document of any size is read by many tasks; only one instance at a time must fit a task. A file that is
    cut off or whose brackets do not match is an error; without ``strict`` it has no rows. An empty file has none.
    """
    shape = "file string, block long, plain boolean, inside boolean"
    quotes = stage(_pieces(spark, path, '"').mapInArrow(_quote_effects, shape), "json-quotes")
    known = stage(_line_states(quotes), "json-strings")
    effects = stage(_begin(_pieces(spark, path, '"'), known).mapInArrow(_structure, "file string, block long, effect string"), "json-structure")
    states = effects.groupBy("file").applyInPandas(_fold, "file string, block long, state string, start long, whole boolean")
    error = F.raise_error(F.concat(F.lit("not a whole JSON document: "), F.col("file")))
    if strict:
        states = states.withColumn("state", F.when(F.col("whole"), F.col("state")).otherwise(error))
    states = stage(states, "json-states")
    found = _begin(_pieces(spark, path, '"'), states).mapInArrow(
        _instances, "file string, block long, head boolean, tail boolean, keys array<string>, pos long, value string")
    found = stage(found, "json-instances")
    whole = found.where("NOT head AND NOT tail").select("file", "keys", "pos", "value")
    # Of the instance that a block's end cuts there is one at most, so the block where it began names it.
    begun = found.where("head OR tail").join(states.select("file", "block", "start"), ["file", "block"])
    begun = begun.withColumn("start", F.when(F.col("head"), F.col("start")).otherwise(F.col("block")))
    parts = F.sort_array(F.collect_list(F.struct("block", "value")))
    joined = begun.groupBy("file", "start").agg(
        F.max("keys").alias("keys"), F.max("pos").alias("pos"), F.concat_ws('"', F.transform(parts, lambda p: p["value"])).alias("value"))
    out = whole.unionAll(joined.select("file", "keys", "pos", "value"))
    if not strict:
        broken = states.where(~F.col("whole")).select("file").distinct()
        out = out.join(broken, "file", "left_anti")
    return out
