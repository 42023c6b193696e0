"""Byte-level BPE over whole text columns, from a file of ranks.

A text is split by a pattern; each piece is merged by itself. Pieces repeat, so every distinct one of a
block is encoded once: pieces of similar length are the rows of a padded matrix, and in every round each row
merges its leftmost pair of minimum rank. Ranks of pairs come from a hash table of numpy arrays; rows
without a further pair leave the matrix. Decoding looks up the bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from langmill.llm import spans
from langmill.llm.table import pick, spread_small
from langmill.llm.tokens import segments

_NONE = np.int32(2**31 - 1)  # rank of two ids that do not merge
_CELLS = 1 << 20  # cells of a matrix of pieces
#: Pieces of more bytes are merged alone.
LONG = 128
#: Bytes of the table of segments that a worker keeps with their ids; beyond, it starts anew. An entry counts so many
#: bytes besides its own: a key, a slot, a number.
KEPT, ENTRY = 1 << 26, 200

# Letters and numbers assigned after the version of Unicode that the tiktoken library knows. It splits
# them like signs.
LATER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _class(ranges: str) -> str:
    return "[" + "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in ranges.split()) + "]"


_LATER = regex.compile(_class(LATER_LETTERS + " " + LATER_NUMBERS))
_SIGN = "\ue000"  # neither letter, number nor white space


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PairTable:
    """Ranks of pairs of ids in an open hash table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.mask = np.uint64((1 << max(10, int(2 * len(rank)).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, -1, dtype=np.int64)
        self.ranks = np.full(int(self.mask) + 1, _NONE, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):  # the first of the keys that want a free slot gets it, the others go on
            free = todo[self.keys[slot[todo]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], rank[put]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & int(self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (spans.mix(keys.astype(np.uint64)) & self.mask).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; an id below zero merges with nothing."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(len(left), _NONE, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[todo].astype(np.int64) << 32) | right[todo]
        slot = self._slot(keys)
        while len(todo):
            there = self.keys[slot]
            hit = there == keys
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != -1)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & int(self.mask)
        return out.reshape(shape)


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1024, dtype=kind), 0

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            grown = np.zeros(self.n + len(more) + len(self.held) // 2, dtype=self.held.dtype)
            grown[: self.n] = self.values
            self.held = grown
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)


class Coder:
    """Encodes and decodes with one file of ranks; ids are ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        missing = [i for i in range(256) if bytes([i]) not in self.ranks]
        if missing:
            raise ValueError(f"{path} has no rank for the bytes {missing}")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = [
            (self.ranks[token[:i]], self.ranks[token[i:]], rank) for token, rank in self.ranks.items() for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        self.pairs = PairTable(*np.array(pairs or [(0, 0, _NONE)], dtype=np.int64).T)
        # Bytes of all ids, one after the other.
        self.width = np.zeros(max(self.ranks.values()) + 1, dtype=np.int64)
        for token, rank in self.ranks.items():
            self.width[rank] = len(token)
        self.place = np.concatenate(([0], np.cumsum(self.width)))[:-1]
        self.bytes = np.zeros(int(self.width.sum()), dtype=np.uint8)
        for token, rank in self.ranks.items():
            self.bytes[self.place[rank] : self.place[rank] + len(token)] = np.frombuffer(token, dtype=np.uint8)
        self.pattern = regex.compile(pattern)
        if self.pattern.groups:
            raise ValueError("the pattern must not have groups")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # segment i has the ids pool[place[i] : place[i] + size[i]]
        self.at, self.size, self.pool = (Growing(kind) for kind in (np.int64, np.int64, np.int32))
        self.held = 0

    # --- splitting ---

    def split(self, text: str) -> list[str]:
        """Matches of the pattern; what lies between them has no ids."""
        if text.isascii() or not _LATER.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(_LATER.sub(_SIGN, text))]

    # --- merging ---

    def pieces(self, items: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray | None] = [None] * len(items)
        lengths = np.array([len(x) for x in items])
        rest = []
        for i, item in enumerate(items):
            rank = self.ranks.get(item)
            if rank is not None:
                out[i] = np.array([rank], dtype=np.int32)
            elif len(item) > LONG:
                out[i] = self.long(self.byte[np.frombuffer(item, dtype=np.uint8)])
            else:
                rest.append(i)
        rest = sorted(rest, key=lambda i: lengths[i])
        first = 0
        while first < len(rest):  # rows of one matrix differ in length by less than a factor of two
            width = 1 << max(int(lengths[rest[first]]) - 1, 1).bit_length()
            last = min(first + max(_CELLS // width, 1), int(np.searchsorted(lengths[rest], width, side="right")))
            chosen = rest[first:last]
            flat = self.byte[np.frombuffer(b"".join(items[i] for i in chosen), dtype=np.uint8)]
            size = lengths[chosen]
            matrix = np.full((len(chosen), width), -1, dtype=np.int32)
            matrix[np.arange(width) < size[:, None]] = flat
            for i, ids in zip(chosen, self.matrix(matrix)):
                out[i] = ids
            first = last
        return out

    def matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Ids of each row, padded by -1: a round merges the leftmost pair of minimum rank of every row."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(ids)
        rows = np.arange(len(ids))
        ranks = self.pairs.of(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)  # the first of equals
            best = ranks[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                for row, line in zip(rows[done], ids[done]):
                    out[row] = line[line >= 0]
                # Compaction: finished rows go, and columns that no row fills any more.
                rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
                if not len(rows):
                    break
                width = int((ids >= 0).sum(axis=1).max())
                ids, ranks = ids[:, :width], ranks[:, : width - 1]
            line, width = np.arange(len(rows)), ids.shape[1]
            shift = np.arange(width) + (np.arange(width) > at[:, None])
            padded = np.concatenate((ids, np.full((len(rows), 1), -1, dtype=np.int32)), axis=1)
            ids = np.take_along_axis(padded, shift, axis=1)
            ids[line, at] = best
            padded = np.concatenate((ranks, np.full((len(rows), 1), _NONE, dtype=np.int32)), axis=1)
            ranks = np.take_along_axis(padded, shift[:, : width - 1], axis=1)
            # Only the pairs on both sides of the merged one are new.
            after = np.where(at + 1 < width, ids[line, np.minimum(at + 1, width - 1)], -1)
            before = np.where(at > 0, ids[line, np.maximum(at - 1, 0)], -1)
            inside = at < width - 1
            ranks[line[inside], at[inside]] = self.pairs.of(best, after)[inside]
            inside = at > 0
            ranks[line[inside], at[inside] - 1] = self.pairs.of(before, best)[inside]
        return out

    def long(self, ids: np.ndarray) -> np.ndarray:
        """Ids of one long piece: a round merges all pairs of minimum rank from the left, as one after the other would.

        That holds as long as no merged pair makes a pair of lower rank with its neighbours; the first that does is the
        last of its round.
        """
        ranks = self.pairs.of(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == best)
            run = np.cumsum(np.diff(at, prepend=-2) > 1)  # pairs that overlap: every other one of a run from its start
            start = np.flatnonzero(np.diff(run, prepend=0))
            at = at[(np.arange(len(at)) - start[run - 1]) % 2 == 0]
            new = np.full(len(at), best, dtype=np.int32)
            before = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
            before[1:] = np.where(np.diff(at) == 2, best, before[1:])
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            lower = (self.pairs.of(before, new) < best) | (self.pairs.of(new, after) < best)
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            ids = ids.copy()
            ids[at] = best
            kept = np.ones(len(ids), dtype=bool)
            kept[at + 1] = False
            place = at - np.arange(len(at))  # of the merged ones among those kept
            ids = ids[kept]
            # A pair goes with its right id, so that its rank stays beside its left one; those at merged ids are new.
            ranks = np.concatenate((ranks, [_NONE]))[kept][: len(ids) - 1]
            near = np.unique(np.concatenate((place, place - 1)))
            near = near[(near >= 0) & (near < len(ids) - 1)]
            ranks[near] = self.pairs.of(ids[near], ids[near + 1])
        return ids

    # --- columns ---

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Blocks: first row, end row, ids of all its rows, offsets of the rows among the ids."""
        for a, b, data, offsets in spans.blocks(texts):
            start = segments(data, offsets)
            end = np.concatenate((start[1:], [len(data)])).astype(np.int64) if len(start) else start
            first, inverse = _distinct(data, start, end)
            raw = data.tobytes()
            which = self._segments([raw[x:y] for x, y in zip(start[first].tolist(), end[first].tolist())])[inverse]
            size = self.size.values[which]
            cut = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, offsets)]
            yield a, b, self.pool.values[ragged(self.at.values[which], size)], cut

    def _segments(self, items: list[bytes]) -> np.ndarray:
        """Places of distinct segments in the table of this worker; those not there are encoded and added."""
        missing = [x for x in items if x not in self.known]
        if missing and self.held > KEPT:
            self._forget()
            missing = items
        if missing:
            owner, flat = [], []
            for i, x in enumerate(missing):
                found = self.split(x.decode("utf-8", "replace"))
                flat += found
                owner += [i] * len(found)
            place = {p: k for k, p in enumerate(dict.fromkeys(flat))}
            ids = self.pieces([p.encode() for p in place])
            which = np.array([place[p] for p in flat], dtype=np.int64)
            width = np.array([len(x) for x in ids], dtype=np.int64)
            all_ids = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
            size = np.bincount(np.array(owner, dtype=np.int64), width[which], len(missing)).astype(np.int64)
            self.at.extend(len(self.pool.values) + np.cumsum(size) - size)
            self.size.extend(size)
            self.pool.extend(all_ids[ragged((np.cumsum(width) - width)[which], width[which])])
            self.known.update(zip(missing, range(len(self.known), len(self.known) + len(missing))))
            self.held += sum(map(len, missing)) + ENTRY * len(missing)
        return np.array([self.known[x] for x in items], dtype=np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, one after the other."""
        if len(ids) and (int(ids.max()) >= len(self.width) or not self.width[ids].all()):
            raise ValueError("an id has no bytes in the file of ranks")
        return self.bytes[ragged(self.place[ids], self.width[ids])]


def ragged(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices place, place + 1, ..., ``size`` of them, for each item."""
    total = np.concatenate(([0], np.cumsum(size)))
    return np.arange(total[-1]) + np.repeat(place - total[:-1], size)


def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each distinct segment, and which of them each segment is; equal fingerprints are compared byte by byte."""
    _, first, inverse = np.unique(spans.Prints(data).of(start, end), return_index=True, return_inverse=True)
    same, size = first[inverse], end - start
    if np.array_equal(size, size[same]) and np.array_equal(data, data[ragged(start[same], size)]):
        return first, inverse
    raw = data.tobytes()
    seen: dict[bytes, int] = {}
    inverse = np.array([seen.setdefault(raw[x:y], len(seen)) for x, y in zip(start.tolist(), end.tolist())])
    return np.unique(inverse, return_index=True)[1], inverse


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """The coder of this Python worker."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of a buffer as a column of bytes."""
    offsets = np.ascontiguousarray(offsets, dtype=np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return column.cast(pa.binary())


def encode(docs: DataFrame, *, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit numbers) of every row, in its whole text.

    Null and empty texts have no ids. Repeated rows and null ids each keep their row. The ids are those of the tiktoken
    library without special tokens: strings like ``<|endoftext|>`` are plain text. Bytes that are no UTF-8 count as
    U+FFFD. A segment (a word with the space before it) is kept by a worker with its ids; a piece of any length is
    merged whole. ``ranks`` is a path that every executor can open.
    """
    rows = pick(docs, id=id_col, text=text_col)
    path, split = ranks or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, split)
        for batch in batches:
            for a, b, ids, cut in own.encode(batch.column("text")):
                column = _binary(ids.astype("<u4").view(np.uint8), 4 * cut)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(np.diff(cut)), column], ["id", "n_tokens", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return spread_small(rows).mapInArrow(run, f"id {kind}, n_tokens long, ids binary")


def decode(coded: DataFrame, *, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows of ``encode`` with ``decoded``, the bytes of their ids. Null ids give no bytes; unknown ones are an error."""
    path, split = ranks or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, split)
        for batch in batches:
            for a, b, data, offsets in spans.blocks(batch.column("ids"), kind=pa.large_binary()):
                ids = np.frombuffer(data.tobytes(), dtype="<u4")
                ends = np.concatenate(([0], np.cumsum(own.width[ids])))[offsets // 4]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, _binary(own.decode(ids), ends)], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"{name} {kind}" for name, kind in coded.dtypes)
    return coded.mapInArrow(run, f"{schema}, decoded binary")
