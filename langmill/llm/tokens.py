"""Token ids of whole text columns by a public byte-level BPE tokenizer.

The tokenizer splits a text before it merges, so a text can be encoded in segments that end where it
always splits: a word with the single space before it, and white space in front of that. Segments repeat
a lot, so each Python worker keeps their ids in a table by fingerprint (``SLOTS`` segments, ``KEPT`` ids).
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from langmill.llm import spans

SLOTS = 1 << 22
KEPT = 20_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True


def segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the segments: no token of the byte-level BPE crosses one, and none depends on its neighbours.

    Runs of white space within a text are cut before their last character, which begins the next word
    if it is a space and stands alone otherwise.
    """
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    blank = _SPACES[data]
    first = np.zeros(len(data), dtype=bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    next_word = np.concatenate((~blank[1:], [False]))
    next_word[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False  # the last byte of a text has no next one
    before = np.concatenate(([False], blank[:-1]))
    start = blank & ~before  # a run of white space begins
    start |= blank & next_word  # its last character
    start |= ~blank & before & ~np.concatenate(([False], data[:-1] == 0x20))  # a word after other white space
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):  # runs of white space that go on beyond ASCII are not cut there
        for i in lead[_wide_space(data, lead)].tolist():
            start[[i, min(i + (2 if data[i] == 0xC2 else 3), len(data) - 1)]] = False
            start[max(i - 1, 0)] &= bool(not blank[i - 1] or not before[i - 1]) if i else False
    start |= first
    return np.flatnonzero(start)


def _wide_space(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Which of the leading bytes begin a white-space character beyond ASCII."""
    padded = np.concatenate((data[: len(data)], [0, 0]))
    a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
    return (
        ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        | ((a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F))))
    )


class Encoder:
    """Encodes text columns; one instance for each worker and tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # bytes of each id
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # a byte-level token writes each byte as one character
        self.known = np.zeros(SLOTS, dtype=np.uint64)
        self.place = np.zeros(SLOTS, dtype=np.int64)  # the ids of slot i are ids[place[i] : place[i] + size[i]]
        self.size = np.zeros(SLOTS, dtype=np.int32)
        self.ids, self.used = np.zeros(SLOTS, dtype=np.uint32), 0

    def dtype(self, *more: int) -> np.dtype:
        """Smallest little-endian type that holds every id."""
        return np.dtype("<u2" if max(len(self.width) - 1, *more) < 1 << 16 else "<u4")

    def _encode(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given segments, one after the other, and the number of ids of each."""
        data = np.frombuffer(raw, dtype=np.uint8)
        joined = (data[start] == 0x20) & (end - start > 1)  # a space and a word: splits wherever it stands
        size = np.zeros(len(start), dtype=np.int64)
        parts: list[np.ndarray] = []
        owner = [np.flatnonzero(joined), np.flatnonzero(~joined)]
        texts = [raw[x:y].decode() for x, y in zip(start[owner[0]].tolist(), end[owner[0]].tolist())]
        runs = ["".join(texts[i : i + 2000]) for i in range(0, len(texts), 2000)]
        for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False):
            parts.append(np.array(e.ids, dtype=np.uint32))
        if parts:
            ids = np.concatenate(parts)
            ends = np.concatenate(([0], np.searchsorted(np.cumsum(self.width[ids]), np.cumsum((end - start)[owner[0]])) + 1))
            size[owner[0]] = np.diff(ends)
        alone = [raw[x:y].decode() for x, y in zip(start[owner[1]].tolist(), end[owner[1]].tolist())]
        for k, e in zip(owner[1].tolist(), self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            size[k] = len(e.ids)
            parts.append(np.array(e.ids, dtype=np.uint32))
        order = np.concatenate(owner)
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        place = np.zeros(len(start), dtype=np.int64)
        place[order] = np.concatenate(([0], np.cumsum(size[order])))[:-1]
        return flat[_ragged(place, size)], size

    def strings(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts without the cache."""
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def column(self, texts: pa.Array):
        """Blocks: first row, end row, ids of all its rows, offsets of the rows among the ids."""
        for a, b, data, offsets in spans.blocks(texts):
            raw = data.tobytes()
            whole = []
            if any(s in raw for s in self.special):  # a special token may span words: such rows are encoded whole
                rows = [raw[x:y] for x, y in zip(offsets[:-1], offsets[1:])]
                whole = [i for i, x in enumerate(rows) if any(s in x for s in self.special)]
                data, offsets = self._without(rows, set(whole))
                raw = data.tobytes()
            start = segments(data, offsets)
            end = np.concatenate((start[1:], [len(data)])).astype(np.int64) if len(start) else start
            ids, size = self._segments(spans.Prints(data).of(start, end), start, end, raw)
            cut = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, offsets)]
            if whole:
                parts = np.split(ids, cut[1:-1])
                for i, more in zip(whole, self.strings([rows[i].decode() for i in whole])):
                    parts[i] = more
                ids, cut = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
            yield a, b, ids, cut

    @staticmethod
    def _without(rows: list[bytes], left_out: set[int]) -> tuple[np.ndarray, np.ndarray]:
        kept = [b"" if i in left_out else x for i, x in enumerate(rows)]
        return np.frombuffer(b"".join(kept), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in kept]))).astype(np.int64)

    def _segments(self, prints: np.ndarray, start, end, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments and the number of ids of each; those not in the table are encoded and put there."""
        slot = (prints & np.uint64(SLOTS - 1)).astype(np.int64)
        missing = np.flatnonzero(self.known[slot] != prints)
        place, size = self.place[slot], self.size[slot].astype(np.int64)
        pool = self.ids
        if len(missing):
            _, first, inverse = np.unique(prints[missing], return_index=True, return_inverse=True)
            f = missing[first]
            new, width = self._encode(raw, start[f], end[f])
            if self.used + len(new) > len(self.ids):
                grown = np.zeros(2 * (self.used + len(new)), dtype=np.uint32)
                grown[: self.used] = self.ids[: self.used]
                self.ids = grown
            self.ids[self.used : self.used + len(new)] = new
            at = self.used + np.concatenate(([0], np.cumsum(width)))[:-1]
            self.used += len(new)
            place[missing], size[missing] = at[inverse], width[inverse]
            pool = self.ids
            self.known[slot[f]], self.place[slot[f]], self.size[slot[f]] = prints[f], at, width
        out = pool[_ragged(place, size)]
        if self.used > KEPT:
            self.known[:] = 0
            self.ids, self.used = np.zeros(SLOTS, dtype=np.uint32), 0
        return out, size


def _ragged(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices place, place + 1, ..., size of them, for each item."""
    total = np.concatenate(([0], np.cumsum(size)))
    return np.arange(total[-1]) + np.repeat(place - total[:-1], size)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
