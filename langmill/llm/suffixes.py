"""Repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Every string of ``length`` bytes has an anchor that its own bytes choose, so equal strings have equal
anchors. Anchors whose next bytes are unique drop out first. Tasks sort the suffixes at the other anchors
into runs, front-code them (length of the prefix shared with the one before, then the rest), and send each
key range to one task, which merges runs by a loser tree. Borders of ranges are whole suffixes, so those that
begin with the same passage are cut into as many ranges as others. The tree keeps, for every waiting suffix, how
long a prefix it shares with the last winner, and never reads those bytes again. Neighbours in sorted
order then show which strings occur twice.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmill.llm import spans
from langmill.llm.table import ROW, draw, keyed, pick, staged, tasks

#: Bytes behind an anchor that are compared by fingerprint first.
AHEAD = 100
#: Bytes of suffixes that a task sorts into one run, and suffixes for one key range.
RUN_BYTES, RANGE = 64 << 20, 20_000
#: Sampled suffixes for each key range and for each task that orders them.
OVER, ORDERED = 32, 1_000
#: Numbers of bytes before an anchor by which ranges first compare their open strings.
LEVELS = np.array([0, 4, 8, *range(16, 1 << 12, 16), *(2**k for k in range(12, 31))])
#: Between the suffix and the reversed bytes before it; no byte of UTF-8.
_END = b"\xff"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor, first and last string start that choose it, and print of the bytes ahead, for a block."""
    none = np.zeros(0, dtype=np.int64)
    n, reach = len(data), length - AHEAD + 1
    if n < length:
        return none, none, none, none
    prints = spans.Prints(data).of(np.arange(n - AHEAD + 1), np.arange(AHEAD, n + 1))
    bits = max(n.bit_length(), 8)
    order = (prints >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(prints), dtype=np.uint64)
    padded = np.full(-(-len(order) // reach) * reach, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(order)] = order
    table = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - length + 1)
    row = spans.rows_at(start, offsets)
    start = start[start + length <= offsets[row + 1]]
    if not len(start):
        return none, none, none, none
    at = (np.minimum(back[start], ahead[start + reach - 1]) & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1
    return at[first], start[first], start[last], prints[at[first]].astype(np.int64)


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    end = min(len(a), len(b))
    step = 32
    while known < end and a[known : known + step] == b[known : known + step]:
        known += step
    known = min(known, end)
    while known < end and a[known] == b[known]:
        known += 1
    return known


def front_coded(keys: list[bytes]) -> tuple[list[int], list[bytes]]:
    prefix = [shared(a, b) for a, b in zip([b"", *keys[:-1]], keys)]
    return prefix, [k[p:] for p, k in zip(prefix, keys)]


class Run:
    """A front-coded run: the current key and the prefix it shares with the last winner of the merge."""

    __slots__ = ("prefix", "tails", "counts", "at", "key", "same", "count")

    def __init__(self, prefix, tails, counts):
        self.prefix, self.tails, self.counts, self.at = prefix, tails, counts, -1
        self.key: bytes | None = b""
        self.advance()
        self.same = 0

    def advance(self) -> None:
        """Next key; called when the current one has won, so the coded prefix is shared with the winner."""
        self.at += 1
        if self.at == len(self.tails):
            self.key = None
            return
        self.same = self.prefix[self.at]
        self.key = self.key[: self.same] + self.tails[self.at]
        self.count = self.counts[self.at]


def merged(runs: list[Run]):
    """Distinct keys in order: ``(key, count, prefix shared with the key before)``."""
    size = 1 << max(0, (len(runs) - 1).bit_length())
    loser: list[Run | None] = [None] * size

    def play(a: Run | None, b: Run | None) -> tuple[Run | None, Run | None]:
        """Winner and loser; afterwards the loser knows the prefix it shares with this winner."""
        if a is None or a.key is None:
            return b, a
        if b is None or b.key is None:
            return a, b
        if a.same != b.same:  # the one that shares more with the last winner comes first; the other keeps its prefix
            return (a, b) if a.same > b.same else (b, a)
        n = shared(a.key, b.key, a.same)
        first = n == len(a.key) or (n < len(b.key) and a.key[n] < b.key[n])
        winner, other = (a, b) if first else (b, a)
        other.same = n
        return winner, other

    level: list[Run | None] = runs + [None] * (size - len(runs))
    place = {id(r): i for i, r in enumerate(runs)}
    base = size
    while base > 1:
        base //= 2
        pairs = [play(level[2 * i], level[2 * i + 1]) for i in range(base)]
        loser[base : 2 * base] = [p[1] for p in pairs]
        level = [p[0] for p in pairs]
    winner, key, count, same = level[0], None, 0, 0
    while winner is not None and winner.key is not None:
        if key is not None and winner.same == len(key) == len(winner.key):
            count += winner.count
        else:
            if key is not None:
                yield key, count, same
            key, count, same = winner.key, winner.count, winner.same
        at = (place[id(winner)] + size) // 2
        winner.advance()
        while at:
            winner, loser[at] = play(winner, loser[at])
            at //= 2
    if key is not None:
        yield key, count, same


def _class(key: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(key, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _intervals(found: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate(([0], found.astype(np.int8), [0])))
    return [{"from": int(a), "to": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _window_prints(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """Fingerprints of all strings of each context."""
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    ends = np.cumsum([len(c) for c in contexts])
    prints = spans.Prints(data)
    return [prints.of(np.arange(e - len(c), e - length + 1), np.arange(e - len(c) + length, e + 1)) for c, e in zip(contexts, ends.tolist())]


def _original(key: bytes) -> tuple[bytes, int]:
    """Bytes in text order and the offset of the anchor in them."""
    right, left = key.split(_END, 1)
    return left[::-1] + right, len(left)


def _by_mark(key: bytes, prints: np.ndarray, offsets: np.ndarray):
    """``(mark, prints, offsets)`` of a context's strings by their level, the largest that is at most their bytes before the anchor.

    The mark is a print of the bytes ahead of the anchor and as many before it as the level: equal strings have equal marks.
    """
    back = key.split(_END, 1)[1]
    level = np.searchsorted(LEVELS, len(back) - offsets, side="right") - 1
    for n in np.unique(level):
        yield _class(key[:AHEAD] + _END + back[: LEVELS[n]])[0], prints[level == n], offsets[level == n]


def repeats(entries: list[tuple[bytes, int, int]], length: int, low: bytes = b"", high: bytes = b""):
    """Per key of one sorted range: which strings occur twice, and strings that may occur in another range too.

    A key that occurs twice repeats all its strings. Other keys share strings only with keys that share the
    bytes ahead of the anchor, and those stand together. The range holds keys from border ``low`` to below ``high``
    (empty: no border). No key behind a border shares more bytes with a key than the border does, so a string
    is left open only if the border holds all its bytes behind the anchor: such strings are given once, as
    ``(key, mark, prints, offsets)``.
    """
    begin, out, open_ = 0, [], []
    while begin < len(entries):
        end = begin + 1
        while end < len(entries) and entries[end][2] >= AHEAD:
            end += 1
        group = entries[begin:end]
        contexts = [_original(k)[0] for k, _, _ in group]
        found = [np.full(len(c) - length + 1, n > 1) for c, (_, n, _) in zip(contexts, group)]
        reach = [max(shared(k, low), shared(k, high)) for k, _, _ in group] if begin == 0 or end == len(entries) else []
        edge = max(reach, default=0) >= AHEAD
        if edge or len(group) > 1 and not all(n > 1 for _, n, _ in group):
            prints = _window_prints(contexts, length)
            values, at, inverse, times = np.unique(np.concatenate(prints), return_index=True, return_inverse=True, return_counts=True)
            cuts = np.cumsum([len(p) for p in prints])[:-1]
            found = [f | o for f, o in zip(found, np.split(times[inverse] > 1, cuts))]
            if edge:  # strings found twice here are settled, and the first of them speaks for all in other ranges
                once = np.zeros(len(inverse), dtype=bool)
                once[at] = True
                behind = [np.arange(len(p)) + length - _original(k)[1] for (k, _, _), p in zip(group, prints)]
                once &= np.concatenate([b <= r for b, r in zip(behind, reach)])
                open_ += [(k, *m) for (k, _, _), p, o in zip(group, prints, np.split(once, cuts)) if o.any() for m in _by_mark(k, p[o], np.flatnonzero(o))]
        out += [(k, f) for (k, _, _), f in zip(group, found) if f.any()]
        begin = end
    return out, open_


def remove_repeats(docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row of ``docs``.

    A byte of the UTF-8 text goes if a string of ``length`` bytes over it starts anywhere else too, in the
    same row or another. Rows are told apart by position, so repeated rows and null ids are rows of their
    own; a null text is empty. ``kept`` holds the bytes left (cuts may fall inside a character).
    """
    rows = keyed(pick(docs, id=id_col, text=text_col), "suffixes")

    def find(batches):
        for batch in batches:
            for a, b, data, offsets in spans.blocks(batch.column("text")):
                at, first, last, print_ = anchors(data, offsets, length)
                row = spans.rows_at(at, offsets)
                base = offsets[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(ROW).take(pa.array(a + row)), *(pa.array((x - base).astype(np.int32)) for x in (at, first, last)), pa.array(print_)],
                    [ROW, "at", "first", "last", "print"])

    found = staged(rows.select(ROW, "text").mapInArrow(find, f"{ROW} long, at int, first int, last int, print long"), "suffixes-anchors")
    repeated = found.groupBy("print").count().where("count > 1").select("print")
    marked = staged(found.join(repeated, "print").drop("print"), "suffixes-marked")
    splits = _splits(rows, marked, length)
    sorted_ = _with_anchors(rows, marked).mapInArrow(_runs(splits, length), _RUNS)
    sorted_ = staged(sorted_, "suffixes-runs")
    runs = sorted_.where("range is not null").select("range", "prefix", "counts", "tails")
    classes = staged(runs.groupBy("range").applyInArrow(_merge(splits, length), _CLASSES), "suffixes-classes")
    again = classes.where("mark is null").select("one", "two", "intervals")
    open_ = classes.where("mark is not null").select("one", "two", "range", "mark", "open")
    across = open_.groupBy("mark").agg(F.min("range").alias("low"), F.max("range").alias("high")).where("low < high").select("mark")
    open_ = open_.join(across, "mark").select("one", "two", F.inline("open"))
    many = open_.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    more = open_.join(many, "print").select("one", "two", F.array(F.struct(F.col("offset").alias("from"), (F.col("offset") + 1).alias("to"))).alias("intervals"))
    intervals = again.union(more).groupBy("one", "two").agg(F.flatten(F.collect_list("intervals")).alias("intervals"))
    places = sorted_.where("range is null").select(ROW, "first", "one", "two").join(intervals, ["one", "two"])
    cover = places.groupBy(ROW).agg(F.collect_list(F.struct("first", "intervals")).alias("cover"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.join(cover, ROW, "left").select("id", "text", "cover").mapInArrow(_cut(length), f"id {kind}, {_CUT}")
    return out.withColumnRenamed("id", id_col)


_RUNS = f"{ROW} long, first int, one long, two long, range int, prefix array<int>, counts array<int>, tails array<binary>"
_CLASSES = "one long, two long, intervals array<struct<from:int,to:int>>, range int, mark long, open array<struct<print:long,offset:int>>"
_CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _with_anchors(rows: DataFrame, marked: DataFrame) -> DataFrame:
    by_row = marked.groupBy(ROW).agg(F.collect_list(F.struct("at", "first", "last")).alias("anchors"))
    return rows.select(ROW, "text").join(by_row, ROW)


def _key(raw: bytes, anchor: dict, length: int) -> bytes:
    return raw[anchor["at"] : anchor["last"] + length] + _END + raw[anchor["first"] : anchor["at"]][::-1]


def _splits(rows: DataFrame, marked: DataFrame, length: int) -> list[bytes]:
    """Borders of key ranges of about ``RANGE`` suffixes, at least one range for each task.

    They are keys of a sample that grows with the number of ranges, each cut after the first byte that tells it
    from the sampled key before. They decide the balance only.
    """
    many = marked.count()
    wanted = OVER * max(tasks(rows), many // RANGE)

    def keys(batches):
        for batch in batches:
            texts = [text.as_buffer().to_pybytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_key(raw, f, length) for raw, found in zip(texts, batch.column("anchors").to_pylist()) for f in found], pa.binary())], ["key"])

    def borders(batches):
        before, n, out = b"", 0, []
        for batch in batches:
            for key in batch.column("key").to_pylist():
                if n % OVER == 0:
                    out.append(key[: shared(before, key) + 1] if n else key)
                before, n = key, n + 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["key"])

    drawn = marked.where(draw("suffix-border", ROW, "at") * many < wanted)
    sample = staged(_with_anchors(rows, drawn).mapInArrow(keys, "key binary"), "suffixes-sample")
    ordered = sample.repartitionByRange(min(tasks(rows), -(-wanted // ORDERED)), "key").sortWithinPartitions("key")
    return sorted({r["key"] for r in ordered.mapInArrow(borders, "key binary").collect()})


def _runs(splits: list[bytes], length: int):
    def flush(keys: dict[bytes, int]):
        ordered = sorted(keys)
        groups: dict[int, list[bytes]] = {}
        for k in ordered:
            groups.setdefault(bisect_right(splits, k), []).append(k)
        coded = [front_coded(g) for g in groups.values()]
        n = len(groups)
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([
            none, none.cast(pa.int32()), none, none, pa.array(groups, pa.int32()), pa.array([c[0] for c in coded], pa.list_(pa.int32())),
            pa.array([[keys[k] for k in g] for g in groups.values()], pa.list_(pa.int32())), pa.array([c[1] for c in coded], pa.list_(pa.binary()))],
            [ROW, "first", "one", "two", "range", "prefix", "counts", "tails"])

    def sort(batches):
        keys: dict[bytes, int] = {}
        held = 0
        for batch in batches:
            places = []
            for row, text, found in zip(batch.column(ROW).to_pylist(), batch.column("text"), batch.column("anchors").to_pylist()):
                raw = text.as_buffer().to_pybytes()
                for f in found:
                    key = _key(raw, f, length)
                    places.append((row, f["first"], *_class(key)))
                    held += 0 if key in keys else len(key)
                    keys[key] = keys.get(key, 0) + 1
            n = len(places)
            columns = [pa.array(c, t) for c, t in zip(zip(*places), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))] if n else []
            lists = [pa.nulls(n, t) for t in (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()))]
            if n:
                yield pa.RecordBatch.from_arrays([*columns, *lists], [ROW, "first", "one", "two", "range", "prefix", "counts", "tails"])
            if held > RUN_BYTES:
                yield from flush(keys)
                keys, held = {}, 0
        if keys:
            yield from flush(keys)

    return sort


def _merge(splits: list[bytes], length: int):
    interval = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    string = pa.struct([("print", pa.int64()), ("offset", pa.int32())])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        at = key[0].as_py()
        columns = [table.column(c).to_pylist() for c in ("prefix", "tails", "counts")]
        entries = list(merged([Run(*x) for x in zip(*columns)]))
        found, open_ = repeats(entries, length, splits[at - 1] if at else b"", splits[at] if at < len(splits) else b"")
        names = [_class(k) for k, *_ in [*found, *open_]]
        strings = [pa.array([p.astype(np.int64) for *_, p, _ in open_], pa.list_(pa.int64())).flatten(), pa.array([o.astype(np.int32) for *_, o in open_], pa.list_(pa.int32())).flatten()]
        ends = pa.array(np.cumsum([0, *(len(p) for *_, p, _ in open_)]), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(strings, fields=list(string)))
        return pa.table({
            "one": pa.array([n[0] for n in names], pa.int64()), "two": pa.array([n[1] for n in names], pa.int64()),
            "intervals": pa.concat_arrays([pa.array([_intervals(f) for _, f in found], interval), pa.nulls(len(open_), interval)]),
            "range": pa.array([at] * len(names), pa.int32()), "mark": pa.array([None] * len(found) + [m for _, m, _, _ in open_], pa.int64()),
            "open": pa.concat_arrays([pa.nulls(len(found), lists.type), lists]),
        })

    return merge


def _cut(length: int):
    def cut(batches):
        for batch in batches:
            out = []
            for text, cover in zip(batch.column("text"), batch.column("cover").to_pylist()):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                change = np.zeros(len(raw) + 1, dtype=np.int64)
                for c in cover or ():
                    for i in c["intervals"]:
                        change[c["first"] + i["from"]] += 1
                        change[c["first"] + i["to"] - 1 + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return cut
