"""Jaccard join of documents on word shingles: T-occurrence search in the way of DivideSkip.

A set's shingles are dealt by hash to K buckets. Sets of like sizes that link differ in at most D shingles, so they agree
on T = K - D of their buckets or more. An inverted index lists the sets by the content of a bucket; its lists are short, since
all shingles of a bucket have to be the same, and are merged by the shuffle. The long lists, those of empty buckets, are
never read: K leaves room for as many, so linked sets still meet in a short one. A set with more empty buckets
than that has those lists too. What is left of the count is probed by binary search in a candidate's shingles.

K belongs to a range of sizes; a set is listed for its own range and the next one, where larger sets that it can link
with are. Lists go to the shuffle as blocks of numbers, once for each set and task, and only those that several sets share
come back as rows. Candidates carry parities: one bit for each hash bucket of shingles, telling whether the bucket holds an odd
number. Two sets differ in at least as many shingles as their parities differ in bits, so a pair whose
parities differ too much needs no probe. Lists of large groups are not turned into pairs. In a few turns,
every member of a list meets a few leaders of the turn and is compared with the likest one that it is still apart from; members
and leaders carry coarse parities, so that only those that may be alike make a pair. What the links of a turn join is contracted; only
members that are then still in different components are paired, in the first list that both are in. No step loses a link
between components.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmill.llm import spans
from langmill.llm.components import components, follow
from langmill.llm.table import pick, spread_small, staged, tasks
from langmill.session import broadcast_if_small

#: Buckets that may be empty besides one in so many, of those that linked sets can differ in.
SPARE, SPARE_SHARE = 3, 10
#: Turns in which lists choose new leaders, and leaders of a list; what they leave apart is paired, so they decide only the cost.
MOST_TURNS, LEADERS = 3, 8
#: Words of 64 parity bits that a set carries.
_PARITIES = [f"parity{i}" for i in range(16)]
#: Words of coarser parities, of several buckets each, that every entry of a list carries.
_COARSE = [f"coarse{i}" for i in range(4)]
#: Entries of lists that a task holds before it sends them, and entries that one group puts in order.
HELD, MET = 1 << 18, 1 << 20
#: Bytes of text and rows handled at once; a waiting worker keeps about the memory of its largest arrays.
BLOCK, ROWS = 1 << 19, 1 << 10


def shingle_sets(texts: pa.Array, words: int):
    """Blocks: first row, end row, distinct shingles sorted by row and value, offsets by row.

    A text with fewer words than a shingle is one shingle; one without words has none.
    """
    for a, b, data, offsets in spans.blocks(texts, BLOCK):
        data = spans.lower_ascii(data)
        start, end, row = spans.words(data, offsets)
        word = spans.Prints(data).of(start, end)
        first, gram = spans.grams(word, row, words)
        owner = row[first]
        size = np.bincount(row, minlength=b - a)
        short = np.flatnonzero((size > 0) & (size < words))
        if len(short):
            at = spans.per_row(row, b - a)
            more = [spans.grams(word[at[r] : at[r + 1]], row[at[r] : at[r + 1]], int(size[r]))[1][0] for r in short.tolist()]
            owner, gram = np.concatenate((owner, short)), np.concatenate((gram, np.array(more, dtype=np.uint64)))
        order = np.lexsort((gram, owner))
        owner, gram = owner[order], gram[order]
        new = np.ones(len(gram), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
        yield a, b, gram[new], spans.per_row(owner[new], b - a)


def _names(gram: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set of shingles; 0 for the empty set."""
    total = np.zeros(len(gram) + 1, dtype=np.uint64)
    np.cumsum(spans.mix(gram, 3), out=total[1:])
    name = spans.mix((total[cut[1:]] - total[cut[:-1]]) + (cut[1:] - cut[:-1]).astype(np.uint64), 9)
    return np.where(cut[1:] > cut[:-1], name, 0).astype(np.int64)


def _parities(gram: np.ndarray, owner: np.ndarray, n: int) -> list[pa.Array]:
    """One bit for each bucket of a row's shingles, set if the bucket holds an odd number of them."""
    width = 64 * len(_PARITIES)
    bucket = ((spans.mix(gram, 21) >> np.uint64(32)) % np.uint64(width)).astype(np.int64)
    packed = np.zeros((n, len(_PARITIES)), dtype=np.int64)
    for first in range(0, n, ROWS):
        end = min(first + ROWS, n)
        a, b = np.searchsorted(owner, (first, end))
        odd = (np.bincount((owner[a:b] - first) * width + bucket[a:b], minlength=(end - first) * width) & 1).astype(np.uint8)
        packed[first:end] = np.packbits(odd.reshape(-1, width), axis=1).view(np.int64)
    return [pa.array(np.ascontiguousarray(packed[:, i])) for i in range(len(_PARITIES))]


def _ranges(percent: int, most: int) -> np.ndarray:
    """Smallest sizes of the ranges up to that of ``most``, and of two more: sets of a range link with those of the next at most."""
    low = [1]
    while low[-1] <= most:
        low.append(100 * low[-1] // percent + 1)
    return np.array([*low, 100 * low[-1] // percent + 1], dtype=np.int64)


def _sizes(n: np.ndarray, percent: int, above: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Range, buckets that may be empty and number of buckets of every row, for the range of its size (or ``above`` that)."""
    low = _ranges(percent, int(n.max(initial=0)))
    place = np.searchsorted(low, n, side="right") - 1 + above
    apart = (100 - percent) * 2 * (low[place + 1] - 1) // (100 + percent)
    spare = SPARE + apart // SPARE_SHARE
    return place, spare, np.where(100 * n >= percent * (n + 1), apart + 1 + spare, 0)


def _contents(gram: np.ndarray, owner: np.ndarray, n: np.ndarray, percent: int, above: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the buckets of every row and their offsets by row, for the range of its size (or ``above`` that).

    Empty buckets are left out, but for rows with more of them than linked sets need. Rows that link with their equals only have none.
    """
    place, spare, size = _sizes(n, percent, above)
    first = np.concatenate(([0], np.cumsum(size)))
    inside = size[owner] > 0
    gram, owner = gram[inside], owner[inside]
    at = first[owner] + (spans.mix(gram, 31) % size[owner].astype(np.uint64)).astype(np.int64)
    value = spans.mix(gram, 37)
    # sums modulo 2 ** 64 by halves: each is exact in double precision
    halves = [np.bincount(at, part.astype(np.float64), first[-1]).astype(np.uint64) for part in (value & np.uint64(0xFFFFFFFF), value >> np.uint64(32))]
    row = np.repeat(np.arange(len(n)), size)
    own = (np.arange(first[-1]) - first[row]).astype(np.uint64) * np.uint64(4096) + place[row].astype(np.uint64)
    name = spans.mix(halves[0] + (halves[1] << np.uint64(32)) + spans.mix(own, 41), 43)
    empty = np.bincount(at, minlength=first[-1]) == 0
    short_of = np.bincount(row[empty], minlength=len(n)) > spare
    kept = ~empty | short_of[row]
    return name[kept].astype(np.int64), spans.per_row(row[kept], len(n))


def _freeing(batches):
    """``batches``; at their end memory that Arrow keeps for later goes back, since workers wait beside the steps that follow."""
    yield from batches
    pa.default_memory_pool().release_unused()


def sets(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Staged ``id, node, n, listed`` and parities of every row: name and size of its set, number of its buckets for both ranges."""
    def build(batches):
        for batch in batches:
            for a, b, gram, cut in shingle_sets(batch.column("text"), words):
                n = np.diff(cut)
                listed = sum(_sizes(n, percent, above)[2] for above in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(_names(gram, cut)), pa.array(n), pa.array(listed), *_parities(gram, np.repeat(np.arange(b - a), n), b - a)],
                    ["id", "node", "n", "listed", *_PARITIES])

    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id {kind}, node long, n long, listed long, " + ", ".join(f"{c} long" for c in _PARITIES)
    return staged(rows.mapInArrow(lambda batches: _freeing(build(batches)), fields), "jaccard-sets")


def _listing(words: int, percent: int):
    def build(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, gram, cut in shingle_sets(batch.column("text"), words):
                node, n = _names(gram, cut), np.diff(cut)
                first = np.sort(np.unique(node, return_index=True)[1])
                new = np.zeros(len(n), dtype=bool)
                new[[i for i in first.tolist() if node[i] not in seen]] = True
                seen.update(node[new].tolist())
                owner, n = np.repeat(np.arange(len(n)), n), np.where(new, n, 0)
                lists = [spans.lists(*_contents(gram, owner, n, percent, above), pa.int64()) for above in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(node), *lists], ["node", "own", "next"]).filter(pa.array(new))

    return build


def _dealing(parts: int):
    def flush(held: dict[str, list]):
        for column, blocks in held.items():
            bucket, node = (np.concatenate(x) for x in zip(*blocks))
            part = (bucket.view(np.uint64) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            at, first = np.unique(part[order], return_index=True)
            ends = np.append(first, len(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array([column == "own"] * len(at), pa.bool_()), *(spans.lists(x[order], ends, pa.int64()) for x in (bucket, node))],
                ["part", "own", "bucket", "node"])

    def deal(batches):
        held, entries = {"own": [], "next": []}, 0
        for batch in batches:
            node = batch.column("node").to_numpy()
            for column, blocks in held.items():
                lists = batch.column(column)
                blocks.append((lists.flatten().to_numpy(), np.repeat(node, lists.value_lengths().to_numpy())))
                entries += len(blocks[-1][0])
            if entries > HELD:
                yield from flush(held)
                held, entries = {"own": [], "next": []}, 0
        if entries:
            yield from flush(held)

    return deal


_DEALT = "part int, own boolean, bucket array<long>, node array<long>"


def index(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """``node, own, next``: names of the buckets for both ranges, once for each set and task; sets that link with their equals only have none."""
    return rows.select("text").mapInArrow(_listing(words, percent), "node long, own array<long>, next array<long>")


def _dealt(indexed: DataFrame, parts: int) -> DataFrame:
    """Entries of the lists as blocks of numbers, dealt to ``parts`` by list: ``part, own, bucket, node``."""
    return indexed.mapInArrow(_dealing(parts), _DEALT)


def _dealt_index(rows: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """``_dealt`` of ``index`` by one worker a task: of two, both keep their memory for the steps that follow."""
    lists, deal = _listing(words, percent), _dealing(parts)
    return rows.select("text").mapInArrow(lambda batches: _freeing(deal(lists(batches))), _DEALT)


def _met(table: pa.Table) -> pa.Table:
    """``bucket, node, own`` of the lists of a part that hold several sets, one of them of the lists' own range at least."""
    bucket, node = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("bucket", "node"))
    size = table.column("bucket").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    own = np.repeat(table.column("own").to_numpy(), size)
    order = np.lexsort((node, bucket))
    bucket, node, own = bucket[order], node[order], own[order]
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1]))[: len(bucket)]
    bucket, node, own = bucket[new], node[new], own[new]
    # sets that are both of the range below have met in their own
    _, group, members = np.unique(bucket, return_inverse=True, return_counts=True)
    kept = (members > 1) & (np.bincount(group, own, len(members)) > 0)
    kept = kept[group]
    return pa.table({"bucket": bucket[kept], "node": node[kept], "own": own[kept]})


def _compatible(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _coarse() -> list:
    """Parities of buckets that several of ``_PARITIES`` make up together; what is said of the bits of those holds of these too."""
    step = len(_COARSE)
    return [functools.reduce(lambda x, y: x.bitwiseXOR(y), map(F.col, _PARITIES[i::step])).alias(c) for i, c in enumerate(_COARSE)]


def _apart(a: str, b: str, bits: list[str] = _PARITIES):
    """Bits in which the parities of two sets differ."""
    return sum((F.bit_count(F.col(f"{c}_{a}").bitwiseXOR(F.col(f"{c}_{b}"))) for c in bits), F.lit(0))


def _alike(a: str, b: str, percent: int, bits: list[str] = _PARITIES):
    """False only for sets whose parities differ in more bits than linked sets of their sizes can."""
    return (100 + percent) * _apart(a, b, bits) <= (100 - percent) * (F.col(f"n_{a}") + F.col(f"n_{b}"))


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Staged ``a, b, same, total``: sizes of intersection and union of the sets of distinct pairs."""
    texts = texts.select("node", "text")
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def probe(batches):
        for batch in batches:
            other = batch.column("text_b")
            for x, y, gram, cut in shingle_sets(batch.column("text_a"), words):
                same, total = np.zeros(y - x, dtype=np.int64), np.zeros(y - x, dtype=np.int64)
                for p, q, more, cut2 in shingle_sets(other.slice(x, y - x), words):
                    for i in range(p, q):
                        one, two = gram[cut[i] : cut[i + 1]], more[cut2[i - p] : cut2[i - p + 1]]
                        if len(one) > len(two):
                            one, two = two, one
                        at = np.searchsorted(two, one)
                        same[i] = np.count_nonzero(two[np.minimum(at, len(two) - 1)] == one) if len(two) else 0
                        total[i] = len(one) + len(two) - same[i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").slice(x, y - x), batch.column("b").slice(x, y - x), pa.array(same), pa.array(total)], ["a", "b", "same", "total"])

    return staged(both.mapInArrow(lambda batches: _freeing(probe(batches)), "a long, b long, same long, total long"), "jaccard-verified")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, node, component_id`` of every row of ``docs``.

    Two texts link when 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles
    (A-Z lower-cased). ``component_id`` is the smallest id reachable by links; rows without words (null
    text too) link with nothing and keep their own id. Repeated rows are equal sets; a null id is left out
    of the minimum unless the component has no other. Extra columns are left out.
    """
    rows = spread_small(pick(docs, id=id_col, text=text_col))
    found = sets(rows, words, percent)
    roots = _roots(rows, found, words, percent)
    named = staged(follow(found.select("id", "n", "node", F.col("node").alias("root")), "root", roots), "jaccard-roots")
    least = named.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    out = named.where("n > 0").join(least, "root").select("id", "n", "node", "component_id")
    out = out.union(named.where("n = 0").select("id", "n", "node", F.col("id").alias("component_id")))
    return out.withColumnsRenamed({"id": id_col, "n": "n_shingles"})


def _roots(rows: DataFrame, found: DataFrame, words: int, percent: int) -> DataFrame:
    """Staged ``node, root`` of every set that is linked, but for the roots themselves."""
    linked = F.expr(f"100 * same >= {percent} * total")
    carried = ["n", *_PARITIES]
    nodes = staged(found.where("listed > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in carried]), "jaccard-nodes")
    parts = max(tasks(rows), (found.agg(F.sum("listed")).first()[0] or 0) // MET)
    shared = _dealt_index(rows, words, percent, parts).groupBy("part").applyInArrow(_met, "bucket long, node long, own boolean")
    lists = staged(staged(shared, "jaccard-shared").join(nodes.select("node", "n", *_coarse()), "node").withColumn("root", F.col("node")), "jaccard-lists")
    texts = _texts(rows, staged(lists.select("node").distinct(), "jaccard-wanted"), words)
    one, two = (nodes.toDF(x, *[f"{c}_{x}" for c in carried]) for x in "ab")
    roots = checked = None
    for turn in range(MOST_TURNS):
        pairs = _led(lists, turn, percent)
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = pairs.join(one, "a").join(two, "b").where(_alike("a", "b", percent)).select("a", "b", _apart("a", "b").alias("apart"))
        pairs = pairs.groupBy("a").agg(F.min(F.struct("apart", F.xxhash64("b", F.lit(turn)), "b")).alias("leader")).select("a", F.col("leader.b").alias("b"))
        found = _verified(pairs, texts, words)
        new = found.where(linked).select("a", "b")
        both = found.select("a", "b").union(found.select("b", "a"))
        checked = both if checked is None else checked.union(both)
        roots, merged = _merged(roots, new)
        apart = follow(lists, "root", merged)
        mixed = apart.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
        lists = staged(apart.join(mixed, "bucket"), "jaccard-apart")
        if not merged.head(1) or not lists.head(1):
            break
    # members that no leader has joined: pairs of different components that their parities do not keep apart, in their first list
    inside = lists.groupBy("node", "own").agg(F.collect_list("bucket").alias("all"))
    lists = staged(lists.drop(*_COARSE).join(inside, ["node", "own"]).join(nodes.select("node", *_PARITIES), "node"), "jaccard-left")
    one, two = (_sided(lists, side) for side in "ab")
    first = F.array_min(F.array_intersect("all_a", "all_b")) == F.col("bucket")
    far = (one.join(two, "bucket").where("root_a < root_b and (own_a or own_b)").where(_compatible("n_a", "n_b", percent)).where(_alike("a", "b", percent)).where(first)
           .select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())
    far = far.join(checked, ["a", "b"], "left_anti")
    return _merged(roots, _verified(far, texts, words).where(linked).select("a", "b"))[0]


def _led(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """``a, b``: every member with the leaders of its lists, the same for all lists where it can be, unless coarse parities keep them apart."""
    slot, order = F.pmod(F.xxhash64(F.lit("slot"), "node", F.lit(turn)), F.lit(LEADERS)), F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", *_COARSE, "root", "own")
    leaders = lists.groupBy("bucket", slot.alias("slot")).agg(F.min(order).alias("leader")).select("bucket", *[f"leader.{c}" for c in lists.columns if c != "bucket"])
    pairs = _sided(lists, "a").join(_sided(leaders, "b"), "bucket").where("root_a != root_b and (own_a or own_b)").where(_compatible("n_a", "n_b", percent))
    return pairs.where(_alike("a", "b", percent, _COARSE)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _sided(lists: DataFrame, side: str) -> DataFrame:
    return lists.toDF(*[c if c == "bucket" else f"{c}_{side}" for c in lists.columns])


def _merged(roots: DataFrame | None, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, root`` once ``links`` are added to what ``roots`` joins, and the same for roots that they join to others."""
    if roots is None:
        merged = components(links)
        return merged, merged
    merged = components(follow(follow(links, "a", roots), "b", roots))
    return staged(follow(roots, "root", merged).union(merged), "jaccard-merged"), merged


def _texts(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Staged ``node, text`` of one document for each wanted set."""
    def name(batches):
        for batch in batches:
            for a, b, gram, cut in shingle_sets(batch.column("text"), words):
                yield pa.RecordBatch.from_arrays([pa.array(_names(gram, cut)), batch.column("text").slice(a, b - a)], ["node", "text"])

    named = rows.select("text").mapInArrow(lambda batches: _freeing(name(batches)), "node long, text string").join(broadcast_if_small(wanted)[0], "node", "left_semi")
    return staged(named.groupBy("node").agg(F.first("text").alias("text")), "jaccard-texts")
