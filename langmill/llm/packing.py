"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of packets (pieces of documents of at most one sequence). A window is a turn of
the round: every source gets a quantum of tokens in proportion to its target and gives the packets that
begin within the credit it has gathered; what the last packet overdraws or leaves is its deficit and
changes what it gives next. Credit after k windows is k quanta, so the packet that begins at token t of
its queue leaves in window floor(t / quantum): all windows of all partitions follow from running sums.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from langmill.llm import tokens
from langmill.llm.table import ROW, pick, spread_small, staged, starts

#: Windows whose sums are added up by one task; sums of so many windows are added up by one task again.
_BLOCK = 4096


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Staged ``id, src, n, ids``: ids of every text with ``end_id`` behind them, as little-endian numbers."""
    rows = pick(docs, id=id_col, text=text_col, src=source_col)

    def encode(batches):
        coder = tokens.encoder(path)
        kind = coder.dtype(end_id)
        for batch in batches:
            for a, b, ids, cut in coder.column(batch.column("text")):
                size = np.diff(cut) + 1
                ends = np.cumsum(size)
                flat = np.full(ends[-1], end_id, dtype=kind)
                hole = np.ones(len(flat), dtype=bool)
                hole[ends - 1] = False
                flat[hole] = ids
                offsets = pa.array(np.concatenate(([0], ends)) * kind.itemsize, pa.int64())
                ids = pa.Array.from_buffers(pa.large_binary(), b - a, [None, offsets.buffers()[1], pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), batch.column("src").slice(a, b - a), pa.array(size), ids.cast(pa.binary())],
                    ["id", "src", "n", "ids"],
                )

    kind, source = (rows.schema[c].dataType.simpleString() for c in ("id", "src"))
    found = spread_small(rows).mapInArrow(encode, f"id {kind}, src {source}, n long, ids binary")
    return staged(found.withColumn(ROW, F.monotonically_increasing_id()), "pack-ids")


def pack(docs: DataFrame, *, length: int = 1024, window: int = 64 * 1024, targets: dict | None = None, tokenizer: str | None = None,
         end_id: int = 0, seed: str = "pack", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` ids.

    ``targets`` maps sources to weights of the mixture; by default each weighs its tokens, so that all
    queues run dry in the last window. A source that others outlast leaves its share to them. Only the
    end of the last window can fill no whole sequence: it is cut into sequences whose lengths are powers
    of two, so nothing is padded. A null or empty text is its end id alone; a null source is a queue.
    """
    path = tokenizer or tokens.default_path()
    coded = encoded(docs, path, end_id, id_col, text_col, source_col)
    total = coded.agg(F.sum("n")).first()[0] or 0
    weight = F.col("total").cast("double")
    if targets:
        weight = F.coalesce(F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("src")], F.lit(1.0))
        weight = weight * float(total) / float(sum(targets.values()))
    queue = starts(coded.select("id", "src", "n", ROW), ["src"], "n", seed, ["id", "n"])
    packets = queue.select(
        ROW, "src", "n", "start", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(length).cast("long"))).alias("from")
    ).select(
        ROW, "src", "from", (F.col("start") + F.col("from")).alias("at"), F.least(F.lit(length), F.col("n") - F.col("from")).alias("size"),
        F.floor((F.col("start") + F.col("from")) * float(total) / (weight * float(window))).alias("window"),
    )
    packets = staged(packets, "pack-packets")
    first = _window_starts(packets)
    inside = Window.partitionBy("window").orderBy("src", "at", ROW).rowsBetween(Window.unboundedPreceding, -1)
    packets = packets.join(first, "window").withColumn("at", F.col("first") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    pieces = packets.select(ROW, "from", "at", "size", F.inline(_sequences(total, length)))
    begin = F.greatest("at", "low")
    pieces = pieces.select(
        ROW, (F.col("from") + begin - F.col("at")).alias("start"), (F.least(F.col("at") + F.col("size"), "high") - begin).alias("length"),
        "sequence_id", (begin - F.col("low")).alias("offset"),
    )
    by_row = pieces.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    return _checksums(coded.join(by_row, ROW), tokens.encoder(path).dtype(end_id), id_col)


def _window_starts(packets: DataFrame) -> DataFrame:
    """Tokens before each window: sums by window, by block of windows, and running sums within blocks."""
    sums = packets.groupBy("window").agg(F.sum("size").alias("size")).withColumn("block", F.floor(F.col("window") / _BLOCK))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("block").agg(F.sum("size").alias("s")).select("block", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("block").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    return sums.join(blocks, "block").select("window", (F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("first"))


def _sequences(total: int, length: int):
    """Sequences (id, low, high) that the packet at ``at`` touches: whole ones, then powers of two at the end."""
    whole = total - total % length
    end = F.col("at") + F.col("size")
    ids = F.when(F.col("at") < whole, F.sequence(F.floor(F.col("at") / length), F.floor((F.least(end, F.lit(whole)) - 1) / length)))
    full = F.transform(F.coalesce(ids, F.array().cast("array<bigint>")), lambda i: F.struct(
        i.alias("sequence_id"), (i * length).alias("low"), ((i + 1) * length).alias("high")))
    tail, low, left = [], whole, total - whole
    while left:
        size = 1 << (left.bit_length() - 1)
        tail.append((whole // length + len(tail), low, low + size))
        low, left = low + size, left - size
    if not tail:
        return full
    rest = F.array(*[F.struct(F.lit(i).cast("long").alias("sequence_id"), F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high")) for i, a, b in tail])
    return F.concat(full, F.filter(rest, lambda s: (s["low"] < end) & (s["high"] > F.col("at"))))


def _checksums(rows: DataFrame, kind: np.dtype, id_col: str) -> DataFrame:
    columns = ("start", "length", "sequence_id", "offset")

    def check(batches):
        for batch in batches:
            pieces = batch.column("pieces")
            flat, cut = pieces.flatten(), np.diff(np.asarray(pieces.offsets))
            start, size = (flat.field(c).to_numpy() for c in columns[:2])
            owner = np.repeat(np.arange(len(cut)), cut)
            sums, row, ids = np.zeros(len(flat), dtype=np.int64), -1, None
            for k, (r, s, n) in enumerate(zip(owner.tolist(), start.tolist(), size.tolist())):
                if r != row:
                    row, ids = r, np.frombuffer(batch.column("ids")[r].as_buffer(), dtype=kind)
                sums[k] = zlib.crc32(ids[s : s + n].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(owner)), *map(flat.field, columns), pa.array(sums), batch.column("n").take(pa.array(owner))],
                ["id", *columns, "ids_crc32", "doc_tokens"],
            )

    schema = f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, sequence_id long, offset long, ids_crc32 long, doc_tokens long"
    return rows.select("id", "n", "ids", "pieces").mapInArrow(check, schema).withColumnRenamed("id", id_col)
