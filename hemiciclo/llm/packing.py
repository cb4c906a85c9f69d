"""Best-fit packing of documents into sequences: planned on the histogram of lengths, so for the whole corpus at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hemiciclo.llm.common import range_offsets, stash
from hemiciclo.llm.tokens import END, encoded, vocabulary_path

CAPACITY = 1024
#: Pieces of a length that one rank range holds, about.
RANGE_ROWS = 1000


@dataclass
class Bins:
    """`count` sequences that hold the same lengths, in this order."""

    count: int
    lengths: list[int] = field(default_factory=list)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Sequences for so many pieces of each length, 1 to `capacity`.

    Pieces above a third of the capacity stand at most two in a sequence. From the longest down, each is matched with
    the longest other that fits beside it. The shorter ones, from the longest down, go where they leave the least
    room, and open sequences only when no room is left. All sequences with the same lengths move together, so time
    and memory depend on the capacity, not on the number of pieces.
    """
    left = {n: c for n, c in histogram.items() if c}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    rooms: dict[int, list[Bins]] = {}

    def put(bins: Bins) -> None:
        rooms.setdefault(capacity - sum(bins.lengths), []).append(bins)

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for m in large:
            if m <= n and n + m <= capacity and left[n] and left[m]:
                pairs = left[n] // 2 if m == n else min(left[n], left[m])
                if pairs:
                    left[n] -= pairs
                    left[m] -= pairs
                    put(Bins(pairs, [n, m]))
        if left[n]:
            put(Bins(left[n], [n]))
            left[n] = 0
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            room = min((r for r in rooms if r >= n), default=None)
            if room is None:
                each = capacity // n
                if full := todo // each:
                    put(Bins(full, [n] * each))
                if todo % each:
                    put(Bins(1, [n] * (todo % each)))
                break
            bins = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            if bins.count > todo:
                rooms.setdefault(room, []).append(Bins(bins.count - todo, bins.lengths))
            fits = min(todo, bins.count)
            put(Bins(fits, [*bins.lengths, n]))
            todo -= fits
    return [b for group in rooms.values() for b in group]


def bin_slots(plan: Iterable[Bins]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, one past the last, first sequence, offset): which places the pieces of a length take, by their rank."""
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for b in plan:
        offset = 0
        for n in b.lengths:
            rank = used.get(n, 0)
            slots.append((n, rank, rank + b.count, sequence, offset))
            used[n] = rank + b.count
            offset += n
        sequence += b.count
    return slots


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on demand, ids of every piece of every document.

    A document longer than `capacity` is cut into pieces of `capacity`, of which the first may be shorter.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def make(rows: pa.RecordBatch, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(ends)
        pieces = -(-sizes // capacity)
        of = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        head = (sizes - 1) % capacity + 1
        start = np.where(piece == 0, 0, head[of] + (piece - 1) * capacity)
        length = np.where(piece == 0, head[of], capacity)
        at = ends[of] + start
        raw = ids.astype("<u4", copy=False)
        crc = [zlib.crc32(raw[i:j]) for i, j in zip(at.tolist(), (at + length).tolist(), strict=True)]
        arrays = [rows.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        if with_ids:  # pieces follow each other in `ids` as they stand
            arrays.append(pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1]), pa.int32()), pa.array(ids.view(np.int32))))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(encoded(tokenizer or vocabulary_path(), 1, end, make), kinds)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS, **kwargs) -> DataFrame:
    """pieces() with sequence_id and offset: as few sequences of at most `capacity` tokens as the plan finds.

    Pieces are encoded once and kept in the shared folder. Their histogram (at most `capacity` rows) comes to the
    driver, which plans for all of them; the plan goes back as rank ranges by length, whose number depends on the
    capacity alone. A piece's rank among those of its length is its place in its hash range plus the sizes of the
    ranges before (in two levels), so a length that many pieces share is spread over many tasks.

    NULL text is empty and packs as its end token; repeated rows are packed each; equal pieces take any order among
    themselves; only the id and text columns are read, whatever others are called; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = stash(pieces(docs, capacity=capacity, **kwargs), "pieces", texts=True)
    ranges = max(1, -(-cut.count() // range_rows))
    hashed = F.xxhash64("doc_id", "piece", "ids_crc32")
    rows = cut.withColumns({"_h": hashed, "_r": F.pmod(hashed, F.lit(ranges)).cast("int")})
    counts = stash(rows.groupBy("length", "_r").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(bin_slots(plan_bins(histogram, capacity)), "at long, low long, high long, sequence long, offset long")
    first = range_offsets(counts, "length", "_r", "n").select(F.col("length").alias("_length"), F.col("_r").alias("_range"), F.col("offset").alias("_before"))
    inside = F.row_number().over(W.partitionBy("length", "_r").orderBy("_h", "doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = rows.withColumn("_inside", inside).join(first, (F.col("length") == F.col("_length")) & (F.col("_r") == F.col("_range")))
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_inside"))
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("at")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
    return placed.select(*cut.columns, (F.col("sequence") + F.col("_rank") - F.col("low")).alias("sequence_id"), "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids: the token sequences themselves, of a pack() with ids; one shuffle by sequence, none larger than the capacity."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
