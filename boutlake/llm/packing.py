"""Best-fit packing planned on the histogram of lengths.

1. Each task encodes its texts, cuts those that are longer than the capacity, and numbers the pieces of each length.
   The pieces are written to the shared folder.
2. The histogram of lengths (as many numbers as the capacity, whatever the data) goes to the driver, which packs it
   best-fit decreasing: lengths from the longest down, each into the sequences with the least room that is enough.
   Sequences with the same history are one range of numbers, so that a step deals with any number of pieces.
3. A piece's rank within its length is its number in its task plus the pieces of this length in the tasks before (a
   window over one row per task and length). The plan's run that holds the rank gives its sequence and offset.

Rows: null text counts as empty and makes a piece of one token (the end id); null and repeated doc_ids and repeated rows
are packed like others, each a document of its own. Pieces of one length are alike to the plan; which of them takes which
of its places goes by task and order of reading. A text of any length is encoded whole, and its ids are held at once. An
empty table gives no rows. Only the id and the text are read, so that columns of any other name play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from ._common import map_arrow, stored, struct

CAPACITY = 4096

#: A run: pieces of `length` with ranks from `rank` on (`count` of them) go `each` to a sequence, from `sequence` on, at `offset`.
RUN = ("length", "rank", "count", "sequence", "each", "offset")


def plan(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Returns the runs, by length and rank."""
    room: dict[int, list[tuple[int, int]]] = {}  # by room left: ranges (first sequence, number of sequences)
    rooms: list[int] = []
    runs, opened = [], 0

    def give(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                size = rooms[at]
                first, n = room[size].pop()
                if not room[size]:
                    del room[size], rooms[at]
            else:
                size, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = min(size // length, left)
            full = min(n, left // each)
            runs.append((length, rank, full * each, first, each, capacity - size))
            give(size - each * length, first, full)
            give(size, first + full, n - full)
            rank, left = rank + full * each, left - full * each
    return sorted(runs)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, number (within the task and length), and ids if kept."""

    def make() -> object:
        encode, part, met = tokens.encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            names = batch.column(0).to_pylist()
            at = 0
            for ids, ends in encode(batch.column(1)):
                rows = []
                for own in tokens.per_text(ids, ends):
                    own = np.append(own, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(own), capacity)):
                        cut = own[start : start + capacity]
                        raw = cut.tobytes()
                        rows.append((names[at], k, start, len(cut), zlib.crc32(raw), part, int(met[len(cut)]), raw))
                        met[len(cut)] += 1
                    at += 1
                if rows:
                    yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "part", "number", "ids"), zip(*rows)))

        return step

    schema = struct("doc_id long, piece int, start long, length long, ids_crc32 long, part long, number long" + ", ids binary" * keep_ids)
    return map_arrow(docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")), make, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with keep_ids the ids."""
    cut = stored(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids), "packing-pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(plan(histogram, capacity), dtype=np.int64).reshape(-1, len(RUN))
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(counts.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("rank", F.col("before") + F.col("number"))
    carried = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def make() -> object:
        table = shared.value
        keys = (table[:, 0] << 44) + table[:, 1]

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            run = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield {n: batch.column(n) for n in carried} | {"sequence_id": run[:, 3] + nth // run[:, 4], "offset": run[:, 5] + nth % run[:, 4] * length}

        return step

    schema = struct("doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long")
    return map_arrow(ranked.select(*carried, "rank"), make, schema)
