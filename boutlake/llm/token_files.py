"""Token ids in files of fixed-width bits, in ascending order of the documents.

Format: a folder of Parquet files, written by Spark (so that any store Spark writes to will do), one row a block:

  shard int        number of the range of doc_ids that one task wrote; shards ascend with doc_id
  block_start long ids of all blocks of the shard before this one
  width int        bits of an id: the fewest that hold the largest id of the vocabulary
  doc_ids array, offsets array   the block's documents and where each begins, counted in ids, with the end as last
  payload binary   the ids, each in `width` bits, low bit first, without gaps

A block holds whole documents, some BLOCK_IDS ids or one longer document, and needs no other block to be read; the id
at place k of a block lies at bit k * width, so that any run of ids is read without what is before it. The ids before a
shard are the sum over the shards before it: one number a shard, kept by the reader (`shard_starts`).

Rows: null text counts as empty, and its document holds the end id alone; null doc_ids come first; rows with the same
doc_id stay separate documents, in the order of a hash of their text (then of the text), so that ties have a defined
place; repeated rows are as many documents. A text of any length is one document, whose ids are held at once. An empty
table gives no rows. Only the id and the text are read, so that columns of any other name play no part.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from ._common import map_arrow, shared_dir, struct, tasks_for

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 16
#: Bytes of text for one task, for the number of shards.
SHARD_BYTES = 64 << 20

BLOCKS = struct("shard int, block_start long, width int, doc_ids longs, offsets longs, payload binary")


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """The ids at places start to stop of a block, from the bytes that hold them."""
    low, high = start * width // 8, -(-stop * width // 8)
    part = np.frombuffer(payload, dtype=np.uint8, count=high - low, offset=low)
    if width in (8, 16, 32):
        return part.view(f"<u{width // 8}").astype(np.uint32)
    bits = np.unpackbits(part, bitorder="little")[start * width - low * 8 :][: (stop - start) * width]
    return bits.reshape(-1, width).astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> str:
    """Encodes whole texts, appends end_id to each, and writes them in ascending order of id_col. Returns the folder."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/boutlake/tokens-{uuid.uuid4().hex}"
    width = max(1, (tokens.vocabulary_size(tokenizer) - 1).bit_length())
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slim = slim.withColumn("tie", F.xxhash64("text"))  # splits and orders the rows of one id
    ordered = slim.repartitionByRange(tasks_for(spark, size, SHARD_BYTES), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def make() -> object:
        encode, shard, written = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        names: list = []
        parts: list[np.ndarray] = []
        held = 0

        def block() -> dict:
            nonlocal names, parts, held, written
            ends = np.cumsum([0, *(len(p) for p in parts)])
            row = {"shard": [shard], "block_start": [written], "width": [width], "doc_ids": [names], "offsets": [ends.tolist()], "payload": [pack(np.concatenate(parts), width)]}
            written += held
            names, parts, held = [], [], 0
            return row

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            nonlocal held
            ids_of = batch.column(0).to_pylist()
            at = 0
            for ids, ends in encode(batch.column(1)):
                for own in tokens.per_text(ids, ends):
                    names.append(ids_of[at])
                    parts.append(np.append(own, np.uint32(end_id)))
                    held += len(own) + 1
                    at += 1
                    if held >= BLOCK_IDS:
                        yield block()
            if names:
                yield block()

        return step

    map_arrow(ordered, make, BLOCKS).write.option("compression", "none").parquet(path)
    return path


def shard_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard. One row a shard reaches the driver."""
    ids = F.element_at("offsets", -1)
    totals = spark.read.schema(BLOCKS).parquet(path).groupBy("shard").agg(F.sum(ids).alias("n")).orderBy("shard").collect()
    starts, at = {}, 0
    for r in totals:
        starts[r["shard"]] = at
        at += r["n"]
    return starts


def read_ids(spark: SparkSession, path: str, doc_id: int, start: int = 0, stop: int | None = None) -> list[np.ndarray]:
    """The ids from start to stop of each document with this doc_id. Only blocks that hold it are read, and of their
    payloads only the bytes that hold these ids are unpacked. What is asked for goes to the driver."""
    found = []
    for b in spark.read.schema(BLOCKS).parquet(path).where(F.array_contains("doc_ids", F.lit(doc_id))).toLocalIterator():
        for name, i, j in zip(b["doc_ids"], b["offsets"], b["offsets"][1:]):
            if name == doc_id:
                found.append(unpack(b["payload"], b["width"], min(i + start, j), j if stop is None else min(i + stop, j)))
    return found


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, and the ids as 32-bit integers if asked for."""
    starts = spark.sparkContext.broadcast(shard_starts(spark, path))
    schema = struct("doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)

    def make() -> object:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            for b in batch.to_pylist():
                ids = unpack(b["payload"], b["width"], 0, b["offsets"][-1]).astype("<u4")
                own = [ids[i:j].tobytes() for i, j in zip(b["offsets"], b["offsets"][1:])]
                first = starts.value[b["shard"]] + b["block_start"]
                out = {"doc_id": b["doc_ids"], "start": [first + i for i in b["offsets"][:-1]], "n_tokens": [len(x) // 4 for x in own], "ids_crc32": [zlib.crc32(x) for x in own]}
                yield out | {"ids": own} if with_ids else out

        return step

    return map_arrow(spark.read.schema(BLOCKS).parquet(path), make, schema)
