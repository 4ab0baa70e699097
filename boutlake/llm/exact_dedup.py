"""Exact dedup with an extendible-hash index on shared files.

1. Every row gets a key (64 bits of a hash of its normalised text). Each task chains the rows it has read by key and
   compares their bytes, so that of a group of copies only one text a task (the task's head) goes further.
2. The heads are written to the shared folder. A directory of the leading bits of the keys is doubled until no
   bucket holds more than `bucket_bytes` of heads (or `max_depth` is reached: the heads of one key can't be split). Only
   the buckets' sizes reach the driver: one entry per bucket, 1.6 million of them for 100 TB of distinct texts.
3. Each bucket is a key range with one owner task, which chains the heads that have the same key and compares bytes.
   Texts that collide in the key, but differ, stay apart. A task begins its chains anew after CHAIN_BYTES, so a text that
   a share of all rows holds comes to its owner once for each task and CHAIN_BYTES of other texts; the owner reads these
   one after the other and holds one of them.
4. The rows find their group through their head; the group's size and survivor are aggregated with map-side partials.

Rows: null text counts as empty; null doc_ids sort below all others; of rows with the same doc_id in one group, one stays:
in exact_groups the one that was read last, in drop_copies the first by a hash of all its columns (so that it doesn't
depend on partitions). Texts of any length are compared whole. An empty table gives an empty result. Columns besides the
id and the text play no part otherwise, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, map_arrow, stored, struct

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
FOLD = bytes.maketrans(_UPPER, _LOWER)

#: Bytes of heads that a task chains before it begins a new chain; bounds the memory of a task.
CHAIN_BYTES = 16 << 20
#: Bytes of heads that a bucket holds at most.
BUCKET_BYTES = 64 << 20
#: Key ranges (buckets) that an owner task works off, one after the other.
OWNED = 16

_HEADS = "uid long, doc_id long, head long, key long, text_sha256 string, size long, text binary"


def _chain() -> object:
    part = TaskContext.get().partitionId() << 34
    chains: dict[int, list[tuple[int, bytes, str]]] = {}
    seen = held = 0

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        nonlocal seen, held
        out: dict[str, list] = {n: [] for n in ("uid", "doc_id", "head", "key", "text_sha256", "size", "text")}
        size = 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            body = (text.as_py() or b"").translate(FOLD)
            key = xxhash.xxh3_64_intdigest(body)
            uid, seen = part + seen, seen + 1
            chain = chains.setdefault(key, [])
            found = next((x for x in chain if x[1] == body), None)
            if found is None:
                found = (uid, body, hashlib.sha256(body).hexdigest())
                chain.append(found)
                held += len(body) + 200
            for n, v in zip(out, (uid, doc_id, found[0], key - (1 << 63), found[2], len(body), body if found[0] == uid else None)):
                out[n].append(v)
            size += len(body) if found[0] == uid else 0
            if held > CHAIN_BYTES:
                chains.clear()
                held = 0
            if size > 4 << 20:
                yield out
                out, size = {n: [] for n in out}, 0
        yield out

    return step


def _own() -> object:
    """Chains the heads of one key range, which come sorted by key: only one key's distinct texts are held."""
    at, chain = None, []

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        nonlocal at, chain
        heads, roots = [], []
        for key, uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if key != at:
                at, chain = key, []
            body = text.as_py()
            root = next((u for u, b in chain if b == body), None)
            if root is None:
                chain.append((uid, body))
                root = uid
            heads.append(uid)
            roots.append(root)
        yield {"head": heads, "root": roots}

    return step


def directory(heads: DataFrame, bucket_bytes: int, max_depth: int) -> list[tuple[int, int]]:
    """(prefix, depth) of each bucket. The directory begins as deep as the heads' bytes ask for at least; each further
    round doubles it below the buckets that overflow, and weighs only those."""
    total = heads.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    depth, done, parents = max(0, (total // bucket_bytes).bit_length()), [], None
    while True:
        found = heads.select(_prefix(depth).alias("prefix"), "size")
        if parents is not None:
            found = found.where(F.shiftright("prefix", 1).isin(parents))
        sizes = found.groupBy("prefix").agg(F.sum("size").alias("n")).collect()
        over = {r["prefix"] for r in sizes if r["n"] > bucket_bytes and depth < max_depth}
        done += [(r["prefix"], depth) for r in sizes if r["prefix"] not in over]
        if not over:
            return done
        parents, depth = sorted(over), depth + 1


def _prefix(depth: int):
    """The leading bits of a key, whose sign bit was flipped so that order is kept."""
    flipped = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    return F.shiftrightunsigned(flipped, 64 - depth) if depth else F.lit(0).cast("long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, max_depth: int = 40) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, uid (an own number of the row)."""
    rows = stored(map_arrow(docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("binary")), _chain, struct(_HEADS)), "dedup-heads")
    heads = rows.where(F.col("text").isNotNull())
    buckets = sorted(((p << (64 - d)) if d else 0) for p, d in directory(heads, bucket_bytes, max_depth))
    starts = np.array(buckets, dtype=np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(starts)

    def locate() -> object:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
            yield {"bucket": np.maximum(np.searchsorted(shared.value, key, side="right") - 1, 0), **{n: batch.column(n) for n in ("key", "head", "text")}}

        return step

    owned = map_arrow(heads.select("key", "head", "text"), locate, struct("bucket long, key long, head long, text binary"))
    n = max(1, -(-len(buckets) // OWNED), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    owned = owned.repartition(n, "bucket").sortWithinPartitions("key", "head")
    roots = map_arrow(owned.select("key", "head", "text"), _own, struct("head long, root long"))
    members = stored(rows.select("uid", "doc_id", "head", "text_sha256").join(roots, "head"), "dedup-members")
    best = F.max(F.struct("doc_id", "uid"))
    groups = members.groupBy("root").agg(best.alias("best"), F.count("*").alias("group_size"))
    return members.join(groups, "root").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256", "uid"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they are; one row per group even if doc_ids repeat.

    Only groups of two rows or more are joined with the rows, by the hash of the text; they are broadcast if counted to be
    few, so that texts aren't shuffled again. Groups whose survivor's doc_id repeats within them are settled by a hash of
    the rows.
    """
    fold = F.sha2(F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), _UPPER.decode(), _LOWER.decode()).cast("binary"), 256)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), fold.alias("_sha"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    named = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    groups = exact_groups(docs, id_col, text_col).groupBy("text_sha256").agg(F.first("keep_id").alias("_keep"), F.count("*").alias("_n"), F.count_if(named).alias("_same")).where("_n > 1")
    groups = stored(groups.withColumnRenamed("text_sha256", "_sha"), "dedup-groups")
    found = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, "_sha", "left")
    found = found.where("_n is null or _id <=> _keep")
    if groups.where("_same > 1").isEmpty():
        return found.select("_row.*")
    fields = docs.schema.fields
    order = F.xxhash64(*[F.to_json(f"_row.`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"_row.`{f.name}`") for f in fields])
    again = found.where("_same > 1").withColumn("_order", order)
    one = again.withColumn("_at", F.row_number().over(Window.partitionBy("_sha").orderBy("_order"))).where("_at = 1")
    return found.where("_same is null or _same = 1").select("_row.*").unionByName(one.select("_row.*"))
