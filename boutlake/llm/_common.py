"""Helpers shared by the operators of this subpackage: the shared folder, stored tables, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if it is counted to have no more rows than this.
BROADCAST_ROWS = 200_000
BATCH_BYTES = 4 << 20
#: Slots of a table of flags at most (a byte each), and how many go to the driver in one row.
SLOTS, CHUNK = 1 << 24, 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir. Where that is unset, a folder of its own is set in
    local mode (one machine, as in tests); on a cluster there is no place that lost executors leave alone, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="boutlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/boutlake/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch where the session leaves Spark's own bound: rows are whole texts here, and each
    task holds a few batches on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None and spark.conf.get(key, None) != str(BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for so many rows: grows with the data, and never below the session's own setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def dotless(df: DataFrame) -> DataFrame:
    """With other names for columns that have a dot in theirs."""
    return df.toDF(*[f"__column_{i}" if "." in c else c for i, c in enumerate(df.columns)]) if any("." in c for c in df.columns) else df


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: T.StructType) -> DataFrame:
    """mapInArrow with a function made once in each task; it turns one batch into dicts of column values. Columns with a dot in
    their name, which mapInArrow doesn't find, go by their place."""
    df = dotless(df)
    names, kinds = [f.name for f in schema.fields], [arrow_type(f.dataType) for f in schema.fields]
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = begun(make)
        for batch in batches:
            for out in step(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=k) for n, k in zip(names, kinds)], names=names)
        del step
        given_back()

    return df.mapInArrow(run, schema)


_kept: dict = {}
_asked: list = []


def kept_in_worker(key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps between tasks, such as words it has met. The latest key's alone is kept."""
    _asked.append(key)
    if key not in _kept:
        _kept.clear()
        given_back()
        _kept[key] = make()
    return _kept[key]


def begun(make: Callable[[], object]) -> object:
    """What make gives, at the start of a task. If it asks for nothing that is kept, what an earlier operator's tasks have
    kept in this worker goes: workers live on, and an operator is not to pay for the memory of the one before it."""
    _asked.clear()
    made = make()
    if not _asked and _kept:
        _kept.clear()
        given_back()
    return made


def given_back() -> None:
    """Hands freed memory back to the system: the worker lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


_TRIM = _trim()


def arrow_type(kind: T.DataType) -> pa.DataType:
    plain = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_()}
    return pa.list_(arrow_type(kind.elementType)) if isinstance(kind, T.ArrayType) else plain[type(kind)]


def struct(spec: str) -> T.StructType:
    """A schema from 'name type, ...' without a session."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "longs": T.ArrayType(T.LongType()), "ints": T.ArrayType(T.IntegerType()), "strings": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in spec.split(","))])


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def flag_table(rows: DataFrame, n: int) -> np.ndarray:
    """From h and flags (int): the flags of each slot, a byte each; slots are some 16 times n, SLOTS at most."""
    slots = min(SLOTS, 1 << max(16, (16 * n).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit(slots - 1))
    each = rows.select(slot.alias("slot"), "flags").groupBy("slot").agg(F.bit_or("flags").alias("flags"))
    each = each.select(F.shiftright("slot", CHUNK.bit_length() - 1).alias("chunk"), F.col("slot").bitwiseAND(F.lit(CHUNK - 1)).alias("place"), "flags")

    def packed(t: pa.Table) -> pa.Table:
        out = np.zeros(CHUNK, np.uint8)
        out[t["place"].to_numpy()] = t["flags"].to_numpy().astype(np.uint8)
        return pa.table({"chunk": t["chunk"].slice(0, 1).cast(pa.int64()), "bytes": [out.tobytes()]})

    table = np.zeros(max(slots, CHUNK), np.uint8)
    for row in each.groupBy("chunk").applyInArrow(packed, struct("chunk long, bytes binary")).collect():
        table[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["bytes"], np.uint8)
    return table
