"""Deterministic randomness, bins, running totals and numbers over whole tables, and the shared folder.

Every draw is an md5 of a seed and a key, so that it doesn't depend on partitions and SQL engines agree on it.
"""

from __future__ import annotations

import hashlib
import math
import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def draw(seed: int | str, *keys: str | Column) -> Column:
    """A hex string to order by: md5 of 'seed|key|key...'."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))


def uniform(seed: int | str, *keys: str | Column) -> Column:
    """A double in [0, 1) from the first 52 bits of draw()."""
    return F.conv(F.substring(draw(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


#: The mean up to which a Poisson draw is inverted step by step.
LARGEST_MEAN = 500


def poisson_steps(mean: int) -> list[float]:
    """P(X <= k) of a Poisson variable for k = 0, 1, ... as far as it differs from 1 in double precision."""
    p = c = math.exp(-float(mean))
    out = [c]
    for k in range(1, math.ceil(mean + 12 * math.sqrt(mean) + 30) + 1):
        p = p * mean / k
        c += p
        out.append(c)
    return out


def with_poisson(df: DataFrame, out: str, mean: str, seed: int | str, *keys: str | Column) -> DataFrame:
    """Adds `out` (long), a draw from a Poisson distribution of the whole mean in a column: uniform(seed, *keys) inverted.

    Beyond LARGEST_MEAN exp(-mean) would run out of range and the steps would be many. There a second draw makes the uniform
    number a normal one, z, and the draw is the quantile mean + sqrt(mean) z + (z z - 1) / 6, rounded, whose next term
    (below 0.06 for |z| < 4) no longer moves a draw by one.
    """
    name = free_name("_u", df)
    u, n = F.col(name), F.col(mean).cast("double")
    one = F.lit(0)  # the mean of most rows is 0 or 1
    for c in poisson_steps(1)[:20]:
        one = one + (u >= c).cast("int")

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * n / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), (s["k"] + (s["c"] + p <= u).cast("int")).alias("k"))

    least = F.exp(-n)
    first = F.struct(least.alias("p"), least.alias("c"), (least <= u).cast("int").alias("k"))
    inverted = F.aggregate(
        F.sequence(F.lit(1), F.ceil(n + 12 * F.sqrt(n) + 30).cast("int")), first, step, lambda s: s["k"]
    )
    z = F.sqrt(-2 * F.ln(1 - u)) * F.cos(F.lit(2 * math.pi) * uniform(seed, *keys, F.lit("z")))
    wide = F.greatest(F.lit(0.0), F.round(n + F.sqrt(n) * z + (z * z - 1) / 6))
    drawn = F.when(n == 0, F.lit(0)).when(n == 1, one).when(n <= LARGEST_MEAN, inverted).otherwise(wide).cast("long")
    return df.withColumn(
        name, uniform(seed, *keys)
    ).withColumn(out, drawn).drop(name)  # a column, so that it is drawn once


def uniforms(keys: Sequence[str], numbers: Sequence[int | str]) -> np.ndarray:
    """What uniform() gives for each key ('seed|key') followed by each number, made in a task: a row per key."""
    ends = [f"|{n}".encode() for n in numbers]

    def digest(start: object, end: bytes) -> bytes:
        h = start.copy()
        h.update(end)
        return h.digest()

    digests = b"".join([digest(start, end) for start in (hashlib.md5(k.encode()) for k in keys) for end in ends])
    return ((np.frombuffer(digests, ">u8")[::2] >> 12).astype("float64") / (1 << 52)).reshape(len(keys), len(ends))


def poisson_draws(keys: Sequence[str], means: np.ndarray, numbers: Sequence[int]) -> np.ndarray:
    """The draws of with_poisson for each key, of the key's mean, and each number, made in a task: a row per key."""
    out = np.zeros((len(keys), len(numbers)), "int64")
    for mean in np.unique(means[means > 0]):
        at = np.flatnonzero(means == mean)
        own, n = [keys[i] for i in at], float(mean)
        u = uniforms(own, numbers)
        if mean <= LARGEST_MEAN:
            out[at] = np.searchsorted(poisson_steps(int(mean)), u, side="right")
        else:
            z = np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * math.pi * uniforms(own, [f"{r}|z" for r in numbers]))
            out[at] = np.maximum(0, np.floor(n + math.sqrt(n) * z + (z * z - 1) / 6 + 0.5))
    return out


def bin_label(value: Column, edges: Sequence[float], labels: Sequence[str], left_closed: bool = True) -> Column:
    """The label of [edges[i], edges[i+1]) (or of (edges[i], edges[i+1]]); null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed([*zip(edges, edges[1:], labels)]):
        inside = (value >= low) & (value < high) if left_closed else (value > low) & (value <= high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share, spark.checkpoint.dir. Where that is unset, one is set in local mode
    (one machine, as in tests); on a cluster it is an error."""
    base = spark.conf.get(
        "spark.checkpoint.dir", None
    ) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="boutlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/boutlake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, *tables: DataFrame) -> str:
    """The name, with a "_" more for as long as one of the tables has it in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int = 1) -> DataFrame:
    """The first k rows, by this order, of each value of the keys; all columns as they are."""
    at = free_name("_at", df)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(at, number).where(F.col(at) <= k).drop(at)


#: Rows of a range that one task sorts, in running totals and numbers over a whole table.
RANGE_ROWS = 1_000_000


def place_among(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending cuts are below the value, by halving: log2 of their number steps, however many there are."""
    table = F.array(*[F.lit(c) for c in cuts])

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        inside = s["low"] < s["high"]
        below = inside & (F.get(table, middle) < value)
        return F.struct(
            F.when(below, middle + 1).otherwise(s["low"]).alias("low"),
            F.when(inside & ~below, middle).otherwise(s["high"]).alias("high")
        )

    if not cuts:
        return F.lit(0)
    ends = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), ends, halve, lambda s: s["low"])


def _ranged(df: DataFrame, order: str, out: str) -> DataFrame:
    """Adds `out`: the row's range of the order, from 0 on, -1 where the order is null. Ranges hold some RANGE_ROWS rows and are
    cut at quantiles, so that they become more as rows do, and a task's share does not grow with the table."""
    ranges = -(-df.count() // RANGE_ROWS)
    cuts = sorted(
        set(df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.3 / ranges))
    ) if ranges > 1 else []
    return df.withColumn(out, F.when(F.col(order).isNull(), F.lit(-1)).otherwise(place_among(F.col(order), cuts)))


def running_totals(df: DataFrame, order: str, values: Mapping[str, str], descending: bool = False) -> DataFrame:
    """Adds running sums over the whole table (`order` distinct), as {value: name of its sum}, without a window in a
    single partition. Rows whose order is null stay, add nothing to the others' sums, and have null sums.

    Two levels: rows are put into ranges of the order by quantiles; the ranges' totals (a row each) are summed up in a
    small window and joined back; within a range the window is partitioned.
    """
    place = free_name("_range", df)
    ranged = _ranged(df, order, place)
    by = F.desc if descending else F.asc
    named = {v: (free_name(f"_total_{v}", df), free_name(f"_before_{v}", df)) for v in values}
    totals = ranged.where(F.col(place) >= 0).groupBy(place).agg(*[F.sum(v).alias(t) for v, (t, _) in named.items()])
    before = Window.orderBy(by(place)).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(place, *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(b) for t, b in named.values()])
    within = Window.partitionBy(place).orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(totals), place, "left")  # no total of null orders: their sums are null
    sums = {out: F.col(named[v][1]) + F.sum(v).over(within) for v, out in values.items()}
    return joined.withColumns(sums).drop(place, *[b for _, b in named.values()])


def quantiles(
    df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = (), count: str | None = None
) -> DataFrame:
    """by, and {name: share} as columns: exact quantiles by linear interpolation of the values that aren't null (by null
    is a group of its own; without by one row, of nulls where there are no values). count: a column that says how many
    times a row's value counts.

    Counts per value are made with map-side partials and written to the shared folder once. They are put into ranges of
    the value, whose sums go before the sums within a range, so that no task holds all distinct values; a quantile is
    looked up by its places in the order.
    """
    keys = [F.col(b).alias(f"by{i}") for i, b in enumerate(by)]
    names = [f"by{i}" for i in range(len(by))]
    times = F.sum(count) if count else F.count("*")
    counts = df.where(F.col(value).isNotNull()).groupBy(
        *keys, F.col(value).cast("double").alias("v")
    ).agg(times.alias("c"))
    ranged = _ranged(stored(counts, "quantiles"), "v", "range")
    sums = ranged.groupBy(*names, "range").agg(F.sum("c").alias("s"))
    group = Window.partitionBy(*names, F.lit(0))
    before = F.coalesce(F.sum("s").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(
        *[F.col(b).alias(f"sum_{b}") for b in names], F.col("range").alias("sum_range"), before.alias("before"),
        F.sum("s").over(group).alias("all")
    )
    same = F.col("range") == F.col("sum_range")
    for b in names:
        same = same & F.col(b).eqNullSafe(F.col(f"sum_{b}"))
    within = Window.partitionBy(*names, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.join(sums, same).withColumn("upto", F.col("before") + F.sum("c").over(within))
    found, out = [], []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("all") - 1)
        for end, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            found.append(
                F.max(
                    F.when((F.col("upto") - F.col("c") <= at) & (at < F.col("upto")), F.col("v"))
                ).alias(f"{end}_{name}")
            )
        part = place - F.floor(place)
        out.append((F.col(f"low_{name}") + (F.col(f"high_{name}") - F.col(f"low_{name}")) * part).alias(name))
    return rows.groupBy(*names).agg(F.max("all").alias("all"), *found).select(
        *[F.col(b).alias(c) for b, c in zip(names, by)], *out
    )


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """Adds the row's number from 0 in this order (distinct values, nulls first): ranks within ranges plus the sizes of the
    ranges before."""
    place, size = free_name("_range", df), free_name("_before", df)
    ranged = _ranged(df, order, place)
    sizes = ranged.groupBy(place).agg(F.count("*").alias(size))
    before = F.coalesce(F.sum(size).over(Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = ranged.join(F.broadcast(sizes.select(place, before.alias(size))), place)
    own = F.row_number().over(Window.partitionBy(place).orderBy(order))
    return ranged.withColumn(out, F.col(size) + own - 1).drop(place, size)
