"""Mixing sources to target weights by Poisson replication.

A row of source s is repeated on average rate(s) = budget * weight(s) / (sum of weights * size(s)) times. Its count is
a Poisson draw with that mean, inverted from a uniform number that depends on the seed and the row's id alone; means
beyond 500 are drawn as a sum of equal parts, where exp(-mean) would run out of range. The copies are then put into a
global random order: by the md5 of seed, id and number of the copy, whose leading bits give the partition.

Plan: one aggregate with map-side partials (sources, written to the shared folder), a join with the table of sources
(broadcast only if counted to have few rows, else a shuffled join whose hot source AQE splits), explode, one shuffle. As
md5 is uniform, partitions are equal without a sample, and their number grows with the rows that are expected.

Rows: a null source counts as a source of its own; rows with repeated ids draw alike, and each row counts; a row with a
null id draws by all of its columns, so that such rows don't draw alike nor end up in one place unless they are equal.
Null, empty and long texts are carried as they are. Sources of weight 0 vanish. An empty table stays empty. All columns
of the input stay as they are: where one has the name of an added column in any case, the added one gets a "_" more.
Columns of the input that differ in case only need a session that tells cases apart (spark.sql.caseSensitive); else Spark
itself holds their names to be ambiguous. A rate of any size is made in chunks of COPIES, which are dealt out first.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, stored, tasks_for

#: The mean up to which one draw is inverted directly.
LARGEST_MEAN = 500.0
#: Rows of a partition of the result, and copies of a row that are made at once.
ROWS, COPIES = 50_000, 10_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits of the md5 of the parts, joined by '|'."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, source_col: str, weights: Mapping[str, float] | None, budget: float | None) -> DataFrame:
    """(source, size, weight, rate). Without weights a source weighs the square root of its rows; the budget is the
    number of rows that are wanted, by default as many as there are."""
    sizes = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count("*").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.sqrt(F.col("size").cast("double")))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        sizes = sizes.join(given.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    total = sizes.agg(F.sum("size").alias("_n"), F.round(F.sum("weight"), 6).alias("_w"))
    want = F.col("_n").cast("double") if budget is None else F.lit(float(budget))
    return sizes.crossJoin(F.broadcast(total)).select("source", "size", "weight", F.coalesce(F.round(want * F.col("weight") / F.nullif(F.col("_w"), F.lit(0.0)) / F.col("size"), 9), F.lit(0.0)).alias("rate"))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as far as it differs from 1 in double precision."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def add(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda s: s["all"])


def _free(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _hashable(df: DataFrame, row: str) -> list[Column]:
    """The columns of a struct column, maps as JSON, for hash functions."""
    fields = df.schema[row].dataType.fields
    return [F.to_json(F.col(f"{row}.`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"{row}.`{f.name}`") for f in fields]


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: Mapping[str, float] | None = None, budget: float | None = None, seed: int = 42) -> DataFrame:
    """All columns of docs, with the added columns `copy` (int, from 0) and `shuffle_key` (string, ascending)."""
    spark = docs.sparkSession
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int")
    rates = source_rates(docs, source_col, weights, budget).where("rate > 0").withColumn("_parts", parts)
    rates = stored(rates.select(F.col("source").alias("_source"), "size", "rate", "_parts"), "mixing-rates")
    sources, rows, most = rates.agg(F.count("*"), F.coalesce(F.sum(F.col("size") * F.col("rate")), F.lit(0.0)), F.coalesce(F.max("rate"), F.lit(0.0))).first()
    rates = rates.select("_source", "_parts", poisson_cdf(F.col("rate") / F.col("_parts")).alias("_cdf"))
    if sources <= BROADCAST_ROWS // 100:
        rates = F.broadcast(rates)
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    own = F.concat(F.lit("null "), F.xxhash64(*_hashable(nested, "_row")).cast("string"))
    ident, salt = F.coalesce(F.col(f"_row.`{id_col}`").cast("string"), own), F.lit(str(seed))
    joined = nested.select("_row", ident.alias("_ident")).join(rates, F.col(f"_row.`{source_col}`").eqNullSafe(F.col("_source")))
    draws = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda j: uniform(salt, F.col("_ident"), j))
    count = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("_cdf", lambda c: c <= u)))
    # Counts are a column of their own and the explode is the outer form: a filter for counts over 0 would be pushed below
    # and would draw a second time.
    drawn = joined.select("_row", "_ident", count.alias("_count"))
    chunks = F.when(F.col("_count") > 0, F.sequence(F.lit(0), F.floor((F.col("_count") - 1) / COPIES).cast("int")))
    dealt = drawn.select("_row", "_ident", "_count", F.explode_outer(chunks).alias("_chunk")).where("_chunk is not null")
    if most > COPIES:
        dealt = dealt.repartition(tasks_for(spark, int(rows), ROWS * 10))  # a row's chunks go to many tasks
    last = F.least(F.col("_count"), (F.col("_chunk") + 1) * COPIES) - 1
    copies = dealt.select("_row", "_ident", F.explode(F.sequence(F.col("_chunk") * COPIES, last)).alias("_copy"))
    key = F.md5(F.concat_ws("|", salt, F.col("_ident"), F.lit("copy"), F.col("_copy").cast("string")).cast("binary"))
    names = [_free("copy", docs.columns), _free("shuffle_key", docs.columns)]
    out = copies.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], F.col("_copy").alias(names[0]), key.alias(names[1]))
    n = tasks_for(spark, int(rows), ROWS)
    place = F.shiftright(F.conv(F.substring(F.col(names[1]), 1, 8), 16, 10).cast("long") * n, 32).cast("int")
    return out.repartitionById(n, place).sortWithinPartitions(names[1])
