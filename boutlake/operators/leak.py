"""Leak control: what sets share, exclusion, near-duplicate recordings, and temporal neighbours across splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.det import first_rows, stored


def duplicate_files(segments: DataFrame, name: str = "filename", place: str = "path") -> DataFrame:
    """name, first_path, path: every later place of a file with the first one."""
    w = Window.partitionBy(name).orderBy(place)
    rows = segments.select(name, place, F.row_number().over(w).alias("_r"), F.first(place).over(w).alias("first_path"))
    return rows.where("_r > 1").select(name, "first_path", place)


def exclude_known(pool: DataFrame, known: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of the pool whose key is in none of the known tables, the first of each key by this order."""
    keys = reduce(DataFrame.unionByName, [k.select(key) for k in known])
    rest = pool.join(keys, key, "left_anti")
    return first_rows(rest, [key], [order])


def disjoint_splits(train: DataFrame, val: DataFrame, test: DataFrame, key: str) -> dict[str, DataFrame]:
    """Test keys leave val and train, then val's remaining keys leave train."""
    val = val.join(test.select(key), key, "left_anti")
    return {
        "train": train.join(test.select(key), key, "left_anti").join(val.select(key), key, "left_anti"),
        "val": val, "test": test
    }


def holdout_unused(linked: DataFrame, train: DataFrame, val: DataFrame, key: str = "video") -> DataFrame:
    """Events whose recording is in neither split; none is an error."""
    out = linked.join(train.select(key).unionByName(val.select(key)), key, "left_anti")
    if out.isEmpty():
        raise ValueError("every recording is in a split")
    return out


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


#: Rows of the corpus with one key, above which the key is split up by a second band.
HOT = 1_000


def _masks(n_words: int, bands: int) -> list[list[int]]:
    """For each band its bits as words: every `bands`-th bit, so that a part of the bits that is constant for many rows (a dark
    half of a frame) makes up a part of each band only."""
    out = [[0] * n_words for _ in range(bands)]
    for bit in range(64 * n_words):
        out[bit % bands][bit // 64] |= 1 << bit % 64
    return [[w - (1 << 64) if w >= 1 << 63 else w for w in words] for words in out]


def near_duplicates(
    queries: DataFrame, corpus: DataFrame, most: int, n_words: int, key: str = "id", words: str = "words",
    hot: int = HOT
) -> DataFrame:
    """query, match, distance of all pairs within `most` bits; exact.

    The bits are dealt out to most + 2 bands. A pair differs in `most` of them at most, so two bands at least are equal. The
    key of an equi-join is (band, hash of its bits); keys that more than `hot` rows of the corpus have are left out
    and give way to keys of that band and a second one. A pair that shares a key that isn't hot meets there; one
    whose equal bands are all hot has two of them, and meets by the two. Only what meets is compared in full.
    """
    bands = most + 2
    masks = F.array(*[F.array(*[F.lit(w) for w in m]) for m in _masks(n_words, bands)])

    def side(df: DataFrame, name: str) -> DataFrame:
        keys = F.transform(masks, lambda m: F.xxhash64(F.zip_with(F.col("w"), m, lambda w, x: w.bitwiseAND(x))))
        rows = stored(
            df.select(F.col(key).alias(name), F.col(words).alias("w")), f"signatures-{name}"
        )  # worked out once
        rows = rows.select(name, F.col("w").alias(f"{name}_w"), keys.alias(f"{name}_k"))
        return rows.select(name, f"{name}_w", f"{name}_k", F.posexplode(f"{name}_k").alias("band", "bits"))

    left, right = side(queries, "query"), side(corpus, "match")
    many = stored(
        right.groupBy("band", "bits").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("band", "bits"),
        "hot-bands"
    )
    few = F.broadcast(many) if many.count() <= 100_000 else many  # counted: a row for `hot` rows of the corpus at least
    cold = [x.join(few, ["band", "bits"], "left_anti").drop("query_k", "match_k") for x in (left, right)]

    def split(x: DataFrame, name: str) -> DataFrame:
        """A row for each second band of rows with a hot key."""
        x = x.join(few, ["band", "bits"], "left_semi").select(
            name, f"{name}_w", "band", "bits", F.posexplode(f"{name}_k").alias("other", "more")
        )
        return x.where("other <> band")

    met = cold[0].join(cold[1], ["band", "bits"]).select("query", "query_w", "match", "match_w")
    met = met.unionByName(
        split(left, "query").join(
            split(right, "match"), ["band", "bits", "other", "more"]
        ).select("query", "query_w", "match", "match_w")
    )
    near = met.withColumn("distance", hamming(F.col("query_w"), F.col("match_w"))).where(
        (F.col("distance") <= most) & (F.col("query") != F.col("match"))
    )
    return near.select("query", "match", "distance").distinct()


def best_match(pairs: DataFrame) -> DataFrame:
    """The nearest match of each query, ties to the smaller."""
    return first_rows(pairs, ["query"], ["distance", "match"])


def name_overlap(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Rows of a whose file name is in b, without case."""
    keys = b.select(F.lower(name).alias("_name")).distinct()
    return a.join(keys, F.lower(a[name]) == F.col("_name"), "left_semi")


def overlap_decision(clips: DataFrame, policy: str = "any") -> DataFrame:
    """Adds decision (VAL or TEST) and reasons. clips: ours (nullable), name_match, distance (nullable), with `strict`,
    `loose` bits as columns strict and loose. Policies: any, label, hash, and, or; under `and` and `or` a distance between
    strict and loose makes REVIEW."""
    ours, name = F.coalesce("ours", F.lit(False)), F.coalesce("name_match", F.lit(False))
    near = F.coalesce(F.col("distance") <= F.col("strict"), F.lit(False))
    band = F.coalesce((F.col("distance") > F.col("strict")) & (F.col("distance") <= F.col("loose")), F.lit(False))
    rule = {
        "any": ours | name | near | band, "label": ours, "hash": near, "and": ours & near, "or": ours | near
    }[policy]
    decision = F.when(rule, "VAL").otherwise("TEST")
    if policy in ("and", "or"):
        decision = F.when(band & ~rule, "REVIEW").otherwise(decision)
    reasons = F.array_compact(
        F.array(
            F.when(ours, "flag"), F.when(name, "name"),
            F.when(near | (band if policy == "any" else F.lit(False)), "hash")
        )
    )
    return clips.withColumn("decision", decision).withColumn("reasons", reasons)


def temporal_leakage(
    train: DataFrame, val: DataFrame, gap: float = 30.0, video: str = "video", start: str = "start_sec"
) -> DataFrame:
    """One row: shared_videos, pairs (train x val of shared videos) and near_pairs (starts less than `gap` apart).

    The number of pairs follows from counts; only near ones are met, in bins of `gap` and their neighbours.
    """
    n = train.groupBy(video).agg(F.count("*").alias("n")).join(val.groupBy(video).agg(F.count("*").alias("m")), video)
    totals = n.agg(
        F.count("*").alias("shared_videos"), F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("pairs")
    )
    bins = F.floor(F.col(start) / gap)
    left = train.select(video, F.col(start).alias("s"), bins.alias("_bin"))
    right = val.select(video, F.col(start).alias("t"), F.explode(F.array(bins - 1, bins, bins + 1)).alias("_bin"))
    near = left.join(right, [video, "_bin"]).where(
        F.abs(F.col("s") - F.col("t")) < gap
    ).agg(F.count("*").alias("near_pairs"))
    return totals.crossJoin(near)


def tagged(splits: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("split", F.lit(n)) for n, df in splits.items()])


def split_report(
    splits: DataFrame, label: str = "behavior", minority: str = "tail", video: str = "video", group: str = "grp"
) -> DataFrame:
    """Per split: events, videos, groups, minority and its percent (4 decimals)."""
    n = F.count_if(F.col(label) == minority)
    return splits.groupBy("split").agg(
        F.count("*").alias("events"), F.countDistinct(video).alias("videos"),
        F.countDistinct(group).alias("groups"), n.alias("minority"),
        F.round(100 * n / F.count("*"), 4).alias("percent")
    )


def split_overlap(splits: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """One row: keys in both splits, in either, and the shared percent of either (4 decimals)."""
    sets = splits.groupBy(key).agg(
        F.bool_or(F.col("split") == a).alias("in_a"), F.bool_or(F.col("split") == b).alias("in_b")
    ).where("in_a or in_b")
    both = F.count_if(F.col("in_a") & F.col("in_b"))
    return sets.agg(
        both.alias("shared"), F.count("*").alias("either"),
        F.round(100 * both / F.greatest(F.count("*"), F.lit(1)), 4).alias("percent")
    )


def pairwise_overlap(named: DataFrame, key: str, name: str = "split") -> DataFrame:
    """a, b, shared: distinct keys that each pair of named sets has in common (pairs without any have no row)."""
    keys = named.select(name, key).distinct()
    left, right = keys.select(F.col(name).alias("a"), key), keys.select(F.col(name).alias("b"), key)
    return left.join(right, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def set_duplicates(named: DataFrame, key: str, name: str = "split") -> DataFrame:
    """name, rows, keys (distinct, nulls left out), repeated (keys that more than one row has), extra (rows beyond the first)."""
    per = named.where(F.col(key).isNotNull()).groupBy(name, key).agg(F.count("*").alias("n"))
    return per.groupBy(name).agg(
        F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"),
        F.sum(F.col("n") - 1).alias("extra")
    )


def leak_asserts(splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The splits as they are; an error when a key's value is in two of them, raised by the job that reads the result."""
    out = splits
    for key in keys:
        leak = splits.groupBy(key).agg(
            F.countDistinct("split").alias("_n")
        ).where("_n > 1").agg(F.count("*").alias("_leaks"))
        said = F.when(
            F.col("_leaks") > 0, F.raise_error(F.concat(F.lit(f"leak of {key}: "), F.col("_leaks").cast("string")))
        ).otherwise(F.lit(True))
        out = out.crossJoin(F.broadcast(leak)).where(said.cast("boolean")).drop("_leaks")
    return out


def grid_dhash(grid: Column, rows: int = 16, columns: int = 17) -> Column:
    """64-bit words of a grey grid (four of 16 x 17): a bit is set where a cell's right neighbour is brighter, row by row.
    A word holds whole rows, so columns - 1 divides 64."""
    per = 64 // (columns - 1)
    ups = lambda r: F.zip_with(
        F.slice(r, 1, columns - 1), F.slice(r, 2, columns - 1), lambda x,
        y: F.when(y > x, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    )
    row = lambda s, r: F.aggregate(ups(r), s, lambda w, b: F.shiftleft(w, 1).bitwiseOR(b))
    return F.transform(
        F.sequence(F.lit(0), F.lit(rows // per - 1)),
        lambda i: F.aggregate(F.slice(grid, i * per + 1, per), F.lit(0).cast("bigint"), row)
    )
