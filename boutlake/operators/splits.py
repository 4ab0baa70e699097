"""Deterministic leak-free splits, stratification, balancing and selection.

All choices are ranks by an md5 of a seed and a key within a partition, so that a plan has one window a choice and gives
the same rows wherever it runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.det import draw, first_rows, free_name, numbered, uniform


def _ranked(partition: Sequence[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def split_bouts(
    df: DataFrame, val: float = 0.15, seed: int = 42, minority: str = "tail", video: str = "video",
    label: str = "behavior"
) -> DataFrame:
    """bout_id, split. Per video: one bout goes to train; with two bouts or more of either kind (with minority or not)
    ceil(n * val) of each kind's share go to val (by largest remainder: a quota in the order of the draw), else
    max(1, floor(n * val)) at random."""
    bouts = df.groupBy(video, "bout_id").agg(F.bool_or(F.col(label) == minority).alias("has"))
    return _quota_split(bouts, video, "has", "bout_id", val, 2, 2, seed)


def split_events_intravideo(
    df: DataFrame, val: float = 0.2, least: int = 3, seed: int = 42, video: str = "video", label: str = "behavior",
    idx: str = "event_idx"
) -> DataFrame:
    """event_idx, split: as split_bouts for events, by label; videos of fewer than `least` events go to train."""
    return _quota_split(df.select(video, label, idx), video, label, idx, val, least, 2, seed)


def _quota_split(
    items: DataFrame, video: str, stratum: str, key: str, val: float, least: int, least_in_stratum: int, seed: int
) -> DataFrame:
    counts = items.groupBy(video, stratum).agg(F.count("*").alias("n"))
    w = Window.partitionBy(video)
    counts = counts.withColumn("all", F.sum("n").over(w)).withColumn(
        "strata", F.count("*").over(w)
    ).withColumn("smallest", F.min("n").over(w))
    stratified = (F.col("strata") > 1) & (F.col("smallest") >= least_in_stratum)
    goal = F.ceil(F.round(F.col("all") * val, 9))
    exact = F.col("n") * goal / F.col("all")
    left = goal - F.sum(F.floor(exact)).over(w)
    by_rest = F.row_number().over(w.orderBy(F.round(F.floor(exact) - exact, 9), stratum))
    quota = F.floor(exact) + F.when(by_rest <= left, 1).otherwise(0)
    counts = counts.select(video, stratum, "all", stratified.alias("stratified"), quota.alias("quota"))
    rows = items.join(counts, [video, stratum])
    order = draw(seed, video, key)
    in_stratum, in_video = _ranked([video, stratum], order, key), _ranked([video], order, key)
    fallback = F.greatest(F.lit(1), F.floor(F.round(F.col("all") * val, 9)))
    chosen = F.when(F.col("all") < least, False).when(
        F.col("stratified"), in_stratum <= F.col("quota")
    ).otherwise(in_video <= fallback)
    return rows.select(key, F.when(chosen, "val").otherwise("train").alias("split"))


def split_videos(
    modes: DataFrame, val: float = 0.1, test: float = 0.1, seed: int = 42, video: str = "video",
    label: str = "mode_label"
) -> DataFrame:
    """video, split: per label, half-even rounded shares of val and test by the draw, one video of each label in train at least."""
    n = F.count("*").over(Window.partitionBy(label))
    rank = _ranked([label], draw(seed, video), video)
    n_val, n_test = F.bround(n * val), F.bround(n * test)
    room = n - 1
    n_test = F.least(n_test, room)
    n_val = F.least(n_val, room - n_test)
    split = F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "val").otherwise("train")
    return modes.select(video, split.alias("split"))


def holdout_groups(df: DataFrame, groups: Sequence[int], group: str = "grp") -> DataFrame:
    """Adds split: ood for the listed groups, dev for the rest (null too)."""
    return df.withColumn("split", F.when(F.col(group).isin(*groups), "ood").otherwise("dev"))


def oversample(
    df: DataFrame, ratio: float = 0.3, seed: int = 42, label: str = "behavior", minority: str = "tail",
    majority: str = "ear", idx: str = "event_idx"
) -> DataFrame:
    """df with `draw_no` (0), and int((r * majority - minority * (1 - r)) / (1 - r)) minority rows drawn with replacement
    (draw_no from 1): the k-th draw takes the row at floor(u_k * n) of the minority in the order of idx."""
    counts = df.agg(
        F.count_if(F.col(label) == majority).alias("_maj"), F.count_if(F.col(label) == minority).alias("_min")
    )
    extra = counts.withColumn(
        "_extra",
        F.greatest(
            F.lit(0),
            F.floor(F.round((ratio * F.col("_maj") - F.col("_min") * (1 - ratio)) / (1 - ratio), 9)).cast("int")
        )
    )
    draws = extra.where("_extra > 0 and _min > 0").select(
        F.explode(F.sequence(F.lit(1), F.col("_extra"))).alias("draw_no"), "_min"
    )
    place = free_name("_place", df)
    draws = draws.select("draw_no", F.floor(uniform(seed, "draw_no") * F.col("_min")).cast("long").alias(place))
    rows = numbered(df.where(F.col(label) == minority), idx, place)
    return df.withColumn("draw_no", F.lit(0)).unionByName(rows.join(draws, place).drop(place))


def sample_weights(df: DataFrame, label: str = "behavior") -> DataFrame:
    """Adds weight: one over the row's class count (1 at least)."""
    size = free_name("_size", df)
    counts = df.groupBy(label).agg(F.count("*").alias(size))
    return df.join(counts, label).withColumn("weight", 1 / F.greatest(F.col(size), F.lit(1))).drop(size)


def weighted_draw(df: DataFrame, n: int, seed: int = 42, weight: str = "weight", idx: str = "event_idx") -> DataFrame:
    """n rows without replacement with chances by weight: the smallest -ln(u) / weight."""
    key = F.round(-F.ln(F.greatest(uniform(seed, idx), F.lit(1e-12))) / F.col(weight), 6)
    return df.orderBy(key, idx).limit(n)


def move_minority_videos(
    train: DataFrame, val: DataFrame, add: int, seed: int = 42, video: str = "video", label: str = "behavior",
    minority: str = "tail"
) -> DataFrame:
    """video, n of the train videos that go to val: by their minority count from the top, ties by the draw, until val has
    gained `add`. Too few is an error, as is a video that val has already."""
    counts = train.groupBy(video).agg(F.count_if(F.col(label) == minority).alias("n")).where("n > 0")
    if counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] < add:
        raise ValueError(f"train has fewer than {add} of {minority}")
    if not train.select(video).intersect(val.select(video)).isEmpty():
        raise ValueError("train and val share videos")
    # The choice ends within the `add` first videos, each of which brings one at least.
    top = counts.orderBy(F.desc("n"), draw(seed, video), video).limit(add)
    w = Window.orderBy(F.desc("n"), draw(seed, video), video).rowsBetween(Window.unboundedPreceding, -1)
    return top.withColumn(
        "_before", F.coalesce(F.sum("n").over(w), F.lit(0))
    ).where(F.col("_before") < add).drop("_before")


def select_diverse(
    df: DataFrame, n: int, seed: int = 42, label: str = "behavior", rare: Sequence[str] = ("tail", "other"),
    majority: str = "ear", cells: Sequence[str] = ("grp", "camera"), idx: str = "event_idx", share: float = 0.35,
    done: DataFrame | None = None
) -> DataFrame:
    """n rows: rare classes up to a share, the majority evenly over cells, the rest at random; adds `tier` (1, 2, 3). done: a
    table with idx of rows that aren't to be chosen again."""
    if done is not None:
        df = df.join(done.select(idx), idx, "left_anti")
    order = draw(seed, idx)
    is_rare = F.col(label).isin(*rare)
    rare_n = int(n * share)
    first = df.where(is_rare).orderBy(order, idx).limit(rare_n).withColumn("tier", F.lit(1))
    sizes = df.where(F.col(label) == majority).select(*cells).distinct().count()
    slots = n - first.count()
    per = max(1, slots // max(1, sizes))
    second = df.where(F.col(label) == majority).transform(
        first_rows, cells, [order, idx], per
    ).withColumn("tier", F.lit(2))
    taken = first.select(idx).unionByName(second.select(idx))
    third = df.join(taken, idx, "left_anti").orderBy(order, idx).limit(n).withColumn("tier", F.lit(3))
    return first.unionByName(second).unionByName(third).orderBy("tier", order, idx).limit(n)


def sample_per_class(
    df: DataFrame, k: int, seed: int = 42, label: str = "behavior", idx: str = "event_idx"
) -> DataFrame:
    return first_rows(df, [label], [draw(seed, idx), idx], k)


def pick_longest(
    df: DataFrame, k: int, least: float = 3.0, keys: Sequence[str] = ("grp", "day"),
    duration: str = "duration_sec", idx: str = "event_idx"
) -> DataFrame:
    """Per key the k longest of `least` or more; if there are none, any k (the first by idx)."""
    long = F.col(duration) >= least
    some = F.coalesce(F.max(long.cast("int")).over(Window.partitionBy(*keys)), F.lit(0)) == 1
    order = [F.when(some, F.when(long, 0).otherwise(1)), F.when(some, -F.col(duration)), idx]
    rows = df.withColumn("_some", some).withColumn("_r", _ranked(keys, *order))
    return rows.where((F.col("_r") <= k) & (~F.col("_some") | long)).drop("_some", "_r")


def sample_non_events(
    events: DataFrame, duration: float, buffer: float, length: float = 1_800.0, seed: int = 42,
    video: str = "video", start: str = "offset_sec", event_duration: str = "duration_sec"
) -> DataFrame:
    """video, clip_start: one clip per video, clear of every event and its buffer, uniform over all places there are.

    Forbidden intervals are merged (running maximum of ends), the gaps between them are laid end to end, and a draw
    picks a place. Videos without room have no row.
    """
    low, high = F.greatest(F.lit(0.0), F.col(start) - buffer - duration), F.least(
        F.lit(length), F.col(start) + F.col(event_duration) + buffer
    )
    marks = events.select(video, low.alias("s"), high.alias("e"))
    edge = events.select(video).distinct()
    marks = marks.unionByName(edge.select(video, F.lit(length - duration).alias("s"), F.lit(length).alias("e")))
    w = Window.partitionBy(video).orderBy("s", "e")
    free = marks.withColumn(
        "_from", F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ).withColumn("_room", F.least(F.col("s"), F.lit(length - duration)) - F.col("_from")).where("_room > 0")
    laid = free.withColumn(
        "_upto",
        F.sum("_room").over(Window.partitionBy(video).orderBy("_from").rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_all", F.sum("_room").over(Window.partitionBy(video)))
    at = uniform(seed, video) * F.col("_all")
    hit = laid.where((at >= F.col("_upto") - F.col("_room")) & (at < F.col("_upto")))
    return hit.select(video, F.round(F.col("_from") + at - (F.col("_upto") - F.col("_room")), 3).alias("clip_start"))
