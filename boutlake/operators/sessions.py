"""Bouts, gaps, overlaps, duplicates and the profile of durations.

Windows are partitioned by the recording, so a table of any size is spread; sums over the whole table are aggregates of
what the windows give.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.det import bin_label, first_rows, free_name, quantiles

#: Edges and names of the bins of gaps, durations and counts.
GAP_EDGES = (float("-inf"), 0, 5, 10, 30, 60, 300, float("inf"))
GAP_LABELS = ("overlap", "0-5s", "5-10s", "10-30s", "30-60s", "1-5min", "5min+")
DURATION_EDGES = (0, 1, 3, 5, 10, 30, 60, float("inf"))
DURATION_LABELS = ("0-1s", "1-3s", "3-5s", "5-10s", "10-30s", "30-60s", "60s+")
COUNT_EDGES = (1, 2, 3, 5, 10, 20, float("inf"))
COUNT_LABELS = ("1", "2", "3-4", "5-9", "10-19", "20+")


def _by_start(video: str, start: str, idx: str) -> Window:
    return Window.partitionBy(video).orderBy(start, idx)


def assign_bouts(
    df: DataFrame, gap: float = 30.0, video: str = "video", start: str = "start_sec",
    duration: str = "duration_sec", idx: str = "event_idx"
) -> DataFrame:
    """Adds bout_id: within a video, a bout ends when the next start is more than `gap` behind the previous row's end."""
    w = _by_start(video, start, idx)
    ended = F.lag(F.col(start) + F.coalesce(F.col(duration), F.lit(0.0))).over(w)
    opens = F.coalesce((F.col(start) - ended > gap).cast("int"), F.lit(0))
    mark = free_name("_opens", df)
    number = F.sum(mark).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1
    return df.withColumn(mark, opens).withColumn(
        "bout_id", F.concat(F.col(video), F.lit("__bout_"), number.cast("string"))
    ).drop(mark)


def bout_summary(df: DataFrame, minority: str = "tail", label: str = "behavior", video: str = "video") -> DataFrame:
    """bout_id, video, n_events, n_tail, has_tail."""
    n = F.count_if(F.col(label) == minority)
    return df.groupBy("bout_id", video).agg(
        F.count("*").alias("n_events"), n.alias("n_tail"), (n > 0).alias("has_tail")
    )


def bout_sizes(summary: DataFrame) -> DataFrame:
    """One row over a bout summary: bouts, mean_size, largest, single (bouts of one event), with_tail; 6 decimals."""
    return summary.agg(
        F.count("*").alias("bouts"), F.round(F.avg("n_events"), 6).alias("mean_size"),
        F.max("n_events").alias("largest"),
        F.count_if(F.col("n_events") == 1).alias("single"), F.count_if("has_tail").alias("with_tail"),
    )


def gaps(
    df: DataFrame, video: str = "video", start: str = "start_sec", duration: str = "duration_sec",
    idx: str = "event_idx"
) -> DataFrame:
    """One row per event that has a predecessor in its video: idx, gap (to the predecessor's end)."""
    ended = F.lag(F.col(start) + F.col(duration)).over(_by_start(video, start, idx))
    return df.select(video, idx, (F.col(start) - ended).alias("gap")).where("gap is not null")


def gap_profile(df: DataFrame, **names: str) -> DataFrame:
    """One row: n, mean, median, least, most, overlaps (< 0) and clusters (< 5, overlaps too), 6 decimals."""
    g, rows = F.col("gap"), gaps(df, **names)
    plain = rows.agg(
        F.count("*").alias("n_gaps"), F.round(F.avg(g), 6).alias("mean_gap"), F.round(F.min(g), 6).alias("min_gap"),
        F.round(F.max(g), 6).alias("max_gap"),
        F.count_if(g < 0).alias("overlaps"), F.count_if(g < 5).alias("clusters"),
    )
    median = quantiles(rows, "gap", {"_median": 0.5}).select(F.round("_median", 6).alias("median_gap"))
    return plain.crossJoin(F.broadcast(median)).select(
        "n_gaps", "mean_gap", "median_gap", "min_gap", "max_gap", "overlaps", "clusters"
    )


def gap_bins(df: DataFrame, **names: str) -> DataFrame:
    return gaps(df, **names).groupBy(
        bin_label(F.col("gap"), GAP_EDGES, GAP_LABELS).alias("bin")
    ).agg(F.count("*").alias("n"))


def overlapping_pairs(
    df: DataFrame, video: str = "video", start: str = "start_sec", duration: str = "duration_sec",
    idx: str = "event_idx"
) -> DataFrame:
    """Neighbours by start of which the first ends behind the second's start: idx, next_idx, overlap_sec."""
    w = _by_start(video, start, idx)
    rows = df.select(
        video, idx, F.lead(idx).over(w).alias("next_idx"),
        (F.col(start) + F.col(duration) - F.lead(start).over(w)).alias("overlap_sec")
    )
    return rows.where("overlap_sec > 0")


def duplicate_events(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All rows whose values in these columns occur more than once (nulls equal nulls)."""
    times = free_name("_times", df)
    return df.withColumn(times, F.count("*").over(Window.partitionBy(*columns))).where(F.col(times) > 1).drop(times)


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many rows repeat an earlier one in these columns."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def dedupe_first(df: DataFrame, columns: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row, by this order, of each value of these columns."""
    return first_rows(df, columns, order)


def max_event_gaps(
    df: DataFrame, label: str = "behavior", minority: str = "tail", idx: str = "event_idx", least: float = 0.3
) -> DataFrame:
    """One row: the minority's range of indices, how much of it is missing, and if they are clustered (little missing)."""
    own = df.where(F.col(label) == minority).agg(
        F.min(idx).alias("first"), F.max(idx).alias("last"), F.countDistinct(idx).alias("n")
    )
    missing = 1 - F.col("n") / (F.col("last") - F.col("first") + 1)
    return own.select(
        "first", "last", "n", F.round(missing, 6).alias("missing_share"), (missing < least).alias("clustered")
    )


def duration_profile(df: DataFrame, duration: str = "duration_sec") -> DataFrame:
    """One row of statistics: sample standard deviation, exact quantiles by linear interpolation, 6 decimals."""
    d = F.col(duration)
    parts = {"mean": F.avg(d), "std": F.stddev_samp(d), "min": F.min(d), "max": F.max(d)}
    places = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    plain = df.agg(
        F.count(d).alias("n"), F.count_if(d == 0).alias("zeros"),
        *[F.round(c, 6).alias(n) for n, c in parts.items()]
    )
    exact = quantiles(df, duration, places).select(*[F.round(n, 6).alias(n) for n in places])
    names = ("n", "zeros", "mean", "median", "std", "min", "max", "p25", "p75", "p90", "p95")
    return plain.crossJoin(F.broadcast(exact)).select(*names)


def duration_bins(df: DataFrame, duration: str = "duration_sec") -> DataFrame:
    """bin, n: left-closed; what lies outside has no row."""
    return df.groupBy(
        bin_label(F.col(duration), DURATION_EDGES, DURATION_LABELS).alias("bin")
    ).agg(F.count("*").alias("n")).where("bin is not null")


def duration_by_label(df: DataFrame, label: str = "behavior", duration: str = "duration_sec") -> DataFrame:
    """label, n, mean, median (exact); 6 decimals."""
    plain = df.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg(duration), 6).alias("mean"))
    median = quantiles(df, duration, {"_median": 0.5}, [label]).select(
        F.col(label).alias("_label"), F.round("_median", 6).alias("median")
    )
    return plain.join(median, F.col(label).eqNullSafe(F.col("_label")), "left").select(label, "n", "mean", "median")


def events_per_video(df: DataFrame, video: str = "video") -> DataFrame:
    """bin, videos: how many videos have how many events."""
    per = df.groupBy(video).agg(F.count("*").alias("n"))
    return per.groupBy(bin_label(F.col("n"), COUNT_EDGES, COUNT_LABELS).alias("bin")).agg(F.count("*").alias("videos"))


def coverage(df: DataFrame, group: str = "grp", video: str = "video") -> DataFrame:
    """Per group: distinct videos and events."""
    return df.groupBy(group).agg(F.countDistinct(video).alias("videos"), F.count("*").alias("events"))


def mode_label(df: DataFrame, key: str = "video", label: str = "behavior") -> DataFrame:
    """key, mode_label: the most frequent label, ties to the first by name."""
    counts = df.groupBy(key, label).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy(F.desc("_n"), label)
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, F.col(label).alias("mode_label"))
