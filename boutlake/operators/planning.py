"""Clip, window and frame plans: one event becomes a window or many, by column algebra and explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.det import quantiles


def plan_clip(
    df: DataFrame, pre: float = 3.0, post: float = 3.0, least: float = 6.0, start: str = "event_start",
    end: str = "event_end", length: str = "video_sec"
) -> DataFrame:
    """Adds clip_start, clip_end, clip_duration, pad_before, pad_after, visible and flags (codes).

    The event is padded, enlarged to the least length on both sides, and clamped to its recording; padding that is lost
    on one side goes to the other. Rounded half-even to 2 decimals.
    """
    s, e, v = F.col(start), F.col(end), F.col(length)
    extra = F.greatest(least - (e - s + pre + post), F.lit(0.0)) / 2
    lost = F.greatest(-(s - pre - extra), F.lit(0.0))
    low = F.greatest(s - pre - extra, F.lit(0.0))
    high = F.when(lost > 0, F.least(e + post + extra + lost, v)).otherwise(e + post + extra)
    over = F.greatest(high - v, F.lit(0.0))
    rows = df.withColumn("_lost", lost).withColumn("_over", over).withColumn(
        "_low", F.when(over > 0, F.greatest(low - over, F.lit(0.0))).otherwise(low)
    ).withColumn("_high", F.least(high, v))
    before, after = s - F.col("_low"), F.col("_high") - e
    visible = (F.col("_low") <= s) & (e <= F.col("_high"))
    flags = F.array_compact(F.array(
        F.when(F.col("_lost") > 0, "start_clamped"), F.when(F.col("_over") > 0, "end_clamped"),
        F.when(~visible, "outside_clip"),
        F.when((before < 1) & (s > 1), "thin_pre"), F.when((after < 1) & (v - e > 1), "thin_post"),
    ))
    r = lambda c: F.bround(c, 2)
    out = rows.withColumns(
        {
            "clip_start": r(F.col("_low")), "clip_end": r(F.col("_high")),
            "clip_duration": r(F.col("_high") - F.col("_low")), "pad_before": r(before), "pad_after": r(after),
            "visible": visible, "flags": flags
        }
    )
    return out.drop("_lost", "_over", "_low", "_high")


def clip_plan_report(plan: DataFrame, label: str = "behavior") -> DataFrame:
    """Per label (null: all): clips, clamped, outside, mean, median, least, most, hours (4 decimals)."""
    d = F.col("clip_duration")
    has = lambda f: F.array_contains("flags", f)
    plain = plan.rollup(label).agg(
        F.grouping_id().alias("_all"),
        F.count("*").alias("clips"), F.count_if(has("start_clamped") | has("end_clamped")).alias("clamped"),
        F.count_if(has("outside_clip")).alias("outside"),
        F.round(F.avg(d), 4).alias("mean"), F.min(d).alias("least"), F.max(d).alias("most"),
        F.round(F.sum(d) / 3600, 4).alias("hours"),
    )
    counts = plan.groupBy(label, d).agg(F.count("*").alias("_clips"))
    both = counts.withColumn("_of", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_label", F.when(F.col("_of") == 0, F.col(label))
    )
    median = quantiles(both, "clip_duration", {"_median": 0.5}, ["_of", "_label"], count="_clips")
    joined = plain.join(median, (F.col("_all") == F.col("_of")) & F.col(label).eqNullSafe(F.col("_label")), "left")
    return joined.select(
        label, "clips", "clamped", "outside", "mean", F.round("_median", 4).alias("median"), "least", "most",
        "hours"
    )


def slide_windows(
    df: DataFrame, length: float, overlap: float = 0.5, cap: int = 20, flip: bool = False,
    start: str = "event_start", end: str = "event_end", idx: str = "event_idx"
) -> DataFrame:
    """idx, window, flipped, win_start, win_end, clip_id: windows over an event.

    A window begins every length * (1 - overlap) seconds (0.1 at least) while its end is within half a stride of the
    event's, and is then pulled back to it; an event shorter than a window gets one, centred. At most `cap` windows.
    """
    stride = max(0.1, length * (1 - overlap))
    s, e = F.col(start), F.col(end)
    n = F.least(F.floor(F.round((e - s - length + stride / 2) / stride, 9)) + 1, F.lit(cap)).cast("int")
    many = F.transform(
        F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.least(s + i * F.lit(stride), e - length)
    )
    one = F.array(F.greatest(F.lit(0.0), (s + e) / 2 - length / 2))
    rows = df.select(idx, F.posexplode(F.when(e - s <= length, one).otherwise(many)).alias("window", "win_start"))
    rows = rows.withColumn("flipped", F.explode(F.array(F.lit(False), F.lit(True)) if flip else F.array(F.lit(False))))
    name = F.concat(
        F.format_string("evt_%04d_w%02d", F.col(idx), F.col("window")),
        F.when(F.col("flipped"), "_flip").otherwise("")
    )
    return rows.select(
        idx, "window", "flipped", F.round("win_start", 6).alias("win_start"),
        F.round(F.col("win_start") + length, 6).alias("win_end"), name.alias("clip_id")
    )


def spread_clips(
    df: DataFrame, n: int, length: float, start: str = "event_start", end: str = "event_end",
    idx: str = "event_idx"
) -> DataFrame:
    """idx, clip_idx, clip_start: n evenly spaced starts in [start, end - length]; one if the event is no longer than a clip."""
    s, room = F.col(start), F.col(end) - F.col(start) - length
    many = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: s + room * i / F.lit(max(1, n - 1)))
    return df.select(idx, F.posexplode(F.when(room <= 0, F.array(s)).otherwise(many)).alias("clip_idx", "clip_start"))


def frame_indices(
    start: Column, end: Column, source_fps: Column, frames: Column, length: int = 16, fps: float = 12.0,
    jitter: Column | None = None
) -> Column:
    """Array of `length` frame numbers around the event's middle (moved by jitter seconds), a stride of the rates' quotient apart, clamped."""
    stride = F.greatest(F.bround(source_fps / fps), F.lit(1.0))
    middle = (start + end) / 2 + (jitter if jitter is not None else F.lit(0.0))
    first = F.bround(middle * source_fps) - stride * (length // 2)
    return F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda i: F.least(F.greatest(first + i * stride, F.lit(0.0)), frames - 1).cast("int")
    )


def keyframes(
    df: DataFrame, every: int = 15, frames: str = "frames", fps: str = "fps", idx: str = "event_idx"
) -> DataFrame:
    """idx, frame, time_sec (3 decimals): every so many frames, and the last; nothing where there are no frames."""
    n = F.col(frames)
    numbers = F.array_union(F.sequence(F.lit(0), n - 1, F.lit(every)), F.array(n - 1))
    rows = df.where(n > 0).select(idx, fps, F.explode(numbers).alias("frame"))
    return rows.select(idx, "frame", F.bround(F.col("frame") / F.col(fps), 3).alias("time_sec"))


def even_frames(frames: Column, n: int) -> Column:
    """n frame numbers from first to last, cut to whole numbers."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.floor(F.round((frames - 1) * i / F.lit(max(1, n - 1)), 9)).cast("int")
    )


def sample_points(frames: Column, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> Column:
    return F.array(*[F.floor(F.round(frames * p, 9)).cast("int") for p in shares])


def fixed_windows(df: DataFrame, pre: float, length: float, start: str = "event_start") -> DataFrame:
    low = F.greatest(F.lit(0.0), F.col(start) - pre)
    return df.withColumn("win_start", low).withColumn("win_end", F.col("win_start") + length)


def static_clip_flag(
    frames: DataFrame, clip: str = "clip_id", number: str = "frame", mean: str = "grey", variance: str = "variance"
) -> DataFrame:
    """clip, static: mean variance under 5, or the mean change of grey between frames under 1, or no readable frame."""
    diff = F.abs(F.col(mean) - F.lag(mean).over(Window.partitionBy(clip).orderBy(number)))
    rows = frames.withColumn("_diff", diff)
    still = (F.avg(variance) < 5) | (F.avg("_diff") < 1)
    return rows.groupBy(clip).agg((F.coalesce(still, F.lit(False)) | (F.count(mean) == 0)).alias("static"))
