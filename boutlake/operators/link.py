"""Joins of events to recordings: point in interval with tolerance and priority, repair of mappings, and look-ups.

A bare range predicate with (group, day) as the only equal key would compare all events of a day with all its segments.
Here time is cut into bins as long as a segment; a segment is copied to the bins that it (with the tolerance) reaches,
an event has one bin, and (group, day, bin) is the key of an ordinary equi-join. An event's clock time is put on the
segment's start date, so bins are seconds of that day and none lies beyond midnight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1_800

#: Recording file names: channel, start, end. Fixed pattern.
SEGMENT_NAME = r"_ch(\d+)_main_(\d{14})_(\d{14})"
CLOCK = r"^(\d{1,2}):(\d{2}):(\d{2})$"


def segment_times(name: Column) -> tuple[Column, Column]:
    """Start and end that a recording's file name says; either is null if it says none."""
    part = [F.regexp_extract(name, SEGMENT_NAME, i) for i in (2, 3)]
    return tuple(F.try_to_timestamp(p, F.lit("yyyyMMddHHmmss")) for p in part)


def parse_segment_name(name: Column) -> Column:
    """struct(channel, start, end, seconds) of a recording's file name; null if it is none."""
    channel = F.regexp_extract(name, SEGMENT_NAME, 1)
    start, end = segment_times(name)
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    made = F.struct(
        channel.try_cast("int").alias("channel"), start.alias("start"), end.alias("end"),
        seconds.cast("double").alias("seconds")
    )
    return F.when(start.isNotNull() & end.isNotNull(), made)


def clock_seconds(text: Column) -> Column:
    """Seconds of the day of H:MM:SS, or null."""
    part = [F.regexp_extract(F.trim(text), CLOCK, i).try_cast("int") for i in (1, 2, 3)]
    return (part[0] * 3600 + part[1] * 60 + part[2]).cast("double")


def _binned(segments: DataFrame, tolerance: float, keys: Sequence[str]) -> DataFrame:
    low, high = F.greatest(F.col("seg_start") - tolerance, F.lit(0.0)), F.least(
        F.col("seg_end") + tolerance, F.lit(86_399.999)
    )
    bins = F.sequence(F.floor(low / BIN), F.floor(high / BIN))
    return segments.where(low <= high).withColumn("_bin", F.explode(bins))


def _hits(events: DataFrame, segments: DataFrame, tolerance: float, keys: Sequence[str]) -> DataFrame:
    """event_idx, time of events with each segment they may belong to, and if exactly."""
    placed = events.select("event_idx", *keys, "time_sec", F.floor(F.col("time_sec") / BIN).alias("_bin"))
    met = placed.join(_binned(segments, tolerance, keys), [*keys, "_bin"])
    exact = (F.col("time_sec") >= F.col("seg_start")) & (F.col("time_sec") < F.col("seg_end"))
    near = F.col("time_sec").between(F.col("seg_start") - tolerance, F.col("seg_end") + tolerance)
    return met.withColumn("exact", exact).where(exact | near if tolerance > 0 else exact).drop("_bin")


def link_events(
    events: DataFrame, segments: DataFrame, tolerance: float = 60.0, keys: Sequence[str] = ("grp", "day")
) -> DataFrame:
    """Each event with its segment: columns of events, linked, camera, seg_idx, offset_sec.

    events: event_idx, keys, time_sec (second of the day; null if unreadable). segments: keys, camera, camera_order,
    seg_idx (order within the camera), seg_start, seg_end (seconds of the start's day). The first camera in order with
    any hit wins; in it an exact hit [start, end) before one within the closed tolerance, then the smallest offset (of
    exact ones), or the first segment (of near ones). The offset is 0 for events before the segment. Events without a
    readable time or without any segment of their keys are not in the result (see unlinked_reasons).
    """
    hits = _hits(events, segments, tolerance, keys).withColumn(
        "offset_sec", F.greatest(F.col("time_sec") - F.col("seg_start"), F.lit(0.0))
    )
    order = ["camera_order", F.desc("exact"), F.when(F.col("exact"), F.col("offset_sec")), "seg_idx"]
    best = hits.withColumn("_r", F.row_number().over(Window.partitionBy("event_idx").orderBy(*order))).where("_r = 1")
    days = segments.select(*keys).distinct()
    known = events.where("time_sec is not null").join(days, [*keys], "left_semi")
    return known.join(
        best.select("event_idx", "camera", "seg_idx", "offset_sec"), "event_idx", "left"
    ).withColumn("linked", F.col("seg_idx").isNotNull())


def unlinked_reasons(
    events: DataFrame, segments: DataFrame, tolerance: float = 60.0, keys: Sequence[str] = ("grp", "day")
) -> DataFrame:
    """event_idx, reason of every event that isn't linked: no_time, no_segments or no_match."""
    linked = link_events(events, segments, tolerance, keys).where("linked").select(
        "event_idx", F.lit(True).alias("_linked")
    )
    days = segments.select(*keys).distinct().withColumn("_day", F.lit(True))
    rows = events.join(linked, "event_idx", "left").where("_linked is null").join(days, [*keys], "left")
    return rows.select(
        "event_idx",
        F.when(
            F.col("time_sec").isNull(), "no_time"
        ).when(F.col("_day").isNull(), "no_segments").otherwise("no_match").alias("reason")
    )


def relink_priority(
    linked: DataFrame, segments: DataFrame, priority: DataFrame, keys: Sequence[str] = ("grp", "day")
) -> DataFrame:
    """Linked events moved to the camera that ranks first: event_idx, camera, seg_idx, offset_sec, status.

    priority: grp, camera, rank, excluded. Only exact hits count; cameras without a rank come behind, by number;
    excluded ones never. Without a hit the old link stays (failed); rows that were not linked stay (unlinked).
    """
    olds = linked.select(
        "event_idx", F.col("camera").alias("old_camera"), F.col("seg_idx").alias("old_seg"),
        F.col("offset_sec").alias("old_offset"), "linked"
    )
    hits = _hits(linked.where("linked").select("event_idx", *keys, "time_sec"), segments, 0.0, keys)
    ranked = hits.join(
        priority.select("grp", "camera", "rank", "excluded"), ["grp", "camera"], "left"
    ).where(~F.coalesce("excluded", F.lit(False)))
    order = [F.coalesce(F.col("rank"), 1000 + F.col("camera")), "seg_idx"]
    best = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("event_idx").orderBy(*order))).where("_r = 1")
    best = best.select("event_idx", "camera", "seg_idx", (F.col("time_sec") - F.col("seg_start")).alias("offset_sec"))
    rows = olds.join(best, "event_idx", "left")
    status = F.when(~F.col("linked"), "unlinked").when(F.col("seg_idx").isNull(), "failed").when(
        (F.col("camera") == F.col("old_camera")) & (F.col("seg_idx") == F.col("old_seg")), "unchanged"
    ).otherwise("changed")
    return rows.select(
        "event_idx", F.coalesce("camera", "old_camera").alias("camera"),
        F.coalesce("seg_idx", "old_seg").alias("seg_idx"),
        F.coalesce("offset_sec", "old_offset").alias("offset_sec"), status.alias("status")
    )


def candidate_cameras(
    linked: DataFrame, segments: DataFrame, pad: float = 3.0, keys: Sequence[str] = ("grp", "day")
) -> DataFrame:
    """All cameras that saw an event: event_idx, camera, seg_idx, clip_start, clip_end, is_current."""
    hits = _hits(linked.where("linked").select("event_idx", *keys, "time_sec"), segments, 0.0, keys)
    current = linked.select("event_idx", F.col("camera").alias("_camera"), "duration_sec")
    offset = F.col("time_sec") - F.col("seg_start")
    end = F.least(offset + F.col("duration_sec") + pad, F.col("seg_end") - F.col("seg_start"))
    return hits.join(current, "event_idx").select(
        "event_idx", "camera", "seg_idx", F.greatest(offset - pad, F.lit(0.0)).alias("clip_start"),
        end.alias("clip_end"), F.coalesce(F.col("camera") == F.col("_camera"), F.lit(False)).alias("is_current")
    )


def fix_segment_mapping(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Each row's file in its own folder whose interval holds the event: event_idx, file, status.

    rows: event_idx, folder, file, seconds (of the event; null: unreadable). files: folder, file, seg_start, seg_end.
    status: ok (file is new or old), bad_filename, bad_start_time, no_segment (the old file stays).
    """
    placed = rows.withColumn("_bin", F.floor(F.col("seconds") / BIN))
    bins = F.explode(F.sequence(F.floor(F.col("seg_start") / BIN), F.floor(F.col("seg_end") / BIN)))
    binned = files.select("folder", F.col("file").alias("new_file"), "seg_start", "seg_end", bins.alias("_bin"))
    hits = placed.join(binned, ["folder", "_bin"]).where("seconds >= seg_start and seconds < seg_end")
    best = hits.groupBy("event_idx").agg(F.min("new_file").alias("new_file"))
    out = rows.join(best, "event_idx", "left")
    status = F.when(F.col("file").isNull(), "bad_filename").when(
        F.col("seconds").isNull(), "bad_start_time"
    ).when(F.col("new_file").isNull(), "no_segment").otherwise("ok")
    return out.select("event_idx", F.coalesce("new_file", "file").alias("file"), status.alias("status"))


def shift_segment(
    df: DataFrame, seg: str = "seg_idx", offset: str = "offset_sec", length: str = "seg_len",
    most_excess: float = 120.0
) -> DataFrame:
    """An offset behind the segment's end by `most_excess` at most goes to the next segment; adds `shifted`."""
    excess = F.col(offset) - F.col(length)
    over = F.coalesce((excess > 0) & (excess <= most_excess), F.lit(False))
    return df.withColumn("shifted", over).withColumn(
        seg, F.when(over, F.col(seg) + 1).otherwise(F.col(seg))
    ).withColumn(offset, F.when(over, excess).otherwise(F.col(offset)))


def resolve_segment(
    df: DataFrame, files: DataFrame, most_shift: int = 3, keys: Sequence[str] = ("grp", "day", "camera")
) -> DataFrame:
    """The nearest existing segment around a row's own that holds it: event_idx, seg_idx, offset_sec, shift.

    df: event_idx, keys, seg_idx, time_sec, seg_start, seg_len. files: keys, seg_idx. Shifts are tried 0, 1, -1, 2, ...;
    the interval is the own one moved by so many lengths. Without a hit the own segment stays, with the offset plus one
    length if negative, else modulo the length (shift null).
    """
    order = [0, *(s for k in range(1, most_shift + 1) for s in (k, -k))]
    tries = F.posexplode(F.array(*[F.lit(s) for s in order])).alias("_order", "shift")
    rows = df.select("*", tries).withColumn(
        "_from", F.col("seg_start") + F.col("shift") * F.col("seg_len")
    ).withColumn("_seg", F.col("seg_idx") + F.col("shift"))
    inside = rows.where((F.col("time_sec") >= F.col("_from")) & (F.col("time_sec") < F.col("_from") + F.col("seg_len")))
    there = inside.join(files.select(*keys, F.col("seg_idx").alias("_seg")).distinct(), [*keys, "_seg"], "left_semi")
    best = there.groupBy("event_idx").agg(
        F.min_by(F.struct("_seg", (F.col("time_sec") - F.col("_from")).alias("o"), "shift"), "_order").alias("b")
    )
    off = F.col("time_sec") - F.col("seg_start")
    rest = F.when(off < 0, off + F.col("seg_len")).otherwise(F.pmod(off, F.col("seg_len")))
    return df.join(best, "event_idx", "left").select(
        "event_idx", F.coalesce("b._seg", "seg_idx").alias("seg_idx"),
        F.coalesce(F.col("b.o"), rest).alias("offset_sec"), F.col("b.shift").alias("shift")
    )


def attach_manifest(
    preds: DataFrame, manifest: DataFrame, clip: str = "clip_id", columns: Sequence[str] = ("grp", "camera")
) -> DataFrame:
    """Predictions with event_idx from 'event_<n>' in the clip's name, and the manifest's columns (null without a match)."""
    idx = F.regexp_extract(clip, r"event_(\d+)", 1).try_cast("long")
    return preds.withColumn("event_idx", idx).join(manifest.select("event_idx", *columns), "event_idx", "left")


def propagate_split(derived: DataFrame, splits: DataFrame, base: str = "base_event_idx") -> DataFrame:
    """Derived rows get the split of their base event; without one they are left out."""
    return derived.join(splits.select(F.col("event_idx").alias(base), "split"), base)


def merge_results(plan: DataFrame, results: DataFrame, videos: DataFrame) -> DataFrame:
    """Planned clips with their outcome: event_idx, success, actual_duration, reason.

    results: event_idx, ok, duration. A clip whose recording is missing failed; one without a result exists already.
    """
    there = videos.select("video").distinct().withColumn("_there", F.lit(True))
    rows = plan.join(results.select("event_idx", "ok", "duration"), "event_idx", "left").join(there, "video", "left")
    missing = F.col("_there").isNull()
    success = F.when(missing, False).otherwise(F.coalesce("ok", F.lit(True)))
    reason = F.when(missing, "video_missing").when(
        F.col("ok").isNull(), "existing"
    ).when(F.col("ok"), "extracted").otherwise("failed")
    return rows.select(
        "event_idx", success.alias("success"),
        F.when(success, F.coalesce("duration", "clip_duration")).alias("actual_duration"), reason.alias("reason")
    )
