"""Row audits of events against recordings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.det import free_name, stored
from .link import clock_seconds, parse_segment_name, segment_times

#: Overlapping pairs that temporal_nms settles at once on the driver.
FEW = 100_000


def clock_offset(segment_start: Column, clock: Column) -> Column:
    """Seconds from a segment's start to a clock time put on the start's date: a time more than six hours before the
    start is of the next day, and what is still negative gets a day."""
    return _offset(segment_start, clock_seconds(clock))


def _offset(segment_start: Column, seconds: Column) -> Column:
    day_start = F.hour(segment_start) * 3600 + F.minute(segment_start) * 60 + F.second(segment_start)
    off = seconds - day_start
    off = F.when(off < -6 * 3600, off + 86_400).otherwise(off)
    return F.when(off < 0, off + 86_400).otherwise(off)


#: The tables that issues of the alignment are listed in, by the reason or the flag of a row.
ISSUES = {
    "missing_video": "reason = 'missing_video'",
    "parse_errors": "reason in ('cannot_parse_segment', 'cannot_parse_event_time')",
    "offset_exceeds_segment": "reason = 'offset_exceeds_segment'", "offset_mismatch": "offset_mismatch",
    "bad_duration": "bad_duration",
}
#: Beside the issues: all rows with what was worked out, and those that are in order.
FIXED, VERIFIED = "fixed", "verified"


def verify_alignment(df: DataFrame, files: DataFrame, most_diff: float = 1.0, least: float = 1.0) -> DataFrame:
    """df with calc_offset_sec, segment_sec, reason (the first check that fails, or ok), offset_mismatch, bad_duration (none
    or not above 0, of rows that are ok otherwise) and duration_fixed (of those what the clock times say; `least` at least).
    df: event_idx, filename, path, start_time, end_time, duration_sec, offset_sec. files: path."""
    there, seg = free_name("_there", df), free_name("_seg", df)
    rows = df.join(
        files.select("path").distinct().withColumn(there, F.lit(True)), "path", "left"
    ).withColumn(seg, parse_segment_name(F.col("filename")))
    rows = rows.withColumn("segment_sec", F.col(f"{seg}.seconds")).withColumn(
        "calc_offset_sec", clock_offset(F.col(f"{seg}.start"), F.col("start_time"))
    )
    reason = (
        F.when(F.col(seg).isNull() | (F.col("segment_sec") <= 0), "cannot_parse_segment")
        .when(F.col(there).isNull(), "missing_video").when(F.col("calc_offset_sec").isNull(), "cannot_parse_event_time")
        .when(F.col("calc_offset_sec") > F.col("segment_sec"), "offset_exceeds_segment").otherwise("ok")
    )
    spent = F.pmod(clock_seconds(F.col("end_time")) - clock_seconds(F.col("start_time")), F.lit(86_400.0))
    bad = ~F.coalesce(F.col("duration_sec") > 0, F.lit(False))
    fixed = F.greatest(F.when(bad, F.coalesce(spent, F.lit(0.0))).otherwise(F.col("duration_sec")), F.lit(least))
    off = F.coalesce(F.abs(F.col("calc_offset_sec") - F.col("offset_sec")) > most_diff, F.lit(False))
    ok = reason == "ok"
    return rows.withColumns(
        {"reason": reason, "offset_mismatch": ok & off, "bad_duration": ok & bad, "duration_fixed": fixed}
    ).drop(seg, there)


def alignment_outcomes(checked: DataFrame) -> DataFrame:
    """The rows of verify_alignment once for each table that they belong to, by `outcome`: fixed, verified, and the issues."""
    tables = F.array_compact(
        F.array(
            F.lit(FIXED), F.when(F.col("reason") == "ok", VERIFIED),
            *[F.when(F.expr(c), n) for n, c in ISSUES.items()]
        )
    )
    return checked.withColumn("outcome", F.explode(tables))


def write_alignment(checked: DataFrame, path: str, kind: str = "parquet") -> str:
    """Writes all tables in one pass, a folder each (`outcome=<name>`); read_alignment reads one back."""
    alignment_outcomes(checked).write.mode("overwrite").option("header", True).partitionBy("outcome").format(kind).save(path)
    return path


def read_alignment(
    checked_schema: StructType, spark: SparkSession, path: str, outcome: str, kind: str = "parquet"
) -> DataFrame:
    """One table of write_alignment; only its folder is read. A table without rows is empty."""
    schema = StructType([*checked_schema.fields, StructField("outcome", StringType())])
    rows = spark.read.option("header", True).schema(schema).format(kind).load(path)
    return rows.where(F.col("outcome") == outcome).drop("outcome")


def alignment_summary(checked: DataFrame) -> DataFrame:
    """reason, n, mismatches."""
    return checked.groupBy("reason").agg(F.count("*").alias("n"), F.count_if("offset_mismatch").alias("mismatches"))


def audit_events(
    df: DataFrame, videos: DataFrame, most_diff: float = 5.0, keep: Sequence[str] = ()
) -> DataFrame:
    """event_idx, status (OK, WARN, FAIL), issues (joined by '|'), and the columns to keep. videos: path, actual_sec.

    All checks count, but what follows a missing recording is left out; a computed offset of 0 counts as none.
    """
    rows = df.join(
        videos.select("path", "actual_sec"), "path", "left"
    )
    start, end = segment_times(F.col("filename"))
    # Columns, so that each text is parsed once however often its time is used.
    rows = rows.withColumns({"_start": start, "_end": end, "_clock": clock_seconds(F.col("start_time"))})
    named = F.col("_start").isNotNull() & F.col("_end").isNotNull()
    calc = F.when(named, _offset(F.col("_start"), F.col("_clock")))
    rows = rows.withColumn("_calc", F.nullif(calc, F.lit(0.0))).withColumn("_there", F.col("actual_sec").isNotNull())
    offset = F.coalesce("_calc", "offset_sec", F.lit(0.0))
    there = F.col("_there")
    hidden = F.coalesce(F.col("filename").startswith("._"), F.lit(False))
    exceeds = there & (F.col("actual_sec") > 0) & (offset > F.col("actual_sec"))
    issues = F.array_compact(F.array(
        F.when(hidden, "hidden_file"), F.when(F.coalesce("duration_sec", F.lit(0.0)) <= 0, "zero_duration"),
        F.when(~there, "video_not_found"),
        F.when(there & ~named, "cannot_parse_filename"),
        F.when(there & (F.abs(F.col("_calc") - F.col("offset_sec")) > most_diff), "offset_mismatch"),
        F.when(exceeds, "offset_exceeds_duration"),
    ))
    status = F.when(hidden | ~there | exceeds, "FAIL").when(F.size("_issues") > 0, "WARN").otherwise("OK")
    return rows.withColumn("_issues", issues).select(
        "event_idx", status.alias("status"), F.array_join("_issues", "|").alias("issues"), *keep
    )


def audit_by_class(df: DataFrame, audited: DataFrame, label: str = "behavior", idx: str = "event_idx") -> DataFrame:
    """label, issue, n: how many events of each class failed or were warned of for each issue (of audit_events). Audited rows that
    keep the label aren't joined to df."""
    # Outer, and the filter behind it: a filter on issues would be pushed down and work all checks out again.
    rows = audited.withColumn("issue", F.explode_outer(F.split("issues", r"\|"))).where(F.col("issue") != "")
    if label not in audited.columns:
        rows = rows.join(df.select(idx, label), idx)
    return rows.groupBy(label, "status", "issue").agg(F.count("*").alias("n"))


def verify_paths(
    manifest: DataFrame, files: DataFrame, k: int = 3, camera: str = "camera", path: str = "path"
) -> DataFrame:
    """camera, path, present: of the first k files of each camera by path."""
    first = manifest.select(camera, path).distinct().withColumn(
        "_r", F.row_number().over(Window.partitionBy(camera).orderBy(path))
    ).where(F.col("_r") <= k)
    there = files.select(path).distinct().withColumn("present", F.lit(True))
    return first.join(there, path, "left").select(camera, path, F.coalesce("present", F.lit(False)).alias("present"))


def pool_validity(df: DataFrame) -> DataFrame:
    """Rows of a pool that are valid: by its column `valid`, else with hash and size and a blank error."""
    if "valid" in df.columns:
        return df.where(F.lower(F.col("valid").cast("string")).isin("true", "1", "yes"))
    return df.where(
        F.col("hash").isNotNull() & F.col("size").isNotNull() & (F.coalesce(F.trim("error"), F.lit("")) == "")
    )


def clip_presence(df: DataFrame, files: DataFrame, label: str = "behavior", idx: str = "event_idx") -> DataFrame:
    """Adds clip and present: whether evt_<4 digits>_<label>.mp4 is among the files' names."""
    clip = F.concat(
        F.lit("evt_"),
        F.when(F.col(idx) < 10_000, F.lpad(F.col(idx).cast("string"), 4, "0")).otherwise(F.col(idx).cast("string")),
        F.lit("_"), F.col(label), F.lit(".mp4")
    )
    there = files.select("name").distinct().withColumn("_there", F.lit(True))
    rows = df.withColumn("clip", clip)
    return rows.join(
        there, rows["clip"] == there["name"], "left"
    ).withColumn("present", F.col("_there").isNotNull()).drop("_there", "name")


def corrupt_impact(events: DataFrame, bad: DataFrame, video: str = "video", group: str = "grp") -> DataFrame:
    """group, events, videos that unreadable recordings touch."""
    return events.join(bad.select(video).distinct(), video, "left_semi").groupBy(group).agg(
        F.count("*").alias("events"), F.countDistinct(video).alias("videos")
    )


def filter_tracks(
    df: DataFrame, least: int = 5, confidence: float = 0.4, most_gap: int = 10,
    keys: Sequence[str] = ("video", "track"), frame: str = "frame"
) -> DataFrame:
    """keys, n, mean_conf, gaps_filled of tracks that stay: long and sure enough; gaps of up to most_gap frames count as filled."""
    gap = F.col(frame) - F.lag(frame).over(Window.partitionBy(*keys).orderBy(frame)) - 1
    rows = df.withColumn("_gap", F.coalesce(gap, F.lit(0)))
    fill = F.when((F.col("_gap") > 0) & (F.col("_gap") <= most_gap), F.col("_gap")).otherwise(0)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("mean_conf"), F.sum(fill).alias("gaps_filled")
    )
    return out.where((F.col("n") >= least) & (F.col("mean_conf") >= confidence))


def fill_tracks(
    df: DataFrame, values: Sequence[str], least: int = 5, confidence: float = 0.4, most_gap: int = 10,
    keys: Sequence[str] = ("video", "track"), frame: str = "frame"
) -> DataFrame:
    """keys, frame, values, filled: the frames of the tracks that filter_tracks keeps, and a row for each missing frame of a gap
    of up to most_gap frames, with values on the line between the frames beside it (null where one of them is null). Gaps
    that are longer stay open. Of rows of a track with the same frame the first by its values counts."""
    once = F.row_number().over(Window.partitionBy(*keys, frame).orderBy(*values))
    names = {n: free_name(n, df) for n in ("_once", "_from", "_part")}
    rows = df.withColumn(names["_once"], once).where(F.col(names["_once"]) == 1).drop(names["_once"])
    kept = filter_tracks(rows, least, confidence, most_gap, keys, frame).select(*keys)
    track = Window.partitionBy(*keys).orderBy(frame)
    gap = F.col(frame) - F.lag(frame).over(track) - 1
    start = F.when((gap > 0) & (gap <= most_gap), F.lag(frame).over(track) + 1).otherwise(F.col(frame))
    before = [F.lag(v).over(track).cast("double").alias(f"_before_{i}") for i, v in enumerate(values)]
    rows = rows.join(kept, list(keys), "left_semi").select(
        *keys, F.col(frame).alias(names["_from"]), start.alias("_start"), *before,
        *[F.col(v).cast("double").alias(f"_at_{i}") for i, v in enumerate(values)]
    )
    rows = rows.withColumn("_frame", F.explode(F.sequence("_start", names["_from"])))
    share = (F.col("_frame") - F.col("_start") + 1) / (F.col(names["_from"]) - F.col("_start") + 1)
    filled = F.col("_frame") < F.col(names["_from"])
    lines = [
        F.when(
            filled, F.col(f"_before_{i}") + (F.col(f"_at_{i}") - F.col(f"_before_{i}")) * share
        ).otherwise(F.col(f"_at_{i}")).alias(v)
        for i, v in enumerate(values)
    ]
    return rows.select(*keys, F.col("_frame").alias(frame), *lines, filled.alias("filled"))


def temporal_nms(
    df: DataFrame, iou: float = 0.5, video: str = "video", idx: str = "event_idx", start: str = "start_sec",
    end: str = "end_sec", score: str = "score"
) -> DataFrame:
    """idx of scored intervals that no kept interval of a higher score (ties: smaller idx) in their video covers by more than `iou`.

    Overlapping pairs are found in bins of time, of a width for each octave of lengths, so that an interval is in few
    bins. Then rounds on Spark: intervals that no open stronger one overlaps stay, those they cover go, and the pairs of
    both are closed; what is left is written to the shared folder. The last FEW pairs are settled one after the other.
    iou: 0 or more.
    """
    length = F.col(end).cast("double") - F.col(start).cast("double")
    node = F.struct(F.col(video).alias("v"), F.col(idx).alias("i"))
    rows = df.select(
        F.col(video).alias("v"), node.alias("node"),
        F.struct((-F.col(score)).alias("o"), F.col(idx).alias("i")).alias("rank"),
        F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"),
        F.floor(F.log2(length)).cast("int").alias("octave")
    ).where(length > 0)
    apart = math.ceil(math.log2(1 / max(iou, 2.0**-40))) + 1  # octaves between lengths that may still have this overlap

    def binned(x: DataFrame, tag: str) -> DataFrame:
        """Columns with a tag, but octave and bin."""
        w = F.pow(F.lit(2.0), F.col("octave") + 1)
        x = x.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / w), F.floor(F.col("e") / w))))
        return x.select(
            "octave", "bin", *[F.col(c).alias(f"{c}_{tag}") for c in x.columns if c not in ("octave", "bin")]
        )

    longer = binned(rows.withColumn("own", F.col("octave")), "x")
    shorter = binned(
        rows.withColumn("own", F.col("octave")).withColumn(
            "octave", F.explode(F.sequence(F.col("octave"), F.col("octave") + apart))
        ),
        "y"
    )
    met = longer.join(
        shorter,
        (
            longer["octave"] == shorter["octave"]
        ) & (longer["bin"] == shorter["bin"]) & longer["v_x"].eqNullSafe(shorter["v_y"])
    )
    both = F.greatest(F.least("e_x", "e_y") - F.greatest("s_x", "s_y"), F.lit(0.0))
    overlap = both / F.greatest((F.col("e_x") - F.col("s_x")) + (F.col("e_y") - F.col("s_y")) - both, F.lit(1e-9))
    once = (
        F.floor(F.greatest("s_x", "s_y") / F.pow(F.lit(2.0), longer["octave"] + 1)) == longer["bin"]
    ) & ((F.col("own_y") < F.col("own_x")) | (F.col("rank_x") < F.col("rank_y")))
    first = F.col("rank_x") < F.col("rank_y")
    pairs = met.where(once & (overlap > iou)).select(
        F.when(first, F.col("node_x")).otherwise(F.col("node_y")).alias("a"),
        F.when(first, F.col("node_y")).otherwise(F.col("node_x")).alias("b"),
        F.when(first, F.col("rank_x")).otherwise(F.col("rank_y")).alias("rank")
    )
    pairs = stored(pairs, "nms-pairs")
    gone = []
    while pairs.count() > FEW:
        weak = pairs.select(F.col("b").alias("a")).distinct()
        covered = stored(pairs.join(weak, "a", "left_anti").select("b").distinct(), "nms-covered")
        gone.append(covered)
        settled = pairs.join(weak, "a", "left_anti").select("a").union(covered.select(F.col("b").alias("a"))).distinct()
        pairs = stored(
            pairs.join(settled, "a", "left_anti").join(covered, "b", "left_anti").select("a", "b", "rank"),
            "nms-pairs"
        )
    last: set[tuple] = set()
    for r in pairs.orderBy("rank").collect():
        if tuple(r["a"]) not in last:
            last.add(tuple(r["b"]))
    gone.append(df.sparkSession.createDataFrame([(x,) for x in last], pairs.select("b").schema))
    return df.select(video, idx).withColumn("b", node).join(
        reduce(DataFrame.unionByName, gone), "b", "left_anti"
    ).select(video, idx)
