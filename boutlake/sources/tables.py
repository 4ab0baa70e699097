"""Sources and sinks: event sheets, segment listings, nested manifests, rules, predictions, run artefacts, and the files
that splits, plans and annotation tools read. All of it goes through Spark's readers and writers, so any store will do."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.det import free_name, numbered
from ..operators.clean import base_name
from ..operators.link import parse_segment_name

VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv")


def read_events(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV events with a header, without columns whose name begins with 'enter a 0'; text unless a schema is given."""
    # Fixed value: 'enter a 0'.
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.drop(*[c for c in df.columns if c.strip().lower().startswith("enter a 0")])


def read_annotation_sheet(
    spark: SparkSession, path: str, renamed: Mapping[str, str], constant: Sequence[str] = (),
    order: Column | None = None
) -> DataFrame:
    """A sheet exported as CSV: columns dropped and renamed, and event_idx, the row's place in the sheet, or in an order of
    distinct values. A sheet of several files goes by their paths, and a file's rows in their order, however Spark packs
    files and cuts large ones: a row is numbered within the block that it was read in, behind the blocks before."""
    df = spark.read.option("header", True).csv(path)
    file, block, number = (free_name(n, df) for n in ("_file", "_block", "_number"))
    if order is None:
        df = df.select(
            "*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(block),
            F.monotonically_increasing_id().alias(number)
        )
    df = df.drop(*constant).withColumnsRenamed(dict(renamed))
    if order is not None:
        return numbered(df.withColumn(number, order), number, "event_idx").drop(number)
    size = free_name("_before", df)
    sizes = df.groupBy(file, block).agg(F.count("*").alias(size))  # a row per block
    before = F.coalesce(
        F.sum(size).over(Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    own = F.row_number().over(
        Window.partitionBy(file, block).orderBy(number)
    )  # a block is read by one task, so it fits in one
    rows = df.withColumn(number, own).join(F.broadcast(sizes.select(file, block, before.alias(size))), [file, block])
    return rows.withColumn("event_idx", F.col(size) + F.col(number) - 1).drop(file, block, number, size)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length of the files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option(
        "recursiveFileLookup", True
    ).option("pathGlobFilter", glob).load(path)
    return found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length")


def segments_of(files: DataFrame) -> DataFrame:
    """path, filename, camera, start, end, seconds of recordings in folders 'Cam <n>'; unreadable names have nulls there."""
    name = base_name(F.col("path"))
    seg = parse_segment_name(name)
    camera = F.regexp_extract("path", r"(?i)/cam (\d+)/", 1).try_cast("int")
    return files.where(F.lower("path").endswith(".mp4")).select(
        "path", name.alias("filename"), F.coalesce(camera, seg["channel"]).alias("camera"),
        seg["start"].alias("start"), seg["end"].alias("end"), seg["seconds"].alias("seconds")
    )


def scan_segments(spark: SparkSession, path: str) -> DataFrame:
    return segments_of(list_files(spark, path, "*.[mM][pP]4"))


def segment_rollup(segments: DataFrame, expected: DataFrame, folder: Column | str = "folder") -> DataFrame:
    """Per folder and camera (nulls: totals): files, hours (2 decimals, readable names only), sorted dates, and whether the
    camera is unexpected. segments: folder, camera, start, seconds (nulls: unreadable). expected: folder, camera."""
    marks = expected.select("folder", "camera").distinct().withColumn("_known", F.lit(True))
    out = segments.withColumn("_day", F.date_format("start", "yyyy-MM-dd")).rollup("folder", "camera").agg(
        F.count("*").alias("files"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)) / 3600, 2).alias("hours"),
        F.array_join(F.array_sort(F.collect_set("_day")), ",").alias("dates")
    )
    joined = out.join(marks, ["folder", "camera"], "left")
    return joined.select(
        "folder", "camera", "files", "hours", "dates",
        (F.col("camera").isNotNull() & F.col("_known").isNull()).alias("unexpected")
    )


_VIDEO = "array<struct<filename:string,path:string,start:string,end:string,duration_sec:double>>"
_FOLDERS = f"map<string,struct<group_id:int,day:int,cameras:map<string,struct<videos:{_VIDEO}>>>>"


def read_video_manifest(spark: SparkSession, path: str, part: str = "labeled", multi_line: bool = True) -> DataFrame:
    """A nested JSON manifest (a document a file, or a record a line) as flat segments: grp, day, camera, filename, path, start, end, seconds. The folder's name
    gives group and day ('group3_day2') where the fields don't."""
    df = spark.read.schema(f"labeled {_FOLDERS}, unlabeled {_FOLDERS}").option("multiLine", multi_line).json(path)
    return flatten_manifest(df, part)


def flatten_manifest(df: DataFrame, part: str = "labeled") -> DataFrame:
    folders = df.select(F.explode(part).alias("folder", "f")).select(
        "folder", "f.group_id", "f.day", F.explode("f.cameras").alias("camera", "c")
    )
    rows = folders.select("folder", "group_id", "day", "camera", F.explode("c.videos").alias("v"))
    named = lambda i: F.regexp_extract("folder", r"group(\d+)_day(\d+)", i).try_cast("int")
    return rows.select(
        F.coalesce("group_id", named(1)).alias("grp"), F.coalesce("day", named(2)).alias("day"),
        F.col("camera").try_cast("int").alias("camera"), "v.filename", "v.path",
        F.try_to_timestamp("v.start").alias("start"), F.try_to_timestamp("v.end").alias("end"),
        F.col("v.duration_sec").alias("seconds")
    )


def read_rules(spark: SparkSession, path: str) -> dict:
    """Rules as a dict from a YAML file, if a YAML reader is installed, or a JSON file; read through Spark's readers."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("no YAML reader is installed; write the rules as JSON") from e
        return yaml.safe_load(text)
    return json.loads(text)


def rule_table(spark: SparkSession, rules: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """field, raw, norm: label maps as a small table."""
    rows = [(field, raw, norm) for field, table in rules.items() for raw, norm in table.items()]
    return spark.createDataFrame(rows, "field string, raw string, norm string")


def read_predictions(
    spark: SparkSession, path: str, required: Sequence[str] = ("clip_id", "true_label", "pred_label")
) -> DataFrame:
    """A CSV of predictions; probabilities and logits as doubles. A missing column is an error."""
    df = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing}")
    numeric = [c for c in df.columns if c.startswith(("prob_", "logit_")) or c == "msp"]
    return df.withColumns({c: F.col(c).try_cast("double") for c in numeric})


def read_run_artifacts(spark: SparkSession, glob: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON files of runs (a document a file, or a record a line) with `run`, the name of the folder each lies in."""
    df = spark.read.schema(schema).option("multiLine", multi_line).json(glob)
    return df.withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))


def read_run_configs(spark: SparkSession, glob: str) -> DataFrame:
    """run, key, value: the settings of runs from their config.yaml (or .json) files, nested ones as 'model.backbone', lists as
    JSON. A file is read whole by one task; one that can't be parsed gives the key '_error' with the parser's message."""
    texts = spark.read.text(glob, wholetext=True).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"), "value"
    )

    def parsed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(run, k, v) for run, text in zip(part["run"], part["value"]) for k, v in settings_of(text)]
            yield pd.DataFrame(rows, columns=["run", "key", "value"])

    return texts.mapInPandas(parsed, "run string, key string, value string")


def settings_of(text: str) -> list[tuple[str, str | None]]:
    """(key, value) of a YAML or JSON text, nested keys joined by dots; values as JSON, but texts as they are."""
    try:
        import yaml
    except ImportError:
        yaml = None
    try:
        top = yaml.safe_load(text) if yaml else json.loads(text)
    except (yaml.YAMLError if yaml else ValueError) as e:
        return [("_error", str(e))]
    out: list[tuple[str, str | None]] = []
    todo = [("", top)]
    while todo:
        name, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{name}.{k}" if name else str(k), v) for k, v in reversed(x.items())]
        elif name:
            out.append((name, x if isinstance(x, str) or x is None else json.dumps(x, default=str)))
    return out


def write_manifest(df: DataFrame, path: str, kind: str = "csv", by: Sequence[str] = ()) -> str:
    """CSV with a header, JSON records or Parquet, in folders by these columns."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*by) if by else writer).format(kind).save(path)
    return path


def split_protocol(
    splits: DataFrame, parameters: Mapping[str, object], label: str = "behavior", video: str = "video"
) -> DataFrame:
    """One row with `protocol`, a JSON text of parameters and the counts of each split."""
    counts = splits.groupBy("split", label).agg(F.count("*").alias("n")).groupBy("split").agg(
        F.sum("n").alias("events"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("labels")
    )
    videos = splits.groupBy("split").agg(F.countDistinct(video).alias("videos"))
    rows = counts.join(videos, "split").select(
        F.struct("split", F.struct("events", "videos", "labels").alias("c")).alias("e")
    )
    one = rows.agg(F.map_from_entries(F.collect_list("e")).alias("splits"))
    return one.select(
        F.to_json(
            F.struct(F.lit(json.dumps(dict(parameters), sort_keys=True)).alias("parameters"), "splits")
        ).alias("protocol")
    )


def annotation_tasks(events: DataFrame, kind: str = "cvat", frames: DataFrame | None = None) -> DataFrame:
    """task (a JSON text) per event: name, video, span and label; with frames (event_idx, frame) one task per keyframe."""
    rows = events if frames is None else events.join(frames, "event_idx")
    name = F.format_string("evt_%04d", F.col("event_idx"))
    at = [] if frames is None else [F.col("frame")]
    if kind == "cvat":
        task = F.struct(
            name.alias("name"), F.col("video"), *at,
            F.struct(
                F.col("start_sec").alias("start"), (F.col("start_sec") + F.col("duration_sec")).alias("stop")
            ).alias("segment"),
            F.array(F.struct(F.col("behavior").alias("label"))).alias("labels")
        )
    else:
        task = F.struct(
            F.struct(F.col("video"), name.alias("id"), *at).alias("data"),
            F.array(
                F.struct(
                    F.struct(
                        F.col("start_sec").alias("start"),
                        (F.col("start_sec") + F.col("duration_sec")).alias("end"),
                        F.array("behavior").alias("labels")
                    ).alias("value")
                )
            ).alias("annotations")
        )
    return rows.select("event_idx", *at, F.to_json(task).alias("task"))


def frame_labels(events: DataFrame, classes: Mapping[str, int], n_frames: int, label: str = "behavior") -> DataFrame:
    """split, file, labels (the class's number for each frame): rows whose label is unknown are dropped. Written in a folder
    per split, a record a file, this is the frame-label file in pieces."""
    number = F.element_at(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]), F.col(label))
    rows = events.where(F.col(label).isin(*classes)).withColumn("_class", number)
    return rows.select(
        "split",
        F.concat(F.format_string("evt_%04d_", F.col("event_idx")), F.col(label), F.lit(".mp4")).alias("file"),
        F.array_repeat("_class", n_frames).alias("labels")
    )


def collect_corpus(files: DataFrame, excluded: str, source: Column) -> DataFrame:
    """path, source of video files that are not in the excluded folder (by its path or name) or below it; unique by the
    lower-case, slash-normalised path. files: path."""
    key = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    bar = excluded.lower().replace("\\", "/").rstrip("/")
    is_video = F.lit(False)
    for e in VIDEO_EXTENSIONS:
        is_video = is_video | key.endswith(e)
    inside = key.startswith(bar + "/") | key.contains("/" + bar.strip("/") + "/")
    rows = files.withColumn("_key", key).withColumn("source", source).where(is_video & ~inside)
    first = F.row_number().over(Window.partitionBy("_key").orderBy("path"))
    return rows.withColumn("_r", first).where("_r = 1").select("path", "source")
