"""Registered queries of sources and sinks: tables are written to the shared folder in the format of the source and read
back through it."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.det import shared_folder
from ..sources import tables
from ..streaming import bouts, streams
from .bindings import EV, events, table
from .cleaning import GAP, RANGES, TYPES, BOUTS_SQL, _DUR_SQL, _ID_SQL, _TYPE_SQL
from .linking import TH, three

Q: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


@query("s1_read_events", f"WITH {EV} SELECT event_idx::VARCHAR AS event_idx, behavior, duration_sec::VARCHAR AS duration_sec FROM ev")
def s1(spark, d):
    e = events(spark, d).select("event_idx", "behavior", "duration_sec", F.lit(0).alias("enter a 0 if unsure"))
    out = tables.read_events(spark, tables.write_manifest(e, shared_folder(spark, "s1")))
    return out.withColumn("duration_sec", F.col("duration_sec").cast("double").cast("string"))


@query("s2_read_annotation_sheet", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS event_idx, source AS grp FROM documents")
def s2(spark, d):
    sheet = table(spark, d, "documents").select("doc_id", F.col("source").alias("Cohort"), F.lit("x").alias("Group"))
    path = tables.write_manifest(sheet, shared_folder(spark, "s2"))
    out = tables.read_annotation_sheet(spark, path, {"Cohort": "grp"}, ["Group"], order=F.col("doc_id").cast("long"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "event_idx", "grp")


_TILES = "tl AS (SELECT DISTINCT grp, camera, day, floor((start_sec - (day - 1) * 86400.0::DOUBLE) / 3600)::INT AS h FROM ev)"


def _files(spark, d):
    """Recording files, one an hour with events; the last of the day can't be read (no end)."""
    t = events(spark, d).select("grp", "camera", "day", F.expr("cast(floor((start_sec - (day - 1) * 86400D) / 3600) as int)").alias("h")).distinct()
    name = F.format_string("f_ch%d_main_202401%02d%02d0000_202401%02d%s.mp4", "camera", "day", "h", "day", F.when(F.col("h") < 23, F.format_string("%02d0000", F.col("h") + 1)).otherwise("xx"))
    return t.select(F.concat(F.format_string("/data/group%d_day%d/Cam %d/", "grp", "day", "camera"), name).alias("path"), F.format_string("group%d_day%d", "grp", "day").alias("folder"))


@query("s3_scan_segments", f"WITH {EV}, {_TILES} SELECT camera, count(*) AS files, count(*) FILTER (h < 23) AS readable, sum(CASE WHEN h < 23 THEN 3600.0 END)::DOUBLE AS seconds FROM tl GROUP BY camera")
def s3(spark, d):
    seg = tables.segments_of(_files(spark, d))
    return seg.groupBy("camera").agg(F.count("*").alias("files"), F.count("start").alias("readable"), F.sum("seconds").alias("seconds"))


@query("a5_segment_rollup", f"""WITH {EV}, {_TILES}, f AS (SELECT 'group' || grp || '_day' || day AS folder, camera, CASE WHEN h < 23 THEN strftime(DATE '2024-01-01' + (day - 1), '%Y-%m-%d') END AS dd, CASE WHEN h < 23 THEN 3600.0 END AS sec FROM tl),
r AS (SELECT folder, camera, count(*) AS files, round(coalesce(sum(sec), 0)::DOUBLE / 3600, 2) AS hours, coalesce(string_agg(DISTINCT dd, ',' ORDER BY dd), '') AS dates FROM f GROUP BY ROLLUP (folder, camera)) SELECT *, camera IS NOT NULL AND camera = 3 AS unexpected FROM r""")
def a5(spark, d):
    files = _files(spark, d)
    seg = tables.segments_of(files).join(files, "path").select("folder", "camera", "start", "seconds")
    return tables.segment_rollup(seg, seg.where("camera <> 3"))


@query("p9_parse_segment_name", f"WITH {EV}, {_TILES} SELECT camera AS channel, day, h, CASE WHEN h < 23 THEN 3600.0::DOUBLE END AS seconds FROM tl")
def p9(spark, d):
    seg = tables.segments_of(_files(spark, d))
    at = lambda i: F.regexp_extract("filename", r"_main_202401(\d\d)(\d\d)", i).cast("int")
    return seg.select(F.col("camera").alias("channel"), at(1).alias("day"), at(2).alias("h"), "seconds")


@query("s4_read_video_manifest", f"WITH {EV} SELECT grp, day, camera, count(*) AS videos FROM (SELECT DISTINCT grp, day, camera, video FROM ev) GROUP BY ALL")
def s4(spark, d):
    v = events(spark, d).select("grp", "day", "camera", "video").distinct()
    item = F.struct(F.col("video").alias("filename"), F.concat(F.lit("/"), "video").alias("path"), F.lit("2024-01-01 00:00:00").alias("start"), F.lit("2024-01-01 00:30:00").alias("end"), F.lit(1800.0).alias("duration_sec"))
    cams = v.groupBy("grp", "day", "camera").agg(F.collect_list(item).alias("videos"))
    folders = cams.groupBy("grp", "day").agg(F.map_from_entries(F.collect_list(F.struct(F.col("camera").cast("string"), F.struct("videos")))).alias("cameras"))
    # One record a folder: the reader's map of folders may come in many records.
    row = folders.select(F.create_map(F.format_string("group%d_day%d", "grp", "day"), F.struct("cameras")).alias("labeled"))
    path = shared_folder(spark, "s4")
    row.write.json(path)
    return tables.read_video_manifest(spark, path, multi_line=False).groupBy("grp", "day", "camera").agg(F.count("*").alias("videos"))


@query("s5_rule_table", f"WITH {EV} SELECT event_idx, CASE event_type WHEN 'click' THEN 'press' WHEN 'view' THEN 'look' WHEN 'error' THEN 'fault' WHEN 'purchase' THEN 'buy' END AS norm FROM ev")
def s5(spark, d):
    path = shared_folder(spark, "s5")
    spark.range(1).select(F.lit(json.dumps({"event_type": TYPES}))).coalesce(1).write.text(path)
    rules = tables.rule_table(spark, tables.read_rules(spark, path))
    return events(spark, d).join(F.broadcast(rules.where("field = 'event_type'")), F.col("event_type") == F.col("raw"), "left").select("event_idx", "norm")


@query("s6_read_predictions", "SELECT 'event_' || vec_id AS clip_id, label::VARCHAR AS true_label, round(embedding[1]::DOUBLE, 6) AS logit_a FROM embeddings")
def s6(spark, d):
    p = table(spark, d, "embeddings").select(F.format_string("event_%d", "vec_id").alias("clip_id"), F.col("label").alias("true_label"), F.col("label").alias("pred_label"), F.expr("round(cast(element_at(embedding, 1) as double), 6)").alias("logit_a"))
    return tables.read_predictions(spark, tables.write_manifest(p, shared_folder(spark, "s6"))).select("clip_id", "true_label", "logit_a")


@query("s7_read_run_artifacts", f"WITH {EV} SELECT 'split=' || split AS run, count(*) AS n, round(sum(duration_sec), 3) AS total FROM (SELECT *, CASE WHEN grp < 3 THEN 'a' ELSE 'b' END AS split FROM ev) GROUP BY 1")
def s7(spark, d):
    e = events(spark, d).select(F.when(F.col("grp") < 3, "a").otherwise("b").alias("split"), "duration_sec")
    path = shared_folder(spark, "s7")
    e.write.partitionBy("split").json(path)
    runs = tables.read_run_artifacts(spark, f"{path}/split=*/*.json", "duration_sec double", multi_line=False)
    return runs.groupBy("run").agg(F.count("*").alias("n"), F.round(F.sum("duration_sec"), 3).alias("total"))


@query("s8_write_manifest", f"WITH {EV}, {TH} SELECT event_idx, behavior, split FROM sp")
def s8(spark, d):
    rows = [df.withColumn("split", F.lit(n)).select("event_idx", "behavior", "split") for n, df in three(spark, d).items()]
    path = tables.write_manifest(rows[0].unionByName(rows[1]).unionByName(rows[2]), shared_folder(spark, "s8"), "json", ["split"])
    return spark.read.schema("event_idx long, behavior string, split string").json(path)


@query("s9_split_protocol", None)
def s9(spark, d):
    rows = [df.withColumn("split", F.lit(n)) for n, df in three(spark, d).items()]
    return tables.split_protocol(rows[0].unionByName(rows[1]).unionByName(rows[2]), {"seed": 42, "val": 0.2})


_PROTOCOL = "parameters string, splits map<string, struct<events: bigint, videos: bigint, labels: map<string, bigint>>>"


@query("s9_protocol_rows", f"""WITH {EV}, {TH}, c AS (SELECT split, behavior, count(*) AS n FROM sp GROUP BY ALL), t AS (SELECT split, count(*) AS events, count(DISTINCT video) AS videos FROM sp GROUP BY split)
SELECT '{{"seed": 42, "val": 0.2}}' AS parameters, split, events, videos, behavior, n FROM c JOIN t USING (split)""")
def s9_rows(spark, d):
    """The protocol, read back from its JSON."""
    back = s9(spark, d).select(F.from_json("protocol", _PROTOCOL).alias("p")).select("p.parameters", F.explode("p.splits").alias("split", "c"))
    return back.select("parameters", "split", "c.events", "c.videos", F.explode("c.labels").alias("behavior", "n"))


@query("s10_annotation_tasks", f"WITH {EV} SELECT event_idx, behavior, video FROM ev")
def s10(spark, d):
    t = tables.annotation_tasks(events(spark, d))
    return t.select("event_idx", F.get_json_object("task", "$.labels[0].label").alias("behavior"), F.get_json_object("task", "$.video").alias("video"))


@query("s11_frame_labels", f"WITH {EV}, {TH} SELECT split, 'evt_' || CASE WHEN event_idx < 10000 THEN lpad(event_idx::VARCHAR, 4, '0') ELSE event_idx::VARCHAR END || '_' || behavior || '.mp4' AS file, 16 AS n, CASE behavior WHEN 'tail' THEN 16 ELSE 0 END AS total FROM sp WHERE behavior <> 'other'")
def s11(spark, d):
    rows = [df.withColumn("split", F.lit(n)) for n, df in three(spark, d).items()]
    path = shared_folder(spark, "s11")
    tables.frame_labels(rows[0].unionByName(rows[1]).unionByName(rows[2]), {"ear": 0, "tail": 1}, 16).write.partitionBy("split").json(path)
    back = spark.read.schema("file string, labels array<int>, split string").json(path)
    return back.select("split", "file", F.size("labels").alias("n"), F.aggregate("labels", F.lit(0), lambda s, x: s + x).alias("total"))


@query("s12_collect_corpus", "WITH f AS (SELECT 'D:\\v\\' || CASE WHEN page_id % 4 = 0 THEN 'Test' ELSE 'lib' END || '\\' || page_id // 2 || CASE WHEN page_id % 3 = 0 THEN '.txt' ELSE '.MP4' END AS path FROM pages) SELECT path, regexp_extract(path, '[0-9]', 0) AS source FROM f WHERE path LIKE '%.MP4' AND path NOT LIKE '%\\Test\\%' QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY path) = 1")
def s12(spark, d):
    folder = F.when(F.col("page_id") % 4 == 0, "Test").otherwise("lib")
    path = F.concat(F.lit("D:\\v\\"), folder, F.lit("\\"), F.expr("cast(page_id div 2 as string)"), F.when(F.col("page_id") % 3 == 0, ".txt").otherwise(".MP4"))
    return tables.collect_corpus(table(spark, d, "pages").select(path.alias("path")), "D:/v/Test", F.regexp_extract("path", "[0-9]", 0))


@query("stream_clean", f"WITH {EV} SELECT event_idx, {_TYPE_SQL.format('event_type')} AS label, concat_ws('|', {_DUR_SQL}, 'initiator_' || {_ID_SQL}) AS flags FROM ev")
def stream_clean(spark, d):
    return _streamed(spark, d, lambda s: streams.stream_clean(s, TYPES, (1, 120, 300), RANGES).select("event_idx", "label", "flags"))


_END = "~end of the feed"


def _bouts(spark, d):
    """All rows of the bouts of a feed that ends with a mark in a later year, so that the watermark passes every event."""
    e = events(spark, d).select("event_idx", "video", "start_sec", "duration_sec")
    feed, out, mark = (shared_folder(spark, n) for n in ("feed", "out", "mark"))
    end = spark.createDataFrame([(0, _END, 1e9, 0.0)], e.schema)
    e.unionByName(end).write.parquet(feed)
    stream = bouts.stream_bouts(spark.readStream.schema(e.schema).parquet(feed), GAP, slot=86_400.0)
    bouts.write_bouts(stream, out, mark, availableNow=True).awaitTermination()
    return bouts.split_kinds(spark.read.schema(stream.schema).parquet(out))


@query("stream_bouts", f"WITH {BOUTS_SQL} SELECT event_idx, video, bout_id, false AS late FROM bt")
def stream_bouts(spark, d):
    """Bouts are numbered here as in the batch operator, by their first start."""
    found = _bouts(spark, d)
    first = F.min("start_sec").over(Window.partitionBy("video", "bout_id"))
    rows = found[bouts.EVENT].withColumn("first", first)
    number = F.dense_rank().over(Window.partitionBy("video").orderBy("first")).cast("string")
    kept = rows.select("event_idx", "video", F.concat(F.col("video"), F.lit("__bout_"), number).alias("bout_id"), F.lit(False).alias("late"))
    return kept.unionByName(found[bouts.LATE].select("event_idx", "video", F.lit(None).cast("string").alias("bout_id"), F.lit(True).alias("late")))


@query("stream_closed_bouts", f"WITH {BOUTS_SQL} SELECT video, count(*) AS n_events, min(start_sec) AS start_sec, arg_max(start_sec + coalesce(duration_sec, 0), (start_sec, event_idx)) AS end_sec FROM bt GROUP BY video, bout_id")
def stream_closed_bouts(spark, d):
    return _bouts(spark, d)[bouts.CLOSED].select("video", "n_events", "start_sec", "end_sec")


def _streamed(spark, d, transform):
    """Writes the events as a feed in time order, runs the stream to its end, and reads what it has put out."""
    e = events(spark, d).drop("ts")
    feed, out, mark = (shared_folder(spark, n) for n in ("feed", "out", "mark"))
    e.repartitionByRange(4, "start_sec").sortWithinPartitions("start_sec").write.parquet(feed)
    stream = transform(spark.readStream.schema(e.schema).parquet(feed))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
