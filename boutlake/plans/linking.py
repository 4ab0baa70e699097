"""Registered queries of linking and leak control. Segments are half-hour tiles of the days that events fall on, per
group and camera, a quarter of them missing, and one day of one group without any."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leak, link
from .bindings import EV, events, table

Q: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def timed(spark, d):
    """Events with the second of their day; some unreadable."""
    t = F.when(F.col("event_idx") % 97 != 0, F.col("start_sec") - (F.col("day") - 1) * 86_400.0)
    return events(spark, d).withColumn("time_sec", t)


def segments(spark, d):
    days = events(spark, d).select("grp", "day").distinct().where("not (grp = 5 and day = 13)")
    tiles = days.withColumn("camera", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("seg_idx", F.explode(F.sequence(F.lit(0), F.lit(47))))
    tiles = tiles.where("(grp * 7 + day * 3 + camera * 5 + seg_idx) % 4 <> 0").withColumn("seg_start", F.expr("cast(seg_idx * 1800 + camera as double)"))
    return tiles.withColumn("seg_end", F.col("seg_start") + 1800).withColumn("camera_order", F.expr("(camera + grp) % 3"))


SEG = f"""{EV}, tm AS (SELECT *, CASE WHEN event_idx % 97 <> 0 THEN start_sec - (day - 1) * 86400.0::DOUBLE END AS time_sec FROM ev),
sg AS (SELECT grp, day, camera, seg_idx, (seg_idx * 1800 + camera)::DOUBLE AS seg_start, (seg_idx * 1800 + camera + 1800)::DOUBLE AS seg_end, (camera + grp) % 3 AS camera_order
  FROM (SELECT DISTINCT grp, day FROM ev WHERE NOT (grp = 5 AND day = 13)), (SELECT unnest(range(3))::INT AS camera), (SELECT unnest(range(48))::INT AS seg_idx)
  WHERE (grp * 7 + day * 3 + camera * 5 + seg_idx) % 4 <> 0)"""
LK = f"""{SEG}, ht AS (SELECT e.event_idx, s.camera, s.seg_idx, s.camera_order, time_sec >= seg_start AND time_sec < seg_end AS exact, greatest(time_sec - seg_start, 0.0) AS offset_sec
  FROM tm e JOIN sg s USING (grp, day) WHERE time_sec BETWEEN seg_start - 60 AND seg_end + 60),
bs AS (SELECT * FROM ht QUALIFY row_number() OVER (PARTITION BY event_idx ORDER BY camera_order, exact DESC, CASE WHEN exact THEN offset_sec END, seg_idx) = 1),
lk AS (SELECT e.*, b.camera AS link_camera, b.seg_idx, b.offset_sec, b.seg_idx IS NOT NULL AS linked FROM tm e SEMI JOIN sg USING (grp, day) LEFT JOIN bs b ON e.event_idx = b.event_idx WHERE e.time_sec IS NOT NULL)"""


def linked(spark, d):
    return link.link_events(timed(spark, d).drop("camera"), segments(spark, d))


@query("j1_link_events", f"WITH {LK} SELECT event_idx, linked, link_camera AS camera, seg_idx, round(offset_sec, 6) AS offset_sec FROM lk")
def j1(spark, d):
    return linked(spark, d).select("event_idx", "linked", "camera", "seg_idx", F.round("offset_sec", 6).alias("offset_sec"))


@query("j2_unlinked_reasons", f"WITH {LK} SELECT event_idx, CASE WHEN time_sec IS NULL THEN 'no_time' WHEN (grp, day) NOT IN (SELECT (grp, day) FROM sg) THEN 'no_segments' ELSE 'no_match' END AS reason FROM tm WHERE event_idx NOT IN (SELECT event_idx FROM lk WHERE linked)")
def j2(spark, d):
    return link.unlinked_reasons(timed(spark, d).drop("camera"), segments(spark, d))


def _priority(spark, d):
    cams = events(spark, d).select("grp").distinct().withColumn("camera", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return cams.select("grp", "camera", F.expr("CASE WHEN (camera * 2 + grp) % 3 < 2 THEN (camera * 2 + grp) % 3 END").alias("rank"), F.expr("grp = 2 AND camera = 1").alias("excluded"))


_RANK = "CASE WHEN (s.camera * 2 + s.grp) % 3 < 2 THEN (s.camera * 2 + s.grp) % 3 ELSE 1000 + s.camera END"


@query("j3_relink_priority", f"""WITH {LK}, nh AS (SELECT e.event_idx, s.camera, s.seg_idx, e.time_sec - s.seg_start AS offset_sec FROM lk e JOIN sg s USING (grp, day)
  WHERE e.linked AND time_sec >= seg_start AND time_sec < seg_end AND NOT (s.grp = 2 AND s.camera = 1) QUALIFY row_number() OVER (PARTITION BY e.event_idx ORDER BY {_RANK}, s.seg_idx) = 1)
SELECT l.event_idx, coalesce(n.camera, l.link_camera) AS camera, coalesce(n.seg_idx, l.seg_idx) AS seg_idx, round(coalesce(n.offset_sec, l.offset_sec), 6) AS offset_sec,
  CASE WHEN NOT linked THEN 'unlinked' WHEN n.seg_idx IS NULL THEN 'failed' WHEN n.camera = l.link_camera AND n.seg_idx = l.seg_idx THEN 'unchanged' ELSE 'changed' END AS status FROM lk l LEFT JOIN nh n ON l.event_idx = n.event_idx""")
def j3(spark, d):
    return link.relink_priority(linked(spark, d), segments(spark, d), _priority(spark, d)).withColumn("offset_sec", F.round("offset_sec", 6))


#: The link of LK with time bins of half an hour for the joins, each table worked out once.
_LINK_BINS = f"""{SEG}, t4 AS MATERIALIZED (SELECT *, floor(time_sec / 1800)::INT AS bin FROM tm WHERE time_sec IS NOT NULL),
s4 AS MATERIALIZED (SELECT *, unnest(range(seg_idx - 1, seg_idx + 3))::INT AS bin FROM sg),
h4 AS (SELECT e.event_idx, s.camera, s.seg_idx, s.camera_order, time_sec >= seg_start AND time_sec < seg_end AS exact, greatest(time_sec - seg_start, 0.0) AS offset_sec
  FROM t4 e JOIN s4 s USING (grp, day, bin) WHERE time_sec BETWEEN seg_start - 60 AND seg_end + 60),
b4 AS MATERIALIZED (SELECT event_idx, camera AS link_camera FROM h4 QUALIFY row_number() OVER (PARTITION BY event_idx ORDER BY camera_order, exact DESC, CASE WHEN exact THEN offset_sec END, seg_idx) = 1)"""


@query("j4_candidate_cameras", f"""WITH {_LINK_BINS}
SELECT e.event_idx, s.camera, s.seg_idx, round(greatest(time_sec - seg_start - 3, 0), 6) AS clip_start, round(least(time_sec - seg_start + duration_sec + 3, seg_end - seg_start), 6) AS clip_end, s.camera = link_camera AS is_current
FROM t4 e JOIN b4 USING (event_idx) JOIN s4 s ON s.grp = e.grp AND s.day = e.day AND s.bin = e.bin WHERE time_sec >= seg_start AND time_sec < seg_end""")
def j4(spark, d):
    out = link.candidate_cameras(linked(spark, d), segments(spark, d))
    return out.withColumn("clip_start", F.round("clip_start", 6)).withColumn("clip_end", F.round("clip_end", 6))


@query("j5_fix_segment_mapping", f"""WITH {SEG}, r AS (SELECT event_idx, grp || '/' || day || '/' || (event_idx % 3) AS folder, CASE WHEN event_idx % 11 <> 0 THEN 'old' END AS file, time_sec AS seconds FROM tm),
f AS (SELECT grp || '/' || day || '/' || camera AS folder, 's' || seg_idx AS file, seg_start, seg_end FROM sg),
h AS (SELECT r.event_idx, min(f.file) AS new_file FROM r JOIN f USING (folder) WHERE seconds >= seg_start AND seconds < seg_end GROUP BY r.event_idx)
SELECT r.event_idx, coalesce(new_file, file) AS file, CASE WHEN file IS NULL THEN 'bad_filename' WHEN seconds IS NULL THEN 'bad_start_time' WHEN new_file IS NULL THEN 'no_segment' ELSE 'ok' END AS status FROM r LEFT JOIN h ON r.event_idx = h.event_idx""")
def j5(spark, d):
    rows = timed(spark, d).select("event_idx", F.expr("concat_ws('/', grp, day, event_idx % 3)").alias("folder"), F.expr("CASE WHEN event_idx % 11 <> 0 THEN 'old' END").alias("file"), F.col("time_sec").alias("seconds"))
    files = segments(spark, d).select(F.expr("concat_ws('/', grp, day, camera)").alias("folder"), F.expr("concat('s', seg_idx)").alias("file"), "seg_start", "seg_end")
    return link.fix_segment_mapping(rows, files)


def _own_segment(spark, d):
    """Each event on the tile before its own clock time by up to two, so that some offsets are behind the end."""
    e = timed(spark, d).where("time_sec is not null")
    seg = F.expr("cast(floor(time_sec / 1800) as int) - event_idx % 3")
    return e.select("event_idx", "grp", "day", F.expr("cast(event_idx % 3 as int)").alias("camera"), "time_sec", seg.cast("int").alias("seg_idx")).withColumn("seg_start", F.col("seg_idx") * 1800.0).withColumn("seg_len", F.lit(1800.0)).withColumn("offset_sec", F.col("time_sec") - F.col("seg_start"))


_OWN = f"{SEG}, ow AS (SELECT *, seg_idx * 1800.0::DOUBLE AS seg_start, 1800.0::DOUBLE AS seg_len, time_sec - seg_idx * 1800.0::DOUBLE AS offset_sec FROM (SELECT event_idx, grp, day, (event_idx % 3)::INT AS camera, time_sec, (floor(time_sec / 1800)::INT - event_idx % 3)::INT AS seg_idx FROM tm WHERE time_sec IS NOT NULL))"


@query("j6_shift_segment", f"WITH {_OWN} SELECT event_idx, offset_sec > 1800 AND offset_sec - 1800 <= 900 AS shifted, CASE WHEN offset_sec > 1800 AND offset_sec - 1800 <= 900 THEN seg_idx + 1 ELSE seg_idx END AS seg_idx, round(CASE WHEN offset_sec > 1800 AND offset_sec - 1800 <= 900 THEN offset_sec - 1800 ELSE offset_sec END, 6) AS offset_sec FROM ow")
def j6(spark, d):
    return link.shift_segment(_own_segment(spark, d), most_excess=900.0).select("event_idx", "shifted", "seg_idx", F.round("offset_sec", 6).alias("offset_sec"))


@query("j7_resolve_segment", f"""WITH {_OWN}, tr AS (SELECT event_idx, s.shift, s.o, seg_idx + s.shift AS seg, time_sec - seg_start - s.shift * 1800 AS off FROM ow, (VALUES (0, 0), (1, 1), (-1, 2), (2, 3), (-2, 4), (3, 5), (-3, 6)) s(shift, o)
  WHERE time_sec >= seg_start + s.shift * 1800 AND time_sec < seg_start + s.shift * 1800 + 1800 AND EXISTS (SELECT 1 FROM sg WHERE sg.grp = ow.grp AND sg.day = ow.day AND sg.camera = ow.camera AND sg.seg_idx = ow.seg_idx + s.shift)),
b AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY event_idx ORDER BY o) = 1)
SELECT ow.event_idx, coalesce(b.seg, ow.seg_idx)::INT AS seg_idx, round(coalesce(b.off, CASE WHEN offset_sec < 0 THEN offset_sec + 1800 ELSE offset_sec - 1800 * floor(offset_sec / 1800) END), 5) AS offset_sec, b.shift FROM ow LEFT JOIN b ON ow.event_idx = b.event_idx""")
def j7(spark, d):
    return link.resolve_segment(_own_segment(spark, d), segments(spark, d)).withColumn("offset_sec", F.round("offset_sec", 5))


def _segment_files(spark, d):
    return segments(spark, d).select(F.expr("concat('s', day, '_', seg_idx)").alias("filename"), F.expr("concat_ws('/', lpad(cast(grp as string), 2, '0'), camera)").alias("path"))


@query("j8_duplicate_files", f"WITH {SEG}, f AS (SELECT 's' || day || '_' || seg_idx AS filename, lpad(grp::VARCHAR, 2, '0') || '/' || camera AS path FROM sg) SELECT filename, first(path) OVER w AS first_path, path FROM f WINDOW w AS (PARTITION BY filename ORDER BY path) QUALIFY row_number() OVER w > 1")
def j8(spark, d):
    return leak.duplicate_files(_segment_files(spark, d))


@query("j9_exclude_known", f"WITH {EV} SELECT event_idx, video FROM ev WHERE video NOT IN (SELECT video FROM ev WHERE behavior = 'tail' AND duration_sec > 200) AND video NOT IN (SELECT video FROM ev WHERE behavior = 'other' AND duration_sec > 250) QUALIFY row_number() OVER (PARTITION BY video ORDER BY event_idx) = 1")
def j9(spark, d):
    e = events(spark, d)
    return leak.exclude_known(e, [e.where("behavior = 'tail' and duration_sec > 200"), e.where("behavior = 'other' and duration_sec > 250")], "video", "event_idx").select("event_idx", "video")


def three(spark, d):
    """Train, val and test by the number of the event, so that they share recordings."""
    e = events(spark, d)
    return {"train": e.where("event_idx % 20 < 14"), "val": e.where("event_idx % 20 between 14 and 17"), "test": e.where("event_idx % 20 > 17")}


TH = "sp AS (SELECT *, CASE WHEN event_idx % 20 < 14 THEN 'train' WHEN event_idx % 20 < 18 THEN 'val' ELSE 'test' END AS split FROM ev)"
_KEY = "concat(video, '/', cast(day as string))"


@query("j10_disjoint_splits", f"WITH {EV}, {TH}, k AS (SELECT event_idx, split, video || '/' || day AS k FROM sp), v AS (SELECT * FROM k WHERE split = 'val' AND k NOT IN (SELECT k FROM k WHERE split = 'test')) SELECT event_idx, split FROM v UNION ALL SELECT event_idx, split FROM k WHERE split = 'test' UNION ALL SELECT event_idx, split FROM k WHERE split = 'train' AND k NOT IN (SELECT k FROM k WHERE split = 'test') AND k NOT IN (SELECT k FROM v)")
def j10(spark, d):
    s = {n: df.select("event_idx", F.expr(_KEY).alias("k")) for n, df in three(spark, d).items()}
    return leak.tagged(leak.disjoint_splits(s["train"], s["val"], s["test"], "k")).select("event_idx", "split")


@query("j11_holdout_unused", f"WITH {EV} SELECT event_idx, video FROM ev WHERE video NOT IN (SELECT video FROM ev WHERE duration_sec > 300) AND video NOT IN (SELECT video FROM ev WHERE duration_sec < 0.5 AND behavior = 'ear')")
def j11(spark, d):
    e = events(spark, d)
    return leak.holdout_unused(e, e.where("duration_sec > 300"), e.where("duration_sec < 0.5 and behavior = 'ear'")).select("event_idx", "video")


#: Cell i = 17 * row + column of frame f of a clip's grids: a product of two components of the vector.
_CELL = "embedding[{i} % 64 + 1]::DOUBLE * embedding[(5 * ({i}) + 11 * {f} + ({i}) // 64) % 64 + 1]::DOUBLE"
_RAISED = " + CASE WHEN ({i} + 31 * {f}) % (20 + vec_id % 200) = 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END"


def _grids(spark, d, raised: bool = False):
    """Each vector as a clip of three frames, grey grids of 16 x 17 cells. Raised: another encoding, some cells brighter."""
    i = "(17 * r + c)"
    cell = f"get(v, {i} % 64) * get(v, cast((5 * {i} + 11 * f + {i} div 64) % 64 as int))"
    if raised:
        cell += f" + CASE WHEN ({i} + 31 * f) % (20 + vec_id % 200) = 0 THEN 10D ELSE 0D END"
    frames = F.expr(f"transform(sequence(0, 2), f -> transform(sequence(0, 15), r -> transform(sequence(0, 16), c -> {cell})))")
    vectors = table(spark, d, "embeddings").select("vec_id", F.expr("transform(embedding, x -> cast(x as double))").alias("v"))
    return vectors.select("vec_id", frames.alias("frames"))


def _signatures(spark, d, raised: bool = False):
    """id, words: 768 bits of a clip. The clips in another encoding have the numbers -1, -2 and so on."""
    words = F.concat(*[leak.grid_dhash(F.get("frames", F.lit(f))) for f in range(3)])
    ident = -F.col("vec_id") - 1 if raised else F.col("vec_id")
    return _grids(spark, d, raised).select(ident.alias("id"), words.alias("words"))


def _bits_sql(frames: int, raised: bool = False) -> str:
    cell = "(" + _CELL + (_RAISED if raised else "") + ")"
    i = "(17 * ((k % 256) // 16) + k % 16)"
    left, right = (cell.format(i=x, f="(k // 256)") for x in (i, f"({i} + 1)"))
    return f"list_aggregate(list_transform(range({256 * frames}), lambda k: CASE WHEN {right} > {left} THEN '1' ELSE '0' END), 'string_agg', '')"


_NEAR = f"""qs AS MATERIALIZED (SELECT -vec_id - 1 AS id, {_bits_sql(3, True)}::BIT AS w FROM embeddings), cs AS MATERIALIZED (SELECT vec_id AS id, {_bits_sql(3)}::BIT AS w FROM embeddings),
nd AS (SELECT a.id AS query, b.id AS match, bit_count(xor(a.w, b.w))::INT AS distance FROM qs a, cs b WHERE bit_count(xor(a.w, b.w)) <= 15)"""


@query("j12_near_duplicates", f"WITH {_NEAR} SELECT query, match, distance FROM nd")
def j12(spark, d):
    return leak.near_duplicates(_signatures(spark, d, raised=True), _signatures(spark, d), 15, 12)


@query("j12_best_match", f"WITH {_NEAR} SELECT query, match, distance FROM nd QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, match) = 1")
def j12_best(spark, d):
    return leak.best_match(j12(spark, d))


@query("j13_name_overlap", "SELECT p.page_id FROM pages p WHERE lower(regexp_extract(url, '([^/]*)/*$', 1)) IN (SELECT lower(regexp_extract(url, '([^/]*)/*$', 1)) FROM pages WHERE page_id % 4 = 0)")
def j13(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"([^/]*)/*$", 1).alias("name"))
    return leak.name_overlap(p, p.where("page_id % 4 = 0"), "name").select("page_id")


@query("j14_overlap_decision", """WITH c AS (SELECT doc_id AS clip, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS ours, toxic = 1 AS name_match, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 40)::INT END AS distance FROM labels)
SELECT clip, CASE WHEN coalesce(ours, false) OR name_match OR coalesce(distance <= 15, false) THEN 'VAL' ELSE 'TEST' END AS decision,
  concat_ws('|', CASE WHEN coalesce(ours, false) THEN 'flag' END, CASE WHEN name_match THEN 'name' END, CASE WHEN distance <= 15 THEN 'hash' END) AS reasons FROM c""")
def j14(spark, d):
    clips = table(spark, d, "labels").select(F.col("doc_id").alias("clip"), F.expr("CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false END").alias("ours"), F.expr("toxic = 1").alias("name_match"), F.expr("CASE WHEN doc_id % 3 = 0 THEN cast(doc_id % 40 as int) END").alias("distance"), F.lit(8).alias("strict"), F.lit(15).alias("loose"))
    return leak.overlap_decision(clips).select("clip", "decision", F.array_join("reasons", "|").alias("reasons"))


@query("j15_temporal_leakage", f"WITH {EV}, {TH}, p AS (SELECT a.video, abs(a.start_sec - b.start_sec) AS gap FROM sp a JOIN sp b USING (video) WHERE a.split = 'train' AND b.split = 'val') SELECT count(DISTINCT video) AS shared_videos, count(*) AS pairs, count(*) FILTER (gap < 3600) AS near_pairs FROM p")
def j15(spark, d):
    s = three(spark, d)
    return leak.temporal_leakage(s["train"], s["val"], gap=3600.0)


@query("j16_attach_manifest", f"WITH {EV} SELECT 'event_' || e.doc_id || '_clip' AS clip_id, e.doc_id AS event_idx, v.grp, v.camera FROM labels e LEFT JOIN ev v ON e.doc_id = v.event_idx AND v.grp <> 3")
def j16(spark, d):
    preds = table(spark, d, "labels").select(F.expr("concat('event_', doc_id, '_clip')").alias("clip_id"))
    return link.attach_manifest(preds, events(spark, d).where("grp <> 3"))


@query("j17_propagate_split", f"WITH {EV}, {TH} SELECT l.doc_id AS base_event_idx, l.toxic, s.split FROM labels l JOIN sp s ON l.doc_id = s.event_idx")
def j17(spark, d):
    return link.propagate_split(table(spark, d, "labels").select(F.col("doc_id").alias("base_event_idx"), "toxic"), leak.tagged(three(spark, d)).select("event_idx", "split"))


@query("j20_merge_results", f"""WITH {EV}, r AS (SELECT doc_id AS event_idx, quality = 1 AS ok, (doc_id % 9)::DOUBLE AS duration FROM labels)
SELECT e.event_idx, grp <> 4 AND coalesce(ok, true) AS success, CASE WHEN grp <> 4 AND coalesce(ok, true) THEN coalesce(duration, duration_sec) END AS actual_duration,
  CASE WHEN grp = 4 THEN 'video_missing' WHEN ok IS NULL THEN 'existing' WHEN ok THEN 'extracted' ELSE 'failed' END AS reason FROM ev e LEFT JOIN r USING (event_idx)""")
def j20(spark, d):
    e = events(spark, d)
    results = table(spark, d, "labels").select(F.col("doc_id").alias("event_idx"), F.expr("quality = 1").alias("ok"), F.expr("cast(doc_id % 9 as double)").alias("duration"))
    return link.merge_results(e.select("event_idx", "video", F.col("duration_sec").alias("clip_duration")), results, e.where("grp <> 4"))


@query("a11_split_report", f"WITH {EV}, {TH} SELECT split, count(*) AS events, count(DISTINCT video) AS videos, count(DISTINCT grp) AS groups, count(*) FILTER (behavior = 'tail') AS minority, round(100 * count(*) FILTER (behavior = 'tail') / count(*), 4) AS percent FROM sp GROUP BY split")
def a11(spark, d):
    return leak.split_report(leak.tagged(three(spark, d)))


@query("a11_split_overlap", f"WITH {EV}, {TH}, k AS (SELECT video || '/' || day AS k, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b FROM sp GROUP BY 1) SELECT count(*) FILTER (a AND b) AS shared, count(*) AS either, round(100 * count(*) FILTER (a AND b) / count(*), 4) AS percent FROM k WHERE a OR b")
def a11_overlap(spark, d):
    return leak.split_overlap(leak.tagged(three(spark, d)).withColumn("k", F.expr(_KEY)), "k", "train", "val")


@query("a12_pairwise_overlap", f"WITH {EV}, {TH}, k AS (SELECT DISTINCT split, video || '/' || day AS k FROM sp) SELECT a.split AS a, b.split AS b, count(*) AS shared FROM k a JOIN k b USING (k) WHERE a.split < b.split GROUP BY ALL")
def a12(spark, d):
    return leak.pairwise_overlap(leak.tagged(three(spark, d)).withColumn("k", F.expr(_KEY)), "k")


@query("b12_leak_asserts", f"WITH {EV} SELECT event_idx, CASE WHEN grp = 5 THEN 'ood' ELSE 'dev' END AS split FROM ev")
def b12(spark, d):
    e = events(spark, d).withColumn("split", F.when(F.col("grp") == 5, "ood").otherwise("dev"))
    return leak.leak_asserts(e, ["video", "grp"]).select("event_idx", "split")


@query("t9_grid_dhash", f"SELECT vec_id, {_bits_sql(1)} AS bits FROM embeddings")
def t9(spark, d):
    words = leak.grid_dhash(F.get("frames", F.lit(0)))
    bits = F.array_join(F.transform(words, lambda w: F.lpad(F.bin(w), 64, "0")), "")
    return _grids(spark, d).select("vec_id", bits.alias("bits"))
