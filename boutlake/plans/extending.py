"""Registered queries of boundaries and roles, filled tracks, tables of the alignment, sheets of any header, and summaries
beside the main reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.det import shared_folder
from ..operators import audit, boundaries, clean, evaluate, leak, sessions, splits
from ..sources import tables
from .bindings import EV, PR, events, predictions, table
from .cleaning import BOUTS_SQL, TYPES, _TYPE_SQL, bouts
from .evaluating import MF, _files, manifest
from .linking import TH, three

Q: dict[str, tuple] = {}


def query(name: str, sql: str):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


# --- intervals against the truth ----------------------------------------------------------------------------------------


def _near_intervals(spark, d):
    """Events of one class, and the same moved by up to 3 seconds and stretched a little as predictions of it; one in seven
    is missing. Roles are animals; one in five predictions has them exchanged, one in eleven another receiver."""
    e = events(spark, d).where("behavior = 'tail'")
    truth = e.select("video", F.col("event_idx").alias("truth_id"), _thousandths("start_sec").alias("start_sec"), _thousandths(F.col("start_sec") + F.col("duration_sec")).alias("end_sec"), *_roles("event_idx % 9", "event_idx % 4"))
    moved = F.expr("(event_idx % 61 - 30) / 10D")
    start = _thousandths(F.col("start_sec") + moved).alias("start_sec")
    end = _thousandths(F.col("start_sec") + moved + F.col("duration_sec") * F.expr("(100 + event_idx % 13 - 6) / 100D")).alias("end_sec")
    swapped = "event_idx % 5 = 0"
    roles = _roles(f"case when {swapped} then event_idx % 4 else event_idx % 9 end", f"case when {swapped} then event_idx % 9 when event_idx % 11 = 0 then 100 else event_idx % 4 end")
    preds = e.where("event_idx % 7 <> 0").select("video", (F.col("event_idx") + 1_000_000).alias("pred_id"), start, end, F.col("duration_sec").alias("score"), *roles)
    return preds.where("end_sec > start_sec"), truth.where("end_sec > start_sec")


def _thousandths(c):
    """Rounded to 3 decimals as the SQL does it, by the whole number of thousandths: a sum such as 36640.7585 is a binary number
    just below the tie, and its decimals would be rounded down."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1000) / 1000


def _roles(a: str, b: str):
    return F.expr(f"cast({a} as int)").alias("initiator"), F.expr(f"cast({b} as int)").alias("receiver")


_NEAR = f"""{EV}, tn AS (SELECT * FROM (SELECT video, event_idx AS truth_id, round(start_sec, 3) AS s, round(start_sec + duration_sec, 3) AS e,
  (event_idx % 9)::INT AS initiator, (event_idx % 4)::INT AS receiver FROM ev WHERE behavior = 'tail') WHERE e > s),
pn AS (SELECT * FROM (SELECT video, event_idx + 1000000 AS pred_id, round(start_sec + (event_idx % 61 - 30) / 10.0::DOUBLE, 3) AS s,
  round(start_sec + (event_idx % 61 - 30) / 10.0::DOUBLE + duration_sec * ((100 + event_idx % 13 - 6) / 100.0::DOUBLE), 3) AS e, duration_sec AS score,
  (CASE WHEN event_idx % 5 = 0 THEN event_idx % 4 ELSE event_idx % 9 END)::INT AS initiator,
  (CASE WHEN event_idx % 5 = 0 THEN event_idx % 9 WHEN event_idx % 11 = 0 THEN 100 ELSE event_idx % 4 END)::INT AS receiver
  FROM ev WHERE behavior = 'tail' AND event_idx % 7 <> 0) WHERE e > s),
bt AS (SELECT video, truth_id AS id, unnest(['start', 'end']) AS edge, unnest([s, e]) AS tm FROM tn),
bp AS (SELECT video, pred_id AS id, unnest(['start', 'end']) AS edge, unnest([s, e]) AS tm FROM pn)"""


def _asof_sql(side: str, asked: str, others: str) -> str:
    near = f"(SELECT video, edge, tm AS t, min(id) AS near FROM {others} GROUP BY ALL)"
    return f"""SELECT '{side}' AS side, edge, least(coalesce(abs(tm - back), 'inf'), coalesce(abs(tm - ahead), 'inf')) AS away FROM (
  SELECT a.*, b.t AS back, c.t AS ahead FROM {asked} a ASOF LEFT JOIN {near} b ON a.video = b.video AND a.edge = b.edge AND a.tm >= b.t
  ASOF LEFT JOIN {near} c ON a.video = c.video AND a.edge = c.edge AND a.tm <= c.t)"""


@query("a35_boundary_errors", f"""WITH {_NEAR}, w AS ({_asof_sql("truth", "bt", "bp")} UNION ALL {_asof_sql("pred", "bp", "bt")}), g AS (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS tolerance)
SELECT side, edge, tolerance, count(*) AS n, count(*) FILTER (round(away, 6) <= tolerance) AS hits, round(avg(round(away, 6)) FILTER (round(away, 6) <= tolerance), 6) AS mean_error,
  round(count(*) FILTER (round(away, 6) <= tolerance) / count(*), 6) AS share FROM w, g GROUP BY ALL""")
def a35_boundaries(spark, d):
    return boundaries.boundary_errors(*_near_intervals(spark, d))


_MATCH = """mn AS (SELECT pred_id, truth_id FROM (SELECT *, row_number() OVER (PARTITION BY truth_id ORDER BY score DESC, pred_id) AS o FROM (
  SELECT pred_id, truth_id, p.score, round((least(p.e, t.e) - greatest(p.s, t.s)) / (greatest(p.e, t.e) - least(p.s, t.s)), 6) AS tiou FROM pn p JOIN tn t USING (video)
  WHERE least(p.e, t.e) > greatest(p.s, t.s) QUALIFY row_number() OVER (PARTITION BY pred_id ORDER BY tiou DESC, truth_id) = 1) WHERE tiou >= 0.5) WHERE o = 1)"""


@query("a35_role_accuracy", f"""WITH {_NEAR}, {_MATCH}, x AS (SELECT p.initiator = t.initiator AS a, p.receiver = t.receiver AS b, p.initiator = t.receiver AND p.receiver = t.initiator AS s
  FROM mn JOIN pn p USING (pred_id) JOIN tn t USING (truth_id))
SELECT count(*) AS matched, count(*) FILTER (a) AS initiator_right, count(*) FILTER (b) AS receiver_right, count(*) FILTER (a AND b) AS all_right, count(*) FILTER (s AND NOT (a AND b)) AS swapped,
  round(count(*) FILTER (a AND b) / nullif(count(*), 0), 6) AS accuracy FROM x""")
def a35_roles(spark, d):
    return boundaries.role_accuracy(*_near_intervals(spark, d), 0.5)


@query("a36_failure_cases", f"""WITH {_NEAR}, {_MATCH}, f AS (SELECT 'false_positive' AS kind, pred_id AS id, round(score, 6) AS weight FROM pn WHERE pred_id NOT IN (SELECT pred_id FROM mn)
UNION ALL SELECT 'false_negative', truth_id, round(e - s, 6) FROM tn WHERE truth_id NOT IN (SELECT truth_id FROM mn)
UNION ALL SELECT 'boundary_error', pred_id, round(abs(p.s - t.s) + abs(p.e - t.e), 6) FROM mn JOIN pn p USING (pred_id) JOIN tn t USING (truth_id))
SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY weight DESC, id) AS rank, id, weight FROM f QUALIFY rank <= 10""")
def a36_failures(spark, d):
    return boundaries.failure_cases(*_near_intervals(spark, d), 0.5)


# --- tracks and the alignment -------------------------------------------------------------------------------------------

_TRACKS = "t AS (SELECT video, behavior AS track, event_idx AS frame, duration_sec / 200 AS conf, sqrt(duration_sec) AS x, sqrt(start_sec) AS y FROM ev)"


@query("v7_fill_tracks", f"""WITH {EV}, {_TRACKS}, k AS (SELECT video, track FROM t GROUP BY ALL HAVING count(*) >= 5 AND round(avg(conf), 6) >= 0.2),
g AS (SELECT *, lag(frame) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py FROM t SEMI JOIN k USING (video, track) WINDOW w AS (PARTITION BY video, track ORDER BY frame)),
f AS (SELECT *, unnest(range(CASE WHEN frame - pf - 1 BETWEEN 1 AND 100 THEN pf + 1 ELSE frame END, frame + 1)) AS fr FROM g)
SELECT video, track, fr AS frame, round(CASE WHEN fr < frame THEN px + (x - px) * ((fr - pf)::DOUBLE / (frame - pf)) ELSE x END, 6) AS x,
  round(CASE WHEN fr < frame THEN py + (y - py) * ((fr - pf)::DOUBLE / (frame - pf)) ELSE y END, 6) AS y, fr < frame AS filled FROM f""")
def v7_fill(spark, d):
    t = events(spark, d).select("video", F.col("behavior").alias("track"), F.col("event_idx").alias("frame"), (F.col("duration_sec") / 200).alias("conf"), F.sqrt("duration_sec").alias("x"), F.sqrt("start_sec").alias("y"))
    return audit.fill_tracks(t, ["x", "y"], 5, 0.2, 100).withColumns({c: F.round(c, 6) for c in ("x", "y")})


_OUTCOMES = {
    "fixed": "true", "verified": "reason = 'ok'", "missing_video": "reason = 'missing_video'", "parse_errors": "reason IN ('cannot_parse_segment', 'cannot_parse_event_time')",
    "offset_exceeds_segment": "reason = 'offset_exceeds_segment'", "offset_mismatch": "reason = 'ok' AND abs(clk - seg_start - offset_sec) > 1", "bad_duration": "reason = 'ok' AND duration_sec <= 0",
}


@query("v1_alignment_tables", f"WITH {MF} " + " UNION ALL ".join(
    f"SELECT '{n}' AS outcome, event_idx, reason, CASE WHEN duration_sec < 1 THEN 1.0 ELSE duration_sec END AS duration_fixed FROM vf WHERE {c}" for n, c in _OUTCOMES.items()))
def v1_tables(spark, d):
    checked = audit.verify_alignment(manifest(spark, d), _files(spark, d))
    path = audit.write_alignment(checked, shared_folder(spark, "alignment"))
    out = None
    for name in (audit.FIXED, audit.VERIFIED, *audit.ISSUES):
        rows = audit.read_alignment(checked.schema, spark, path, name).select(F.lit(name).alias("outcome"), "event_idx", "reason", "duration_fixed")
        out = rows if out is None else out.unionByName(rows)
    return out


_AUDIT = f"""{MF}, a AS (SELECT *, CASE WHEN NOT broken AND NOT noclock AND clk <> seg_start THEN clk - seg_start END AS calc FROM mf), b AS (SELECT *, NOT gone AND coalesce(calc, offset_sec, 0) > 1700 AS exceeds FROM a),
c AS (SELECT event_idx, behavior, gone OR exceeds AS fails, list_filter([CASE WHEN duration_sec <= 0 THEN 'zero_duration' END, CASE WHEN gone THEN 'video_not_found' END, CASE WHEN NOT gone AND broken THEN 'cannot_parse_filename' END,
  CASE WHEN NOT gone AND abs(calc - offset_sec) > 5 THEN 'offset_mismatch' END, CASE WHEN exceeds THEN 'offset_exceeds_duration' END], lambda x: x IS NOT NULL) AS issues FROM b)"""


@query("v2_audit_by_class", f"WITH {_AUDIT} SELECT behavior, CASE WHEN fails THEN 'FAIL' ELSE 'WARN' END AS status, issue, count(*) AS n FROM (SELECT behavior, fails, unnest(issues) AS issue FROM c) GROUP BY ALL")
def v2_classes(spark, d):
    m = manifest(spark, d)
    return audit.audit_by_class(m, audit.audit_events(m, _files(spark, d).withColumn("actual_sec", F.lit(1700.0)), keep=["behavior"]))


# --- sheets and run settings --------------------------------------------------------------------------------------------


@query("s2_sheet_of_files", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS event_idx, source AS grp FROM documents")
def s2_files(spark, d):
    """Seven files of unequal sizes, in order by their names; the place comes from the files alone."""
    sheet = table(spark, d, "documents").select("doc_id", F.col("source").alias("Cohort"), F.length("text").alias("Group"))
    path = shared_folder(spark, "s2")
    sheet.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.option("header", True).csv(path)
    out = tables.read_annotation_sheet(spark, path, {"Cohort": "grp"}, ["Group"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "event_idx", "grp")


@query("s7_run_configs", f"WITH {EV} SELECT 'behavior=' || behavior AS run, key, value FROM (SELECT behavior, count(*) AS n, max(event_idx) AS m FROM ev GROUP BY 1), (VALUES ('model.backbone'), ('data.batch_size'), ('data.sizes'), ('name')) k(key), LATERAL (SELECT CASE key WHEN 'model.backbone' THEN 'net_' || behavior WHEN 'data.batch_size' THEN n::VARCHAR WHEN 'data.sizes' THEN '[1, ' || m || ']' ELSE 'run of ' || behavior END AS value)")
def s7_configs(spark, d):
    """A config.yaml for each class, with nested settings."""
    per = events(spark, d).groupBy("behavior").agg(F.count("*").alias("n"), F.max("event_idx").alias("m"))
    text = F.concat_ws("\n", F.format_string("name: run of %s", "behavior"), F.lit("model:"), F.format_string("  backbone: net_%s", "behavior"), F.lit("data:"), F.format_string("  batch_size: %d", "n"), F.format_string("  sizes: [1, %d]", "m"))
    path = shared_folder(spark, "s7")
    per.select("behavior", text.alias("value")).repartition("behavior").write.partitionBy("behavior").text(path)
    return tables.read_run_configs(spark, f"{path}/behavior=*/*.txt")


def _sheet(spark, d):
    """labels as a sheet with a header that someone else wrote, with blank, numeric and other rows."""
    said = F.element_at(F.array(F.lit("Y"), F.lit(" no "), F.lit("?"), F.lit("true"), F.lit(None)), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.expr("CASE doc_id % 7 WHEN 0 THEN cast(doc_id as string) WHEN 1 THEN '  ' WHEN 2 THEN 'notes.txt' ELSE concat(' c', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.MP4 ' ELSE '.mov' END) END")
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("No."), name.alias(" VIDEO "), said.alias("Is it Our Video?"), F.concat(F.lit(" n"), F.col("doc_id").cast("string")).alias("Notes (free text)"), F.lit("0").alias("old Tail (1-0)"),
        F.col("toxic").cast("string").alias("Ear sucking 1-0"), F.concat(F.col("quality").cast("string"), F.lit(".0")).alias("Tail 1-0"),
    )


@query("p16_read_external_sheet", """SELECT 'c' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.MP4' ELSE '.mov' END AS video, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true END AS ours, 'n' || doc_id AS notes,
  list_concat(CASE WHEN toxic = 1 THEN ['ear'] ELSE [] END, CASE WHEN quality = 1 THEN ['tail'] ELSE [] END) AS labels FROM labels WHERE doc_id % 7 > 2""")
def p16_detected(spark, d):
    return clean.read_external_sheet(_sheet(spark, d))


@query("p16_sheet_statistics", "SELECT count(*) AS rows, count(*) FILTER (doc_id % 7 > 2) AS clips, count(*) FILTER (doc_id % 7 > 2 AND doc_id % 5 IN (0, 3)) AS yes, count(*) FILTER (doc_id % 7 > 2 AND doc_id % 5 = 1) AS no, count(*) FILTER (doc_id % 7 > 2 AND doc_id % 5 IN (2, 4)) AS unknown FROM labels")
def p16_statistics(spark, d):
    return clean.sheet_statistics(_sheet(spark, d))


# --- summaries ----------------------------------------------------------------------------------------------------------


@query("a1_cleaning_distributions", f"""WITH {EV}, c AS (SELECT 'event_type' AS field, event_type AS b, {_TYPE_SQL.format("event_type")} AS a FROM ev UNION ALL SELECT 'animal_id', animal_id, CASE WHEN animal_id::INT % 2 = 0 THEN 'even' END FROM ev),
v AS (SELECT field, coalesce(b, '(null)') AS value, 1 AS before, 0 AS after FROM c UNION ALL SELECT field, coalesce(a, '(null)'), 0, 1 FROM c)
SELECT field, value, sum(before)::BIGINT AS before, sum(after)::BIGINT AS after FROM v GROUP BY ALL""")
def a1_distributions(spark, d):
    animal = F.expr("CASE WHEN try_cast(animal_id as int) % 2 = 0 THEN 'even' END")
    return clean.cleaning_distributions(events(spark, d), {"event_type": (F.col("event_type"), clean.normalize_label(F.col("event_type"), TYPES)), "animal_id": (F.col("animal_id"), animal)})


@query("a10_bout_sizes", f"WITH {BOUTS_SQL}, s AS (SELECT bout_id, count(*) AS n, bool_or(behavior = 'tail') AS t FROM bt GROUP BY bout_id, video) SELECT count(*) AS bouts, round(avg(n), 6) AS mean_size, max(n) AS largest, count(*) FILTER (n = 1) AS single, count(*) FILTER (t) AS with_tail FROM s")
def a10_sizes(spark, d):
    return sessions.bout_sizes(sessions.bout_summary(bouts(spark, d)))


@query("a12_set_duplicates", f"WITH {EV}, {TH}, k AS (SELECT split, video || '/' || day AS k, count(*) AS n FROM sp GROUP BY ALL) SELECT split, sum(n)::BIGINT AS rows, count(*) AS keys, count(*) FILTER (n > 1) AS repeated, sum(n - 1)::BIGINT AS extra FROM k GROUP BY split")
def a12_duplicates(spark, d):
    return leak.set_duplicates(leak.tagged(three(spark, d)).withColumn("k", F.concat_ws("/", "video", "day")), "k")


@query("a15_purest_videos", f"WITH {EV}, p AS (SELECT video || '/' || day AS video, count(*) AS n, count(*) FILTER (behavior = 'ear') AS ear, count(*) FILTER (behavior = 'tail') AS tail FROM ev GROUP BY 1) SELECT * FROM p WHERE (ear > 0) <> (tail > 0) ORDER BY n DESC, video LIMIT 10")
def a15_purest(spark, d):
    return evaluate.purest_videos(events(spark, d).withColumn("video", F.concat_ws("/", "video", "day")))


_LOSS = f"""{PR}, ls AS (SELECT clip_id, true_label AS class, round(greatest(logit_ear, logit_tail) + ln(exp(logit_ear - greatest(logit_ear, logit_tail)) + exp(logit_tail - greatest(logit_ear, logit_tail)))
  - CASE true_label WHEN 'ear' THEN logit_ear ELSE logit_tail END, 6) AS loss, true_label = pred_label AS correct FROM pr)"""


@query("w12_loss_by_class", f"WITH {_LOSS} SELECT class, row_number() OVER (PARTITION BY class ORDER BY loss DESC, clip_id) AS rank, clip_id, loss, correct FROM ls QUALIFY rank <= 10")
def w12_classes(spark, d):
    return evaluate.loss_ranking_by_class(predictions(spark, d))


@query("w12_loss_summary", f"WITH {_LOSS} SELECT class, count(*) AS n, round(avg(loss), 6) AS mean_loss, max(loss) AS max_loss, count(*) FILTER (NOT correct) AS wrong, round(100 * count(*) FILTER (NOT correct) / count(*), 4) AS wrong_percent FROM ls GROUP BY ROLLUP (class)")
def w12_summary(spark, d):
    return evaluate.loss_summary(predictions(spark, d))


_REST = "SELECT * FROM ev WHERE event_idx % 3 <> 0"


@query("b8_select_undone", f"""WITH {EV}, rs AS ({_REST}), f AS (SELECT event_idx, 1 AS tier FROM rs WHERE behavior IN ('tail', 'other') ORDER BY md5('42|' || event_idx), event_idx LIMIT 70),
k AS (SELECT greatest(1, (200 - (SELECT count(*) FROM f)) // (SELECT count(DISTINCT (grp, camera)) FROM rs WHERE behavior = 'ear')) AS per),
s AS (SELECT event_idx, 2 AS tier FROM rs WHERE behavior = 'ear' QUALIFY row_number() OVER (PARTITION BY grp, camera ORDER BY md5('42|' || event_idx), event_idx) <= (SELECT per FROM k)),
t AS (SELECT event_idx, 3 AS tier FROM rs WHERE event_idx NOT IN (SELECT event_idx FROM f) AND event_idx NOT IN (SELECT event_idx FROM s))
SELECT event_idx, tier FROM (SELECT * FROM f UNION ALL SELECT * FROM s UNION ALL SELECT * FROM t) ORDER BY tier, md5('42|' || event_idx), event_idx LIMIT 200""")
def b8_undone(spark, d):
    e = events(spark, d)
    return splits.select_diverse(e, 200, done=e.where("event_idx % 3 = 0")).select("event_idx", "tier")
