"""Registered queries of plans, audits, evaluation and runs."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import functions as F

from ..operators import audit, bootstrap, evaluate, planning, runs
from .bindings import EV, PR, events, predictions, table
from .linking import TH, three

Q: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


# --- plans ------------------------------------------------------------------------------------------------------------


def spans(spark, d):
    """Events as spans in recordings of 1,800 seconds."""
    return events(spark, d).select("event_idx", "behavior", F.expr("pmod(start_sec, 1800D)").alias("event_start"), F.expr("least(1800D, pmod(start_sec, 1800D) + duration_sec / 8)").alias("event_end"), F.lit(1800.0).alias("video_sec"))


def even_spans(spark, d):
    """The spans on a grid of 0.02 seconds: halves are whole hundredths, so that engines round a plan alike."""
    grid = lambda c: (F.floor(F.col(c) * 50) / 50).alias(c)
    return spans(spark, d).select("event_idx", "behavior", grid("event_start"), grid("event_end"), "video_sec")


SN = f"{EV}, sn AS (SELECT event_idx, behavior, st AS event_start, least(1800.0::DOUBLE, st + duration_sec / 8) AS event_end, 1800.0::DOUBLE AS video_sec FROM (SELECT *, start_sec - 1800.0::DOUBLE * floor(start_sec / 1800) AS st FROM ev))"
_CLIP = f"""{SN}, se AS (SELECT event_idx, behavior, floor(event_start * 50) / 50 AS event_start, floor(event_end * 50) / 50 AS event_end, video_sec FROM sn),
c1 AS (SELECT *, greatest(6.0 - (event_end - event_start + 3.0 + 3.0), 0.0) / 2 AS extra FROM se), c2 AS (SELECT *, greatest(-(event_start - 3.0 - extra), 0.0) AS lost, greatest(event_start - 3.0 - extra, 0.0) AS lo, event_end + 3.0 + extra AS h0 FROM c1),
c3 AS (SELECT *, CASE WHEN lost > 0 THEN least(h0 + lost, video_sec) ELSE h0 END AS h1 FROM c2), c4 AS (SELECT *, greatest(h1 - video_sec, 0.0) AS ov FROM c3),
c5 AS (SELECT *, CASE WHEN ov > 0 THEN greatest(lo - ov, 0.0) ELSE lo END AS low, least(h1, video_sec) AS high FROM c4)"""


_PLAN = f"""{_CLIP}, pl AS (SELECT event_idx, behavior, round(low, 2) AS clip_start, round(high, 2) AS clip_end, round(high - low, 2) AS clip_duration, round(event_start - low, 2) AS pad_before,
  round(high - event_end, 2) AS pad_after, low <= event_start AND event_end <= high AS visible, lost > 0 OR ov > 0 AS clamped,
  concat_ws('|', CASE WHEN lost > 0 THEN 'start_clamped' END, CASE WHEN ov > 0 THEN 'end_clamped' END, CASE WHEN NOT (low <= event_start AND event_end <= high) THEN 'outside_clip' END,
  CASE WHEN event_start - low < 1 AND event_start > 1 THEN 'thin_pre' END, CASE WHEN high - event_end < 1 AND video_sec - event_end > 1 THEN 'thin_post' END) AS flags FROM c5)"""


def _plan(spark, d):
    return planning.plan_clip(even_spans(spark, d))


@query("t1_plan_clip", f"WITH {_PLAN} SELECT event_idx, clip_start, clip_end, clip_duration, pad_before, pad_after, visible, flags FROM pl")
def t1(spark, d):
    return _plan(spark, d).select("event_idx", "clip_start", "clip_end", "clip_duration", "pad_before", "pad_after", "visible", F.array_join("flags", "|").alias("flags"))


@query("t2_clip_plan_report", f"""WITH {_PLAN} SELECT behavior, count(*) AS clips, count(*) FILTER (clamped) AS clamped, count(*) FILTER (NOT visible) AS outside, round(avg(clip_duration), 4) AS mean,
  round(quantile_cont(clip_duration, 0.5), 4) AS median, min(clip_duration) AS least, max(clip_duration) AS most, round(sum(clip_duration) / 3600, 4) AS hours FROM pl GROUP BY ROLLUP (behavior)""")
def t2(spark, d):
    return planning.clip_plan_report(_plan(spark, d))


@query("t3_slide_windows", f"""WITH {SN}, w AS (SELECT event_idx, event_start AS s, event_end AS e, greatest(least(floor(round((event_end - event_start - 8.0 + 2.0) / 4.0, 9)) + 1, 20), 1)::INT AS n FROM sn),
x AS (SELECT event_idx, unnest(range(CASE WHEN e - s <= 8 THEN 1 ELSE n END))::INT AS "window", s, e FROM w)
SELECT event_idx, "window", round(CASE WHEN e - s <= 8 THEN greatest(0.0, (s + e) / 2 - 4.0) ELSE least(s + "window" * 4.0, e - 8.0) END, 6) AS win_start, 'evt_' || CASE WHEN event_idx < 10000 THEN lpad(event_idx::VARCHAR, 4, '0') ELSE event_idx::VARCHAR END || '_w' || lpad("window"::VARCHAR, 2, '0') AS clip_id FROM x""")
def t3(spark, d):
    return planning.slide_windows(spans(spark, d), 8.0).select("event_idx", "window", "win_start", "clip_id")


@query("t4_spread_clips", f"""WITH {SN}, x AS (SELECT event_idx, event_start AS s, event_end - event_start - 4.0 AS room, unnest(range(CASE WHEN event_end - event_start - 4.0 <= 0 THEN 1 ELSE 5 END))::INT AS clip_idx FROM sn) SELECT event_idx, clip_idx, round(CASE WHEN room <= 0 THEN s ELSE s + room * clip_idx / 4.0 END, 6) AS clip_start FROM x""")
def t4(spark, d):
    return planning.spread_clips(spans(spark, d), 5, 4.0).withColumn("clip_start", F.round("clip_start", 6))


@query("t5_frame_indices", f"""WITH {SN}, b AS (SELECT event_idx, round_even((event_start + event_end) / 2 * 25.0, 0) - 2.0 * 8 AS f FROM sn) SELECT event_idx, unnest(range(16))::INT AS k, least(greatest(f + unnest(range(16)) * 2.0, 0), 44999)::INT AS frame FROM b""")
def t5(spark, d):
    a = planning.frame_indices(F.col("event_start"), F.col("event_end"), F.lit(25.0), F.lit(45_000.0))
    return spans(spark, d).select("event_idx", F.posexplode(a).alias("k", "frame"))


@query("t6_keyframes", f"WITH {EV}, k AS (SELECT event_idx, floor(duration_sec)::INT AS n FROM ev), x AS (SELECT event_idx, unnest(list_distinct(list_append(range(0, n, 15), (n - 1)::BIGINT)))::INT AS frame FROM k WHERE n > 0) SELECT event_idx, frame, round(frame / 25.0, 3) AS time_sec FROM x")
def t6(spark, d):
    e = events(spark, d).select("event_idx", F.expr("cast(floor(duration_sec) as int)").alias("frames"), F.lit(25.0).alias("fps"))
    return planning.keyframes(e)


@query("t7_even_frames", f"WITH {EV}, n AS (SELECT event_idx, floor(duration_sec)::INT + 1 AS n FROM ev) SELECT event_idx, list_transform(range(8), lambda i: floor(round((n - 1) * i / 7.0, 9))::INT)::VARCHAR AS even, list_transform([0.1, 0.5, 0.9], lambda p: floor(round(n * p::DOUBLE, 9))::INT)::VARCHAR AS points FROM n")
def t7(spark, d):
    n = F.expr("cast(floor(duration_sec) as int) + 1")
    said = lambda c: F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
    return events(spark, d).select("event_idx", said(planning.even_frames(n, 8)).alias("even"), said(planning.sample_points(n)).alias("points"))


@query("t8_fixed_windows", f"WITH {SN} SELECT event_idx, round(greatest(0.0, event_start - 2.0), 6) AS win_start, round(greatest(0.0, event_start - 2.0) + 10.0, 6) AS win_end FROM sn")
def t8(spark, d):
    w = planning.fixed_windows(spans(spark, d), 2.0, 10.0)
    return w.select("event_idx", F.round("win_start", 6).alias("win_start"), F.round("win_end", 6).alias("win_end"))


@query("t10_static_clip_flag", f"WITH {EV}, f AS (SELECT video AS clip_id, duration_sec AS grey, duration_sec / 10 AS variance, abs(duration_sec - lag(duration_sec) OVER (PARTITION BY video ORDER BY event_idx)) AS df FROM ev) SELECT clip_id, coalesce(avg(variance) < 5 OR avg(df) < 1, false) OR count(grey) = 0 AS static FROM f GROUP BY clip_id")
def t10(spark, d):
    f = events(spark, d).select(F.col("video").alias("clip_id"), F.col("event_idx").alias("frame"), F.col("duration_sec").alias("grey"), (F.col("duration_sec") / 10).alias("variance"))
    return planning.static_clip_flag(f)


# --- audits -----------------------------------------------------------------------------------------------------------


def manifest(spark, d):
    """Events with a recording's file name (one in 31 unreadable), path, clock times and a stored offset (one in 13 off)."""
    e = events(spark, d)
    tile = F.expr("cast(floor((start_sec - (day - 1) * 86400D) / 1800) as int)")
    e = e.withColumn("tile", F.when(F.col("event_idx") % 17 == 0, F.greatest(tile - 1, F.lit(0))).otherwise(tile))
    two = lambda c: F.lpad(F.expr(c).cast("string"), 2, "0")
    at = lambda c: F.concat(two(f"cast(floor(({c}) / 3600) as int)"), two(f"cast(floor(({c}) / 60) as int) % 60"), F.lit("00"))
    day = F.concat(F.lit("202401"), two("day"))
    name = F.concat(F.lit("cam_ch"), F.col("camera").cast("string"), F.lit("_main_"), day, at("tile * 1800"), F.lit("_"), F.when(F.col("tile") < 47, F.concat(day, at("tile * 1800 + 1800"))).otherwise(F.concat(day, F.lit("235959"))))
    name = F.when(F.col("event_idx") % 31 == 0, "broken").otherwise(name)
    clock = F.date_format("ts", "HH:mm:ss")
    offset = F.expr("cast(hour(ts) * 3600 + minute(ts) * 60 + second(ts) - tile * 1800 as double)")
    return e.select("event_idx", "behavior", name.alias("filename"), F.concat(F.col("grp").cast("string"), F.lit("/"), F.col("camera").cast("string")).alias("path"), F.when(F.col("event_idx") % 29 == 0, "??").otherwise(clock).alias("start_time"), clock.alias("end_time"), F.expr("CASE WHEN event_idx % 19 = 0 THEN 0D ELSE duration_sec END").alias("duration_sec"), F.when(F.col("event_idx") % 13 == 0, offset + 9).otherwise(offset).alias("offset_sec"))


MF = f"""{EV}, m0 AS (SELECT *, floor((start_sec - (day - 1) * 86400.0::DOUBLE) / 1800)::INT AS t FROM ev), m1 AS (SELECT *, CASE WHEN event_idx % 17 = 0 THEN greatest(t - 1, 0) ELSE t END AS tile, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS clk FROM m0),
mf AS (SELECT event_idx, behavior, event_idx % 31 = 0 AS broken, grp || '/' || camera AS path, event_idx % 29 = 0 AS noclock, tile * 1800 AS seg_start, CASE WHEN tile < 47 THEN 1800 ELSE 1799 END AS seg_sec, clk, CASE WHEN event_idx % 19 = 0 THEN 0.0::DOUBLE ELSE duration_sec END AS duration_sec,
  (clk - tile * 1800 + CASE WHEN event_idx % 13 = 0 THEN 9 ELSE 0 END)::DOUBLE AS offset_sec, grp = 3 AND camera = 1 AS gone FROM m1),
vf AS (SELECT *, CASE WHEN broken THEN 'cannot_parse_segment' WHEN gone THEN 'missing_video' WHEN noclock THEN 'cannot_parse_event_time' WHEN (clk - seg_start) > seg_sec THEN 'offset_exceeds_segment' ELSE 'ok' END AS reason FROM mf)"""


def _files(spark, d):
    return events(spark, d).where("not (grp = 3 and camera = 1)").select(F.expr("concat_ws('/', grp, camera)").alias("path")).distinct()


@query("v1_verify_alignment", f"WITH {MF} SELECT event_idx, reason, reason = 'ok' AND abs(clk - seg_start - offset_sec) > 1 AS offset_mismatch, CASE WHEN duration_sec < 1 THEN 1.0 ELSE duration_sec END AS duration_fixed FROM vf")
def v1(spark, d):
    return audit.verify_alignment(manifest(spark, d), _files(spark, d)).select("event_idx", "reason", "offset_mismatch", "duration_fixed")


@query("v1_alignment_summary", f"WITH {MF} SELECT reason, count(*) AS n, count(*) FILTER (reason = 'ok' AND abs(clk - seg_start - offset_sec) > 1) AS mismatches FROM vf GROUP BY reason")
def v1_summary(spark, d):
    return audit.alignment_summary(audit.verify_alignment(manifest(spark, d), _files(spark, d)))


@query("v2_audit_events", f"""WITH {MF}, a AS (SELECT *, CASE WHEN NOT broken AND NOT noclock AND clk <> seg_start THEN clk - seg_start END AS calc FROM mf), b AS (SELECT *, NOT gone AND coalesce(calc, offset_sec, 0) > 1700 AS exceeds FROM a)
SELECT event_idx, CASE WHEN gone OR exceeds THEN 'FAIL' WHEN duration_sec <= 0 OR (NOT gone AND broken) OR (NOT gone AND coalesce(abs(calc - offset_sec) > 5, false)) THEN 'WARN' ELSE 'OK' END AS status,
  concat_ws('|', CASE WHEN duration_sec <= 0 THEN 'zero_duration' END, CASE WHEN gone THEN 'video_not_found' END, CASE WHEN NOT gone AND broken THEN 'cannot_parse_filename' END, CASE WHEN NOT gone AND abs(calc - offset_sec) > 5 THEN 'offset_mismatch' END, CASE WHEN exceeds THEN 'offset_exceeds_duration' END) AS issues FROM b""")
def v2(spark, d):
    return audit.audit_events(manifest(spark, d), _files(spark, d).withColumn("actual_sec", F.lit(1700.0)))


@query("v3_verify_paths", f"WITH {EV}, p AS (SELECT DISTINCT camera, video AS path FROM ev) SELECT camera, path, path IN (SELECT video FROM ev WHERE grp <> 2) AS present FROM p QUALIFY row_number() OVER (PARTITION BY camera ORDER BY path) <= 5")
def v3(spark, d):
    e = events(spark, d).withColumn("path", F.col("video"))
    return audit.verify_paths(e, e.where("grp <> 2"), 5)


@query("v4_pool_validity", "SELECT page_id FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0")
def v4(spark, d):
    p = table(spark, d, "pages").select("page_id", F.expr("CASE WHEN page_id % 5 <> 0 THEN url END").alias("hash"), F.length("html").alias("size"), F.expr("CASE WHEN page_id % 7 = 0 THEN 'unreadable' ELSE ' ' END").alias("error"))
    return audit.pool_validity(p).select("page_id")


_CN = "'evt_' || CASE WHEN event_idx < 10000 THEN lpad(event_idx::VARCHAR, 4, '0') ELSE event_idx::VARCHAR END || '_' || behavior || '.mp4'"


@query("v5_clip_presence", f"WITH {EV} SELECT event_idx, {_CN} AS clip, event_idx % 3 <> 0 AS present FROM ev")
def v5(spark, d):
    e = events(spark, d).select("event_idx", "behavior")
    files = e.where("event_idx % 3 <> 0").select(F.concat(F.lit("evt_"), F.expr("CASE WHEN event_idx < 10000 THEN lpad(cast(event_idx as string), 4, '0') ELSE cast(event_idx as string) END"), F.lit("_"), F.col("behavior"), F.lit(".mp4")).alias("name"))
    return audit.clip_presence(e, files).select("event_idx", "clip", "present")


@query("v6_corrupt_impact", f"WITH {EV} SELECT grp, count(*) AS events, count(DISTINCT video) AS videos FROM ev WHERE video IN (SELECT video FROM ev WHERE duration_sec > 350) GROUP BY grp")
def v6(spark, d):
    e = events(spark, d)
    return audit.corrupt_impact(e, e.where("duration_sec > 350"))


@query("v7_filter_tracks", f"WITH {EV}, t AS (SELECT video, behavior AS track, event_idx AS frame, duration_sec / 200 AS conf FROM ev), g AS (SELECT *, coalesce(frame - lag(frame) OVER (PARTITION BY video, track ORDER BY frame) - 1, 0) AS gp FROM t) SELECT video, track, count(*) AS n, round(avg(conf), 6) AS mean_conf, sum(CASE WHEN gp > 0 AND gp <= 100 THEN gp ELSE 0 END)::BIGINT AS gaps_filled FROM g GROUP BY ALL HAVING count(*) >= 5 AND round(avg(conf), 6) >= 0.2")
def v7(spark, d):
    t = events(spark, d).select("video", F.col("behavior").alias("track"), F.col("event_idx").alias("frame"), (F.col("duration_sec") / 200).alias("conf"))
    return audit.filter_tracks(t, 5, 0.2, 100)


@query("v8_temporal_nms", None)
def v8(spark, d):
    e = events(spark, d).select("video", "event_idx", "start_sec", (F.col("start_sec") + F.col("duration_sec") * 100).alias("end_sec"), F.col("duration_sec").alias("score"))
    return audit.temporal_nms(e, 0.3)


# --- evaluation -------------------------------------------------------------------------------------------------------


def sure(spark, d):
    return predictions(spark, d).withColumn("msp", F.greatest("prob_ear", "prob_tail")).withColumn("is_ood", F.col("label") >= 7)


_CELLS = "count(*) FILTER (true_label = 'tail' AND pred_label = 'tail')::DOUBLE AS tp, count(*) FILTER (true_label <> 'tail' AND pred_label = 'tail')::DOUBLE AS fp, count(*) FILTER (true_label = 'tail' AND pred_label <> 'tail')::DOUBLE AS fn, count(*) FILTER (true_label <> 'tail' AND pred_label <> 'tail')::DOUBLE AS tn"


def _r(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END"


_F1P, _F1N, _RP, _RN = _r("2 * tp", "2 * tp + fp + fn"), _r("2 * tn", "2 * tn + fp + fn"), _r("tp", "tp + fn"), _r("tn", "tn + fp")
_BIN = {"f1_pos": _F1P, "f1_neg": _F1N, "macro_f1": f"({_F1P} + {_F1N}) / 2", "precision_pos": _r("tp", "tp + fp"), "recall_pos": _RP, "recall_neg": _RN, "balanced_accuracy": f"({_RP} + {_RN}) / 2", "mcc": _r("tp * tn - fp * fn", "sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))")}


@query("a17_confusion_matrix", f"WITH {PR} SELECT true_label, pred_label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY true_label), 6) AS share FROM pr GROUP BY true_label, pred_label")
def a17(spark, d):
    return evaluate.confusion_matrix(predictions(spark, d))


@query("a18_classification_metrics", f"""WITH {PR}, c AS (SELECT unnest(['ear', 'tail', 'other']) AS class), k AS (SELECT class, (SELECT count(*) FROM pr WHERE true_label = class AND pred_label = class)::DOUBLE AS tp, (SELECT count(*) FROM pr WHERE true_label = class)::DOUBLE AS sup, (SELECT count(*) FROM pr WHERE pred_label = class)::DOUBLE AS said FROM c),
m AS (SELECT *, tp / (said + 1e-8) AS p, tp / (sup + 1e-8) AS r FROM k), f AS (SELECT *, 2 * p * r / (p + r + 1e-8) AS f FROM m)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, sup::BIGINT AS support, NULL::DOUBLE AS accuracy FROM f UNION ALL SELECT NULL, round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(sup)::BIGINT, round(sum(tp) / sum(sup), 6) FROM f""")
def a18(spark, d):
    return evaluate.classification_metrics(predictions(spark, d), ["ear", "tail", "other"])


_BINARY = f"WITH {PR}, k AS (SELECT {_CELLS} FROM pr) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {', '.join(f'round({v}, 6) AS {n}' for n, v in _BIN.items())} FROM k"


_CURVE = f"{PR}, pt AS (SELECT prob_tail AS score, count(*) FILTER (true_label = 'tail') AS pos, count(*) FILTER (true_label <> 'tail') AS neg FROM pr GROUP BY 1), cv AS (SELECT *, sum(pos) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(neg) OVER (ORDER BY score DESC)::BIGINT AS fp FROM pt)"


@query("w7_threshold_curve", f"WITH {_CURVE} SELECT score, pos, neg, tp, fp FROM cv")
def w7(spark, d):
    return evaluate.threshold_curve(predictions(spark, d))


_CURVE_METRICS = f"WITH {_CURVE} SELECT sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, round(sum(neg * (tp - pos / 2)) / sum(pos) / sum(neg), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM cv"


@query("a19_binary_metrics", f"SELECT * FROM ({_BINARY}), (SELECT roc_auc, average_precision FROM ({_CURVE_METRICS}))")
def a19(spark, d):
    return evaluate.binary_report(predictions(spark, d))


@query("w7_curve_metrics", _CURVE_METRICS)
def w7_metrics(spark, d):
    return evaluate.curve_metrics(evaluate.threshold_curve(predictions(spark, d)))


def _ece_sql(p: str, hit: str, bins: int) -> str:
    case = " ".join(f"WHEN p > {(b - 1) / bins!r} AND p <= {b / bins!r} THEN {b}" for b in range(1, bins + 1))
    return f"WITH {PR}, e AS (SELECT {p} AS p, ({hit})::INT AS hit FROM pr), b AS (SELECT CASE {case} END AS bin, count(*) AS n, abs(avg(p) - avg(hit)) AS gap FROM (SELECT p::DOUBLE AS p, hit FROM e) GROUP BY 1) SELECT round(sum(n * gap) FILTER (bin IS NOT NULL) / sum(n), 6) AS ece, round(max(gap) FILTER (bin IS NOT NULL), 6) AS mce, sum(n)::BIGINT AS n FROM b"


@query("a20_ece_positive", _ece_sql("prob_tail", "true_label = 'tail'", 10))
def a20(spark, d):
    return evaluate.ece(sure(spark, d), 10, "positive")


@query("a20_ece_top1", _ece_sql("greatest(prob_ear, prob_tail)", "true_label = pred_label", 15))
def a20_top(spark, d):
    return evaluate.ece(sure(spark, d), 15, "top1")


_RATED = f"""WITH {PR}, e AS (SELECT greatest(prob_ear, prob_tail) AS p, (true_label = CASE WHEN prob_tail > prob_ear THEN 'tail' ELSE 'ear' END)::INT AS hit,
  (prob_ear - (true_label = 'ear')::INT) ** 2 + (prob_tail - (true_label = 'tail')::INT) ** 2 AS sq FROM pr),
b AS (SELECT least(10, ceil(p * 10 - 1e-9))::INT AS bin, count(*) AS n, abs(avg(p) - avg(hit)) AS gap, sum(sq) AS sq FROM e GROUP BY 1),
r AS (SELECT round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce, round(sum(sq) / sum(n), 6) AS brier, sum(n)::BIGINT AS n FROM b)
SELECT *, CASE WHEN ece < 0.05 THEN 'excellent' WHEN ece < 0.1 THEN 'good' WHEN ece < 0.15 THEN 'moderate' ELSE 'poor - consider temperature scaling' END AS rating FROM r"""


@query("a20_calibration", _RATED)
def a20_rated(spark, d):
    return evaluate.calibration(sure(spark, d), 10)


@query("a21_ood_scores", f"WITH {PR} SELECT clip_id, greatest(prob_ear, prob_tail) AS msp, round(prob_ear * ln(prob_ear + 1e-10) + prob_tail * ln(prob_tail + 1e-10), 6) AS entropy, round(ln(exp(ln(prob_ear + 1e-10)) + exp(ln(prob_tail + 1e-10))), 6) + 0.0 AS energy FROM pr")
def a21(spark, d):
    probs = [F.col("prob_ear"), F.col("prob_tail")]
    score = lambda m: F.round(evaluate.ood_scores(probs, m), 6)
    return sure(spark, d).select("clip_id", evaluate.ood_scores(probs).alias("msp"), score("entropy").alias("entropy"), (score("energy") + 0.0).alias("energy"))


@query("a22_ood_metrics", f"""WITH {PR}, s AS (SELECT greatest(prob_ear, prob_tail) AS s, label >= 7 AS o FROM pr), t AS (SELECT count(*) FILTER (NOT o) AS np, count(*) FILTER (o) AS nn FROM s),
p AS (SELECT s, count(*) FILTER (NOT o) AS pos, count(*) FILTER (o) AS neg FROM s GROUP BY s), c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(neg) OVER (ORDER BY s) AS otp, sum(pos) OVER (ORDER BY s) AS ofp FROM p)
SELECT round(sum(neg * (tp - pos / 2)) / max(np) / max(nn), 6) AS auroc, round(sum(neg * otp / (otp + ofp)) / max(nn), 6) AS aupr_ood, round(coalesce(min(fp / nn) FILTER (tp / np >= 0.95), 1.0), 6) AS fpr_at_95tpr, round(coalesce(max(tp / np) FILTER (fp / nn <= 0.05), 0.0), 6) AS tpr_at_5fpr, max(np) AS n_id, max(nn) AS n_ood FROM c, t""")
def a22(spark, d):
    return evaluate.ood_metrics(sure(spark, d).withColumn("score", F.col("msp")))


@query("a23_ood_breakdown", f"WITH {PR} SELECT label, count(*) AS n, round(avg(greatest(prob_ear, prob_tail)), 6) AS mean, round(stddev_pop(greatest(prob_ear, prob_tail)), 6) AS std FROM pr WHERE label >= 7 GROUP BY label")
def a23(spark, d):
    return evaluate.ood_breakdown(sure(spark, d).where("is_ood"), "label", "msp")


def _steps_sql(means: str) -> str:
    """SQL of tables: the steps `cs` of the Poisson distribution for each whole mean `n` of a table up to 500."""
    return f"""cdf(n, k, p, c) AS (SELECT DISTINCT n, 0, exp(-n::DOUBLE), exp(-n::DOUBLE) FROM ({means}) WHERE n <= 500
  UNION ALL SELECT n, k + 1, p * n / (k + 1), c + p * n / (k + 1) FROM cdf WHERE k < ceil(n + 12 * sqrt(n) + 30)),
steps AS (SELECT n, list(c ORDER BY k) AS cs FROM cdf GROUP BY n)"""


def _draw_sql(rows: str, n: str, key: str, out: str) -> str:
    """SQL of a query: the rows with a Poisson draw of mean n by this key, for each replicate from 1 to 1000."""
    u = lambda k: f"('0x' || substr(md5({k}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"
    wide = f"greatest(0, round({n} + sqrt({n}) * z + (z * z - 1) / 6))"
    z = f"sqrt(-2 * ln(1 - u)) * cos(2 * pi() * {u(key + " || '|z'")})"
    return f"""SELECT * EXCLUDE (cs, u, z, m), CASE WHEN {n} <= 500 THEN len(list_filter(cs, lambda c: c <= u)) ELSE {wide} END::BIGINT AS {out}
  FROM (SELECT *, {z} AS z FROM (SELECT *, {u(key)} AS u FROM ({rows}) LEFT JOIN (SELECT n AS m, cs FROM steps) ON m = {n}))"""


def _interval_sql(long: str) -> str:
    return f"""SELECT metric, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high,
  round(stddev_pop(value), 6) AS std FROM ({long}) GROUP BY metric"""


_REPLICATES = "(SELECT unnest(range(1, 1001)) AS replicate)"
_PATTERN = " || ".join(f"CASE WHEN true_label {y} 'tail' AND pred_label {z} 'tail' THEN '1' ELSE '0' END" for y, z in (("=", "="), ("<>", "="), ("=", "<>"), ("<>", "<>")))


def _cells_sql(pattern: str, cells: tuple[str, ...]) -> str:
    """SQL of tables up to `k`: the weighted cells of each replicate."""
    sums = ", ".join(f"coalesce(sum(w) FILTER (substr(pattern, {i + 1}, 1) = '1'), 0)::DOUBLE AS {c}" for i, c in enumerate(cells))
    drawn = _draw_sql(f"SELECT * FROM cells, {_REPLICATES}", "n", "'42|' || pattern || '|' || replicate", "w")
    return f"""{PR}, cells AS (SELECT {pattern} AS pattern, count(*) AS n FROM pr GROUP BY 1), {_steps_sql("SELECT n FROM cells")},
k AS (SELECT replicate, {sums} FROM ({drawn}) GROUP BY replicate)"""


_BINARY_VALUES = f"SELECT {', '.join(f'{v} AS {n}' for n, v in _BIN.items())} FROM k WHERE tp + fn > 0 AND fp + tn > 0"
_CI = _cells_sql(_PATTERN, ("tp", "fp", "fn", "tn"))


#: The bootstrap of the report, whose rows draw by counts.
_CI_COUNTED = f"WITH RECURSIVE {_CI}, v AS ({_BINARY_VALUES}) {_interval_sql(f'UNPIVOT v ON {", ".join(_BIN)} INTO NAME metric VALUE value')}"
_W = " + ".join(f"(u >= {c!r})::INT" for c in bootstrap.poisson_one())
_WC = _CELLS.replace("count(*)", "coalesce(sum(w)").replace("::DOUBLE AS", ", 0)::DOUBLE AS")


@query("a24_bootstrap_ci", f"""WITH {PR}, r AS (SELECT pr.*, b AS replicate, ('0x' || substr(md5('42|' || clip_id || '|' || b), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM pr, (SELECT unnest(range(1, 1001)) AS b)), w AS (SELECT *, {_W} AS w FROM r),
k AS (SELECT replicate, {_WC} FROM w WHERE w > 0 GROUP BY replicate), v AS (SELECT {', '.join(f'{v} AS {n}' for n, v in _BIN.items())} FROM k WHERE tp + fn > 0 AND fp + tn > 0), l AS (UNPIVOT v ON {', '.join(_BIN)} INTO NAME metric VALUE value)
SELECT metric, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round(stddev_pop(value), 6) AS std FROM l GROUP BY metric""")
def a24(spark, d):
    return evaluate.bootstrap_ci(predictions(spark, d), 1000, key="clip_id")


#: A user's metric: how many of the rows that the model is sure of are wrong, against all wrong ones.
SURE_ERRORS = bootstrap.Metric("coalesce(try_divide(sure, wrong), 0D)", {"sure": "true_label <> pred_label and abs(prob_tail - 0.5) > 0.3", "wrong": "true_label <> pred_label"}, "wrong > 0")
_OWN = _cells_sql("CASE WHEN true_label <> pred_label AND abs(prob_tail - 0.5) > 0.3 THEN '1' ELSE '0' END || CASE WHEN true_label <> pred_label THEN '1' ELSE '0' END", ("sure", "wrong"))


@query("a24_bootstrap_metrics", f"""SELECT * FROM (WITH RECURSIVE {_CI}, v AS (SELECT macro_f1, mcc FROM ({_BINARY_VALUES})) {_interval_sql("UNPIVOT v ON macro_f1, mcc INTO NAME metric VALUE value")})
UNION ALL SELECT * FROM (WITH RECURSIVE {_OWN} {_interval_sql("SELECT 'sure_errors' AS metric, sure / wrong AS value FROM k WHERE wrong > 0")})""")
def a24_metrics(spark, d):
    return evaluate.bootstrap_ci(predictions(spark, d), 1000, metrics=["macro_f1", "mcc", ("sure_errors", SURE_ERRORS)])


def weighted_auc(rows: pd.DataFrame) -> float | None:
    """A user's function of true_label, permille (a score) and weight: the area under the ROC curve."""
    sums = rows.assign(pos=rows["weight"] * (rows["true_label"] == "tail"), neg=rows["weight"] * (rows["true_label"] != "tail"))
    points = sums.groupby("permille")[["pos", "neg"]].sum().sort_index(ascending=False)
    pos, neg = points["pos"].sum(), points["neg"].sum()
    return float((points["neg"] * (points["pos"].cumsum() - points["pos"] / 2)).sum() / pos / neg) if pos and neg else None


_CUSTOM = _draw_sql(f"SELECT * FROM cells, {_REPLICATES}", "n", "'42|' || true_label || '|' || permille || '|' || replicate", "w")


@query("a24_bootstrap_custom", f"""WITH RECURSIVE {PR}, cells AS (SELECT true_label, round(prob_tail * 1000)::INT AS permille, count(*) AS n FROM pr GROUP BY 1, 2), {_steps_sql("SELECT n FROM cells")},
p AS (SELECT replicate, permille, sum(CASE WHEN true_label = 'tail' THEN w ELSE 0 END) AS pos, sum(CASE WHEN true_label <> 'tail' THEN w ELSE 0 END) AS neg FROM ({_CUSTOM}) GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER (PARTITION BY replicate ORDER BY permille DESC) AS tp FROM p)
{_interval_sql("SELECT 'auc' AS metric, sum(neg * (tp - pos / 2)) / sum(pos) / sum(neg) AS value FROM c GROUP BY replicate HAVING sum(pos) > 0 AND sum(neg) > 0")}""")
def a24_custom(spark, d):
    p = predictions(spark, d).select("true_label", F.round(F.col("prob_tail") * 1000).cast("int").alias("permille"))
    return bootstrap.bootstrap_custom(p, weighted_auc, ["true_label", "permille"], 1000, name="auc")


_OOD_DRAWS = _draw_sql(_draw_sql(f"SELECT * FROM points, {_REPLICATES}", "ids", "'42|' || place || '|id|' || replicate", "pos"), "oods", "'42|' || place || '|ood|' || replicate", "neg")
_OOD_VALUES = """SELECT sum(neg * (tp - pos / 2) / np / nn) AS auroc, sum(neg / nn * otp / (otp + ofp)) AS aupr_ood, coalesce(min(fp / nn) FILTER (tp / np >= 0.95), 1.0) AS fpr_at_95tpr
  FROM cv WHERE np > 0 AND nn > 0 GROUP BY replicate"""


@query("a24_bootstrap_ood", f"""WITH RECURSIVE {PR}, points AS (SELECT row_number() OVER (ORDER BY s) - 1 AS place, s, ids, oods FROM (SELECT greatest(prob_ear, prob_tail) AS s, count(*) FILTER (label < 7) AS ids, count(*) FILTER (label >= 7) AS oods FROM pr GROUP BY 1)),
{_steps_sql("SELECT ids AS n FROM points UNION SELECT oods FROM points")}, dr AS ({_OOD_DRAWS}),
cv AS (SELECT replicate, pos, neg, sum(pos) OVER down AS tp, sum(neg) OVER down AS fp, sum(neg) OVER up AS otp, sum(pos) OVER up AS ofp, sum(pos) OVER (PARTITION BY replicate) AS np, sum(neg) OVER (PARTITION BY replicate) AS nn
  FROM dr WHERE pos + neg > 0 WINDOW down AS (PARTITION BY replicate ORDER BY place DESC), up AS (PARTITION BY replicate ORDER BY place)),
v AS ({_OOD_VALUES}) {_interval_sql("UNPIVOT v ON auroc, aupr_ood, fpr_at_95tpr INTO NAME metric VALUE value")}""")
def a24_ood(spark, d):
    return evaluate.bootstrap_ood(sure(spark, d).withColumn("score", F.col("msp")), 1000)


_SWEEP = f"{PR}, g AS (SELECT round(unnest(range(2, 19)) * 0.05::DOUBLE, 6) AS threshold), x AS (SELECT threshold, true_label, CASE WHEN prob_tail >= threshold THEN 'tail' ELSE '' END AS pred_label FROM pr, g), k AS (SELECT threshold, {_CELLS} FROM x GROUP BY threshold)"


@query("a25_threshold_sweep", f"WITH {_SWEEP}, m AS (SELECT threshold, {', '.join(f'round({_BIN[n]}, 6) AS {n}' for n in ('precision_pos', 'recall_pos', 'f1_pos', 'recall_neg', 'f1_neg', 'macro_f1'))}, round({_r('tn', 'tn + fn')}, 6) AS precision_neg FROM k) SELECT *, row_number() OVER (ORDER BY macro_f1 DESC, threshold) = 1 AS best FROM m")
def a25(spark, d):
    return evaluate.threshold_sweep(predictions(spark, d))


@query("a26_selective_curve", f"""WITH {PR}, s AS (SELECT *, greatest(prob_ear, prob_tail) AS msp FROM pr), e AS (SELECT min(msp) AS a, max(msp) AS b, count(*) AS n FROM s), g AS (SELECT i::INT AS step, round(a + (b - a) * i / 19, 9) AS th, n FROM e, (SELECT unnest(range(20)) AS i)),
k AS (SELECT step, th, n, {_CELLS}, count(*) AS kept FROM s, g WHERE msp >= th - 1e-9 GROUP BY step, th, n), q AS (SELECT *, CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN {_BIN['macro_f1']} ELSE (tp + tn) / kept END AS q FROM k)
SELECT step, round(th, 6) AS threshold, round(kept / n, 6) AS coverage, round(q, 6) AS macro_f1, round(1 - q, 6) AS risk FROM q""")
def a26(spark, d):
    return evaluate.selective_curve(sure(spark, d))


def _clips(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.expr("vec_id div 4").alias("event_id"), F.expr("transform(slice(embedding, 1, 3), x -> cast(x as double) * 5)").alias("logits"))


_AGG = "lg AS (SELECT vec_id // 4 AS event_id, unnest(range(3))::INT AS k, embedding[1 + unnest(range(3))]::DOUBLE * 5 AS v, vec_id FROM embeddings)"
_AGG_TAIL = "sm AS (SELECT event_id, k, n_clips, exp(v - max(v) OVER w) AS e FROM ag WINDOW w AS (PARTITION BY event_id)), pb AS (SELECT event_id, k, n_clips, round(e / sum(e) OVER (PARTITION BY event_id), 6) AS prob FROM sm) SELECT event_id, k, prob, n_clips, row_number() OVER (PARTITION BY event_id ORDER BY prob DESC, k) = 1 AS is_top FROM pb"
_AGG_SQL = {
    "mean": f"WITH {_AGG}, ag AS (SELECT event_id, k, avg(v) AS v, count(*) AS n_clips FROM lg GROUP BY ALL), {_AGG_TAIL}",
    "max": f"WITH {_AGG}, ag AS (SELECT event_id, k, max(v) AS v, count(*) AS n_clips FROM lg GROUP BY ALL), {_AGG_TAIL}",
    "softmax_mean": f"WITH {_AGG}, s0 AS (SELECT event_id, k, vec_id, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM lg), s1 AS (SELECT event_id, k, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM s0), ag AS (SELECT event_id, k, ln(avg(p) + 1e-8) AS v, count(*) AS n_clips FROM s1 GROUP BY ALL), {_AGG_TAIL}",
}


def _aggregated(method, spark, d):
    return evaluate.aggregate_clips(_clips(spark, d), method)


for _m, _sql in _AGG_SQL.items():
    Q[f"a27_aggregate_clips_{_m}"] = (partial(_aggregated, _m), _sql)


@query("a28_accuracy_by_class", f"WITH {PR} SELECT true_label AS class, count(*) AS n, round(avg((true_label = pred_label)::INT), 6) AS accuracy FROM pr GROUP BY ROLLUP (true_label)")
def a28(spark, d):
    return evaluate.accuracy_by_class(predictions(spark, d))


def _nll_sql(grid: str) -> str:
    return f"SELECT t, round(avg(-ln(exp(own / t - greatest(logit_ear / t, logit_tail / t)) / (exp(logit_ear / t - greatest(logit_ear / t, logit_tail / t)) + exp(logit_tail / t - greatest(logit_ear / t, logit_tail / t))) + 1e-10)), 6) AS nll FROM (SELECT *, CASE true_label WHEN 'ear' THEN logit_ear ELSE logit_tail END AS own FROM pr), {grid} GROUP BY t"


@query("a29_fit_temperature", f"WITH {PR}, g1 AS (SELECT round(0.1 + 9.9 * i / 49, 6) AS t FROM (SELECT unnest(range(50))::DOUBLE AS i)), n1 AS ({_nll_sql('g1')}), b AS (SELECT t AS b FROM n1 ORDER BY nll, t LIMIT 1), g2 AS (SELECT DISTINCT round(least(10.0, greatest(0.1, b - 0.5 + i / 100.0)), 6) AS t FROM b, (SELECT unnest(range(101))::DOUBLE AS i)), n2 AS ({_nll_sql('g2')}) SELECT t, nll FROM n2 ORDER BY nll, t LIMIT 1")
def a29(spark, d):
    return evaluate.fit_temperature(predictions(spark, d))


def _ece_grid_sql(grid: str) -> str:
    case = " ".join(f"WHEN p > {(b - 1) / 15!r} AND p <= {b / 15!r} THEN {b}" for b in range(1, 16))
    rows = f"SELECT t, round(1 / (1 + exp(-abs(logit_ear - logit_tail) / t)), 6)::DOUBLE AS p, (true_label = CASE WHEN logit_tail > logit_ear THEN 'tail' ELSE 'ear' END)::INT AS hit FROM pr, {grid}"
    return f"SELECT t, round(sum(n * gap) / sum(n), 6) AS ece FROM (SELECT t, CASE {case} END AS bin, count(*) AS n, abs(avg(p) - avg(hit)) AS gap FROM ({rows}) GROUP BY ALL) GROUP BY t"


@query("a29_fit_temperature_ece", f"WITH {PR}, g1 AS (SELECT round(0.1 + 9.9 * i / 49, 6) AS t FROM (SELECT unnest(range(50))::DOUBLE AS i)), n1 AS ({_ece_grid_sql('g1')}), b AS (SELECT t AS b FROM n1 ORDER BY ece, t LIMIT 1), g2 AS (SELECT DISTINCT round(least(10.0, greatest(0.1, b - 0.5 + i / 100.0)), 6) AS t FROM b, (SELECT unnest(range(101))::DOUBLE AS i)), n2 AS ({_ece_grid_sql('g2')}) SELECT t, ece FROM n2 ORDER BY ece, t LIMIT 1")
def a29_ece(spark, d):
    return evaluate.fit_temperature(predictions(spark, d), objective="ece")


@query("a30_class_weights", f"WITH {EV}, c AS (SELECT behavior, count(*) AS n FROM ev GROUP BY 1), w AS (SELECT *, (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, n)) AS w FROM c) SELECT behavior, n, round(w / avg(w) OVER (), 6) AS weight FROM w")
def a30(spark, d):
    return evaluate.class_weights(events(spark, d), "effective")


_SL = ", ".join(f"count(*) FILTER ({c}) AS {n}_n, round(avg(prob_tail) FILTER ({c}), 6) AS {n}_mean, min(prob_tail) FILTER ({c}) AS {n}_min, max(prob_tail) FILTER ({c}) AS {n}_max" for n, c in (("fn", "true_label = 'tail' AND pred_label <> 'tail'"), ("fp", "true_label <> 'tail' AND pred_label = 'tail'")))


@query("a31_error_slices", f"WITH {PR} SELECT {_SL}, count(*) FILTER (true_label = 'tail' AND pred_label <> 'tail' AND prob_tail < 0.3) AS sure_misses, count(*) FILTER (prob_tail > 0.4 AND prob_tail < 0.6) AS boundary FROM pr")
def a31(spark, d):
    return evaluate.error_slices(predictions(spark, d))


@query("a32_range_slices", f"""WITH {PR}, e AS (SELECT min(clip_id) AS a, max(clip_id) AS b FROM pr), s AS (SELECT *, least(floor((clip_id - a) * 5 / (b - a)), 4)::INT AS slice FROM pr, e),
g AS (SELECT slice, count(*) AS n, round({_r("count(*) FILTER (true_label = 'tail' AND pred_label = 'tail')", "count(*) FILTER (true_label = 'tail')")}, 6) AS recall, round(avg((true_label = pred_label)::INT), 6) AS accuracy, avg(prob_tail) AS m FROM s GROUP BY slice)
SELECT slice, n, recall, accuracy, round(m, 6) AS mean_score, stddev_samp(m) OVER () > 0.1 AS spread FROM g""")
def a32(spark, d):
    return evaluate.range_slices(predictions(spark, d))


@query("a33_label_agreement", "SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS tn, count(*) FILTER (toxic = 1 AND quality = 0) AS fp, count(*) FILTER (toxic = 0 AND quality = 1) AS fn, round(count(*) FILTER (toxic = quality) / count(*), 6) AS accuracy FROM labels")
def a33(spark, d):
    return evaluate.label_agreement(table(spark, d, "labels").select((F.col("toxic") == 1).alias("a"), (F.col("quality") == 1).alias("h")), "a", "h")


@query("w12_loss_ranking", f"WITH {PR} SELECT clip_id, round(greatest(logit_ear, logit_tail) + ln(exp(logit_ear - greatest(logit_ear, logit_tail)) + exp(logit_tail - greatest(logit_ear, logit_tail))) - CASE true_label WHEN 'ear' THEN logit_ear ELSE logit_tail END, 6) AS loss, true_label = pred_label AS correct FROM pr ORDER BY loss DESC, clip_id LIMIT 10")
def w12(spark, d):
    return evaluate.loss_ranking(predictions(spark, d))


@query("a13_confound_by", f"WITH {EV}, c AS (SELECT behavior, 'grp' AS \"column\", grp::VARCHAR AS value FROM ev UNION ALL SELECT behavior, 'camera', camera::VARCHAR FROM ev UNION ALL SELECT behavior, 'day', day::VARCHAR FROM ev), g AS (SELECT \"column\", value, count(*) AS n, count(*) FILTER (behavior = 'ear') AS ear, count(*) FILTER (behavior = 'tail') AS tail, count(*) FILTER (behavior = 'tail') / count(*) AS r FROM c GROUP BY 1, 2) SELECT \"column\", value, n, ear, tail, round(r, 6) AS ratio, stddev_pop(r) OVER (PARTITION BY \"column\") > 0.1 AS warned FROM g")
def a13(spark, d):
    return evaluate.confound_by(events(spark, d), ["grp", "camera", "day"])


@query("a14_level_coverage", f"""WITH {EV}, {TH}, c AS (SELECT split, behavior, 'video' AS "column", video AS value FROM sp WHERE grp <> 2 OR split = 'val' UNION ALL SELECT split, behavior, 'grp', grp::VARCHAR FROM sp WHERE grp <> 2 OR split = 'val'),
g AS (SELECT "column", value, bool_or(split = 'train') AS t, bool_or(split = 'val') AS v, count(*) FILTER (split = 'val' AND behavior = 'tail') AS n FROM c WHERE split <> 'test' GROUP BY 1, 2)
SELECT "column", count(*) FILTER (t AND NOT v) AS only_train, count(*) FILTER (v AND NOT t) AS only_val, count(*) FILTER (t AND v) AS both, coalesce(sum(n) FILTER (v AND NOT t), 0)::BIGINT AS uncovered FROM g GROUP BY 1""")
def a14(spark, d):
    s = three(spark, d)
    return evaluate.level_coverage(s["train"].where("grp <> 2"), s["val"], ["video", "grp"])


@query("a15_video_purity", f"WITH {EV}, p AS (SELECT video || '/' || day AS video, count(*) AS n, count(*) FILTER (behavior = 'ear') AS e, count(*) FILTER (behavior = 'tail') AS t FROM ev GROUP BY 1) SELECT CASE WHEN e > 0 AND t > 0 THEN 'both' WHEN e > 0 THEN 'ear_only' WHEN t > 0 THEN 'tail_only' ELSE 'neither' END AS kind, count(*) AS videos, sum(n)::BIGINT AS events, count(*) FILTER (n > 5) AS heavy FROM p GROUP BY 1")
def a15(spark, d):
    return evaluate.video_purity(events(spark, d).withColumn("video", F.concat_ws("/", "video", "day")))


@query("a16_prob_clusters", f"WITH {PR} SELECT round_even(prob_tail, 2) AS value, count(*) AS n, count(*) FILTER (true_label = 'tail') AS positives FROM pr GROUP BY 1 HAVING count(*) >= 3")
def a16(spark, d):
    return evaluate.prob_clusters(predictions(spark, d), 3, digits=2)


@query("a36_error_breakdown", f"WITH {PR} SELECT true_label, label, count(*) AS n, count(*) FILTER (true_label <> pred_label) AS errors FROM pr GROUP BY CUBE (true_label, label)")
def a36(spark, d):
    return evaluate.error_breakdown(predictions(spark, d), ["true_label", "label"])


def _part_sql(section: str, sql: str, keys: tuple[str, ...] = (), known: bool = False) -> str:
    """SQL of a section of the report from the SQL of its table; known: of the rows that aren't OOD."""
    sql = sql.replace(PR, PR.replace("FROM embeddings)", "FROM embeddings WHERE label < 7)")) if known else sql
    item = "concat_ws('|', " + ", ".join(f"{k}::VARCHAR" for k in keys) + ")" if keys else "''"
    plain = f"SELECT {item} AS item, COLUMNS(* EXCLUDE ({', '.join(keys)}))::DOUBLE FROM ({sql})" if keys else f"SELECT '' AS item, COLUMNS(*)::DOUBLE FROM ({sql})"
    return f"SELECT '{section}' AS section, item, metric, value FROM (UNPIVOT ({plain}) ON COLUMNS(* EXCLUDE (item)) INTO NAME metric VALUE value)"


def _report_sql() -> str:
    of = lambda name: Q[name][1]
    return " UNION ALL ".join([
        _part_sql("binary", _BINARY, known=True), _part_sql("curve", _CURVE_METRICS, known=True), _part_sql("calibration", of("a20_ece_positive"), known=True),
        _part_sql("confusion", f"SELECT true_label, pred_label, n FROM ({of('a17_confusion_matrix')})", ("true_label", "pred_label"), True),
        _part_sql("bootstrap", _CI_COUNTED, ("metric",), True), _part_sql("ood", of("a22_ood_metrics")), _part_sql("ood_bootstrap", of("a24_bootstrap_ood"), ("metric",)),
        _part_sql("ood_breakdown", of("a23_ood_breakdown"), ("label",)), _part_sql("selective", of("a26_selective_curve"), ("step",), True),
    ])


@query("a37_report_rows", _report_sql())
def a37_rows(spark, d):
    return evaluate.report_rows(sure(spark, d), replicates=1000)


@query("a37_evaluate_report", None)
def a37(spark, d):
    return evaluate.evaluate_report(sure(spark, d), replicates=1000)


@query("v9_abstain_curve", f"WITH {PR}, g AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold), x AS (SELECT threshold, greatest(prob_ear, prob_tail) >= threshold AS k, true_label = pred_label AS c FROM pr, g) SELECT threshold, round(count(*) FILTER (k) / count(*), 6) AS coverage, round(count(*) FILTER (k AND c) / nullif(count(*) FILTER (k), 0), 6) AS accuracy FROM x GROUP BY threshold")
def v9(spark, d):
    return evaluate.abstain_curve(sure(spark, d))


def _intervals(spark, d):
    e = events(spark, d)
    truth = e.where("behavior = 'tail'").select("video", F.col("event_idx").alias("truth_id"), "start_sec", (F.col("start_sec") + 40 * F.col("duration_sec")).alias("end_sec"))
    preds = e.where("behavior = 'ear'").select("video", F.col("event_idx").alias("pred_id"), "start_sec", (F.col("start_sec") + 40 * F.col("duration_sec")).alias("end_sec"), F.col("duration_sec").alias("score"))
    return preds, truth


_IV = f"""{EV}, tr AS (SELECT video, event_idx AS truth_id, start_sec AS s, start_sec + 40 * duration_sec AS e FROM ev WHERE behavior = 'tail'), pd AS (SELECT video, event_idx AS pred_id, start_sec AS s, start_sec + 40 * duration_sec AS e, duration_sec AS score FROM ev WHERE behavior = 'ear'),
ov AS (SELECT pred_id, truth_id, score, round((least(p.e, t.e) - greatest(p.s, t.s)) / (greatest(p.e, t.e) - least(p.s, t.s)), 6) AS tiou FROM pd p JOIN tr t USING (video) WHERE least(p.e, t.e) > greatest(p.s, t.s)),
bs AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY pred_id ORDER BY tiou DESC, truth_id) = 1)"""


@query("j19_match_by_tiou", f"WITH {_IV} SELECT pred_id, truth_id, tiou, tiou >= 0.1 AND row_number() OVER (PARTITION BY truth_id ORDER BY score DESC, pred_id) = 1 AS is_match FROM bs")
def j19(spark, d):
    return evaluate.match_by_tiou(*_intervals(spark, d), 0.1)


def _ap_sql(iou: float) -> str:
    return f"""SELECT {iou}::DOUBLE AS iou, round(coalesce(sum(pos * tp / (tp + fp)), 0.0) / (SELECT count(*) FROM tr), 6) AS average_precision FROM (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM
  (SELECT score, count(*) FILTER (m) AS pos, count(*) FILTER (NOT m) AS neg FROM (SELECT pd.score, pd.pred_id IN (SELECT pred_id FROM (SELECT pred_id, tiou >= {iou} AND row_number() OVER (PARTITION BY truth_id ORDER BY score DESC, pred_id) = 1 AS m FROM bs) WHERE m) AS m FROM pd) GROUP BY score))"""


@query("a35_map_at_tiou", f"WITH {_IV} {_ap_sql(0.1)} UNION ALL {_ap_sql(0.3)}")
def a35(spark, d):
    return evaluate.map_at_tiou(*_intervals(spark, d), ious=(0.1, 0.3))


@query("j18_pair_tubes", f"WITH {EV}, t AS (SELECT day AS video, (event_idx % 12)::INT AS track, (event_idx // 12) % 40 AS frame, duration_sec AS x, (event_idx * 37) % 400 AS y FROM ev) SELECT a.video, a.track AS a, b.track AS b, count(DISTINCT a.frame) AS frames FROM t a JOIN t b USING (video, frame) WHERE a.track < b.track AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 22500 GROUP BY ALL HAVING count(DISTINCT a.frame) >= 5")
def j18(spark, d):
    t = events(spark, d).select(F.col("day").alias("video"), F.expr("cast(event_idx % 12 as int)").alias("track"), F.expr("(event_idx div 12) % 40").alias("frame"), F.col("duration_sec").alias("x"), F.expr("(event_idx * 37) % 400").alias("y"))
    return runs.pair_tubes(t)


# --- runs -------------------------------------------------------------------------------------------------------------


def history(spark, d):
    """Orders as training histories: a priority is a run, a month an epoch, sums of prices are losses and metrics."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), F.expr("(year(o_orderdate) - 1995) * 12 + month(o_orderdate)").alias("epoch"), "o_totalprice", "o_orderstatus")
    share = lambda s: F.round(F.count_if(F.col("o_orderstatus") == s) / F.count("*"), 6)
    return o.groupBy("run", "epoch").agg(F.round(F.avg("o_totalprice") / 250000, 6).alias("val_loss"), F.round(F.min("o_totalprice") / 2000, 6).alias("train_loss"), share("O").alias("val_metric"), share("P").alias("val_recall"), share("F").alias("train_acc"), share("P").alias("val_acc"))


HS = "hs AS (SELECT o_orderpriority AS run, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate))::INT AS epoch, round(avg(o_totalprice) / 250000, 6) AS val_loss, round(min(o_totalprice) / 2000, 6) AS train_loss, round(count(*) FILTER (o_orderstatus = 'O') / count(*), 6) AS val_metric, round(count(*) FILTER (o_orderstatus = 'P') / count(*), 6) AS val_recall, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS train_acc, round(count(*) FILTER (o_orderstatus = 'P') / count(*), 6) AS val_acc FROM orders GROUP BY 1, 2)"


@query("w9_overfit_monitor", f"""WITH RECURSIVE {HS}, u AS (SELECT *, coalesce(val_loss > lag(val_loss) OVER w AND lag(val_loss) OVER w > lag(val_loss, 2) OVER w, false) AS up FROM hs WINDOW w AS (PARTITION BY run ORDER BY epoch)),
b AS (SELECT *, coalesce(val_loss < min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS nw FROM u WHERE epoch >= 3), c AS (SELECT *, sum(nw::INT) OVER (PARTITION BY run ORDER BY epoch) AS blk FROM b),
s AS (SELECT *, row_number() OVER (PARTITION BY run, blk ORDER BY epoch) - 1 AS since_best, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM c),
g AS (SELECT *, (val_loss - train_loss > 0.3)::INT + up::INT + (train_acc - val_acc > 0.15)::INT + (since_best >= 5)::INT AS issues FROM s),
f(run, i, counter) AS (SELECT run, i, CASE WHEN issues >= 2 THEN 1 ELSE 0 END FROM g WHERE i = 1 UNION ALL SELECT g.run, g.i, CASE WHEN g.issues >= 2 THEN f.counter + 1 ELSE greatest(0, f.counter - 1) END FROM f JOIN g ON g.run = f.run AND g.i = f.i + 1)
SELECT g.run, g.epoch, issues, CASE WHEN issues >= 3 THEN 'severe' WHEN issues = 2 THEN 'moderate' WHEN issues = 1 THEN 'mild' ELSE 'none' END AS severity, counter, since_best, CASE WHEN counter > 3 THEN 'overfitting' ELSE 'normal' END AS verdict FROM g JOIN f ON g.run = f.run AND g.i = f.i""")
def w9(spark, d):
    return runs.overfit_monitor(history(spark, d))


@query("w10_early_stop", f"""WITH RECURSIVE {HS}, n AS (SELECT run, epoch, val_metric AS m, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM hs),
f(run, i, epoch, level, waited) AS (SELECT run, i, epoch, m, 0 FROM n WHERE i = 1 UNION ALL SELECT n.run, n.i, n.epoch, CASE WHEN n.m > f.level + 0.001 THEN n.m ELSE f.level END, CASE WHEN n.m > f.level + 0.001 THEN 0 ELSE f.waited + 1 END FROM f JOIN n ON n.run = f.run AND n.i = f.i + 1 WHERE f.waited < 15),
e AS (SELECT run, max(epoch) AS stop_epoch, max(waited) >= 15 AS stopped FROM f GROUP BY run)
SELECT e.run, arg_max(hs.epoch, (val_metric, -hs.epoch))::BIGINT AS best_epoch, max(val_metric) AS best_metric, any_value(stop_epoch)::BIGINT AS stop_epoch, any_value(stopped) AS stopped FROM e JOIN hs ON hs.run = e.run AND hs.epoch <= e.stop_epoch GROUP BY e.run""")
def w10(spark, d):
    return runs.early_stop(history(spark, d))


@query("w11_collapse_streak", f"WITH {HS}, l AS (SELECT *, (val_recall < 0.3)::INT AS lo FROM hs), b AS (SELECT *, sum(1 - lo) OVER (PARTITION BY run ORDER BY epoch) AS blk FROM l), s AS (SELECT run, epoch, sum(lo) OVER (PARTITION BY run, blk ORDER BY epoch)::BIGINT AS streak FROM b) SELECT run, epoch, streak, streak >= 3 AS warned FROM s")
def w11(spark, d):
    return runs.collapse_streak(history(spark, d), least=0.3)


@query("a34_run_leaderboard", f"WITH {HS}, r AS (SELECT run, max(val_metric) AS best, arg_max(val_metric, epoch) AS final, count(*) AS epochs FROM hs GROUP BY run) SELECT run, round(best, 6) AS best, round(final, 6) AS final, epochs, round(best - (SELECT best FROM r WHERE lower(run) LIKE '%low%' ORDER BY run LIMIT 1), 6) AS delta, row_number() OVER (ORDER BY best DESC, run) AS place FROM r")
def a34(spark, d):
    return runs.run_leaderboard(history(spark, d), "low")


