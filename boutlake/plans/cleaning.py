"""Registered queries of cleaning, audits of labels, sessions and durations, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, sessions
from .bindings import EV, events, table

Q: dict[str, tuple] = {}

#: Rules for the driver tables, in the form that a rule file has.
TYPES = {"click": "press", "view": "look", "error": "fault", "purchase": "buy"}
PRIORITIES = [("top", ["urgent", "high"]), ("low", ["low"]), ("mid", ["medium"])]
SOURCES = {f"src{i}": ("web" if i % 2 else "book") for i in range(6)}
RANGES = [(10, 40), (60, 80)]


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


_TYPE_SQL = "coalesce(CASE lower(trim({0})) WHEN 'click' THEN 'press' WHEN 'view' THEN 'look' WHEN 'error' THEN 'fault' WHEN 'purchase' THEN 'buy' END, lower(trim({0})), 'unknown')"


@query("p1_normalize_label", f"WITH {EV} SELECT event_idx, {_TYPE_SQL.format('event_type')} AS label FROM ev")
def p1(spark, d):
    return events(spark, d).select("event_idx", clean.normalize_label(F.col("event_type"), TYPES).alias("label"))


@query("p2_normalize_by_substring", "SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%urgent%' OR lower(o_orderpriority) LIKE '%high%' THEN 'top' WHEN lower(o_orderpriority) LIKE '%low%' THEN 'low' WHEN lower(o_orderpriority) LIKE '%medium%' THEN 'mid' ELSE 'unknown' END AS role FROM orders")
def p2(spark, d):
    return table(spark, d, "orders").select("o_orderkey", clean.normalize_by_substring(F.col("o_orderpriority"), PRIORITIES).alias("role"))


@query("p3_normalize_location", "SELECT doc_id, CASE WHEN source IN ('src0', 'src2', 'src4') THEN 'book' WHEN source IN ('src1', 'src3', 'src5') THEN 'web' ELSE lower(trim(source)) END AS place FROM documents")
def p3(spark, d):
    return table(spark, d, "documents").select("doc_id", clean.normalize_label(F.col("source"), SOURCES).alias("place"))


_DUR_SQL = "CASE WHEN duration_sec IS NULL THEN 'missing' WHEN duration_sec < 1 THEN 'below_min' WHEN duration_sec > 300 THEN 'above_max' WHEN duration_sec > 120 THEN 'above_threshold' END"
_ID_SQL = "CASE WHEN animal_id IS NULL THEN 'missing' WHEN try_cast(animal_id AS BIGINT) IS NULL THEN 'invalid_format' WHEN NOT (animal_id::BIGINT BETWEEN 10 AND 40 OR animal_id::BIGINT BETWEEN 60 AND 80) THEN 'outside_range' END"


@query("p4_flag_duration", f"WITH {EV} SELECT event_idx, {_DUR_SQL} AS flag FROM ev")
def p4(spark, d):
    return events(spark, d).select("event_idx", clean.flag_duration(F.col("duration_sec"), 1, 120, 300).alias("flag"))


@query("p5_flag_id", f"WITH {EV} SELECT event_idx, {_ID_SQL} AS flag FROM ev")
def p5(spark, d):
    return events(spark, d).select("event_idx", clean.flag_id(F.col("animal_id"), RANGES).alias("flag"))


_QA_SQL = f"qa AS (SELECT event_idx, concat_ws('|', {_DUR_SQL}, 'initiator_' || {_ID_SQL}) AS flags FROM ev WHERE coalesce({_DUR_SQL}, {_ID_SQL}) IS NOT NULL)"


def _qa(spark, d):
    e = events(spark, d)
    return clean.qa_flags(e, {"": clean.flag_duration(F.col("duration_sec"), 1, 120, 300), "initiator": clean.flag_id(F.col("animal_id"), RANGES)}, "event_idx")


Q["p6_qa_flags"] = (_qa, f"WITH {EV}, {_QA_SQL} SELECT event_idx, flags FROM qa")


@query("a2_flag_counts", f"WITH {EV}, {_QA_SQL} SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, '|')) AS flag FROM qa) GROUP BY flag ORDER BY n DESC, flag LIMIT 10")
def a2(spark, d):
    return clean.flag_counts(_qa(spark, d))


#: How an order's date is written, by o_orderkey % 8: the six formats (a day up to 12 is taken for a month), and two that fit none.
_WRITTEN = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yy", "M/d/yyyy", "d/M/yy", "d/M/yyyy", "yyyy/MM/dd", "'day 'D")


@query("p7_parse_date_multi", """WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, CASE WHEN k = 6 THEN strftime(d, '%Y/%m/%d') WHEN k = 7 THEN 'day ' || dayofyear(d)
  WHEN k IN (4, 5) AND day(d) <= 12 THEN strftime(make_date(year(d), day(d), month(d)), '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END AS date FROM o""")
def p7(spark, d):
    said = F.lit(None).cast("string")
    for k, form in enumerate(_WRITTEN):
        said = F.when(F.col("o_orderkey") % 8 == k, F.concat(F.lit(" "), F.date_format("o_orderdate", form))).otherwise(said)
    return table(spark, d, "orders").select("o_orderkey", clean.parse_date_multi(said).alias("date"))


@query("p8_normalize_time", f"WITH {EV} SELECT event_idx, CASE WHEN event_idx % 2 = 0 THEN strftime(ts, '%H:%M') || ':00' ELSE strftime(ts, '%H:%M:%S') END AS time FROM ev")
def p8(spark, d):
    said = F.when(F.col("event_idx") % 2 == 0, F.date_format("ts", "HH:mm")).otherwise(F.date_format("ts", "HH:mm:ss"))
    return events(spark, d).select("event_idx", clean.normalize_time(said).alias("time"))


@query("p10_collapse_labels", f"WITH {EV} SELECT event_idx, CASE WHEN event_type IN ('click', 'error') THEN event_type ELSE 'other' END AS label FROM ev")
def p10(spark, d):
    return events(spark, d).select("event_idx", clean.collapse_labels(F.col("event_type"), ["click", "error"]).alias("label"))


@query("p11_derive_primary_label", f"WITH {EV} SELECT event_idx, coalesce(CASE event_type WHEN 'click' THEN 'press' WHEN 'view' THEN 'look' WHEN 'error' THEN 'fault' WHEN 'purchase' THEN 'buy' END, 'unknown') AS label FROM ev")
def p11(spark, d):
    return events(spark, d).select("event_idx", clean.derive_primary_label(F.col("event_type"), TYPES).alias("label"))


@query("p12_filter_classes", f"WITH {EV} SELECT event_idx, behavior FROM ev WHERE behavior IN ('ear', 'tail')")
def p12(spark, d):
    return clean.filter_classes(events(spark, d), "behavior", ["ear", "tail"]).select("event_idx", "behavior")


@query("p13_remap_paths", "SELECT page_id, replace(replace(url, 'http://', '/web/'), 'https://', '/web/') AS path FROM pages")
def p13(spark, d):
    return clean.remap_paths(table(spark, d, "pages"), ["file_path", "url"], [("http://", "/web/"), ("https://", "/web/")]).select("page_id", "path")


@query("p14_drop_resource_forks", "SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def p14(spark, d):
    named = table(spark, d, "pages").withColumn("file", F.concat(F.when(F.col("page_id") % 3 == 0, "._").otherwise(""), F.lit("f"), F.col("page_id").cast("string")))
    return clean.drop_resource_forks(named, "file").select("page_id")


@query("p15_video_key", "SELECT page_id, lower(url) AS path_key, regexp_extract(lower(url), '([^/]*)/*$', 1) AS base_key, CASE WHEN ends_with(lower(url), 'p' || page_id || '.mp4') THEN lower(url) ELSE rtrim(lower(url), '/') || '/p' || page_id || '.mp4' END AS joined_key FROM pages")
def p15(spark, d):
    p = table(spark, d, "pages").withColumn("file", F.concat(F.lit("P"), F.col("page_id").cast("string"), F.lit(".MP4")))
    return p.select("page_id", clean.video_key(p, "url").alias("path_key"), clean.video_key(p, "url", variant="base").alias("base_key"), clean.video_key(p, "url", "file", "joined").alias("joined_key"))


@query("p16_parse_external_sheet", "SELECT 'c' || doc_id || '.mp4' AS video, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ours, list_concat(CASE WHEN toxic = 1 THEN ['toxic'] ELSE [] END, CASE WHEN quality = 1 THEN ['quality'] ELSE [] END) AS labels FROM labels WHERE doc_id % 7 <> 0")
def p16(spark, d):
    sheet = table(spark, d, "labels").select(
        F.when(F.col("doc_id") % 7 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit(".mp4"))).alias("Video"),
        F.element_at(F.array(F.lit("Y"), F.lit("no"), F.lit("?")), (F.col("doc_id") % 3 + 1).cast("int")).alias("Our Video?"), "toxic", "quality",
    )
    return clean.parse_external_sheet(sheet, "Video", "Our Video?", ["toxic", "quality"], [".mp4", ".mov"])


@query("p17_onehot_invalid_cells", "SELECT doc_id, 'quality' AS \"column\", (quality + 1)::VARCHAR AS value FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic', (toxic * 3)::VARCHAR FROM labels WHERE toxic = 1")
def p17(spark, d):
    sheet = table(spark, d, "labels").select("doc_id", (F.col("quality") + 1).alias("quality"), (F.col("toxic") * 3).alias("toxic")).withColumn("quality", F.when(F.col("quality") == 2, 2).otherwise(1))
    return clean.onehot_invalid_cells(sheet, "doc_id", ["quality", "toxic"])


@query("a0_label_distribution", f"WITH {EV}, c AS (SELECT 'behavior' AS \"column\", behavior AS value FROM ev UNION ALL SELECT 'grp', grp::VARCHAR FROM ev) SELECT \"column\", value, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY \"column\"), 4) AS percent FROM c GROUP BY 1, 2")
def a0(spark, d):
    return clean.label_distribution(events(spark, d), ["behavior", "grp"])


@query("a1_cleaning_audit", f"WITH {EV}, {_QA_SQL} SELECT count(*) AS rows, count(*) FILTER (coalesce(lower(event_type), 'nan') <> {_TYPE_SQL.format('event_type')}) AS event_type_changes, (SELECT count(*) FROM qa) AS flagged FROM ev")
def a1(spark, d):
    return clean.cleaning_audit(events(spark, d), {"event_type": (F.col("event_type"), clean.normalize_label(F.col("event_type"), TYPES))}, _qa(spark, d))


@query("a3_null_profile", f"WITH {EV}, n AS (SELECT nullif(behavior, 'other') AS behavior, nullif(grp, 0) AS grp, duration_sec FROM ev) SELECT 'behavior' AS \"column\", count(*) - count(behavior) AS nulls FROM n UNION ALL SELECT 'grp', count(*) - count(grp) FROM n UNION ALL SELECT 'duration_sec', count(*) - count(duration_sec) FROM n")
def a3(spark, d):
    return clean.null_profile(events(spark, d).select(F.expr("nullif(behavior, 'other')").alias("behavior"), F.expr("nullif(grp, 0)").alias("grp"), "duration_sec"))


@query("a4_crosstab", f"WITH {EV} SELECT grp::VARCHAR AS grp, behavior, count(*) AS n FROM ev GROUP BY CUBE (grp, behavior)")
def a4(spark, d):
    return clean.crosstab(events(spark, d), "grp", "behavior")


# --- sessions -------------------------------------------------------------------------------------------------------

#: Seconds between bouts on the driver's events.
GAP = 21_600.0

BOUTS_SQL = f"""{EV}, fl AS (SELECT *, CASE WHEN start_sec - lag(start_sec + duration_sec) OVER (PARTITION BY video ORDER BY start_sec, event_idx) > {GAP} THEN 1 ELSE 0 END AS opens FROM ev),
bt AS (SELECT * EXCLUDE (opens), video || '__bout_' || (1 + sum(opens) OVER (PARTITION BY video ORDER BY start_sec, event_idx ROWS UNBOUNDED PRECEDING))::BIGINT AS bout_id FROM fl)"""


def bouts(spark, d):
    return sessions.assign_bouts(events(spark, d), GAP)


@query("w1_assign_bouts", f"WITH {BOUTS_SQL} SELECT event_idx, bout_id FROM bt")
def w1(spark, d):
    return bouts(spark, d).select("event_idx", "bout_id")


@query("a10_bout_summary", f"WITH {BOUTS_SQL} SELECT bout_id, video, count(*) AS n_events, count(*) FILTER (behavior = 'tail') AS n_tail, bool_or(behavior = 'tail') AS has_tail FROM bt GROUP BY bout_id, video")
def a10(spark, d):
    return sessions.bout_summary(bouts(spark, d))


_GAPS_SQL = f"{EV}, g AS (SELECT video, event_idx, start_sec - lag(start_sec + duration_sec) OVER (PARTITION BY video ORDER BY start_sec, event_idx) AS gap FROM ev)"


@query("w2_inter_event_gaps", f"WITH {_GAPS_SQL} SELECT count(gap) AS n_gaps, round(avg(gap), 6) AS mean_gap, round(quantile_cont(gap, 0.5), 6) AS median_gap, round(min(gap), 6) AS min_gap, round(max(gap), 6) AS max_gap, count(*) FILTER (gap < 0) AS overlaps, count(*) FILTER (gap < 5) AS clusters FROM g WHERE gap IS NOT NULL")
def w2(spark, d):
    return sessions.gap_profile(events(spark, d))


@query("w2_gap_bins", f"WITH {_GAPS_SQL} SELECT CASE WHEN gap < 0 THEN 'overlap' WHEN gap < 5 THEN '0-5s' WHEN gap < 10 THEN '5-10s' WHEN gap < 30 THEN '10-30s' WHEN gap < 60 THEN '30-60s' WHEN gap < 300 THEN '1-5min' ELSE '5min+' END AS bin, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1")
def w2_bins(spark, d):
    return sessions.gap_bins(events(spark, d))


@query("w3_overlapping_pairs", f"WITH {EV}, o AS (SELECT video, event_idx, lead(event_idx) OVER w AS next_idx, start_sec + duration_sec - lead(start_sec) OVER w AS overlap_sec FROM ev WINDOW w AS (PARTITION BY video ORDER BY start_sec, event_idx)) SELECT video, event_idx, next_idx, round(overlap_sec, 6) AS overlap_sec FROM o WHERE overlap_sec > 0")
def w3(spark, d):
    return sessions.overlapping_pairs(events(spark, d)).withColumn("overlap_sec", F.round("overlap_sec", 6))


@query("w4_duplicate_events", f"WITH {EV} SELECT event_idx, video, duration_sec FROM ev QUALIFY count(*) OVER (PARTITION BY video, behavior, duration_sec) > 1")
def w4(spark, d):
    return sessions.duplicate_events(events(spark, d), ["video", "behavior", "duration_sec"]).select("event_idx", "video", "duration_sec")


@query("w5_duplicate_rows", f"WITH {EV} SELECT (count(*) - count(DISTINCT (video, behavior, duration_sec))) AS duplicates FROM ev")
def w5(spark, d):
    return sessions.duplicate_rows(events(spark, d), ["video", "behavior", "duration_sec"])


@query("w6_dedupe_first", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def w6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    return sessions.dedupe_first(docs, ["h"], ["doc_id"]).select("doc_id", "source")


@query("w8_max_event_gaps", f"WITH {EV}, o AS (SELECT min(event_idx) AS first, max(event_idx) AS last, count(DISTINCT event_idx) AS n FROM ev WHERE behavior = 'tail') SELECT first, last, n, round(1 - n / (last - first + 1), 6) AS missing_share, 1 - n / (last - first + 1) < 0.3 AS clustered FROM o")
def w8(spark, d):
    return sessions.max_event_gaps(events(spark, d))


@query("a6_duration_profile", f"WITH {EV} SELECT count(duration_sec) AS n, count(*) FILTER (duration_sec = 0) AS zeros, round(avg(duration_sec), 6) AS mean, round(quantile_cont(duration_sec, 0.5), 6) AS median, round(stddev_samp(duration_sec), 6) AS std, round(min(duration_sec), 6) AS min, round(max(duration_sec), 6) AS max, round(quantile_cont(duration_sec, 0.25), 6) AS p25, round(quantile_cont(duration_sec, 0.75), 6) AS p75, round(quantile_cont(duration_sec, 0.9), 6) AS p90, round(quantile_cont(duration_sec, 0.95), 6) AS p95 FROM ev")
def a6(spark, d):
    return sessions.duration_profile(events(spark, d))


@query("a6_duration_bins", f"WITH {EV} SELECT CASE WHEN duration_sec < 1 THEN '0-1s' WHEN duration_sec < 3 THEN '1-3s' WHEN duration_sec < 5 THEN '3-5s' WHEN duration_sec < 10 THEN '5-10s' WHEN duration_sec < 30 THEN '10-30s' WHEN duration_sec < 60 THEN '30-60s' ELSE '60s+' END AS bin, count(*) AS n FROM ev GROUP BY 1")
def a6_bins(spark, d):
    return sessions.duration_bins(events(spark, d))


@query("a6_duration_by_label", f"WITH {EV} SELECT behavior, count(*) AS n, round(avg(duration_sec), 6) AS mean, round(quantile_cont(duration_sec, 0.5), 6) AS median FROM ev GROUP BY behavior")
def a6_label(spark, d):
    return sessions.duration_by_label(events(spark, d))


@query("a7_events_per_video", f"WITH {EV}, c AS (SELECT count(*) AS n FROM ev GROUP BY video) SELECT CASE WHEN n < 2 THEN '1' WHEN n < 3 THEN '2' WHEN n < 5 THEN '3-4' WHEN n < 10 THEN '5-9' WHEN n < 20 THEN '10-19' ELSE '20+' END AS bin, count(*) AS videos FROM c GROUP BY 1")
def a7(spark, d):
    return sessions.events_per_video(events(spark, d))


@query("a8_coverage", f"WITH {EV} SELECT grp, count(DISTINCT video) AS videos, count(*) AS events FROM ev GROUP BY grp")
def a8(spark, d):
    return sessions.coverage(events(spark, d))


MODE_SQL = "md AS (SELECT video, behavior AS mode_label FROM (SELECT video, behavior, count(*) AS n FROM ev GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY video ORDER BY n DESC, behavior) = 1)"


@query("a9_mode_label", f"WITH {EV}, {MODE_SQL} SELECT video, mode_label FROM md")
def a9(spark, d):
    return sessions.mode_label(events(spark, d))
