"""Registered queries of splits, balancing and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions, splits
from .bindings import EV, events
from .cleaning import BOUTS_SQL, MODE_SQL, bouts


Q: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def _quota_sql(items: str, stratum: str, key: str, val: float, least: int) -> str:
    return f"""cn AS (SELECT video, {stratum} AS st, count(*) AS n FROM {items} GROUP BY ALL),
c2 AS (SELECT *, sum(n) OVER (PARTITION BY video)::BIGINT AS al, count(*) OVER (PARTITION BY video) AS strata, min(n) OVER (PARTITION BY video) AS smallest FROM cn),
c3 AS (SELECT *, n * ceil(round(al * {val}, 9)) / al AS exact, ceil(round(al * {val}, 9)) AS goal FROM c2),
c4 AS (SELECT *, goal - sum(floor(exact)) OVER (PARTITION BY video) AS lft, row_number() OVER (PARTITION BY video ORDER BY round(floor(exact) - exact, 9), st) AS br FROM c3),
c5 AS (SELECT video, st, al, strata > 1 AND smallest >= 2 AS stratified, floor(exact) + CASE WHEN br <= lft THEN 1 ELSE 0 END AS quota FROM c4),
rk AS (SELECT i.{key}, c5.*, row_number() OVER (PARTITION BY i.video, c5.st ORDER BY md5('42|' || i.video || '|' || i.{key}), i.{key}) AS r1,
  row_number() OVER (PARTITION BY i.video ORDER BY md5('42|' || i.video || '|' || i.{key}), i.{key}) AS r2 FROM {items} i JOIN c5 ON i.video = c5.video AND i.{stratum} = c5.st)
SELECT {key}, CASE WHEN al < {least} THEN 'train' WHEN stratified THEN CASE WHEN r1 <= quota THEN 'val' ELSE 'train' END WHEN r2 <= greatest(1, floor(round(al * {val}, 9))) THEN 'val' ELSE 'train' END AS split FROM rk"""


@query("b1_split_bouts", f"WITH {BOUTS_SQL}, bo AS (SELECT video, bout_id, bool_or(behavior = 'tail') AS has FROM bt GROUP BY ALL), {_quota_sql('bo', 'has', 'bout_id', 0.15, 2)}")
def b1(spark, d):
    return splits.split_bouts(bouts(spark, d))


@query("b2_split_events_intravideo", f"WITH {EV}, {_quota_sql('ev', 'behavior', 'event_idx', 0.2, 3)}")
def b2(spark, d):
    return splits.split_events_intravideo(events(spark, d))


@query("b3_split_videos", f"""WITH {EV}, {MODE_SQL}, r AS (SELECT video, count(*) OVER (PARTITION BY mode_label) AS n, row_number() OVER (PARTITION BY mode_label ORDER BY md5('42|' || video), video) AS rk FROM md),
q AS (SELECT video, rk, least(round_even(n * 0.1, 0), n - 1) AS nt, n FROM r), s AS (SELECT *, least(round_even(n * 0.1, 0), n - 1 - nt) AS nv FROM q)
SELECT video, CASE WHEN rk <= nt THEN 'test' WHEN rk <= nt + nv THEN 'val' ELSE 'train' END AS split FROM s""")
def b3(spark, d):
    return splits.split_videos(sessions.mode_label(events(spark, d)))


@query("b4_holdout_groups", f"WITH {EV} SELECT event_idx, CASE WHEN grp IN (4, 5) THEN 'ood' ELSE 'dev' END AS split FROM ev")
def b4(spark, d):
    return splits.holdout_groups(events(spark, d), [4, 5]).select("event_idx", "split")


@query("b5_oversample", f"""WITH {EV}, n AS (SELECT count(*) FILTER (behavior = 'ear') AS mj, count(*) FILTER (behavior = 'tail') AS mn FROM ev),
x AS (SELECT mn, greatest(0, floor(round((0.5 * mj - mn * 0.5) / 0.5, 9)))::INT AS extra FROM n), dr AS (SELECT unnest(range(1, extra + 1))::INT AS draw_no, mn FROM x),
pl AS (SELECT draw_no, floor(('0x' || substr(md5('42|' || draw_no), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 * mn)::INT AS p FROM dr), nm AS (SELECT event_idx, row_number() OVER (ORDER BY event_idx) - 1 AS p FROM ev WHERE behavior = 'tail')
SELECT event_idx, 0 AS draw_no FROM ev UNION ALL SELECT event_idx, draw_no FROM nm JOIN pl USING (p)""")
def b5(spark, d):
    return splits.oversample(events(spark, d), 0.5).select("event_idx", "draw_no")


@query("b6_sample_weights", f"WITH {EV} SELECT event_idx, round(1.0::DOUBLE / count(*) OVER (PARTITION BY behavior), 9) AS weight FROM ev")
def b6(spark, d):
    return splits.sample_weights(events(spark, d)).select("event_idx", F.round("weight", 9).alias("weight"))


@query("b6_weighted_draw", f"""WITH {EV}, w AS (SELECT event_idx, 1.0::DOUBLE / count(*) OVER (PARTITION BY behavior) AS weight FROM ev)
SELECT event_idx FROM w ORDER BY round(-ln(greatest(('0x' || substr(md5('42|' || event_idx), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0, 1e-12)) / weight, 6), event_idx LIMIT 500""")
def b6_draw(spark, d):
    return splits.weighted_draw(splits.sample_weights(events(spark, d)), 500).select("event_idx")


@query("b7_move_minority_videos", f"""WITH {EV}, c AS (SELECT video, count(*) AS n FROM ev WHERE behavior = 'tail' AND grp <> 5 GROUP BY video), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, md5('42|' || video), video ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM c) SELECT video, n FROM o WHERE bf < 150""")
def b7(spark, d):
    e = events(spark, d)
    return splits.move_minority_videos(e.where("grp <> 5"), e.where("grp = 5"), 150)


@query("b8_select_diverse", f"""WITH {EV}, f AS (SELECT event_idx, 1 AS tier FROM ev WHERE behavior IN ('tail', 'other') ORDER BY md5('42|' || event_idx), event_idx LIMIT 70),
k AS (SELECT greatest(1, (200 - (SELECT count(*) FROM f)) // (SELECT count(DISTINCT (grp, camera)) FROM ev WHERE behavior = 'ear')) AS per),
s AS (SELECT event_idx, 2 AS tier FROM ev WHERE behavior = 'ear' QUALIFY row_number() OVER (PARTITION BY grp, camera ORDER BY md5('42|' || event_idx), event_idx) <= (SELECT per FROM k)),
t AS (SELECT event_idx, 3 AS tier FROM ev WHERE event_idx NOT IN (SELECT event_idx FROM f) AND event_idx NOT IN (SELECT event_idx FROM s))
SELECT event_idx, tier FROM (SELECT * FROM f UNION ALL SELECT * FROM s UNION ALL SELECT * FROM t) ORDER BY tier, md5('42|' || event_idx), event_idx LIMIT 200""")
def b8(spark, d):
    return splits.select_diverse(events(spark, d), 200).select("event_idx", "tier")


@query("b9_sample_per_class", f"WITH {EV} SELECT event_idx, behavior FROM ev QUALIFY row_number() OVER (PARTITION BY behavior ORDER BY md5('42|' || event_idx), event_idx) <= 25")
def b9(spark, d):
    return splits.sample_per_class(events(spark, d), 25).select("event_idx", "behavior")


@query("b10_pick_longest", f"""WITH {EV}, s AS (SELECT *, max(CASE WHEN duration_sec >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY grp, day) = 1 AS sm FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, day ORDER BY CASE WHEN sm THEN CASE WHEN duration_sec >= 60 THEN 0 ELSE 1 END END, CASE WHEN sm THEN -duration_sec END, event_idx) AS rk FROM s)
SELECT event_idx, grp, day FROM r WHERE rk <= 2 AND (NOT sm OR duration_sec >= 60)""")
def b10(spark, d):
    return splits.pick_longest(events(spark, d), 2, 60.0).select("event_idx", "grp", "day")


@query("b11_sample_non_events", f"""WITH {EV}, m AS (SELECT video, greatest(0.0, start_sec - 60.0 - 10.0) AS s, least(2592000.0, start_sec + duration_sec + 60.0) AS e FROM ev UNION ALL SELECT DISTINCT video, 2592000.0 - 10.0, 2592000.0 FROM ev),
f AS (SELECT video, coalesce(max(e) OVER (PARTITION BY video ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS fr, s FROM m),
g AS (SELECT video, fr, least(s, 2592000.0 - 10.0) - fr AS room FROM f WHERE least(s, 2592000.0 - 10.0) - fr > 0),
h AS (SELECT *, sum(room) OVER (PARTITION BY video ORDER BY fr ROWS UNBOUNDED PRECEDING) AS upto, sum(room) OVER (PARTITION BY video) AS al FROM g),
i AS (SELECT *, ('0x' || substr(md5('42|' || video), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 * al AS pos FROM h)
SELECT video, round(fr + pos - (upto - room), 3) AS clip_start FROM i WHERE pos >= upto - room AND pos < upto""")
def b11(spark, d):
    return splits.sample_non_events(events(spark, d), 10.0, 60.0, length=2_592_000.0, start="start_sec")


