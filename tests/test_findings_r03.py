"""The findings of round 3."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from boutlake.functions import det
from boutlake.operators import audit, bootstrap, runs
from boutlake.plans import evaluating, extending
from boutlake.streaming import bouts

from . import oracle
from .test_extended import interval, predictions, uniform


def test_draws_of_a_task_are_those_of_spark(spark):
    means = [0, 1, 2, 7, 400, 500, 501, 9_000]
    df = spark.createDataFrame([(f"k{m}", m, r) for m in means for r in range(1, 9)], "k string, m long, r int")
    expected = {(r["k"], r["r"]): r["w"] for r in det.with_poisson(df, "w", "m", 5, "k", "r").collect()}
    found = det.poisson_draws([f"5|k{m}" for m in means], np.array(means), [*range(1, 9)])
    assert {(f"k{m}", r): found[i, r - 1] for i, m in enumerate(means) for r in range(1, 9)} == expected


def test_ood_bootstrap_makes_draws_in_tasks(spark, monkeypatch):
    """F1, F8, F10: a draw per score, replicate and side was sorted and shuffled."""
    kept = []
    monkeypatch.setattr(bootstrap, "_interval", lambda long: kept.append(long) or long)
    rnd = random.Random(1)
    scored = spark.createDataFrame([(round(rnd.random(), 2), i % 3 == 0) for i in range(90)], "score double, is_ood boolean")
    bootstrap.bootstrap_ood(scored, 120)  # bands of 50, 50 and 20
    plan = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and kept[0].count() == 360


def test_every_row_draws_its_own_weight(spark):
    """rows of a pattern had one draw together."""
    rows, df = predictions(spark)
    got = {r["metric"]: [r["mean"], r["low"], r["high"], r["std"]] for r in bootstrap.bootstrap_ci(df, 30, metrics=["recall_pos"], key="clip_id").collect()}
    steps, values = bootstrap.poisson_one(), []
    for b in range(1, 31):
        w = {r[0]: sum(c <= uniform(42, r[0], b) for c in steps) for r in rows}
        tp, fn = (sum(w[r[0]] for r in rows if r[1] == "tail" and r[2] == z) for z in ("tail", "ear"))
        values.append(tp / (tp + fn))
    assert got["recall_pos"] == pytest.approx(interval(values), abs=2e-6)


def test_tubes_of_many_positions_meet_by_cells(spark):
    """every position of a track met all others of its frame, nine times and more."""
    rnd = random.Random(8)
    spots = [(v, t, f, rnd.uniform(0, 900), rnd.uniform(0, 900)) for v in "vw" for t in range(7) for f in range(6) for _ in range(rnd.choice([1, 1, 2, 6]))]
    spots += [("v", 9, 0, None, 3.0), ("v", 9, 1, 0.0, 0.0), ("v", 10, 1, 150.0, 0.0)]
    expected = {}
    for v, a, f, x, y in spots:
        for w, b, g, x2, y2 in spots:
            if (v, f) == (w, g) and a < b and None not in (x, x2) and (x - x2) ** 2 + (y - y2) ** 2 <= 22_500:
                expected.setdefault((v, a, b), set()).add(f)
    df = spark.createDataFrame(spots, "video string, track int, frame int, x double, y double")
    for least in (1, 3):
        got = {(r["video"], r["a"], r["b"]): r["frames"] for r in runs.pair_tubes(df, least=least).collect()}
        assert got == {k: len(v) for k, v in expected.items() if len(v) >= least}
    # 3 frames x 2 tracks x 4,000 positions: 48 million pairs
    many = spark.range(24_000).selectExpr("'v' as video", "cast(id % 2 as int) as track", "id div 2 % 3 as frame", "id % 89 / 1D as x", "id % 97 / 1D as y")
    joined = runs.pair_tubes(many, least=1)
    assert [tuple(r) for r in joined.collect()] == [("v", 0, 1, 3)]


def test_times_of_intervals_are_rounded_as_in_sql(spark, tmp_path):
    """36575.1185 + 65.64 is 36640.759 for the SQL, and was 36640.758."""
    at = (pd.Timestamp("2024-01-01") + pd.to_timedelta([36_575_118_500, 36_574_000_000], unit="us")).astype("datetime64[us]")
    rows = pd.DataFrame({"event_id": [152, 153], "ts": at, "user_id": [1, 1], "event_type": ["error"] * 2, "value": [65.64, 66.0], "props": ["{}"] * 2})
    rows.to_parquet(tmp_path / "events.parquet")
    _, truth = extending._near_intervals(spark, str(tmp_path))
    assert {r["truth_id"]: r["end_sec"] for r in truth.collect()}[152] == 36_640.759
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    oracle.compare(extending.a35_boundaries(spark, str(tmp_path)), con, extending.Q["a35_boundary_errors"][1])


def test_bouts_of_many_videos_run_on_together():
    """each video had a state, timers and calls of its own."""
    rnd = random.Random(4)
    feed = [(rnd.choice(["a", "b", "c", None]), i, round(rnd.uniform(0, 900), 1), round(rnd.uniform(0, 30), 1)) for i in range(300)]
    open_ = pd.DataFrame({"video": ["a", "z"], "first": [-9.0, -5.0], "end": [-1.0, -2.0], "n": [3, 1]})
    open_["video"] = open_["video"].astype("object")
    expected, state = {}, {"a": (-9.0, -1.0, 3), "z": (-5.0, -2.0, 1)}
    closed = []
    for v, i, s, d in sorted(feed, key=lambda r: (r[2], r[1])):
        if v in state and s - state[v][1] > 12.0:
            closed.append((v, *state.pop(v)))
        first, _, n = state.get(v, (s, 0, 0))
        state[v], expected[i] = (first, s + d, n + 1), first
    for cut in (0, 100, 300):  # in one go, or in two
        order, bouts_, found, over = sorted(feed, key=lambda r: (r[2], r[1])), open_, {}, []
        for part in (order[:cut], order[cut:]):
            if part:
                rows = pd.DataFrame([(v, i, s, s + d) for v, i, s, d in part], columns=["video", "idx", "start", "end"])
                rows["video"] = rows["video"].astype("object")
                events, done, bouts_ = bouts.run_on(rows, bouts_, 12.0)
                found |= dict(zip(events["idx"], events["first"]))
                over += [tuple(r) for r in done.itertuples(index=False)]
        plain = lambda rows: sorted((str(v) if isinstance(v, str) else "", *r) for v, *r in rows)
        assert found == expected and plain(over) == plain(closed)
        assert plain(bouts_.itertuples(index=False)) == plain((v, *s) for v, s in state.items())


def test_audit_parses_each_text_once(spark, data):
    """clock times were parsed nine times a row, all of it once more in a filter, and audited rows joined to the events."""
    m, files = evaluating.manifest(spark, data), evaluating._files(spark, data).selectExpr("path", "1700D as actual_sec")
    kept = audit.audit_by_class(m, audit.audit_events(m, files, keep=["behavior"]))
    joined = audit.audit_by_class(m, audit.audit_events(m, files))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, joined.collect()))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 7
