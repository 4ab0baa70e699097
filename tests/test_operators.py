"""Edge rules on small hand-made tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from boutlake.functions import det
from boutlake.operators import audit, clean, evaluate, leak, link, planning, runs, sessions, splits
from boutlake.sources import tables
from boutlake.plans.cleaning import bouts
from boutlake.plans.bindings import events


def one(df):
    return df.collect()[0]


def values(df, column):
    return [r[column] for r in df.collect()]


def test_bouts_compare_with_the_previous_row(spark):
    rows = [(i, "v", float(s), float(d)) for i, (s, d) in enumerate([(0, 272), (5, 1), (40, 2), (72, 1)])]
    df = spark.createDataFrame(rows, "event_idx int, video string, start_sec double, duration_sec double")
    assert values(sessions.assign_bouts(df, 30.0).orderBy("event_idx"), "bout_id") == ["v__bout_1", "v__bout_1", "v__bout_2", "v__bout_2"]


def segment(spark, rows):
    return spark.createDataFrame([(1, 1, *r) for r in rows], "grp int, day int, camera int, camera_order int, seg_idx int, seg_start double, seg_end double")


def event(spark, times):
    return spark.createDataFrame([(i, 1, 1, t) for i, t in enumerate(times)], "event_idx int, grp int, day int, time_sec double")


def test_link_exact_and_tolerance(spark):
    t = 6 * 3600.0
    both = segment(spark, [(1, 0, 0, t - 1799, t + 1), (1, 0, 1, t + 1, t + 1801)])
    assert one(link.link_events(event(spark, [t + 25]), both))["offset_sec"] == 24
    only = segment(spark, [(1, 0, 0, t - 1799, t + 1)])
    out = {r["event_idx"]: r for r in link.link_events(event(spark, [t + 25, t + 120, t - 1830, None]), only).collect()}
    assert out[0]["linked"] and out[0]["offset_sec"] == 1824
    assert not out[1]["linked"] and out[2]["linked"] and out[2]["offset_sec"] == 0 and 3 not in out
    reasons = {r["event_idx"]: r["reason"] for r in link.unlinked_reasons(event(spark, [t + 25, t + 120, t, None]), only).collect()}
    assert reasons == {1: "no_match", 3: "no_time"}


def test_first_camera_wins_even_by_tolerance(spark):
    seg = segment(spark, [(7, 0, 0, 0.0, 100.0), (9, 1, 0, 100.0, 500.0)])
    linked = link.link_events(event(spark, [120.0]), seg)
    assert one(linked)["camera"] == 7
    order = spark.createDataFrame([(1, 7, 0, False), (1, 9, 1, False)], "grp int, camera int, rank int, excluded boolean")
    again = one(link.relink_priority(linked, seg, order))
    assert (again["camera"], again["status"], again["offset_sec"]) == (9, "changed", 20.0)


def test_segment_names(spark):
    df = spark.createDataFrame([("a_ch10_main_20240706053001_20240706060001.mp4",), ("a_ch1_main_20241306053001_20240706060001.mp4",), (None,)], "n string")
    out = [r["s"] for r in df.select(link.parse_segment_name(F.col("n")).alias("s")).collect()]
    assert out[0]["channel"] == 10 and out[0]["seconds"] == 1800 and out[1] is None and out[2] is None


def test_labels_roles_durations_ids(spark):
    table = {"tail/teat?": "tail", "mouth": "other", "ear": "ear", "tail": "tail"}
    df = spark.createDataFrame([(None,), (" Ear ",), ("TAIL",), ("tail/teat?",), ("Mouth",), ("xyz",)], "v string")
    assert values(df.select(clean.normalize_label(F.col("v"), table).alias("x")), "x") == ["unknown", "ear", "tail", "tail", "other", "xyz"]
    rules = [("receiver", ["receiver", "reciever"]), ("interrupted", ["lost visibility"]), ("other", ["switched to"])]
    df = spark.createDataFrame([("reciever",), ("lost visibility",), ("switched to tail",), ("zzz",), (None,)], "v string")
    assert values(df.select(clean.normalize_by_substring(F.col("v"), rules).alias("x")), "x") == ["receiver", "interrupted", "other", "unknown", "unknown"]
    df = spark.createDataFrame([(None,), (-1.0,), (0.0,), (120.0,), (121.0,), (300.0,), (301.0,)], "v double")
    assert values(df.select(clean.flag_duration(F.col("v"), 0, 120, 300).alias("x")), "x") == ["missing", "below_min", None, None, "above_threshold", "above_threshold", "above_max"]
    df = spark.createDataFrame([(None,), ("5680.0",), ("5681",), ("1",)], "v string")
    assert values(df.select(clean.flag_id(F.col("v"), [(5680, 5720)]).alias("x")), "x") == ["missing", "invalid_format", None, "outside_range"]


def test_dates_by_the_first_format_that_fits(spark):
    df = spark.createDataFrame([("7/6/24",), ("7/6/2024",), ("2024-07-06",), ("31/12/24",), ("soon",), (None,)], "v string")
    assert values(df.select(clean.parse_date_multi(F.col("v")).alias("x")), "x") == ["2024-07-06", "2024-07-06", "2024-07-06", "2024-12-31", "soon", None]


def test_filter_classes_refuses_nothing(spark):
    with pytest.raises(ValueError):
        clean.filter_classes(spark.createDataFrame([("a",)], "behavior string"), "behavior", ["b"])


def test_clip_windows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 100.0), (99.0, 100.0, 100.0), (50.0, 50.0, 100.0)], "event_start double, event_end double, video_sec double")
    out = planning.plan_clip(df).collect()
    assert [(r["clip_start"], r["clip_end"]) for r in out] == [(0, 7), (93, 100), (47, 53)]
    assert "start_clamped" in out[0]["flags"] and "end_clamped" in out[1]["flags"] and out[2]["flags"] == []


def test_windows_over_an_event(spark):
    df = spark.createDataFrame([(1, 0.0, 4.0), (2, 5.0, 5.5)], "event_idx int, event_start double, event_end double")
    out = planning.slide_windows(df, 4 / 3).orderBy("event_idx", "window").collect()
    assert [round(r["win_start"], 3) for r in out if r["event_idx"] == 1] == [0, 0.667, 1.333, 2, 2.667]
    assert len([r for r in out if r["event_idx"] == 2]) == 1


def test_calibration_bins_are_open_below(spark):
    df = spark.createDataFrame([(0.0, "ear"), (0.1, "tail"), (0.10001, "ear"), (1.0, "tail")], "prob_tail double, true_label string").withColumn("pred_label", F.lit("ear"))
    assert {r["bin"]: r["n"] for r in evaluate.ece_bins(df).collect()} == {None: 1, 1: 1, 2: 1, 10: 1}
    assert one(evaluate.ece(df))["n"] == 4


def test_average_precision_with_ties(spark):
    df = spark.createDataFrame([("tail", 0.9), ("ear", 0.8), ("tail", 0.8), ("ear", 0.1)], "true_label string, prob_tail double")
    out = one(evaluate.curve_metrics(evaluate.threshold_curve(df)))
    assert out["average_precision"] == round(5 / 6, 6) and out["roc_auc"] == 0.875


def test_area_is_the_rank_statistic(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["ear", "tail"]), round(rnd.random(), 2)) for _ in range(300)]
    out = one(evaluate.curve_metrics(evaluate.threshold_curve(spark.createDataFrame(rows, "true_label string, prob_tail double"))))
    pos, neg = [s for y, s in rows if y == "tail"], [s for y, s in rows if y == "ear"]
    u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(out["roc_auc"] - u) < 1e-5


def test_published_predictions(spark):
    """A small table with the counts of a published confusion matrix: [[91, 38], [9, 3]]."""
    cells = [("ear", "ear", 91), ("ear", "tail", 38), ("tail", "ear", 9), ("tail", "tail", 3)]
    df = spark.createDataFrame([(t, p) for t, p, n in cells for _ in range(n)], "true_label string, pred_label string")
    assert one(evaluate.binary_metrics(df))["macro_f1"] == 0.453984


def history(spark, val):
    return spark.createDataFrame([("r", i + 1, float(v)) for i, v in enumerate(val)], "run string, epoch int, val_metric double")


def test_early_stop_level_moves_on_a_jump_only(spark):
    out = one(runs.early_stop(history(spark, [0.50, 0.5005, 0.5009, 0.502, 0.50, 0.50]), patience=2))
    assert (out["stop_epoch"], out["best_epoch"], out["stopped"]) == (3, 3, True)
    out = one(runs.early_stop(history(spark, [0.50, 0.5005, 0.5009, 0.502, 0.50, 0.50]), patience=3))
    assert (out["stop_epoch"], out["best_epoch"], out["stopped"]) == (6, 4, False)


def test_overfit_counter_is_clamped(spark):
    # Issues by epoch: 2, 1, 1, 3 through the gaps of loss and accuracy and a patience of 0 epochs.
    rows = [("r", 1, 1.0, 0.0, 0.9, 0.0), ("r", 2, 0.9, 0.0, 0.0, 0.0), ("r", 3, 0.8, 0.0, 0.0, 0.0), ("r", 4, 0.9, 0.0, 0.9, 0.0)]
    df = spark.createDataFrame(rows, "run string, epoch int, val_loss double, train_loss double, train_acc double, val_acc double")
    out = runs.overfit_monitor(df, patience=1, warm_up=1).orderBy("epoch").collect()
    assert [r["severity"] for r in out] == ["moderate", "mild", "mild", "severe"]
    assert [r["counter"] for r in out] == [1, 0, 0, 1]


def test_oversample_counts(spark):
    df = spark.createDataFrame([(i, "ear" if i < 90 else "tail") for i in range(100)], "event_idx int, behavior string")
    assert splits.oversample(df, 0.3).count() == 128
    assert splits.oversample(df, 0.05).count() == 100


def test_early_event_fails_alignment(spark):
    df = spark.createDataFrame([(1, "a_ch1_main_20240706053001_20240706060001.mp4", "p", "05:29:56", "05:30:10", 0.0, 0.0)], "event_idx int, filename string, path string, start_time string, end_time string, duration_sec double, offset_sec double")
    out = one(audit.verify_alignment(df, df.select("path")))
    assert (out["calc_offset_sec"], out["reason"], out["duration_fixed"]) == (86_395, "offset_exceeds_segment", 14)


def test_banded_hamming_is_brute_force(spark):
    rnd = random.Random(7)
    words = [[rnd.getrandbits(64) - (1 << 63) for _ in range(3)] for _ in range(40)]
    for w in words[:30]:
        near = [*w]
        for _ in range(rnd.randint(0, 14)):
            k = rnd.randrange(3)
            near[k] = ((near[k] + (1 << 63)) ^ (1 << rnd.randrange(64))) - (1 << 63)
        words.append(near)
    df = spark.createDataFrame(list(enumerate(words)), "id int, words array<bigint>")
    found = {(r["query"], r["match"], r["distance"]) for r in leak.near_duplicates(df, df, 12, 3).collect()}
    apart = lambda a, b: sum(bin((x ^ y) & ((1 << 64) - 1)).count("1") for x, y in zip(a, b))
    assert found == {(i, j, apart(a, b)) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and apart(a, b) <= 12}


def test_splits_do_not_leak(spark, data):
    df = bouts(spark, data)
    joined = df.join(splits.split_bouts(df), "bout_id")
    assert joined.count() == df.count()
    assert joined.groupBy("bout_id").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    assert leak.leak_asserts(joined, ["bout_id"]).count() == df.count()
    with pytest.raises(Exception, match="leak of video"):
        leak.leak_asserts(joined, ["video"]).collect()


def test_running_total_is_a_running_total(spark):
    rows = [(float(i), random.Random(i).randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "s double, n int")
    out = {r["s"]: r["t"] for r in det.running_totals(df, "s", {"n": "t"}, descending=True).collect()}
    total = 0
    for s, n in sorted(rows, reverse=True):
        total += n
        assert out[s] == total


def test_results_do_not_depend_on_partitions(spark, data):
    e = events(spark, data)
    assert sorted(splits.split_events_intravideo(e).collect()) == sorted(splits.split_events_intravideo(e.repartition(13)).collect())


def test_free_places_are_clear(spark):
    rnd = random.Random(3)
    rows = [(f"v{i % 5}", rnd.uniform(0, 1700), rnd.uniform(0, 40)) for i in range(40)]
    df = spark.createDataFrame(rows, "video string, offset_sec double, duration_sec double")
    out = splits.sample_non_events(df, 5.0, 10.0).collect()
    assert len(out) == 5
    for r in out:
        assert 0 <= r["clip_start"] <= 1795
        assert all(r["clip_start"] + 5 <= s - 10 + 1e-3 or r["clip_start"] >= s + d + 10 - 1e-3 for v, s, d in rows if v == r["video"])


def test_nms_keeps_the_best(spark):
    rows = [("v", 1, 0.0, 10.0, 0.9), ("v", 2, 1.0, 11.0, 0.8), ("v", 3, 9.0, 20.0, 0.7), ("v", 4, 30.0, 40.0, 0.1)]
    df = spark.createDataFrame(rows, "video string, event_idx int, start_sec double, end_sec double, score double")
    assert sorted(values(audit.temporal_nms(df, 0.5), "event_idx")) == [1, 3, 4]


@pytest.mark.parametrize("few", [0, 50, 100_000])
def test_nms_in_rounds_as_one_after_the_other(spark, monkeypatch, few):
    monkeypatch.setattr(audit, "FEW", few)
    rnd = random.Random(8)
    rows = [(rnd.choice(["v", "w", None]), i, s := rnd.uniform(0, 400), s + rnd.choice([0.0, 2.0, 8.0, 30.0, 64.0]) * rnd.uniform(0.5, 1.5), rnd.randint(0, 30) / 30) for i in range(300)]
    df = spark.createDataFrame(rows, "video string, event_idx int, start_sec double, end_sec double, score double")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[1])):
        def covers(k):
            both = max(min(k[3], r[3]) - max(k[2], r[2]), 0.0)
            return k[0] == r[0] and both / max(k[3] - k[2] + r[3] - r[2] - both, 1e-9) > 0.3
        if not any(covers(k) for k in kept):
            kept.append(r)
    found = audit.temporal_nms(df, 0.3)
    assert sorted(values(found, "event_idx")) == sorted(r[1] for r in kept)
    assert "collect_list" not in found._jdf.queryExecution().toString()  # no group in one row


def test_softmax_is_stable(spark):
    p = one(spark.range(1).select(evaluate.softmax(F.array(F.lit(1000.0), F.lit(999.0))).alias("p")))["p"]
    assert abs(p[0] - 1 / (1 + math.exp(-1))) < 1e-12


def test_decisions(spark):
    rows = [(True, False, None), (False, True, None), (None, False, 15), (None, None, 16), (None, False, 9)]
    df = spark.createDataFrame(rows, "ours boolean, name_match boolean, distance int").withColumn("strict", F.lit(8)).withColumn("loose", F.lit(15))
    assert values(leak.overlap_decision(df), "decision") == ["VAL", "VAL", "VAL", "TEST", "VAL"]
    assert values(leak.overlap_decision(df, "or"), "decision") == ["VAL", "TEST", "REVIEW", "TEST", "REVIEW"]


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_running_totals_keep_null_orders_apart(spark):
    df = spark.createDataFrame([(0.1, 1), (0.5, 2), (None, 3)], "k double, v long")
    for descending, expected in ((False, {0.1: 1, 0.5: 3, None: None}), (True, {0.1: 3, 0.5: 2, None: None})):
        assert {r["k"]: r["t"] for r in det.running_totals(df, "k", {"v": "t"}, descending=descending).collect()} == expected
    assert {r["k"]: r["at"] for r in det.numbered(df, "k", "at").collect()} == {None: 0, 0.1: 1, 0.5: 2}
    assert det.numbered(df.where("false"), "k", "at").count() == 0


def test_more_rows_make_more_ranges(spark, monkeypatch):
    monkeypatch.setattr(det, "RANGE_ROWS", 10)
    df = spark.range(1_000).selectExpr("id * 7 % 1000 as k", "1L as v")
    assert det._ranged(df, "k", "_range").groupBy("_range").count().agg({"count": "max"}).first()[0] < 40
    assert all(r["t"] == r["k"] + 1 for r in det.running_totals(df, "k", {"v": "t"}).collect())


def test_dates_of_six_formats(spark):
    said = {
        "2024-01-05": "2024-01-05", "2024-01-05 10:00:00": "2024-01-05", "1/2/70": "1970-01-02", "1/2/68": "2068-01-02", "12/31/2023": "2023-12-31", "31/12/23": "2023-12-31",
        " 25/1/2024 ": "2024-01-25", "2024/01/05": "2024/01/05", "soon": "soon", "": "", None: None,
    }
    df = spark.createDataFrame([(x,) for x in said], "x string")
    assert {r["x"]: r["d"] for r in df.select("x", clean.parse_date_multi(F.col("x")).alias("d")).collect()} == said


def test_scan_of_a_folder(spark, tmp_path):
    for camera, name in ((1, "a_ch1_main_20240706053001_20240706060001.mp4"), (1, "holiday.MP4"), (2, "a_ch2_main_20240706060001_20240706063001.mp4"), (2, "notes.txt")):
        (tmp_path / f"Cam {camera}").mkdir(exist_ok=True)
        (tmp_path / f"Cam {camera}" / name).write_bytes(b"x")
    found = tables.scan_segments(spark, str(tmp_path))
    assert sorted((r["camera"], r["filename"][:4], r["seconds"]) for r in found.collect()) == [(1, "a_ch", 1800.0), (1, "holi", None), (2, "a_ch", 1800.0)]


def test_manifest_and_rules_of_files(spark, tmp_path):
    video = {"filename": "a.mp4", "path": "/a.mp4", "start": "2024-07-06 05:30:01", "end": "2024-07-06 06:00:01", "duration_sec": 1800.0}
    (tmp_path / "m.json").write_text(json.dumps({"labeled": {"group3_day2": {"cameras": {"1": {"videos": [video, video]}}}}, "unlabeled": {}}, indent=1))
    rows = tables.read_video_manifest(spark, str(tmp_path / "m.json")).collect()
    assert [(r["grp"], r["day"], r["camera"], r["seconds"]) for r in rows] == [(3, 2, 1, 1800.0)] * 2
    rules = {"label": {"Tail ": "tail"}, "camera": {"x": "1"}}
    (tmp_path / "r.json").write_text(json.dumps(rules, indent=1))
    assert tables.read_rules(spark, str(tmp_path / "r.json")) == rules


def test_grid_bits_row_by_row(spark):
    rnd = random.Random(3)
    grid = [[rnd.choice([0.0, 1.0, 2.0]) for _ in range(17)] for _ in range(16)]
    words = one(spark.createDataFrame([(grid,)], "g array<array<double>>").select(leak.grid_dhash(F.col("g")).alias("w")))["w"]
    bits = "".join(format(w & ((1 << 64) - 1), "064b") for w in words)
    assert bits == "".join("1" if r[i + 1] > r[i] else "0" for r in grid for i in range(16))


def test_calibration_against_plain_sums(spark):
    rnd = random.Random(5)
    rows = [(round(rnd.random(), 2), rnd.choice(["ear", "tail"])) for _ in range(300)]
    df = spark.createDataFrame([(p, round(1 - p, 2), y) for p, y in rows], "prob_ear double, prob_tail double, true_label string")
    got = one(evaluate.calibration(df, 10))
    bins = {}
    for p, y in rows:
        top, hit = max(p, round(1 - p, 2)), y == ("ear" if p >= round(1 - p, 2) else "tail")
        b = next(i for i in range(10) if i / 10 < top <= (i + 1) / 10)
        bins.setdefault(b, []).append((top, hit))
    gaps = {b: abs(sum(t for t, _ in v) - sum(h for _, h in v)) / len(v) for b, v in bins.items()}
    assert got["ece"] == pytest.approx(sum(gaps[b] * len(v) for b, v in bins.items()) / 300, abs=2e-6)
    assert got["mce"] == pytest.approx(max(gaps.values()), abs=2e-6)
    assert got["brier"] == pytest.approx(sum((p - (y == "ear")) ** 2 + (round(1 - p, 2) - (y == "tail")) ** 2 for p, y in rows) / 300, abs=2e-6)
    assert got["rating"] == "poor - consider temperature scaling" and got["n"] == 300
    assert one(evaluate.calibration(df.where("false"), 10))["rating"] is None


def test_quantiles_as_the_aggregate_gives_them(spark, monkeypatch):
    monkeypatch.setattr(det, "RANGE_ROWS", 20)
    rnd = random.Random(11)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, round(rnd.gauss(0, 3), 2)])) for _ in range(400)] + [("one", 4.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"q0": 0.0, "q25": 0.25, "q5": 0.5, "q95": 0.95, "q1": 1.0}
    plain = df.where("v is not null").groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in shares.items()])
    got = {r["k"]: [r[n] for n in shares] for r in det.quantiles(df, "v", shares, ["k"]).collect()}
    expected = {r["k"]: [r[n] for n in shares] for r in plain.collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
    assert one(det.quantiles(df, "v", {"m": 0.5}))["m"] == pytest.approx(one(df.agg(F.percentile("v", F.lit(0.5)).alias("m")))["m"])
    assert one(det.quantiles(df.where("false"), "v", {"m": 0.5}))["m"] is None


def test_report_keeps_null_labels_apart_from_the_total(spark):
    plan = spark.createDataFrame([("a", 6.0, []), (None, 8.0, ["end_clamped"]), (None, 9.0, [])], "behavior string, clip_duration double, flags array<string>")
    got = sorted((str(r["behavior"]), r["clips"], r["median"]) for r in planning.clip_plan_report(plan).collect())
    assert got == [("None", 2, 8.5), ("None", 3, 8.0), ("a", 1, 6.0)]
