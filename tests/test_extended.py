"""Bootstrap, ranges, streaming bouts, sheets, alignment tables, boundaries, tracks and near duplicates against plain Python."""

import hashlib
import math
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from boutlake.functions import det
from boutlake.operators import audit, bootstrap, boundaries, clean, evaluate, leak, planning, sessions, splits
from boutlake.sources import tables
from boutlake.streaming import bouts


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def uniform(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def poisson(mean, *parts):
    return sum(c <= uniform(*parts) for c in det.poisson_steps(mean)) if mean else 0


# --- draws and ranges ---------------------------------------------------------------------------------------------------


def test_poisson_draws(spark):
    df = spark.range(40).selectExpr("id", "case when id % 4 = 3 then 300 else id % 4 end as m", "1 as _u")
    for r in det.with_poisson(df, "w", "m", 7, "id").collect():
        assert r["w"] == poisson(r["m"], 7, r["id"])
    many = spark.range(20_000).selectExpr("id", "5000L as m")
    drawn = [r["w"] for r in det.with_poisson(many, "w", "m", 7, "id").collect()]
    assert abs(statistics.fmean(drawn) - 5_000) < 2 and abs(statistics.pvariance(drawn) / 5_000 - 1) < 0.05


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5_000])
def test_place_among_cuts(spark, n):
    cuts = [i * 2.0 for i in range(n)]
    df = spark.createDataFrame([(float(x),) for x in range(-3, 2 * min(n, 60) + 3)] + [(2.0 * n + 9,)], "v double")
    for r in df.select("v", det.place_among(F.col("v"), cuts).alias("p")).collect():
        assert r["p"] == sum(c < r["v"] for c in cuts)


def test_totals_in_thousands_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(det, "RANGE_ROWS", 2)
    df = spark.range(4_000).selectExpr("id * 7 % 4000 as k", "1L as v", "'x' as _range", "2 as _before_v")
    rows = det.running_totals(df, "k", {"v": "t"})
    assert set(rows.columns) == {*df.columns, "t"}
    assert all(r["t"] == r["k"] + 1 and r["_range"] == "x" for r in rows.collect())
    assert all(r["at"] == r["k"] for r in det.numbered(df, "k", "at").collect())


def test_columns_with_helper_names_stay(spark):
    df = spark.createDataFrame([("v", 1, 0.0, 5.0, "tail", 9, 8, 7, 6), ("v", 2, 100.0, 5.0, "ear", 9, 8, 7, 6), ("v", 2, 100.0, 5.0, "ear", 9, 8, 7, 6)], "video string, event_idx int, start_sec double, duration_sec double, behavior string, _opens int, _times int, _at int, _size int")
    for out in (sessions.assign_bouts(df), sessions.duplicate_events(df, ["video", "event_idx"]), sessions.dedupe_first(df, ["event_idx"], ["start_sec"]), splits.sample_weights(df), splits.sample_per_class(df, 1)):
        assert set(df.columns) <= set(out.columns)
        assert {(r["_opens"], r["_times"], r["_at"], r["_size"]) for r in out.collect()} == {(9, 8, 7, 6)}


# --- bootstrap ----------------------------------------------------------------------------------------------------------


def predictions(spark, n=80):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["ear", "tail"]), rnd.choice(["ear", "tail"]), round(rnd.random(), 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "clip_id int, true_label string, pred_label string, prob_tail double")


def interval(values):
    s = sorted(values)
    at = lambda q: s[math.floor(q * (len(s) - 1))] + (s[math.ceil(q * (len(s) - 1))] - s[math.floor(q * (len(s) - 1))]) * (q * (len(s) - 1) % 1)
    return [statistics.fmean(s), at(0.025), at(0.975), statistics.pstdev(s)]


def test_named_and_own_metrics(spark):
    rows, df = predictions(spark)
    own = bootstrap.Metric("coalesce(try_divide(wrong, n), 0D)", {"wrong": "true_label <> pred_label", "n": "true"}, "n > 0")
    found = {r["metric"]: [r["mean"], r["low"], r["high"], r["std"]] for r in bootstrap.bootstrap_ci(df, 50, metrics=["recall_pos", ("wrong", own)]).collect()}
    count = lambda y, z: sum(r[1] == y and r[2] == z for r in rows)
    recall, wrong = [], []
    for b in range(1, 51):
        tp, fn = poisson(count("tail", "tail"), 42, "1000", b), poisson(count("tail", "ear"), 42, "0010", b)
        recall.append(tp / (tp + fn))
        miss = sum(r[1] != r[2] for r in rows)
        w, right = poisson(miss, 42, "11", b), poisson(len(rows) - miss, 42, "01", b)
        wrong.append(w / (w + right))
    assert found["recall_pos"] == pytest.approx(interval(recall), abs=2e-6) and found["wrong"] == pytest.approx(interval(wrong), abs=2e-6)


def test_registered_metrics(spark):
    _, df = predictions(spark)
    bootstrap.register_metric("test_errors", "fp + fn")
    assert [r["metric"] for r in bootstrap.bootstrap_ci(df, 5, metrics=["test_errors"]).collect()] == ["test_errors"]
    bootstrap.register_metric("test_errors", "fp + fn")  # the same again
    with pytest.raises(ValueError, match="test_errors"):
        bootstrap.register_metric("test_errors", "fp")
    with pytest.raises(KeyError):
        bootstrap.bootstrap_ci(df, 5, metrics=["unknown"])
    del bootstrap.METRICS["test_errors"]


def test_metric_of_a_function(spark):
    rows, df = predictions(spark)
    columns = ["true_label", "pred_label"]

    def accuracy(part: pd.DataFrame):
        return None if part["weight"].sum() < 60 else part.loc[part["true_label"] == part["pred_label"], "weight"].sum() / part["weight"].sum()

    got = one(bootstrap.bootstrap_custom(df, accuracy, columns, 40, name="acc"))
    values = []
    for b in range(1, 41):
        w = {k: poisson(sum((r[1], r[2]) == k for r in rows), 42, *k, b) for k in {(r[1], r[2]) for r in rows}}
        if sum(w.values()) >= 60:
            values.append(sum(v for (y, z), v in w.items() if y == z) / sum(w.values()))
    assert [got["mean"], got["low"], got["high"], got["std"]] == pytest.approx(interval(values), abs=2e-6) and got["metric"] == "acc"
    with pytest.raises(ValueError, match="distinct rows"):
        bootstrap.bootstrap_custom(df, accuracy, columns, 4, most_rows=2)


@pytest.mark.parametrize("points", [3, 20_000])
def test_ood_bootstrap_in_ranges(spark, monkeypatch, points):
    monkeypatch.setattr(bootstrap, "POINTS", points)
    rnd = random.Random(6)
    rows = [(round(rnd.random(), 1), i % 4 == 0) for i in range(70)] + [(None, True)]
    scored = spark.createDataFrame(rows, "score double, is_ood boolean")
    values = {"auroc": [], "aupr_ood": [], "fpr_at_95tpr": []}
    scores = sorted({s for s, _ in rows if s is not None})
    for b in range(1, 16):
        pos = {s: poisson(sum(x == s and not o for x, o in rows), 42, i, "id", b) for i, s in enumerate(scores)}
        neg = {s: poisson(sum(x == s and o for x, o in rows), 42, i, "ood", b) for i, s in enumerate(scores)}
        np_, nn = sum(pos.values()), sum(neg.values())
        up = lambda w, s: sum(v for k, v in w.items() if k >= s)
        down = lambda w, s: sum(v for k, v in w.items() if k <= s)
        values["auroc"].append(sum(neg[s] * (up(pos, s) - pos[s] / 2) for s in scores) / np_ / nn)
        values["aupr_ood"].append(sum(neg[s] / nn * down(neg, s) / (down(neg, s) + down(pos, s)) for s in scores if neg[s]))
        values["fpr_at_95tpr"].append(min(up(neg, s) / nn for s in scores if up(pos, s) / np_ >= 0.95))
    for r in bootstrap.bootstrap_ood(scored, 15).collect():
        assert [r["mean"], r["low"], r["high"], r["std"]] == pytest.approx(interval(values[r["metric"]]), abs=3e-6), r["metric"]


def test_report_has_the_same_in_rows_and_json(spark):
    import json

    rnd = random.Random(3)
    rows = [(i, rnd.choice(["ear", "tail"]), rnd.choice(["ear", "tail"]), p := round(rnd.random(), 1), round(1 - p, 1), 7 if i % 4 == 0 else 0, i % 4 == 0) for i in range(60)]
    preds = spark.createDataFrame(rows, "clip_id int, true_label string, pred_label string, prob_ear double, prob_tail double, label int, is_ood boolean").withColumn("msp", F.greatest("prob_ear", "prob_tail"))
    report = json.loads(one(evaluate.evaluate_report(preds, replicates=8))["report"])
    flat = {(r["section"], r["item"], r["metric"]): r["value"] for r in evaluate.report_rows(preds, replicates=8).collect()}
    assert flat["binary", "", "mcc"] == report["binary"]["mcc"] and flat["ood", "", "auroc"] == report["ood"]["auroc"]
    assert {m["metric"]: m["mean"] for m in report["bootstrap"]} == {i: v for (s, i, m), v in flat.items() if s == "bootstrap" and m == "mean"}
    assert {s for s, _, _ in flat} == set(report)
    alone = json.loads(one(evaluate.evaluate_report(preds.where("not is_ood"), replicates=3))["report"])
    assert "ood" not in alone and "bootstrap" in alone


# --- streaming ----------------------------------------------------------------------------------------------------------


FEED = "event_idx long, video string, start_sec double, duration_sec double"


def run_feed(spark, tmp_path, batches, gap, delay, slot=10.0):
    """Rows by kind, and the state's keys after each batch; a batch is a file."""
    feed = tmp_path / "feed"
    feed.mkdir()
    for i, rows in enumerate(batches):
        pd.DataFrame(rows, columns=["event_idx", "video", "start_sec", "duration_sec"]).to_json(feed / f"{i:03}.json", orient="records", lines=True)
        import os

        os.utime(feed / f"{i:03}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = bouts.stream_bouts(spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).json(str(feed)), gap, delay, slot)
    query = bouts.write_bouts(stream, str(tmp_path / "out"), str(tmp_path / "mark"), availableNow=True)
    query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    return {k: df.collect() for k, df in bouts.split_kinds(spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))).items()}, state


def test_stream_takes_events_in_any_order_within_the_delay(spark, tmp_path):
    rnd = random.Random(9)
    events = [(i, rnd.choice("ab"), round(rnd.uniform(0, 600), 1), round(rnd.uniform(0, 9), 1)) for i in range(120)]
    moved = sorted(events, key=lambda e: e[2] + rnd.uniform(0, 45))  # no more than 45 seconds behind
    batches = [moved[i : i + 30] for i in range(0, 120, 30)] + [[(999, "z", 9_999.0, 0.0)]]
    found, _ = run_feed(spark, tmp_path, batches, 15.0, "50 seconds")
    expected = {}
    for v in "ab":
        end = first = None
        for i, _, s, d in sorted((e for e in events if e[1] == v), key=lambda e: (e[2], e[0])):
            if end is None or s - end > 15.0:
                first = s
            expected[i], end = bouts.bout_name(v, first), s + d
    assert {r["event_idx"]: r["bout_id"] for r in found["event"]} == expected and not found["late"]
    closed = {r["bout_id"]: r["n_events"] for r in found["closed"]}
    assert closed == {b: sum(x == b for x in expected.values()) for b in expected.values()}


def test_stream_drops_its_state_and_sets_late_rows_apart(spark, tmp_path):
    batches = [[(10 * b + k, f"v{b}", 1_000.0 * b + k, 1.0) for k in range(5)] for b in range(8)]
    batches.insert(4, [(500, "v0", 2.0, 1.0), (501, "v3", 3_010.0, None)])  # the first is long past
    found, state = run_feed(spark, tmp_path, batches, 30.0, "20 seconds")
    assert [(r["event_idx"], r["video"]) for r in found["late"]] == [(500, "v0")]
    assert {r["video"]: r["n_events"] for r in found["closed"]} == {"v0": 5, "v1": 5, "v2": 5, "v3": 6, "v4": 5, "v5": 5, "v6": 5}
    assert len(state) >= 9 and max(state) <= 8  # as small at the end as at the beginning


# --- sources ------------------------------------------------------------------------------------------------------------


def test_sheet_of_ten_files_keeps_its_order(spark, tmp_path):
    rnd, n = random.Random(2), 0
    for i in range(10):
        rows = rnd.choice([0, 1, 3, 900])
        (tmp_path / f"part-{i}.csv").write_text("k,_file,_number\n" + "".join(f"{n + j},{'x' * rnd.randint(0, 60)},y\n" for j in range(rows)))
        n += rows
    for size in ("128m", "2k"):  # files packed together, and files that are cut
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = tables.read_annotation_sheet(spark, str(tmp_path), {"k": "row"})
            assert set(found.columns) == {"row", "_file", "_number", "event_idx"}
            assert all(int(r["row"]) == r["event_idx"] for r in found.collect()) and found.count() == n
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_settings_of_runs(spark, tmp_path):
    for run, text in {"ablation_a": "model:\n  backbone: mvit\n  pretrained: true\noptim: {lr: 0.001}\n", "ablation_b": "data: [1, {x: 2}]\nname:\n", "ablation_c": "a: [1"}.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "config.yaml").write_text(text)
    found = {(r["run"], r["key"]): r["value"] for r in tables.read_run_configs(spark, f"{tmp_path}/ablation_*/config.yaml").collect()}
    assert "expected" in found.pop(("ablation_c", "_error"))
    assert found == {
        ("ablation_a", "model.backbone"): "mvit", ("ablation_a", "model.pretrained"): "true", ("ablation_a", "optim.lr"): "0.001",
        ("ablation_b", "data"): '[1, {"x": 2}]', ("ablation_b", "name"): None,
    }


def test_columns_are_found_by_their_names(spark):
    assert clean.detect_columns([" Video", "Our video? (note)", "Notes", "None 1-0", "None-ear 1-0", "Tail 1-0", "old tail (1-0)", "Tail"]) == {
        "video": " Video", "ours": "Our video? (note)", "notes": "Notes", "none": "None-ear 1-0", "tail": "old tail (1-0)",
    }
    with pytest.raises(ValueError, match="video"):
        clean.detect_columns(["videos", "Our video"])
    rows = [(" a.MP4 ", "yes", "1.0"), ("12", "Y", "1"), (None, "Y", "1"), ("b.avi", "maybe", " 1 "), ("c.txt", "no", "1"), ("d.mov", "0", "2")]
    df = spark.createDataFrame(rows, "Video string, `Our Video.` string, `Ear 1-0` string")
    assert [(r["video"], r["ours"], r["notes"], r["labels"]) for r in clean.read_external_sheet(df).collect()] == [("a.MP4", True, None, ["ear"]), ("b.avi", None, None, ["ear"]), ("d.mov", False, None, [])]
    bare = clean.read_external_sheet(df.select("Video"))
    assert [r["labels"] for r in bare.collect()] == [[], [], []]


def test_tables_of_the_alignment(spark, tmp_path):
    name = "cam_ch1_main_20240706053000_20240706060000.mp4"
    rows = [
        (1, name, "p", "05:40:00", "05:40:09", 5.0, 600.0), (2, name, "p", "05:40:00", "05:40:09", None, 700.0), (3, "broken", "p", "05:40:00", None, 5.0, 0.0), (4, name, "gone", "05:40:00", None, 5.0, 0.0),
        (5, name, "p", "??", None, 5.0, 0.0), (6, name, "p", "06:10:00", None, 5.0, 0.0), (7, name, "p", "05:40:00", "05:40:00", -1.0, 600.0), (8, name, "p", "05:40:00", "05:40:09", 0.3, 600.0),
    ]
    df = spark.createDataFrame(rows, "event_idx int, filename string, path string, start_time string, end_time string, duration_sec double, offset_sec double")
    checked = audit.verify_alignment(df.withColumn("_seg", F.lit("mine")), spark.createDataFrame([("p",)], "path string"))
    path = audit.write_alignment(checked, str(tmp_path / "out"))
    read = lambda n: sorted(r["event_idx"] for r in audit.read_alignment(checked.schema, spark, path, n).collect())
    assert read("fixed") == [*range(1, 9)] and read("verified") == [1, 2, 7, 8]
    assert [read(n) for n in audit.ISSUES] == [[4], [3, 5], [6], [2], [2, 7]]
    fixed = {r["event_idx"]: (r["duration_fixed"], r["_seg"]) for r in audit.read_alignment(checked.schema, spark, path, "verified").collect()}
    assert fixed == {1: (5.0, "mine"), 2: (9.0, "mine"), 7: (1.0, "mine"), 8: (1.0, "mine")}
    assert audit.read_alignment(checked.schema, spark, audit.write_alignment(checked.where("event_idx = 1"), str(tmp_path / "few")), "missing_video").count() == 0


# --- intervals, tracks, near duplicates ---------------------------------------------------------------------------------


def test_boundary_errors_by_brute_force(spark):
    rnd = random.Random(12)
    make = lambda n, base: [(rnd.choice(["v", "w"]), base + i, s := round(rnd.uniform(0, 60), 1), round(s + rnd.uniform(0, 20), 1)) for i in range(n)]
    truth, preds = make(40, 0), make(50, 100)
    truth.append(("v", 77, None, 3.0))
    as_df = lambda rows, key: spark.createDataFrame(rows, f"video string, {key} int, start_sec double, end_sec double")
    found = {(r["side"], r["edge"], r["tolerance"]): (r["n"], r["hits"], r["mean_error"]) for r in boundaries.boundary_errors(as_df(preds, "pred_id"), as_df(truth, "truth_id")).collect()}
    for side, asked, others in (("truth", truth, preds), ("pred", preds, truth)):
        for edge, k in (("start", 2), ("end", 3)):
            away = [min((round(abs(r[k] - o[k]), 6) for o in others if o[0] == r[0] and o[k] is not None), default=9e9) for r in asked if r[k] is not None]
            for t in boundaries.TOLERANCES:
                hits = [x for x in away if x <= t]
                n, m, mean = found[side, edge, t]
                assert (n, m) == (len(away), len(hits)) and mean == pytest.approx(statistics.fmean(hits), abs=1e-6)


def test_nearest_boundary_ties(spark):
    df = lambda rows, *names: spark.createDataFrame(rows, "video string, id int, edge string, at double")
    near = boundaries.nearest_boundaries(df([("v", 1, "start", 10.0), ("v", 2, "start", 30.0), ("x", 3, "start", 10.0)]), df([("v", 9, "start", 11.0), ("v", 8, "start", 9.0), ("v", 7, "start", 9.0), ("v", 6, "end", 10.0)]), 1.0)
    assert sorted((r["id"], r["near_id"], r["error"]) for r in near.collect()) == [(1, 7, 1.0), (2, None, None), (3, None, None)]


def test_roles_of_matches(spark):
    truth = spark.createDataFrame([("v", 1, 0.0, 10.0, 1, 2), ("v", 2, 20.0, 30.0, 3, 4), ("v", 3, 40.0, 50.0, 5, None)], "video string, truth_id int, start_sec double, end_sec double, initiator int, receiver int")
    preds = spark.createDataFrame([("v", 1, 0.0, 10.0, 0.9, 2, 1), ("v", 2, 20.0, 30.0, 0.9, 3, 9), ("v", 3, 40.0, 50.0, 0.9, 5, None), ("v", 4, 70.0, 80.0, 0.9, 1, 1)], "video string, pred_id int, start_sec double, end_sec double, score double, initiator int, receiver int")
    r = one(boundaries.role_accuracy(preds, truth, 0.5))
    assert (r["matched"], r["initiator_right"], r["receiver_right"], r["all_right"], r["swapped"], r["accuracy"]) == (3, 2, 1, 1, 1, 0.333333)
    assert one(boundaries.role_accuracy(preds.where("false"), truth, 0.5))["accuracy"] is None


def test_gaps_of_tracks_are_filled(spark):
    rows = [("v", 1, f, 0.9, float(f * f)) for f in (0, 1, 4, 5, 40)] + [("v", 1, 5, 0.9, 99.0), ("v", 2, 0, 0.9, 1.0), ("v", 3, 0, 0.9, None), *[("v", 3, f, 0.9, 1.0) for f in (3, 4, 5, 6)], *[("v", 4, f, 0.1, 1.0) for f in range(6)]]
    df = spark.createDataFrame(rows, "video string, track int, frame int, conf double, x double")
    found = sorted((r["track"], r["frame"], r["x"], r["filled"]) for r in audit.fill_tracks(df, ["x"]).collect())
    assert [r for r in found if r[0] == 1] == [(1, 0, 0.0, False), (1, 1, 1.0, False), (1, 2, 6.0, True), (1, 3, 11.0, True), (1, 4, 16.0, False), (1, 5, 25.0, False), (1, 40, 1600.0, False)]
    assert [r for r in found if r[0] == 3][:3] == [(3, 0, None, False), (3, 1, None, True), (3, 2, None, True)]
    assert {r[0] for r in found} == {1, 3}


def test_dark_clips_meet_few(spark):
    """Half of all clips are dark on top: whole bands of these bits would be one key for all of them."""
    rnd = random.Random(1)
    bits = [rnd.getrandbits(256) & ((1 << 256) - 1 if i % 2 else (1 << 128) - 1) for i in range(1_200)]
    bits += [b ^ (1 << rnd.randrange(256)) ^ (1 << rnd.randrange(256)) for b in bits[:40]]
    words = lambda b: [w - (1 << 64) if (w := b >> 64 * k & (1 << 64) - 1) >= 1 << 63 else w for k in range(4)]
    df = spark.createDataFrame([(i, words(b)) for i, b in enumerate(bits)], "id long, words array<long>").repartition(4)
    met = []
    held = leak.hamming
    leak.hamming = lambda a, b: (met.append(1), held(a, b))[1]
    try:
        found = leak.near_duplicates(df, df, 6, 4, hot=100)
    finally:
        leak.hamming = held
    expected = {(i, j) for i in range(len(bits)) for j in range(len(bits)) if i != j and (bits[i] ^ bits[j]).bit_count() <= 6}
    assert {(r["query"], r["match"]) for r in found.collect()} == expected and len(expected) >= 80
    masks = leak._masks(4, 8)
    keys = [[tuple(x & m for x, m in zip(words(b), mask)) for mask in masks] for b in bits]
    counts = pd.Series([(k, v) for own in keys for k, v in enumerate(own)]).value_counts()
    assert counts.iloc[0] < 30  # no key of more than a few rows


def test_hot_bands_give_way_to_pairs_of_bands(spark):
    """Many clips are black but for a few bits: every band is hot, and results are still whole."""
    rnd = random.Random(7)
    bits = [sum(1 << rnd.randrange(128) for _ in range(rnd.randint(0, 9))) for _ in range(150)] + [rnd.getrandbits(128) for _ in range(50)]
    words = lambda b: [w - (1 << 64) if (w := b >> 64 * k & (1 << 64) - 1) >= 1 << 63 else w for k in range(2)]
    df = spark.createDataFrame([(i, words(b)) for i, b in enumerate(bits)], "id long, words array<long>").repartition(3)
    found = leak.near_duplicates(df, df, 5, 2, hot=10)
    expected = {(i, j): (x ^ y).bit_count() for i, x in enumerate(bits) for j, y in enumerate(bits) if i != j and (x ^ y).bit_count() <= 5}
    assert {(r["query"], r["match"]): r["distance"] for r in found.collect()} == expected and expected


def test_clip_plans_round_halves_to_even(spark):
    rows = [(1, "tail", 10.005, 10.015, 100.0), (2, "tail", 10.0125, 10.0375, 100.0), (3, "tail", 0.0, 0.005, 100.0)]
    plan = planning.plan_clip(spark.createDataFrame(rows, "event_idx int, behavior string, event_start double, event_end double, video_sec double"))
    for r in plan.collect():
        s, e = next((s, e) for i, _, s, e, _ in rows if i == r["event_idx"])
        extra = max(6.0 - (e - s + 6.0), 0.0) / 2
        low = max(s - 3.0 - extra, 0.0)
        high = min(e + 3.0 + extra + max(-(s - 3.0 - extra), 0.0), 100.0)
        from decimal import ROUND_HALF_EVEN, Decimal

        two = lambda x: float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_EVEN))
        assert (r["clip_start"], r["clip_end"]) == (two(low), two(high))
