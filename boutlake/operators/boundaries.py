"""Errors of predicted intervals beside their overlap: boundaries in time, roles, and the cases worth a look.

Nearest boundaries are an as-of join in both directions within a tolerance: both sides are put into bins as wide as the
tolerance, one of them also into the neighbouring bins, and of what meets the nearest is kept. So a recording with any
number of intervals is spread over its bins, and only boundaries that may match are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import match_by_tiou

#: Tolerances in seconds that boundaries are judged by.
TOLERANCES = (0.5, 1.0, 2.0)


def boundaries(
    intervals: DataFrame, idx: str, video: str = "video", start: str = "start_sec", end: str = "end_sec"
) -> DataFrame:
    """video, id, edge (start or end), at: two rows per interval; a boundary without a time has no row."""
    edges = F.array(
        F.struct(F.lit("start").alias("edge"), F.col(start).alias("at")),
        F.struct(F.lit("end").alias("edge"), F.col(end).alias("at"))
    )
    rows = intervals.select(F.col(video).alias("video"), F.col(idx).alias("id"), F.explode(edges).alias("e"))
    return rows.select("video", "id", "e.edge", F.col("e.at").cast("double").alias("at")).where("at is not null")


def nearest_boundaries(asked: DataFrame, others: DataFrame, within: float) -> DataFrame:
    """video, id, edge, at of all asked boundaries, and near_id, error (at less the other's time): of the nearest boundary of
    the same edge in the video, at most `within` seconds away, before or behind; of equally near ones the earlier, then
    the one with the smaller id. Null where there is none."""
    bins = F.floor(F.col("at") / within)
    near = others.select("video", "edge", F.col("id").alias("near_id"), F.col("at").alias("near_at"), bins.alias("bin"))
    near = near.groupBy("video", "edge", "near_at", "bin").agg(F.min("near_id").alias("near_id"))  # the same time once
    near = near.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    met = asked.withColumn("bin", bins).join(near, ["video", "edge", "bin"]).withColumn(
        "away", F.abs(F.col("at") - F.col("near_at"))
    )
    best = F.min(F.struct("away", "near_at", "near_id")).alias("b")
    found = met.where(F.col("away") <= within).groupBy("video", "edge", "id").agg(best)
    rows = asked.join(found, ["video", "edge", "id"], "left")
    return rows.select(
        "video", "id", "edge", "at", F.col("b.near_id").alias("near_id"),
        (F.col("at") - F.col("b.near_at")).alias("error")
    )


def boundary_errors(preds: DataFrame, truth: DataFrame, tolerances: Sequence[float] = TOLERANCES) -> DataFrame:
    """side (truth: of the true boundaries; pred: of the predicted ones), edge, tolerance, n, hits, share, mean_error (of the
    hits, absolute; 6 decimals). preds: pred_id, truth: truth_id, both video, start_sec, end_sec; ids are unique."""
    p, t = boundaries(preds, "pred_id"), boundaries(truth, "truth_id")
    both = nearest_boundaries(t, p, max(tolerances)).withColumn("side", F.lit("truth")).unionByName(
        nearest_boundaries(p, t, max(tolerances)).withColumn("side", F.lit("pred"))
    )
    grid = F.array(*[F.lit(float(x)) for x in tolerances])
    away = F.round(F.abs("error"), 6)
    rows = both.select("side", "edge", away.alias("away"), F.explode(grid).alias("tolerance"))
    hit = F.coalesce(F.col("away") <= F.col("tolerance"), F.lit(False))
    out = rows.groupBy("side", "edge", "tolerance").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("hits"),
        F.sum(F.when(hit, F.round(F.col("away") * 1_000_000).cast("long"))).alias("micros")
    )
    # The mean of whole millionths: a sum of doubles would depend on the order of its rows.
    mean = F.round(F.col("micros") / F.nullif(F.col("hits"), F.lit(0))) / 1_000_000
    return out.select(
        "side", "edge", "tolerance", "n", "hits", mean.alias("mean_error"),
        F.round(F.col("hits") / F.col("n"), 6).alias("share")
    )


def role_accuracy(
    preds: DataFrame, truth: DataFrame, iou: float, roles: Sequence[str] = ("initiator", "receiver")
) -> DataFrame:
    """One row: matched pairs (by overlap), how many have each role right (`<role>_right`), all right, both exchanged
    (swapped, where they are two that differ), and the share of all right (6 decimals; null without a match). A role that is
    null on both sides is right."""
    named = lambda df, key, tag: df.select(key, *[F.col(r).alias(f"{r}_{tag}") for r in roles])
    pairs = match_by_tiou(preds, truth, iou).where("is_match").select("pred_id", "truth_id")
    pairs = pairs.join(named(preds, "pred_id", "p"), "pred_id").join(named(truth, "truth_id", "t"), "truth_id")
    right = {r: F.col(f"{r}_p").eqNullSafe(F.col(f"{r}_t")) for r in roles}
    every = F.lit(True)
    for c in right.values():
        every = every & c
    swapped = F.lit(False)
    if len(roles) == 2:
        a, b = roles
        swapped = ~every & F.col(f"{a}_p").eqNullSafe(F.col(f"{b}_t")) & F.col(f"{b}_p").eqNullSafe(F.col(f"{a}_t"))
    out = pairs.agg(
        F.count("*").alias("matched"), *[F.count_if(c).alias(f"{r}_right") for r, c in right.items()],
        F.count_if(every).alias("all_right"), F.count_if(swapped).alias("swapped")
    )
    return out.withColumn("accuracy", F.round(F.col("all_right") / F.nullif(F.col("matched"), F.lit(0)), 6))


def failure_cases(preds: DataFrame, truth: DataFrame, iou: float, k: int = 10) -> DataFrame:
    """kind, rank (from 1), id, weight of the k first of each kind: false_positive (predictions without a match by their score),
    false_negative (true intervals without a match by their length), boundary_error (matches by what start and end are off
    together); 6 decimals, ties to the smaller id."""
    matches = match_by_tiou(preds, truth, iou).where("is_match").select("pred_id", "truth_id")
    lost = truth.join(matches, "truth_id", "left_anti").select(
        F.col("truth_id").alias("id"), (F.col("end_sec") - F.col("start_sec")).alias("weight")
    )
    wrong = preds.join(matches, "pred_id", "left_anti").select(
        F.col("pred_id").alias("id"), F.col("score").alias("weight")
    )
    at = truth.select("truth_id", F.col("start_sec").alias("s"), F.col("end_sec").alias("e"))
    off = preds.join(matches, "pred_id").join(at, "truth_id").select(
        F.col("pred_id").alias("id"),
        (F.abs(F.col("start_sec") - F.col("s")) + F.abs(F.col("end_sec") - F.col("e"))).alias("weight")
    )
    out = None
    for kind, rows in (("false_positive", wrong), ("false_negative", lost), ("boundary_error", off)):
        # Each task keeps k, so that the window has k rows.
        top = rows.select(
            "id", F.round(F.col("weight").cast("double"), 6).alias("weight")
        ).orderBy(F.desc("weight"), "id").limit(k)
        top = top.select(
            F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(F.desc("weight"), "id")).alias("rank"),
            "id", "weight"
        )
        out = top if out is None else out.unionByName(top)
    return out
