"""Training runs from their histories: early stop, overfitting, collapse, and the leaderboard.

A history is one row per run and epoch. Windows are partitioned by the run; only the early-stop level, where each step
needs the one before, is a fold over a run's short sorted array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overfit_monitor(
    history: DataFrame, loss_gap: float = 0.3, acc_gap: float = 0.15, patience: int = 5, warm_up: int = 3,
    run: str = "run", epoch: str = "epoch"
) -> DataFrame:
    """run, epoch, issues, severity, counter, since_best, verdict per epoch behind the warm-up (whose losses count for rising, not for the best)."""
    w = Window.partitionBy(run).orderBy(epoch)
    val = F.col("val_loss")
    rows = history.withColumn(
        "_up",
        F.coalesce((val > F.lag(val, 1).over(w)) & (F.lag(val, 1).over(w) > F.lag(val, 2).over(w)), F.lit(False))
    )
    rows = rows.where(F.col(epoch) >= warm_up)
    best_before = F.min("val_loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(val < best_before, F.lit(True)))
    rows = rows.withColumn("_block", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("since_best", F.row_number().over(Window.partitionBy(run, "_block").orderBy(epoch)) - 1)
    issue = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    issues = issue(val - F.col("train_loss") > loss_gap) + issue(F.col("_up")) + issue(
        F.col("train_acc") - F.col("val_acc") > acc_gap
    ) + issue(F.col("since_best") >= patience)
    rows = rows.withColumn("issues", issues).withColumn("_s", F.when(F.col("issues") >= 2, 1).otherwise(-1))
    # max(0, c + s) step by step is the walk minus its running minimum (0 at most).
    rows = rows.withColumn("_walk", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.least(F.lit(0), F.min("_walk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("counter", F.col("_walk") - low)
    severity = F.when(F.col("issues") >= 3, "severe").when(
        F.col("issues") == 2, "moderate"
    ).when(F.col("issues") == 1, "mild").otherwise("none")
    return rows.select(
        run, epoch, "issues", severity.alias("severity"), "counter", "since_best",
        F.when(F.col("counter") > 3, "overfitting").otherwise("normal").alias("verdict")
    )


def early_stop(
    history: DataFrame, patience: int = 15, delta: float = 0.001, metric: str = "val_metric", run: str = "run",
    epoch: str = "epoch"
) -> DataFrame:
    """run, best_epoch, best_metric (strictly higher, first), stop_epoch: the reference level moves on a rise over delta
    only, and `patience` epochs without one stop the run (else its last epoch)."""
    items = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(metric).cast("double").alias("m"))))
    start = F.struct(
        F.lit(None).cast("double").alias("level"), F.lit(0).alias("waited"),
        F.lit(None).cast("bigint").alias("stop")
    )

    def step(s, x):
        rises = s["level"].isNull() | (x["m"] > s["level"] + delta)
        waited = F.when(rises, 0).otherwise(s["waited"] + 1)
        moved = F.struct(
            F.when(rises, x["m"]).otherwise(s["level"]).alias("level"), waited.alias("waited"),
            F.when(waited >= patience, x["e"].cast("bigint")).alias("stop")
        )
        return F.when(s["stop"].isNotNull(), s).otherwise(moved)

    runs = history.groupBy(run).agg(items.alias("items")).withColumn("_end", F.aggregate("items", start, step)["stop"])
    seen = runs.withColumn("_stop", F.coalesce("_end", F.element_at("items", -1)["e"].cast("bigint")))
    within = F.filter("items", lambda x: x["e"] <= F.col("_stop"))
    best = F.array_max(F.transform(within, lambda x: F.struct(x["m"].alias("m"), (-x["e"]).alias("o"))))
    return seen.withColumn("_b", best).select(
        run, (-F.col("_b.o")).cast("long").alias("best_epoch"), F.col("_b.m").alias("best_metric"),
        F.col("_stop").alias("stop_epoch"), F.col("_end").isNotNull().alias("stopped")
    )


def collapse_streak(
    history: DataFrame, least: float = 0.01, streak: int = 3, metric: str = "val_recall", run: str = "run",
    epoch: str = "epoch"
) -> DataFrame:
    """run, epoch, streak, warned: epochs in a row with the metric under `least`."""
    w = Window.partitionBy(run).orderBy(epoch)
    low = (F.col(metric) < least).cast("int")
    rows = history.withColumn("_low", low).withColumn(
        "_block", F.sum(1 - F.col("_low")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    n = F.sum("_low").over(Window.partitionBy(run, "_block").orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("streak", n).select(run, epoch, "streak", (F.col("streak") >= streak).alias("warned"))


def run_leaderboard(
    history: DataFrame, baseline: str = "baseline", metric: str = "val_metric", run: str = "run",
    epoch: str = "epoch"
) -> DataFrame:
    """run, best, final, epochs, delta (of best to the baseline run's, the first whose name holds `baseline`), place."""
    runs = history.groupBy(run).agg(
        F.max(metric).alias("best"), F.max_by(metric, epoch).alias("final"), F.count("*").alias("epochs")
    )
    base = runs.where(
        F.lower(run).contains(baseline.lower())
    ).orderBy(run).limit(1).select(F.col("best").alias("_base"))
    place = F.row_number().over(Window.orderBy(F.desc("best"), run))  # a row per run
    return runs.join(F.broadcast(base), how="left").select(
        run, F.round("best", 6).alias("best"), F.round("final", 6).alias("final"), "epochs",
        F.round(F.col("best") - F.col("_base"), 6).alias("delta"), place.alias("place")
    )


def explode_history(runs: DataFrame, run: str, columns: list[str]) -> DataFrame:
    """One row per run and epoch (from 1) of parallel arrays."""
    rows = runs.select(run, F.posexplode(F.arrays_zip(*columns)).alias("_p", "_r"))
    return rows.select(run, (F.col("_p") + 1).alias("epoch"), *[F.col(f"_r.{c}").alias(c) for c in columns])


def pair_tubes(tracks: DataFrame, near: float = 150.0, least: int = 5) -> DataFrame:
    """video, a, b, frames: pairs of tracks that are within `near` in `least` frames or more; a track may have several
    positions in a frame.

    Positions are put into cells whose diagonal is below `near`. Two tracks with a cell in common are near each other there,
    however many positions they have in it; so a frame's cells stand for its positions, and positions are only compared for
    tracks that have no cell in common in the frame, in cells that are near enough.
    """
    side = near / 1.5
    placed = tracks.select(
        "video", "frame", "track", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")
    ).where("cx is not null and cy is not null")
    cells = placed.select("video", "frame", "track", "cx", "cy").distinct()
    a = cells.select("video", "frame", F.col("track").alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    b = cells.select("video", "frame", F.col("track").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    at = ["video", "frame", "a", "b"]
    here = [F.col("ax").alias("bx"), F.col("ay").alias("by")]
    same = a.select("video", "frame", "a", *here).join(b, ["video", "frame", "bx", "by"]).where("a < b").select(*at).distinct()
    step = F.sequence(F.lit(-2), F.lit(2))
    around = a.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).where("dx <> 0 or dy <> 0")
    around = around.withColumns({"bx": F.col("ax") + F.col("dx"), "by": F.col("ay") + F.col("dy")}).drop("dx", "dy")
    open_ = around.join(b, ["video", "frame", "bx", "by"]).where("a < b").join(same, at, "left_anti")
    of = lambda t, n: placed.select(
        "video", "frame", F.col("track").alias(t), F.col("cx").alias(f"{t}x"), F.col("cy").alias(f"{t}y"),
        F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")
    ).distinct()
    met = open_.join(of("a", 1), ["video", "frame", "a", "ax", "ay"]).join(of("b", 2), ["video", "frame", "b", "bx", "by"])
    met = met.where(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2) <= near * near)
    every = same.unionByName(met.select(*at).distinct())  # a frame of a pair is in one of them, once
    return every.groupBy("video", "a", "b").agg(F.count("*").alias("frames")).where(F.col("frames") >= least)
