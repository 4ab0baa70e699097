"""Evaluation of classifiers from prediction tables: counts, curves, calibration, out-of-distribution scores, bootstrap.

Everything over thresholds, temperatures or replicates is a grid joined to the rows and summed in one pass with map-side
partials; what reaches a single task is at most one row per grid point or class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.det import running_totals
from .bootstrap import BUILT_IN, METRICS, bootstrap_ci, bootstrap_ood

EPS = 1e-8


def confusion_matrix(preds: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """true, pred, n, share (of the true class, 6 decimals)."""
    counts = preds.groupBy(true, pred).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(true)), 6))


def classification_metrics(
    preds: DataFrame, classes: Sequence[str], true: str = "true_label", pred: str = "pred_label", eps: float = EPS
) -> DataFrame:
    """class, precision, recall, f1, support for each class, and class null with macro means, accuracy as support_share."""
    tp = [F.count_if((F.col(true) == c) & (F.col(pred) == c)).cast("double") for c in classes]
    sup = [F.count_if(F.col(true) == c).cast("double") for c in classes]
    said = [F.count_if(F.col(pred) == c).cast("double") for c in classes]
    items = F.array(
        *[
            F.struct(F.lit(c).alias("class"), t.alias("tp"), s.alias("support"), p.alias("said"))
            for c, t, s, p in zip(classes, tp, sup, said)
        ]
    )
    rows = preds.agg(items.alias("items")).select(F.explode("items").alias("i")).select("i.*")
    p, r = F.col("tp") / (F.col("said") + eps), F.col("tp") / (F.col("support") + eps)
    rows = rows.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * p * r / (p + r + eps))
    out = rows.rollup("class").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.sum("support").alias("support"), F.sum("tp").alias("correct")
    )
    six = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    return out.select(
        "class", *six, F.col("support").cast("long").alias("support"),
        F.when(
            F.col("class").isNull(), F.round(F.col("correct") / F.greatest(F.col("support"), F.lit(1.0)), 6)
        ).alias("accuracy")
    )


def threshold_curve(
    preds: DataFrame, score: str = "prob_tail", true: str = "true_label", positive: str = "tail"
) -> DataFrame:
    """score, pos, neg, tp, fp for each distinct score, from the top: running sums in two levels, none in one partition.
    Rows without a score have no place on a curve and are left out."""
    y = F.col(true) == positive
    points = preds.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")
    )
    return running_totals(points, "score", {"pos": "tp", "neg": "fp"}, descending=True)


def curve_metrics(curve: DataFrame) -> DataFrame:
    """One row: n_pos, n_neg, roc_auc (trapezoids), average_precision (steps), 6 decimals; null without both classes."""
    totals = curve.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    sums = curve.agg(area.alias("area"), ap.alias("ap"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return totals.crossJoin(sums).select(
        "n_pos", "n_neg",
        F.when(both, F.round(F.col("area") / F.col("n_pos") / F.col("n_neg"), 6)).alias("roc_auc"),
        F.when(both, F.round(F.col("ap") / F.col("n_pos"), 6)).alias("average_precision")
    )


def _binary_cells(
    weight: Column | None = None, true: str = "true_label", pred: str = "pred_label", positive: str = "tail"
) -> list[Column]:
    y, z = F.col(true) == positive, F.col(pred) == positive  # whatever is not the positive prediction counts as the other
    w = weight if weight is not None else F.lit(1)
    cell = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0)).cast("double")
    return [cell(y & z).alias("tp"), cell(~y & z).alias("fp"), cell(y & ~z).alias("fn"), cell(~y & ~z).alias("tn")]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0.0)))


def _binary_columns() -> dict[str, Column]:
    return {n: F.expr(METRICS[n].value) for n in BUILT_IN}


def binary_metrics(preds: DataFrame, **names: str) -> DataFrame:
    """One row: F1 of both classes and macro, precision and recall, balanced accuracy, MCC; 6 decimals."""
    return preds.agg(*_binary_cells(**names)).select(
        *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")],
        *[F.round(c, 6).alias(n) for n, c in _binary_columns().items()]
    )


def binary_report(preds: DataFrame, score: str = "prob_tail", **names: str) -> DataFrame:
    """binary_metrics with the area under the ROC curve and the average precision of the score beside them."""
    curve = curve_metrics(threshold_curve(preds, score)).select("roc_auc", "average_precision")  # one row
    return binary_metrics(preds, **names).crossJoin(F.broadcast(curve))


def _bin_of(p: Column, bins: int) -> Column:
    """1 to bins for p in (lo, hi] of equal bins by comparison with the edges; null at 0 and below."""
    out = F.lit(None).cast("int")
    for b in range(bins, 0, -1):
        low, high = (b - 1) / bins, b / bins
        out = F.when((p > low) & (p <= high), F.lit(b)).otherwise(out)
    return out


def ece_bins(
    preds: DataFrame, bins: int = 10, variant: str = "positive", true: str = "true_label",
    pred: str = "pred_label", score: str = "prob_tail", positive: str = "tail", top: str = "msp"
) -> DataFrame:
    """bin, n, confidence, observed. positive: positive probability against positive rate; top1: top probability against accuracy."""
    p, hit = (F.col(score), F.col(true) == positive) if variant == "positive" else (
        F.col(top), F.col(true) == F.col(pred)
    )
    rows = preds.select(_bin_of(p, bins).alias("bin"), p.alias("p"), hit.cast("double").alias("hit"))
    return rows.groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg("hit").alias("observed")
    )


def ece(preds: DataFrame, bins: int = 10, variant: str = "positive", **names: str) -> DataFrame:
    """One row: ece, mce, n (rows in no bin count in n), 6 decimals."""
    b = ece_bins(preds, bins, variant, **names)
    gap = F.abs(F.col("confidence") - F.col("observed"))
    inside = F.col("bin").isNotNull()
    return b.agg(
        F.round(F.sum(F.when(inside, F.col("n") * gap)) / F.sum("n"), 6).alias("ece"),
        F.round(F.max(F.when(inside, gap)), 6).alias("mce"), F.sum("n").alias("n")
    )


#: What an error of calibration below the bound is called, and what one above all bounds is.
ECE_RATINGS = ((0.05, "excellent"), (0.1, "good"), (0.15, "moderate"))
ECE_POOR = "poor - consider temperature scaling"


def _top_class(values: Sequence[Column], classes: Sequence[str]) -> Column:
    """The class with the largest value, the first of equals."""
    most = F.greatest(*values)
    return F.coalesce(*[F.when(v == most, F.lit(c)) for v, c in zip(values, classes)])


def calibration(
    preds: DataFrame, bins: int = 15, probs: Sequence[str] = ("prob_ear", "prob_tail"),
    classes: Sequence[str] = ("ear", "tail"), true: str = "true_label"
) -> DataFrame:
    """One row: ece and mce of the top class, brier (squares summed over the classes), n, rating of the ece; 6 decimals."""
    columns = [F.col(p) for p in probs]
    square = F.lit(0.0)
    for p, c in zip(columns, classes):
        square = square + F.pow(p - F.coalesce((F.col(true) == c).cast("int"), F.lit(0)), F.lit(2.0))
    top = F.greatest(*columns)
    rows = preds.select(
        _bin_of(top, bins).alias("bin"), top.alias("p"),
        (F.col(true) == _top_class(columns, classes)).cast("double").alias("hit"), square.alias("square")
    )
    gap, inside = F.abs(F.col("p") - F.col("hit")), F.col("bin").isNotNull()
    b = rows.groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("hit").alias("hit"), F.sum("square").alias("square")
    )
    out = b.agg(
        F.round(F.sum(F.when(inside, F.col("n") * gap)) / F.sum("n"), 6).alias("ece"),
        F.round(F.max(F.when(inside, gap)), 6).alias("mce"),
        F.round(F.sum("square") / F.sum("n"), 6).alias("brier"), F.sum("n").alias("n"),
    )
    rating = F.when(F.col("ece").isNotNull(), F.lit(ECE_POOR))
    for bound, name in reversed(ECE_RATINGS):
        rating = F.when(F.col("ece") < bound, F.lit(name)).otherwise(rating)
    return out.withColumn("rating", rating)


def ood_scores(probs: Sequence[Column], method: str = "msp") -> Column:
    """Higher means more in-distribution: largest probability, negative entropy, or log of the sum of exp of log-probabilities."""
    if method == "msp":
        return F.greatest(*probs)
    total = F.lit(0.0)
    if method == "entropy":
        for p in probs:
            total = total + p * F.ln(p + 1e-10)
        return total
    for p in probs:
        total = total + F.exp(F.ln(p + 1e-10))
    return F.ln(total)


def ood_metrics(scores: DataFrame, score: str = "score", ood: str = "is_ood") -> DataFrame:
    """One row: auroc (ID above OOD), aupr_ood (OOD positive, negated score), fpr_at_95tpr, tpr_at_5fpr, n_id, n_ood; the
    first two null without both sides. One curve from the top serves both: what is at a score or below follows from the totals."""
    rows = scores.where(F.col(score).isNotNull())
    totals = rows.agg(F.count_if(~F.col(ood)).alias("np"), F.count_if(ood).alias("nn"))
    curve = threshold_curve(rows.select(F.col(score).alias("s"), F.when(F.col(ood), "n").otherwise("p").alias("y")), "s", "y", "p")
    curve = curve.crossJoin(F.broadcast(totals)).select("*", _ratio(F.col("tp"), F.col("np")).alias("tpr"), _ratio(F.col("fp"), F.col("nn")).alias("fpr"))
    below, under = F.col("nn") - F.col("fp") + F.col("neg"), F.col("np") - F.col("tp") + F.col("pos")
    sums = curve.agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"), F.sum(F.col("neg") * below / (below + under)).alias("ap"),
        F.coalesce(F.min(F.when(F.col("tpr") >= 0.95, F.col("fpr"))), F.lit(1.0)).alias("a"),
        F.coalesce(F.max(F.when(F.col("fpr") <= 0.05, F.col("tpr"))), F.lit(0.0)).alias("b"),
    )
    both = (F.col("np") > 0) & (F.col("nn") > 0)
    return sums.crossJoin(totals).select(
        F.when(both, F.round(F.col("area") / F.nullif(F.col("np"), F.lit(0)) / F.nullif(F.col("nn"), F.lit(0)), 6)).alias("auroc"),
        F.when(both, F.round(F.col("ap") / F.nullif(F.col("nn"), F.lit(0)), 6)).alias("aupr_ood"),
        F.round("a", 6).alias("fpr_at_95tpr"), F.round("b", 6).alias("tpr_at_5fpr"), F.col("np").alias("n_id"), F.col("nn").alias("n_ood"),
    )


def ood_breakdown(preds: DataFrame, label: str, score: str) -> DataFrame:
    return preds.groupBy(label).agg(
        F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"),
        F.round(F.stddev_pop(score), 6).alias("std")
    )


def _at_thresholds(preds: DataFrame, grid: DataFrame, score: str, true: str, positive: str) -> DataFrame:
    """threshold, tp, fp, fn, tn: the grid is small and broadcast, sums are partial in each task."""
    rows = preds.select(F.col(true).alias("true_label"), F.col(score).alias("_s")).crossJoin(F.broadcast(grid))
    rows = rows.withColumn(
        "pred_label", F.when(F.col("_s") >= F.col("threshold"), F.lit(positive)).otherwise(F.lit(""))
    )
    return rows.groupBy("threshold").agg(*_binary_cells(positive=positive))


def threshold_sweep(
    preds: DataFrame, first: int = 2, last: int = 18, step: float = 0.05, score: str = "prob_tail",
    true: str = "true_label", positive: str = "tail"
) -> DataFrame:
    """threshold (k * step), precision, recall and F1 of both classes, macro_f1, best (the first of the highest)."""
    grid = preds.sparkSession.range(first, last + 1).select(F.round(F.col("id") * step, 6).alias("threshold"))
    cols = _binary_columns()
    tn, fn = F.col("tn"), F.col("fn")
    out = _at_thresholds(preds, grid, score, true, positive).select(
        "threshold",
        *[
            F.round(cols[c], 6).alias(c)
            for c in ("precision_pos", "recall_pos", "f1_pos", "recall_neg", "f1_neg", "macro_f1")
        ],
        F.round(_ratio(tn, tn + fn), 6).alias("precision_neg")
    )
    best = F.row_number().over(Window.orderBy(F.desc("macro_f1"), "threshold")) == 1  # a row per threshold
    return out.withColumn("best", best)


def selective_curve(
    preds: DataFrame, n: int = 20, confidence: str = "msp", true: str = "true_label", pred: str = "pred_label",
    positive: str = "tail"
) -> DataFrame:
    """threshold, coverage, macro_f1 (accuracy where one class is left), risk: rows at least that sure, n thresholds from least to most."""
    ends = preds.agg(F.min(confidence).alias("a"), F.max(confidence).alias("b"), F.count("*").alias("_all"))
    grid = ends.select(
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(n - 1)),
                lambda i: F.round(F.col("a") + (F.col("b") - F.col("a")) * i / F.lit(max(1, n - 1)), 9)
            )
        ).alias("step", "threshold"),
        "_all"
    )
    rows = preds.select(
        F.col(true).alias("true_label"), F.col(pred).alias("pred_label"), F.col(confidence).alias("_s")
    ).crossJoin(F.broadcast(grid)).where("_s >= threshold - 1e-9")
    cells = rows.groupBy("step", "threshold", "_all").agg(*_binary_cells(positive=positive), F.count("*").alias("kept"))
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
    quality = F.when(both, _binary_columns()["macro_f1"]).otherwise((F.col("tp") + F.col("tn")) / F.col("kept"))
    return cells.select(
        "step", F.round("threshold", 6).alias("threshold"),
        F.round(F.col("kept") / F.col("_all"), 6).alias("coverage"), F.round(quality, 6).alias("macro_f1"),
        F.round(1 - quality, 6).alias("risk")
    )


def softmax(logits: Column) -> Column:
    """Of an array, shifted by its largest for stability."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def aggregate_clips(
    clips: DataFrame, method: str = "mean", event: str = "event_id", logits: str = "logits"
) -> DataFrame:
    """event, k, prob, n_clips, is_top: clips' logit vectors by mean or max, then softmax; or softmax_mean: softmax each,
    mean, log(+1e-8), softmax. A row per event and class."""
    values = softmax(F.col(logits)) if method == "softmax_mean" else F.col(logits)
    parts = clips.select(event, F.posexplode(values).alias("k", "v"))
    one = F.max("v") if method == "max" else F.avg("v")
    v = parts.groupBy(event, "k").agg(one.alias("v"), F.count("*").alias("n_clips"))
    if method == "softmax_mean":
        v = v.withColumn("v", F.ln(F.col("v") + 1e-8))
    w = Window.partitionBy(event)
    e = F.exp(F.col("v") - F.max("v").over(w))
    out = v.withColumn("_e", e).withColumn("prob", F.round(F.col("_e") / F.sum("_e").over(w), 6))
    top = F.row_number().over(w.orderBy(F.desc("prob"), "k")) == 1
    return out.select(event, "k", "prob", "n_clips", top.alias("is_top"))


def accuracy_by_class(preds: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """class (null: all), n, accuracy (6 decimals)."""
    rows = preds.select(F.col(true).alias("class"), (F.col(true) == F.col(pred)).cast("double").alias("hit"))
    return rows.rollup("class").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("accuracy"))


def temperature_grid(
    preds: DataFrame, grid: DataFrame, logits: Sequence[str], classes: Sequence[str], true: str = "true_label",
    objective: str = "nll", bins: int = 15
) -> DataFrame:
    """t and nll or ece (of the top class; 6 decimals) for each temperature of the grid."""
    rows = preds.select(F.col(true).alias("y"), *logits).crossJoin(F.broadcast(grid))
    scaled = [F.col(c) / F.col("t") for c in logits]
    most = F.greatest(*scaled)
    total = F.lit(0.0)
    for s in scaled:
        total = total + F.exp(s - most)
    if objective == "ece":
        p, hit = F.round(1 / total, 6), (F.col("y") == _top_class(scaled, classes)).cast("double")
        b = rows.select("t", _bin_of(p, bins).alias("bin"), p.alias("p"), hit.alias("hit")).groupBy("t", "bin").agg(
            F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("hit").alias("hit")
        )
        return b.groupBy("t").agg(
            F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("hit"))) / F.sum("n"), 6).alias("ece")
        )
    own = F.lit(None).cast("double")
    for c, s in zip(classes, scaled):
        own = F.when(F.col("y") == c, s).otherwise(own)
    loss = -F.ln(F.exp(own - most) / total + 1e-10)
    return rows.groupBy("t").agg(F.round(F.avg(loss), 6).alias("nll"))


def fit_temperature(
    preds: DataFrame, logits: Sequence[str] = ("logit_ear", "logit_tail"),
    classes: Sequence[str] = ("ear", "tail"), steps: int = 50, fine: int = 101, objective: str = "nll"
) -> DataFrame:
    """One row: t, and nll or ece, the objective: the best of a grid from 0.1 to 10, then of a finer one within 0.5 of it (ties to the smaller)."""
    spark = preds.sparkSession
    coarse = spark.range(steps).select(F.round(0.1 + 9.9 * F.col("id") / (steps - 1), 6).alias("t"))
    best = temperature_grid(preds, coarse, logits, classes, objective=objective).orderBy(objective, "t").limit(1)
    near = best.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(fine - 1)),
                lambda i: F.round(
                    F.least(F.lit(10.0), F.greatest(F.lit(0.1), F.col("t") - 0.5 + i / F.lit(float(fine - 1)))), 6
                )
            )
        ).alias("t")
    ).distinct()
    return temperature_grid(preds, near, logits, classes, objective=objective).orderBy(objective, "t").limit(1)


def class_weights(df: DataFrame, method: str = "inv", beta: float = 0.999, label: str = "behavior") -> DataFrame:
    """label, n, weight (mean 1): inv, inv_sqrt or effective number."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    raw = {
        "inv": 1 / F.col("n"), "inv_sqrt": 1 / F.sqrt(F.col("n").cast("double")),
        "effective": (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n")))
    }[method]
    rows = counts.withColumn("_w", raw)
    mean = F.avg("_w").over(Window.partitionBy())  # a row per class
    return rows.select(label, "n", F.round(F.col("_w") / mean, 6).alias("weight"))


def error_slices(
    preds: DataFrame, true: str = "true_label", pred: str = "pred_label", score: str = "prob_tail",
    positive: str = "tail"
) -> DataFrame:
    """One row: misses and false alarms with the statistics of their scores, sure misses (score < 0.3), rows in (0.4, 0.6)."""
    fn, fp = (
        F.col(true) == positive
    ) & (F.col(pred) != positive), (F.col(true) != positive) & (F.col(pred) == positive)
    s = F.col(score)
    cols = []
    for n, c in (("fn", fn), ("fp", fp)):
        v = F.when(c, s)
        cols += [
            F.count_if(c).alias(f"{n}_n"), F.round(F.avg(v), 6).alias(f"{n}_mean"), F.min(v).alias(f"{n}_min"),
            F.max(v).alias(f"{n}_max")
        ]
    return preds.agg(
        *cols, F.count_if(fn & (s < 0.3)).alias("sure_misses"), F.count_if((s > 0.4) & (s < 0.6)).alias("boundary")
    )


def range_slices(
    preds: DataFrame, bins: int = 5, idx: str = "clip_id", true: str = "true_label", pred: str = "pred_label",
    score: str = "prob_tail", positive: str = "tail"
) -> DataFrame:
    """slice, n, recall, accuracy, mean_score over equal ranges of idx, with spread: the sample deviation of the mean scores over 0.1."""
    ends = preds.agg(F.min(idx).alias("_a"), F.max(idx).alias("_b"))
    place = F.least(
        F.floor((F.col(idx) - F.col("_a")) * bins / F.greatest(F.col("_b") - F.col("_a"), F.lit(1))),
        F.lit(bins - 1)
    ).cast("int")
    rows = preds.crossJoin(F.broadcast(ends)).withColumn("slice", place)
    y = F.col(true) == positive
    out = rows.groupBy("slice").agg(
        F.count("*").alias("n"),
        F.round(
            _ratio(F.count_if(y & (F.col(pred) == positive)).cast("double"), F.count_if(y).cast("double")), 6
        ).alias("recall"),
        F.round(F.avg((F.col(true) == F.col(pred)).cast("double")), 6).alias("accuracy"), F.avg(score).alias("_m")
    )
    spread = F.coalesce(F.stddev_samp("_m").over(Window.partitionBy()) > 0.1, F.lit(False))  # a row per slice
    return out.select("slice", "n", "recall", "accuracy", F.round("_m", 6).alias("mean_score"), spread.alias("spread"))


def label_agreement(df: DataFrame, automatic: str, human: str) -> DataFrame:
    """One row: tp, tn, fp, fn and accuracy of an automatic flag against a human one."""
    a, h = F.col(automatic), F.col(human)
    n = F.greatest(F.count("*"), F.lit(1))
    return df.where(h.isNotNull()).agg(
        F.count_if(a & h).alias("tp"), F.count_if(~a & ~h).alias("tn"), F.count_if(a & ~h).alias("fp"),
        F.count_if(~a & h).alias("fn"), F.round(F.count_if(a == h) / n, 6).alias("accuracy")
    )


def losses(
    preds: DataFrame, logits: Sequence[str] = ("logit_ear", "logit_tail"),
    classes: Sequence[str] = ("ear", "tail"), true: str = "true_label", pred: str = "pred_label",
    idx: str = "clip_id"
) -> DataFrame:
    """idx, class (the true one), loss (cross-entropy by log-sum-exp, 6 decimals), correct."""
    most = F.greatest(*logits)
    total = F.lit(0.0)
    for c in logits:
        total = total + F.exp(F.col(c) - most)
    own = F.lit(None).cast("double")
    for c, name in zip(classes, logits):
        own = F.when(F.col(true) == c, F.col(name)).otherwise(own)
    loss = F.round(most + F.ln(total) - own, 6)
    return preds.select(
        idx, F.col(true).alias("class"), loss.alias("loss"), (F.col(true) == F.col(pred)).alias("correct")
    )


def loss_ranking(preds: DataFrame, top: int = 10, idx: str = "clip_id", **names: object) -> DataFrame:
    """idx, loss, correct of the `top` highest losses."""
    return losses(preds, idx=idx, **names).select(idx, "loss", "correct").orderBy(F.desc("loss"), idx).limit(top)


def loss_ranking_by_class(preds: DataFrame, top: int = 10, idx: str = "clip_id", **names: object) -> DataFrame:
    """class, rank (from 1), idx, loss, correct of the `top` highest losses of each class. Two levels: the first `top` of
    each part of a class, then of the class."""
    rows = losses(preds, idx=idx, **names).where("class is not null")
    order = (F.desc("loss"), F.asc(idx))
    part = F.row_number().over(Window.partitionBy("class", F.pmod(F.xxhash64(idx), F.lit(64))).orderBy(*order))
    rows = rows.withColumn("rank", part).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(*order)))
    return rows.where(F.col("rank") <= top).select("class", "rank", idx, "loss", "correct")


def loss_summary(preds: DataFrame, **names: object) -> DataFrame:
    """class (null: all), n, mean_loss, max_loss, wrong, wrong_percent (4 decimals)."""
    rows = losses(preds, **names).where("class is not null")
    out = rows.rollup("class").agg(
        F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("mean_loss"), F.max("loss").alias("max_loss"),
        F.count_if(~F.col("correct")).alias("wrong")
    )
    return out.withColumn("wrong_percent", F.round(100 * F.col("wrong") / F.col("n"), 4))


def confound_by(
    df: DataFrame, columns: Sequence[str], label: str = "behavior", minority: str = "tail", majority: str = "ear",
    warn: float = 0.1
) -> DataFrame:
    """column, value, n, ear, tail, ratio, and if the ratios' population deviation within the column is over `warn`."""
    cells = df.select(
        label, *[F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in columns]
    ).unpivot(label, list(columns), "column", "value")
    tail = F.count_if(F.col(label) == minority)
    rows = cells.groupBy("column", "value").agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == majority).alias("ear"), tail.alias("tail"),
        (tail / F.count("*")).alias("_r")
    )
    warned = F.stddev_pop("_r").over(Window.partitionBy("column")) > warn
    return rows.select("column", "value", "n", "ear", "tail", F.round("_r", 6).alias("ratio"), warned.alias("warned"))


def level_coverage(
    train: DataFrame, val: DataFrame, columns: Sequence[str], label: str = "behavior", minority: str = "tail"
) -> DataFrame:
    """column, only_train, only_val, both, and minority rows of val whose value train has not."""
    def cells(df: DataFrame, side: str) -> DataFrame:
        text = df.select(label, *[F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in columns])
        return text.unpivot(label, list(columns), "column", "value").withColumn("side", F.lit(side))

    sides = cells(train, "t").unionByName(cells(val, "v")).groupBy("column", "value").agg(
        F.bool_or(F.col("side") == "t").alias("t"), F.bool_or(F.col("side") == "v").alias("v"),
        F.count_if((F.col("side") == "v") & (F.col(label) == minority)).alias("tail")
    )
    t, v = F.col("t"), F.col("v")
    return sides.groupBy("column").agg(
        F.count_if(t & ~v).alias("only_train"), F.count_if(v & ~t).alias("only_val"),
        F.count_if(t & v).alias("both"),
        F.coalesce(F.sum(F.when(v & ~t, F.col("tail"))), F.lit(0)).alias("uncovered")
    )


def video_purity(
    df: DataFrame, video: str = "video", label: str = "behavior", minority: str = "tail", majority: str = "ear",
    heavy: int = 5
) -> DataFrame:
    """kind (both, ear_only, tail_only, neither), videos, events, heavy: videos of more than `heavy` events."""
    per = df.groupBy(video).agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == majority).alias("e"),
        F.count_if(F.col(label) == minority).alias("t")
    )
    kind = F.expr(
        "CASE WHEN e > 0 AND t > 0 THEN 'both' WHEN e > 0 THEN 'ear_only' WHEN t > 0 THEN 'tail_only' ELSE 'neither' END"
    )
    return per.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("videos"), F.sum("n").alias("events"), F.count_if(F.col("n") > heavy).alias("heavy")
    )


def purest_videos(
    df: DataFrame, k: int = 10, video: str = "video", label: str = "behavior", minority: str = "tail",
    majority: str = "ear"
) -> DataFrame:
    """video, n, ear, tail of the k videos with most events among those of one class only (ties by the video)."""
    per = df.groupBy(video).agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == majority).alias("ear"),
        F.count_if(F.col(label) == minority).alias("tail")
    )
    return per.where("(ear > 0) <> (tail > 0)").orderBy(F.desc("n"), video).limit(k)


def prob_clusters(
    preds: DataFrame, least: int = 3, score: str = "prob_tail", true: str = "true_label", positive: str = "tail",
    digits: int = 4
) -> DataFrame:
    """value (half-even to 4 digits), n, positives of scores that occur `least` times or more."""
    return preds.groupBy(F.bround(score, digits).alias("value")).agg(
        F.count("*").alias("n"), F.count_if(F.col(true) == positive).alias("positives")
    ).where(F.col("n") >= least)


def _report_parts(
    preds: DataFrame, ood: str, replicates: int, method: str, label: str
) -> dict[str, tuple[DataFrame, list[str]]]:
    """section: (table, the columns that name its rows; none where it has one row)."""
    known = preds.where(~F.col(ood))
    scored = preds.withColumn("score", ood_scores([F.col("prob_ear"), F.col("prob_tail")], method))
    parts = {
        "binary": (binary_metrics(known), []), "curve": (curve_metrics(threshold_curve(known)), []),
        "calibration": (ece(known), []),
        "confusion": (confusion_matrix(known).select("true_label", "pred_label", "n"), ["true_label", "pred_label"]),
        "bootstrap": (bootstrap_ci(known, replicates), ["metric"]),
    }
    if not preds.where(ood).isEmpty():
        parts |= {
            "ood": (ood_metrics(scored), []), "ood_bootstrap": (bootstrap_ood(scored, replicates), ["metric"]),
            "ood_breakdown": (ood_breakdown(scored.where(ood), label, "score"), [label]),
            "selective": (selective_curve(scored.where(~F.col(ood)), confidence="score"), ["step"]),
        }
    return parts


def report_rows(
    preds: DataFrame, ood: str = "is_ood", replicates: int = 1000, method: str = "msp", label: str = "label"
) -> DataFrame:
    """section, item, metric, value: the report as rows; item names a row of a section that has several."""
    out = None
    for section, (df, keys) in _report_parts(preds, ood, replicates, method, label).items():
        item = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("item")
        values = [F.col(c).cast("double").alias(c) for c in df.columns if c not in keys]
        rows = df.select(item, *values).unpivot("item", [c for c in df.columns if c not in keys], "metric", "value")
        rows = rows.select(F.lit(section).alias("section"), "item", "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def evaluate_report(
    preds: DataFrame, ood: str = "is_ood", replicates: int = 1000, method: str = "msp", label: str = "label"
) -> DataFrame:
    """One row with `report`, a JSON text: metrics, confusion, calibration and bootstrap of the known rows, and the
    out-of-distribution metrics, their bootstrap, the breakdown by `label` and the selective curve of the known rows where
    there are such rows. The scored rows are read once a part."""
    rows = None
    for section, (df, keys) in _report_parts(preds, ood, replicates, method, label).items():
        one = F.array_sort(F.collect_list(F.struct("*"))) if keys else F.first(F.struct("*"))
        part = df.agg(one.alias(section))
        rows = part if rows is None else rows.crossJoin(part)  # one row each
    return rows.select(F.to_json(F.struct("*")).alias("report"))


def match_by_tiou(preds: DataFrame, truth: DataFrame, iou: float, video: str = "video") -> DataFrame:
    """Predictions (pred_id, video, start_sec, end_sec, score) with the best overlapping truth (truth_id) of their own
    video: pred_id, truth_id, tiou, is_match. Of predictions that want the same truth, the highest score has it.

    Intervals are put into bins of ten minutes, so that only neighbours in time are compared."""
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 600), F.floor(F.col(b) / 600)))
    left = preds.withColumn("_bin", cut("start_sec", "end_sec"))
    right = truth.select(
        video, "truth_id", F.col("start_sec").alias("s"), F.col("end_sec").alias("e")
    ).withColumn("_bin", cut("s", "e"))
    both = F.least("end_sec", "e") - F.greatest("start_sec", "s")
    met = left.join(right, [video, "_bin"]).where(both > 0).withColumn(
        "tiou", F.round(both / (F.greatest("end_sec", "e") - F.least("start_sec", "s")), 6)
    )
    pairs = met.select("pred_id", "truth_id", "score", "tiou").distinct()
    best = pairs.withColumn(
        "_r", F.row_number().over(Window.partitionBy("pred_id").orderBy(F.desc("tiou"), "truth_id"))
    ).where("_r = 1")
    owner = F.row_number().over(Window.partitionBy("truth_id").orderBy(F.desc("score"), "pred_id"))
    return best.withColumn("_o", F.when(F.col("tiou") >= iou, owner)).select(
        "pred_id", "truth_id", "tiou",
        F.coalesce((F.col("_o") == 1) & (F.col("tiou") >= iou), F.lit(False)).alias("is_match")
    )


def map_at_tiou(preds: DataFrame, truth: DataFrame, ious: Sequence[float] = (0.3, 0.5, 0.7)) -> DataFrame:
    """iou, average_precision (6 decimals): matches by descending score, steps of precision over all truths."""
    from functools import reduce

    total = truth.agg(F.count("*").alias("_truths"))
    out = []
    for iou in ious:
        hit = match_by_tiou(preds, truth, iou).where("is_match").select("pred_id", F.lit("p").alias("y"))
        rows = preds.select("pred_id", "score").join(hit, "pred_id", "left").fillna("n", ["y"])
        curve = threshold_curve(rows, "score", "y", "p")
        ap = curve.agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s")).crossJoin(total)
        out.append(
            ap.select(
                F.lit(iou).alias("iou"),
                F.round(F.coalesce("s", F.lit(0.0)) / F.col("_truths"), 6).alias("average_precision")
            )
        )
    return reduce(DataFrame.unionByName, out)


def error_breakdown(
    preds: DataFrame, columns: Sequence[str], true: str = "true_label", pred: str = "pred_label"
) -> DataFrame:
    """columns (null: all), n, errors: for every combination."""
    return preds.cube(*columns).agg(F.count("*").alias("n"), F.count_if(F.col(true) != F.col(pred)).alias("errors"))


def abstain_curve(
    preds: DataFrame, grid: Sequence[float] = (0.5, 0.6, 0.7, 0.8, 0.9), confidence: str = "msp",
    true: str = "true_label", pred: str = "pred_label"
) -> DataFrame:
    """threshold, coverage, accuracy of the rows that are sure enough."""
    points = preds.sparkSession.createDataFrame([(float(t),) for t in grid], "threshold double")
    hit = F.col(confidence) >= F.col("threshold")
    rows = preds.crossJoin(F.broadcast(points)).groupBy("threshold").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("k"),
        F.count_if(hit & (F.col(true) == F.col(pred))).alias("c")
    )
    return rows.select(
        "threshold", F.round(F.col("k") / F.col("n"), 6).alias("coverage"),
        F.when(F.col("k") > 0, F.round(F.col("c") / F.col("k"), 6)).alias("accuracy")
    )
