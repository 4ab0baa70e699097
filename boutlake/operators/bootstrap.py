"""Bootstrap of metrics: named ones as SQL over weighted sums, the user's own as SQL or as a function.

A row takes part in a replicate with a Poisson(1) weight. The sum of such weights over n rows is Poisson(n), so that rows
which a metric can't tell apart are counted first and get one draw together: what is drawn and shuffled doesn't depend on
the number of rows. Rows are told apart by

* the pattern of a metric's cells (bootstrap_ci): a few patterns, a draw for each and replicate; with a `key` every row
  draws for itself instead, in the task that reads it;
* the distinct scores (bootstrap_ood): sums along the scores are made in ranges within a replicate;
* the distinct rows of the columns that a function asks for (bootstrap_custom): at most `most_rows`, counted before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.det import numbered, poisson_draws, stored, uniforms, with_poisson

#: Points of a replicate that one task sums up, replicates that it does at a time, and draws of a task.
POINTS, BAND, DRAWS = 20_000, 50, 2_000_000
#: Rows whose own draws a task holds at once.
KEYS = 1_000

#: What the four cells count, for columns true_label, pred_label and the positive class 'tail'.
BINARY_CELLS = {
    "tp": "true_label = 'tail' and pred_label = 'tail'", "fp": "true_label <> 'tail' and pred_label = 'tail'",
    "fn": "true_label = 'tail' and pred_label <> 'tail'", "tn": "true_label <> 'tail' and pred_label <> 'tail'",
}


@dataclass(frozen=True)
class Metric:
    """value: SQL over the cells' sums (doubles). cells: SQL conditions on a row. needs: SQL over the sums; replicates without
    it don't count."""

    value: str
    cells: Mapping[str, str] = field(default_factory=lambda: BINARY_CELLS)
    needs: str = "tp + fn > 0 and fp + tn > 0"


def over(a: str, b: str) -> str:
    """SQL of a ratio that is 0 where there is nothing to divide by."""
    return f"coalesce(try_divide({a}, {b}), 0D)"


_F1_POS, _F1_NEG = over("2 * tp", "2 * tp + fp + fn"), over("2 * tn", "2 * tn + fp + fn")
_RECALL_POS, _RECALL_NEG = over("tp", "tp + fn"), over("tn", "tn + fp")

#: The metrics that are known by name; register_metric adds to them.
METRICS: dict[str, Metric] = {
    "f1_pos": Metric(_F1_POS), "f1_neg": Metric(_F1_NEG), "macro_f1": Metric(f"({_F1_POS} + {_F1_NEG}) / 2"),
    "precision_pos": Metric(over("tp", "tp + fp")), "recall_pos": Metric(_RECALL_POS),
    "recall_neg": Metric(_RECALL_NEG),
    "balanced_accuracy": Metric(f"({_RECALL_POS} + {_RECALL_NEG}) / 2"),
    "mcc": Metric(over("tp * tn - fp * fn", "sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))")),
}
BUILT_IN = tuple(METRICS)


def register_metric(name: str, value: str, cells: Mapping[str, str] | None = None, needs: str = "true") -> Metric:
    """Makes a metric known by a name, from then on in this process. A name that has another meaning already is an error."""
    metric = Metric(value, BINARY_CELLS if cells is None else dict(cells), needs)
    if METRICS.setdefault(name, metric) != metric:
        raise ValueError(f"there is another metric {name}")
    return metric


def _interval(long: DataFrame) -> DataFrame:
    """metric, mean, low, high, std from metric, value: a row per replicate and metric."""
    six = lambda c, n: F.round(c, 6).alias(n)
    low, high = (F.percentile("value", F.lit(q)) for q in (0.025, 0.975))
    return long.groupBy("metric").agg(
        six(F.avg("value"), "mean"), six(low, "low"), six(high, "high"), six(F.stddev_pop("value"), "std")
    )


def poisson_one() -> list[float]:
    """P(X <= k) of a Poisson variable with mean 1, k from 0 to 9, 12 decimals."""
    return [round(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)), 12) for k in range(10)]


def _row_draws(
    replicates: int, seed: int, parts: Iterator[pd.DataFrame]
) -> Iterator[pd.DataFrame]:
    """pattern, replicate, w: what a task's rows (pattern, key) weigh together, each with its own draws."""
    numbers, steps, sums = [*range(1, replicates + 1)], poisson_one(), {}
    for part in parts:
        for pattern, keys in part.groupby("pattern")["key"]:
            for at in range(0, len(keys), KEYS):
                u = uniforms([f"{seed}|{k}" for k in keys.iloc[at : at + KEYS]], numbers)
                sums[pattern] = sums.get(pattern, 0) + np.searchsorted(steps, u, side="right").sum(axis=0)
    for pattern, w in sums.items():
        yield pd.DataFrame({"pattern": pattern, "replicate": numbers, "w": w})


def _grid(spark: SparkSession, replicates: int) -> DataFrame:
    """replicate from 1 on, dealt out by it, so that what is joined to it is grouped by it where it is."""
    grid = spark.range(1, replicates + 1).select(F.col("id").alias("replicate"))
    return grid.repartition(max(1, min(replicates, spark.sparkContext.defaultParallelism)), "replicate")


def bootstrap_values(
    preds: DataFrame, metrics: Sequence[str | tuple[str, Metric]] = BUILT_IN, replicates: int = 1000,
    seed: int = 42, key: str | None = None
) -> DataFrame:
    """metric, replicate, value of the replicates that have what the metric needs. metrics: names, or names with a Metric.
    key: a column that tells rows apart, by which each draws its own weight; without, a pattern's rows draw together."""
    chosen = {m: METRICS[m] if isinstance(m, str) else m for m in metrics if isinstance(m, str)}
    chosen |= {name: metric for name, metric in (m for m in metrics if not isinstance(m, str))}
    parts = []
    for cells in {
        tuple(sorted(m.cells.items())): m.cells for m in chosen.values()
    }.values():  # metrics with the same cells share the draws
        names = [*cells]
        marks = [F.when(F.expr(c), "1").otherwise("0") for c in cells.values()]
        if key is None:
            counts = preds.groupBy(F.concat(*marks).alias("pattern")).agg(F.count("*").alias("n"))
            few = F.broadcast(counts)  # a row per pattern: 2 ** cells at most
            drawn = with_poisson(
                _grid(preds.sparkSession, replicates).crossJoin(few), "w", "n", seed, "pattern", "replicate"
            )
        else:
            said = F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key")
            tasks = max(
                preds.sparkSession.sparkContext.defaultParallelism, -(-preds.count() * replicates // (10 * DRAWS))
            )
            drawn = preds.select(F.concat(*marks).alias("pattern"), said).repartition(tasks).mapInPandas(
                partial(_row_draws, replicates, seed), "pattern string, replicate long, w long"
            )
        sums = [
            F.sum(F.when(F.substring("pattern", i + 1, 1) == "1", F.col("w")).otherwise(0)).cast("double").alias(c)
            for i, c in enumerate(names)
        ]
        of = {n: m for n, m in chosen.items() if m.cells == cells}
        values = [F.when(F.expr(m.needs), F.expr(m.value)).cast("double").alias(n) for n, m in of.items()]
        rows = drawn.groupBy("replicate").agg(*sums).select("replicate", *values)
        parts.append(
            rows.unpivot(
                "replicate", [*of], "metric", "value"
            ).where(F.col("value").isNotNull()).select("metric", "replicate", "value")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bootstrap_ci(
    preds: DataFrame, replicates: int = 1000, seed: int = 42,
    metrics: Sequence[str | tuple[str, Metric]] = BUILT_IN, key: str | None = None
) -> DataFrame:
    """A row per metric: metric, mean, low, high (2.5 and 97.5 %), std (population), over replicates that have what it needs."""
    return _interval(bootstrap_values(preds, metrics, replicates, seed, key))


def bootstrap_custom(
    preds: DataFrame, metric: Callable[[pd.DataFrame], float | None], columns: Sequence[str],
    replicates: int = 1000, seed: int = 42, name: str = "custom", most_rows: int = 200_000
) -> DataFrame:
    """The same for a metric that SQL can't express: `metric` gets a frame of the columns and `weight`, a row per distinct row
    that takes part, and returns a number, or None where the replicate doesn't count.

    The distinct rows go to every task, so they are counted first: more than `most_rows` is an error. Coarsen the columns
    then (round scores), or write the metric as SQL.
    """
    distinct = stored(preds.groupBy(*columns).agg(F.count("*").alias("_n")), "bootstrap-rows")
    if (found := distinct.count()) > most_rows:
        raise ValueError(f"{found} distinct rows of {list(columns)}, at most {most_rows} go to a task")
    spark = preds.sparkSession
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in columns]
    named = distinct.withColumn("_key", F.concat_ws("|", *said))
    rows = with_poisson(
        _grid(spark, replicates).crossJoin(F.broadcast(named)), "weight", "_n", seed, "_key", "replicate"
    )

    def one(part: pd.DataFrame) -> pd.DataFrame:
        value = metric(
            part[part["weight"] > 0].drop(columns="replicate")
        )  # a filter in Spark would be pushed down and draw again
        return pd.DataFrame({"metric": [name], "value": [None if value is None else float(value)]})

    long = rows.select("replicate", *columns, "weight").groupBy("replicate").applyInPandas(
        one, "metric string, value double"
    )
    return _interval(long.where("value is not null"))


def bootstrap_ood(
    scores: DataFrame, replicates: int = 1000, seed: int = 42, score: str = "score", ood: str = "is_ood"
) -> DataFrame:
    """metric (auroc, aupr_ood, fpr_at_95tpr), mean, low, high, std as bootstrap_ci, over replicates that have rows of both
    sides: both are resampled. Rows without a score are left out.

    Distinct scores are counted and numbered once. Each gets a Poisson draw for either side in each replicate, and sums
    from the top are made in two levels: in ranges of POINTS scores, after the sums of the ranges above. A task makes the
    draws of a range for BAND replicates at a time where they are needed, so that no draw is shuffled or kept.
    """
    known = scores.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(ood).alias("o"))
    points = known.groupBy("s").agg(F.count_if(~F.col("o")).alias("ids"), F.count_if("o").alias("oods"))
    points = stored(numbered(points, "s", "place"), "bootstrap-points")
    tasks = max(scores.sparkSession.sparkContext.defaultParallelism, -(-points.count() * replicates // DRAWS))
    dealt = lambda df: df.repartition(tasks, "range", "band")
    parts = dealt(points.select(
        F.expr(f"place div {POINTS}").alias("range"), F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // BAND))).alias("band"),
        "place", "ids", "oods"
    ))
    sums = parts.groupBy("range", "band").applyInPandas(
        partial(_range_sums, replicates, seed), "range long, replicate long, p long, n long"
    )
    own = Window.partitionBy("replicate")
    above = own.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    sums = sums.select(
        "range", F.expr(f"cast((replicate - 1) div {BAND} as int)").alias("band"), "replicate", before("p").alias("p0"),
        before("n").alias("n0"), F.sum("p").over(own).alias("np"), F.sum("n").over(own).alias("nn")
    )
    curve = parts.groupBy("range", "band").cogroup(dealt(sums).groupBy("range", "band")).applyInPandas(
        partial(_range_curve, replicates, seed), "replicate long, np long, nn long, auroc double, aupr double, fpr double"
    )
    values = curve.where("np > 0 and nn > 0").groupBy("replicate").agg(
        F.sum("auroc").alias("auroc"), F.sum("aupr").alias("aupr_ood"),
        F.coalesce(F.min("fpr"), F.lit(1.0)).alias("fpr_at_95tpr"),
    )
    return _interval(values.unpivot([], ["auroc", "aupr_ood", "fpr_at_95tpr"], "metric", "value"))


def _range_draws(replicates: int, seed: int, part: pd.DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The replicates of a band, and the draws of either side for a range's scores from the top: a row per score."""
    part, first = part.sort_values("place", ascending=False), int(part["band"].iloc[0]) * BAND + 1
    numbers = [*range(first, min(first + BAND, replicates + 1))]
    draws = lambda tag, n: poisson_draws([f"{seed}|{p}|{tag}" for p in part["place"]], part[n].to_numpy(), numbers)
    return numbers, draws("id", "ids"), draws("ood", "oods")


def _range_sums(replicates: int, seed: int, part: pd.DataFrame) -> pd.DataFrame:
    numbers, pos, neg = _range_draws(replicates, seed, part)
    return pd.DataFrame({"range": int(part["range"].iloc[0]), "replicate": numbers, "p": pos.sum(axis=0), "n": neg.sum(axis=0)})


def _range_curve(replicates: int, seed: int, part: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
    """Of a range: its shares of both areas, and the least rate of OOD rows at a score that keeps 95 % of the known ones."""
    numbers, pos, neg = _range_draws(replicates, seed, part)
    p0, n0, np_, nn = (sums.sort_values("replicate")[c].to_numpy() for c in ("p0", "n0", "np", "nn"))
    tp, fp = p0 + pos.cumsum(axis=0), n0 + neg.cumsum(axis=0)
    below, under = nn - fp + neg, np_ - tp + pos  # OOD and known rows at this score or below
    with np.errstate(divide="ignore", invalid="ignore"):  # replicates without a side don't count
        auroc = (neg * (tp - pos / 2) / np_ / nn).sum(axis=0)
        aupr = np.where(neg > 0, neg / nn * below / (below + under), 0.0).sum(axis=0)
        fpr = np.where(tp / np_ >= 0.95, fp / nn, np.inf).min(axis=0)
    fpr = pd.Series(fpr).astype(object).where(np.isfinite(fpr), None)
    return pd.DataFrame({"replicate": numbers, "np": np_, "nn": nn, "auroc": auroc, "aupr": aupr, "fpr": fpr})
