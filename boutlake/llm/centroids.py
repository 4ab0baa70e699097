"""Centroid clustering (Lloyd's rounds in whole numbers) with bounds that are tightened by geometry.

A vector keeps two bounds: `upper`, no less than its distance to its own centroid, and `lower`, no more than the distance to
any other. While upper < lower nothing can be nearer, and the vector isn't looked at. When centroids move, upper grows by
its own centroid's move. lower would shrink by the largest move of any other; but a cluster's vectors lie in a sphere around
its centroid o (radius: the largest upper), and for another centroid that moves from c to c2, in the plane of o, c and c2:
with the middle m of c and c2 and x at the angle t from the move's direction, seen from m,
    d(x, c) - d(x, c2) = 2 <x - m, c2 - c> / (d(x, c) + d(x, c2)) <= |c2 - c| cos t,   as d(x, c) + d(x, c2) >= 2 |x - m|,
and no x of the sphere has an angle below that of o less asin(radius / |o - m|). So a cluster's lower bounds shrink by the
largest |c2 - c| cos of that angle (0 from a right angle on, and all of the move only where m lies in the sphere), which is
less than the full drift. A cluster also has half of the distance to the next centroid: nearer than that is its own.
Vectors that these bounds leave open are measured against their own centroid, and if still open, against all, exactly.

Distances are whole numbers: in doubles where all sums are below 2**53 (components up to 2**22), else Python's integers.
Centroids are floor(sum / count) of exact sums. A round writes its state to the shared folder (cut of the lineage, lost executors);
the driver holds the centroids and, per cluster, a count, a radius and sums, nothing per vector. Sums are carried on from
the vectors that changed, so that later rounds read few.

Rows: vectors that are null, not of `size` components, or have null or non-finite ones are left out (no row); zero vectors and
repeated rows take part; a null vec_id is kept, but is a first centroid only if there aren't enough others; of equal ids, the
smaller components are first. Fewer vectors than clusters: as many clusters as vectors; empty tables give no rows. A component
or a distance that doesn't fit in 64 bits is an error. Only the two columns are read, others of any name play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, stored, struct

#: Components up to this are measured in doubles, exactly.
SMALL = 1 << 22
#: Bounds are widened by this share, for rounding.
SLACK = 1e-9

_STATE = struct("vec_id long, v longs, was int, cluster int, upper double, lower double")


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, size: int, scale: int) -> DataFrame:
    """vec_id, v (floor(scale * x)) of the rows that take part."""

    def make() -> object:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            lists = batch.column(1)
            right = np.flatnonzero(np.array(lists.value_lengths().fill_null(-1)) == size)
            kept = lists.take(pa.array(right))
            values = kept.flatten()
            x = np.floor(values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, size) * scale)
            good = np.isfinite(values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, size)).all(axis=1)
            x, right = x[good], right[good]
            if len(x) and not (np.abs(x) < 2.0**62).all():
                raise OverflowError("a component doesn't fit in 64 bits")
            whole = x.astype(np.int64)
            yield {"vec_id": batch.column(0).take(pa.array(right)), "v": pa.ListArray.from_arrays(np.arange(0, size * len(x) + 1, size, dtype=np.int32), whole.ravel())}

        return step

    return map_arrow(vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`")), make, struct("vec_id long, v longs"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x and rows of c, exact."""
    if max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))) <= SMALL and x.shape[1] <= 128:
        p, q = x.astype(np.float64), c.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * (p @ q.T)).astype(np.int64)
    p, q = x.astype(object), c.astype(object)
    return np.array([[((a - b) ** 2).sum() for b in q] for a in p], dtype=object).reshape(len(p), len(q))


def squared_own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The squared distance of each row of x and the same row of c, exact."""
    if max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))) <= SMALL:
        return ((x - c) ** 2).sum(axis=1)
    return ((x.astype(object) - c.astype(object)) ** 2).sum(axis=1)


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def loosening(o: np.ndarray, radius: float, c: np.ndarray, c2: np.ndarray) -> float:
    """At least the most by which a point of the sphere around o gets nearer to a centroid that moves from c to c2."""
    o, c, c2 = (np.asarray(x, np.float64) for x in (o, c, c2))
    move, seen = c2 - c, o - (c + c2) / 2
    drift, far = float(np.sqrt(move @ move)), float(np.sqrt(seen @ seen))
    if not drift:
        return 0.0
    if far <= radius * (1 + SLACK):
        return drift * (1 + SLACK)
    angle = np.arccos(np.clip(seen @ move / (drift * far), -1, 1)) - np.arcsin(min(1.0, radius / far))
    return drift * min(1.0, max(0.0, np.cos(max(0.0, angle))) + SLACK) * (1 + SLACK)


class Moved:
    """What a round's tasks get: old and new centroids, and for each cluster its own move, the loosening, half of the way to
    the next centroid."""

    def __init__(self, old: np.ndarray, new: np.ndarray, radius: dict[int, float]) -> None:
        k = len(new)
        self.new = new
        self.own = np.array([float(np.sqrt(float(squared_own(old[i : i + 1], new[i : i + 1])[0]))) for i in range(k)]) * (1 + SLACK)
        self.less = np.array([max((loosening(old[i], radius[i], old[j], new[j]) for j in range(k) if j != i), default=0.0) if i in radius else 0.0 for i in range(k)])
        between = roots(squared(new, new))
        np.fill_diagonal(between, np.inf)
        self.half = between.min(axis=1) / 2 * (1 - SLACK)


def nearest_two(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid (ties: the smaller number), the distance to it and to the nearest other."""
    d = squared(x, c)
    near = d.argmin(axis=1).astype(np.int64) if len(d) else np.zeros(0, np.int64)
    own = roots(d[np.arange(len(d)), near])
    rest = d.astype(np.float64)
    rest[np.arange(len(d)), near] = np.inf
    return near, own, np.sqrt(rest.min(axis=1, initial=np.inf))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size)


def assign_first(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """The state after the first assignment, which measures all."""
    shared = vectors.sparkSession.sparkContext.broadcast(c)

    def make() -> object:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            near, upper, lower = nearest_two(_matrix(batch.column(1), shared.value.shape[1]), shared.value)
            yield {"vec_id": batch.column(0), "v": batch.column(1), "was": np.full(len(near), -1, np.int32), "cluster": near.astype(np.int32), "upper": upper * (1 + SLACK), "lower": lower * (1 - SLACK)}

        return step

    return map_arrow(vectors, make, _STATE)


def reassigned(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: Moved) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower) after the move, and how many vectors had to be measured against all centroids."""
    cluster, upper = cluster.copy(), upper + moved.own[cluster]
    upper *= 1 + SLACK
    lower = np.maximum(lower - moved.less[cluster], 0.0) * (1 - SLACK)
    open_ = np.flatnonzero(~(upper < np.maximum(lower, moved.half[cluster])))
    if len(open_):
        upper[open_] = roots(squared_own(x[open_], moved.new[cluster[open_]])) * (1 + SLACK)
        open_ = open_[~(upper[open_] < np.maximum(lower[open_], moved.half[cluster[open_]]))]
    if len(open_):
        cluster[open_], own, other = nearest_two(x[open_], moved.new)
        upper[open_], lower[open_] = own * (1 + SLACK), other * (1 - SLACK)
    return cluster, upper, lower, len(open_)


def assign_again(state: DataFrame, moved: Moved) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(moved)

    def make() -> object:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            was = batch.column(3).to_numpy()
            upper, lower = (batch.column(i).to_numpy() for i in (4, 5))
            cluster, upper, lower, _ = reassigned(_matrix(batch.column(1), shared.value.new.shape[1]), was.astype(np.int64), upper, lower, shared.value)
            yield {"vec_id": batch.column(0), "v": batch.column(1), "was": was, "cluster": cluster.astype(np.int32), "upper": upper, "lower": lower}

        return step

    return map_arrow(state, make, _STATE)


def changes(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What vectors that have changed their cluster take and bring: sums (k x size) and counts, exact."""

    def make() -> object:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            x = _matrix(batch.column(0), size)
            x = x.astype(object) if len(x) and int(np.abs(x).max()) > (1 << 40) else x
            rows: list[tuple[int, list[str]]] = []
            for column, sign in ((1, -1), (2, 1)):
                own = batch.column(column).to_numpy()
                for c in np.unique(own[own >= 0]).tolist():
                    sums = x[own == c].sum(axis=0)
                    rows.append((c, [str(sign * int(s)) for s in [*sums, (own == c).sum()]]))
            yield {"cluster": [r[0] for r in rows], "sums": [r[1] for r in rows]}

        return step

    parts = map_arrow(state.where("was <> cluster").select("v", "was", "cluster"), make, struct("cluster int, sums strings"))
    parts = parts.select("cluster", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = np.zeros((k, size + 1), object)
    for r in parts.collect():  # k * (size + 1) rows at most
        out[r["cluster"], r["at"]] = int(r["s"])
    return out[:, :size], out[:, size]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """The last state (vec_id, v, cluster among its columns), and the centroids: first those of the smallest sha256 of
    'seed:vec_id', then `rounds` times assigned and moved to the floor of the mean, then assigned once more."""
    whole = stored(whole_vectors(vectors, id_col, vec_col, size, scale), "centroids-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = whole.orderBy(order.asc_nulls_last(), "v").limit(k).collect()  # k rows
    if not first:
        return whole.select("vec_id", "v", F.lit(0).alias("cluster")), np.zeros((0, size), np.int64)
    c = np.array([r["v"] for r in first], np.int64)
    state = stored(assign_first(whole, c), "centroids-state")
    sums, counts = np.zeros((len(c), size), object), np.zeros(len(c), object)
    for _ in range(rounds):
        more, times = changes(state, len(c), size)
        sums, counts = sums + more, counts + times
        new = np.array([[s // n for s in row] if n else old for row, n, old in zip(sums, counts, c.tolist())], np.int64)
        radius = {r["cluster"]: r["radius"] for r in state.groupBy("cluster").agg(F.max("upper").alias("radius")).collect()}  # a row per cluster
        state = stored(assign_again(state, Moved(c, new, radius)), "centroids-state")
        c = new
    return state, c


def measured(state: DataFrame, c: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared, exact)."""
    shared = state.sparkSession.sparkContext.broadcast(c)

    def make() -> object:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            own = batch.column(2).to_numpy()
            yield {"vec_id": batch.column(0), "cluster": batch.column(2), "distance": squared_own(_matrix(batch.column(1), shared.value.shape[1]), shared.value[own])}

        return step

    return map_arrow(state.select("vec_id", "v", "cluster"), make, struct("vec_id long, cluster int, distance long"))


def digest(state: DataFrame, c: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = stored(measured(state, c), "centroids-distances")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row per cluster
    total = sum(sums.values())
    info = [(i, s, total, hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i, s in sums.items()]
    named = state.sparkSession.createDataFrame(info, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
