"""Nearest neighbours by cosine with a block matrix join.

Queries and candidates are dealt into groups of bounded size by a hash of their rows, and each pair of groups is a tile
of one task (the stated queries against all rows, in blocks). In a tile the vectors are scaled to length 1 and stored as
int8 with a scale of their own. A product of int8 blocks gives each cosine up to a bound that follows from the two
vectors' quantisation errors: with u = u' + du, |u.v - u'.v'| <= |du| + |dv| + |du||dv|. Pairs whose upper bound falls
short of the k-th best lower bound of their query are out. The survivors are recomputed in double precision, and a
heap of k entries per query takes them in block by block; a query's heaps of all tiles are merged by a heap of k entries
in the task that owns the query. So the result is exact.

Vectors are divided by a power of two near their largest component before anything is squared, which changes no cosine and
keeps the squares of any finite vector in range.

Both groups of a tile have about TILE_BYTES of vectors: with square tiles the candidates are copied once for every
TILE_BYTES of queries, and not once for every block of an int8 product.

Rows with the same id and vector are counted with map-side partials before they are dealt out, so that a row which a
share of the table repeats is one candidate and one query, with its number. Equal vectors of different ids within a tile
are one candidate with its k + 1 smallest ids: more can't be among a query's k nearest. Only vectors of the query's
dimension are candidates.

Rows: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids; ties go
to the smaller id. A row is not its own candidate, but other rows with the query's id are. Rows with the same id, and
repeated rows, are one candidate and one query each. An empty table gives no rows. Only the id and the vector are read, so
that columns of any other name play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import begun, given_back, stored, struct

#: Bytes of vectors of a candidate group and of a query group, and vectors of either side of a block of an int8 product.
TILE_BYTES, BLOCK = 8 << 20, 2_048


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, good) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and the lengths of what is lost."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    q = np.rint(unit / scale).astype(np.int8)
    lost = np.sqrt(((unit - q * scale) ** 2).sum(axis=1))
    return q, scale[:, 0], lost + 1e-9


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products, summed in the order of the components, so that equal vectors get equal sums."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _scaled(v: np.ndarray) -> np.ndarray:
    """Divided by a power of two, so that the largest component of a row is between 1/2 and 1."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, times: np.ndarray, k: int, own: bool) -> Iterator[tuple[int, int, float]]:
    """(place of the query, id, score). times: how many rows a candidate stands for. own: the queries are rows of the candidates."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c, times = c_ids[order], c[order], np.minimum(times[order], k + 1)
    raw = np.ascontiguousarray(c).view([("", c.dtype)] * c.shape[1]).ravel()
    _, first, which = np.unique(raw, return_index=True, return_inverse=True)
    c_ids, which = np.repeat(c_ids, times), np.repeat(which, times)
    by = np.argsort(which, kind="stable")
    begin = np.searchsorted(which[by], np.arange(len(first)))
    same = [c_ids[by[b : min(b + k + 1, e)]].tolist() for b, e in zip(begin, [*begin[1:], len(by)])]
    place = {x.tobytes(): j for j, x in enumerate(raw[first])} if own else {}
    c = _scaled(c[first])
    cn = np.sqrt(_dots(c, c))
    codes = (c, cn, *_quantised(c / cn[:, None]))
    for at in range(0, len(q), BLOCK):
        part = q[at : at + BLOCK]
        mine = [place.get(x.tobytes(), -1) for x in np.ascontiguousarray(part)]
        for i, other, score in _block(q_ids[at : at + BLOCK], _scaled(part), mine, codes, same, k):
            yield at + i, other, score


def _block(q_ids: np.ndarray, q: np.ndarray, mine: list[int], codes: tuple, same: list[list[int]], k: int) -> Iterator[tuple[int, int, float]]:
    """The heaps of a block of queries over all candidates of a tile."""
    c, cn, c8, cs, cl = codes
    qn = np.sqrt(_dots(q, q))
    q8, qs, ql = _quantised(q / qn[:, None])
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    # Sums of products of int8 are exact in float32 below 2 ** 24, else in float64.
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    left = q8.astype(kind)
    floor = np.full(len(q), -np.inf)
    for at in range(0, len(c), BLOCK):
        to = min(at + BLOCK, len(c))
        near = (left @ c8[at:to].astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, at:to]
        slack = ql[:, None] + cl[None, at:to] + ql[:, None] * cl[None, at:to]
        low = near - slack
        if to - at > k:  # of k + 1 candidates, one may be the query itself
            floor = np.maximum(floor, -np.partition(-low, k, axis=1)[:, k])
        rows, cols = np.nonzero(near + slack >= floor[:, None])
        for part in range(0, len(rows), 200_000):
            r, s = rows[part : part + 200_000], cols[part : part + 200_000] + at
            scores = _dots(q[r], c[s]) / (qn[r] * cn[s])
            for i, j, score in zip(r.tolist(), s.tolist(), np.clip(scores, -1.0, 1.0).tolist()):
                heap = heaps[i]
                if len(heap) == k and score < heap[0][0]:
                    continue
                others = same[j]
                if j == mine[i] and q_ids[i] in others:  # one of the rows with the query's id and vector is the query
                    others = [*others]
                    others.remove(q_ids[i])
                for ident in others:
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -ident))
                    elif (score, -ident) > heap[0]:
                        heapq.heapreplace(heap, (score, -ident))
        full = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        floor = np.maximum(floor, full - 1e-9)
    for i, heap in enumerate(heaps):
        for score, other in heap:
            yield i, -other, score


def nearest(candidates: DataFrame, queries: DataFrame | Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest candidates. Queries are the candidates' rows for
    which a condition holds (then each row's own is left out), or a table of other rows (then none is)."""
    own = isinstance(queries, Column)

    def merged(df: DataFrame, asked: Column, label: str) -> DataFrame:
        """id, v, n and asked: how many rows are alike, and how many of them are queries."""
        v = F.col(f"`{vector_col}`").cast("array<double>")
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), F.coalesce(asked.cast("long"), F.lit(0)).alias("asked"))
        rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id", "v").agg(F.count("*").alias("n"), F.sum("asked").alias("asked"))
        return stored(rows.withColumn("d", F.size("v")).withColumn("row", F.monotonically_increasing_id()), label)  # its number stays

    right = merged(candidates, queries if own else F.lit(False), "neighbour-rows")
    left = (right if own else merged(queries, F.lit(True), "neighbour-queries")).where("asked > 0").withColumnRenamed("row", "query")

    def groups(df: DataFrame) -> int:
        return -(-df.agg(F.coalesce(F.sum(F.col("d") * 8), F.lit(0))).first()[0] // TILE_BYTES) or 1

    n_left, n_right = groups(left), groups(right)
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    left = left.select("query", "id", "v", "d", "asked", deal(n_left).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))).alias("h"))
    right = right.select("id", "v", "d", "n", deal(n_right).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("g"))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        begun(lambda: None)
        found: list[tuple[int, int, float]] = []
        if len(a) and len(b):
            (q_ids, q), (c_ids, c) = (
                (t["id"].to_numpy(), t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)) for t in (a, b)
            )
            found = [*_tile(q_ids, q, c_ids, c, b["n"].to_numpy(), k, own)]
        at, others, scores = [*zip(*found)] or [[], [], []]
        which = pa.array(at, pa.int64())
        columns = [*(a[n].take(which) for n in ("query", "id", "asked")), pa.array(others, pa.int64()), pa.array(scores, pa.float64())]
        return pa.table(columns, names=["query", "query_id", "asked", "vec_id", "score"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The heaps of all tiles, which come by query, into one heap of k; asked stays beside it."""
        at, heap = None, []

        def out() -> pa.RecordBatch:
            best = sorted(heap, reverse=True)
            columns = [[at[1]] * len(best), [*range(1, len(best) + 1)], [-x for _, x in best], [x for x, _ in best], [at[2]] * len(best)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "rank", "vec_id", "score", "asked"])

        for batch in batches:
            for query, ident, asked, other, score in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if at != (query, ident, asked):
                    if heap:
                        yield out()
                    at, heap = (query, ident, asked), []
                heapq.heappush(heap, (score, -other))
                if len(heap) > k:
                    heapq.heappop(heap)
        if heap:
            yield out()
        given_back()

    keys = ("g", "h", "d")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, struct("query long, query_id long, asked long, vec_id long, score double"))
    best = near.repartition("query").sortWithinPartitions("query").mapInArrow(merge, struct("query_id long, rank int, vec_id long, score double, asked long"))
    return best.withColumn("asked", F.explode(F.sequence(F.lit(1).cast("long"), "asked"))).drop("asked")
