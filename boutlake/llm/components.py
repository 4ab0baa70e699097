"""Connected components of a table of links, by rounds of large and small stars; nothing reaches the driver but counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import given_back, stored, struct

#: Nodes of a forest that a task holds at most before it gives it out and begins a new one.
FOREST = 200_000


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: a, b (long). Returns node, component: the smallest node reachable, for every node that has a link.

    A round begins with what each task can settle among the links that it has read: they become stars around the
    smallest node (`_forests`), so that chains and repeated links are gone before anything is shuffled. Then a large
    star links all larger neighbours of a node to the smallest of its neighbourhood, a small star its smaller ones.
    When a round changes nothing, every node is linked with its component's smallest alone. Both stars are a minimum
    per node with map-side partials and a join back, so that a hub of any size is no task's own (AQE splits it).

    Rounds grow with the logarithm of the longest chain; RuntimeError if `most_rounds` don't settle it.
    """
    edges = stored(_forests(links.select("a", "b")), "links")
    if edges.count() <= FOREST // 2:  # a forest that one task holds is settled
        edges, most_rounds = stored(_forests(edges.coalesce(1)), "links"), 0
    for _ in range(most_rounds):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = stored(_forests(small.where("a <> b").distinct()), "links")
    else:
        if most_rounds:
            raise RuntimeError("components did not settle")
    return edges.unionByName(edges.select(F.col("b").alias("a"), "b")).distinct().toDF("node", "component")


def _settled(edges: DataFrame) -> bool:
    """Whether every node is linked once, with a node that is not linked further."""
    ends = edges.distinct().select("a", F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up")))
    odd = ends.groupBy("a").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 1 or (ups = 1 and n > 1)")
    return odd.isEmpty()


def _forests(links: DataFrame) -> DataFrame:
    """Each task's links as stars: (a, b) with b the smallest node that the task's links (or a part of them) connect a with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.get(top, top)) != top:
                top = up
            while x != top:
                root[x], x = top, root.get(x, x)
            return top

        def out() -> pa.RecordBatch:
            rows = [(x, find(x)) for x in root]
            rows = [(x, y) for x, y in rows if x != y]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, q = find(a), find(b)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    root.setdefault(min(p, q), min(p, q))
            if len(root) > FOREST:
                yield out()
                root.clear()
        if root:
            yield out()
        root.clear()
        given_back()

    return links.mapInArrow(run, struct("a long, b long"))
