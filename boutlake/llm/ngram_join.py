"""N-gram Jaccard join in the metric space of shingle sets, by pivots, windows and regions.

The Jaccard distance d(x, y) = 1 - |x & y| / |x | y| is a metric on sets; links are pairs with d <= r (r = 0.2 for a
similarity of 0.8). Between texts that share nothing it is 1, so a pivot far from two texts says nothing about them, and
pivots have to be near. They are taken in two layers.

First layer: sets of one shingle. The pivot {s} is at 1 - 1/|x| from x if x holds s, else at 1, so the pivots nearest to
x are its own shingles, all equally near; ties go by one global order, and the region of s are the texts whose first
shingle is s. The window: x and y with d(x, y) <= r differ in at most r|x| of x's shingles, so a first shared shingle
is among the first |x| - ceil((1 - r)|x|) + 1 of either in the order. A text is replicated to the regions of those, and
no link is lost. The order puts shingles that many texts hold last (they are counted over all texts), hash order else, so that
regions stay small. Distances to {s} also give rings (by size: sizes of linked texts differ by the factor 1 - r at most).
Of regions with the same texts the one that is first in the order does for all.

Second layer: texts. In rounds, each region is compared with one pivot of it (the first in an order of all texts, so that
regions share pivots), at most a pair for each text and region; links are verified on the full sets, linked texts become
components, and regions that are within one component are done. Rounds go on while they connect much. Of what is left,
only pairs across components are looked at. Regions of at most `REGION` texts join at once. Larger ones recurse to any
depth: two far texts of a region are pivots with measured distances; each text goes to its nearer pivot's cell and, by
the triangle inequality, also to the other if that is at most 2r farther. A region whose texts are too far from any
pivot for that is dealt out by the next one-shingle pivots instead: links share a second (third, ...) shingle within a
window that is longer by one (two, ...). Only what neither divides is joined in square blocks of `BLOCK` texts.

Pairs first meet bounds: the rings, what may still be shared from the region's shingle on, and sketches: counts of a set's
shingles by class are its distances to the classes, taken as pivots of the symmetric difference, so the sum of differences
is at most |x ^ y|, which is at most (|x| + |y|) r / (2 - r) for links. What is left is verified on the full sets.

That is for components: jaccard_join skips links between texts that other links already connect. jaccard_links skips none:
it takes all pairs of the same regions and cells. Its rows are as many as there are links, quadratic in a group of near copies.

Sets are sets of 64-bit hashes of shingles (see shingles.py), copies (equal sets) are one node, and nodes are told apart by
a second hash. So results are exact but for hashes that clash by chance: two given texts of a thousand shingles each are
held to share one shingle too many once in 10 ** 13 pairs.

Rows: null, empty and wordless texts have no set, n_shingles 0 and no links; fewer words than a shingle has make one
shingle of the whole; texts of any length are taken whole; a null doc_id may have links, and names no component unless
all of its ids are null; rows with the same id, or repeated rows, are texts of their own. An empty table gives no rows.
Only the id and the text are read, so that columns of any other name play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from ._common import BROADCAST_ROWS, begun, flag_table, given_back, map_arrow, stored, struct
from .components import components

#: Texts of a region whose pairs are made without sketches, and of a block.
REGION, BLOCK = 48, 512
#: Rounds of pivots go on while they link at least this share of the pairs they compare. That shifts work, not results.
WORTHWHILE = 0.25
#: Shingles in more texts than this are last in the order. Of these, the most frequent HOT_MOST are sent to the tasks.
HOT, HOT_MOST = 64, 1_000_000
#: Parts that the region of a frequent shingle is dealt out in.
PARTS = 64
#: The share of the hash range in which the shingles of all texts are counted at first. Texts whose windows reach beyond it are
#: counted in whole after that, so it shifts work only.
COUNTED = 0.3
TOP = np.uint64(int(COUNTED * (1 << 64)))

#: By turn: numbers of sets that two different sets had; these take the number of the next turn.
Clashes = tuple[frozenset[int], ...]


def window_size(n: int, percent: int) -> int:
    """How many first shingles hold the first one shared with any linked text."""
    return n - -(-percent * n // 100) + 1


def _node(own: np.ndarray, clashes: Clashes) -> int:
    """A number for a set."""
    for turn in range(len(clashes) + 1):
        node = xxhash.xxh3_64_intdigest(own, turn) - (1 << 63)
        if turn == len(clashes) or node not in clashes[turn]:
            break
    return node


def sketch(own: np.ndarray) -> bytes:
    """How many shingles of each class there are, up to 255; classes: a power of two, half of the set at least."""
    classes = 1 << max(6, (len(own) // 2 - 1).bit_length())
    return np.minimum(np.bincount((own >> np.uint64(8)).astype(np.int64) & (classes - 1), minlength=classes), 255).astype(np.uint8).tobytes()


def may_link(a: bytes, n: int, b: bytes, m: int, percent: int) -> bool:
    """False only if the sketches rule a link out."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.minimum(y.reshape(-1, len(x)).sum(axis=0), 255)
    return int(np.abs(x - y).sum()) * (100 + percent) <= (100 - percent) * (n + m)


def profiles(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, Clashes]:
    """doc_id, n, node, check, sketch for every row (no node where there is no set), and the numbers that clashed."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`"))

    def of(clashes: Clashes) -> DataFrame:
        def make() -> object:
            def step(batch: pa.RecordBatch) -> Iterator[dict]:
                found = [(len(own), _node(own, clashes), xxhash.xxh3_64_intdigest(own, 1 << 32) - (1 << 63), sketch(own)) if len(own) else (0, None, None, None) for own in shingles.sets(batch.column(1), words)]
                yield {"doc_id": batch.column(0)} | dict(zip(("n", "node", "check", "sketch"), zip(*found)))

            return step

        return stored(map_arrow(rows, make, struct("doc_id long, n long, node long, check long, sketch binary")), "join-profiles")

    clashes: Clashes = ()
    while True:  # numbers of two sets in 2 ** 64 clash: some 70 pairs of 5 * 10 ** 10 texts
        found = of(clashes)
        both = found.where("node is not null").groupBy("node").agg(F.min("check").alias("p"), F.max("check").alias("q")).where("p <> q")
        bad = frozenset(r["node"] for r in both.select("node").collect())
        if not bad:
            return found, clashes
        clashes = (*clashes, bad)


def frequent(docs: DataFrame, text_col: str, words: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of the shingles that more than HOT texts hold, of all that may come into a window; a table of flags of
    the counted ones that two texts hold at least).

    A window holds a text's first shingles that aren't frequent, by their hashes. So it is enough to count those in the
    lowest part of the hash range at first; a text that has too few infrequent ones there (as much of it is shared
    with many) is counted a second time, with all others of its shingles. Windows of other texts hold none of these,
    so that they are counted where they matter.
    """
    lowest, repeated = _often(docs, text_col, words, lambda own: own[: np.searchsorted(own, TOP)])
    shared = docs.sparkSession.sparkContext.broadcast(lowest)

    def rest(own: np.ndarray) -> np.ndarray:
        at = int(np.searchsorted(own, TOP))
        return own[at:] if in_order(own[:at], shared.value)[1] < window_size(len(own), percent) else own[:0]

    more, _ = _often(docs, text_col, words, rest)
    twice = flag_table(repeated.select(F.col("key").alias("h"), F.lit(1).alias("flags")), repeated.count())
    return np.union1d(lowest, more), twice


def alone(own: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Which shingles no other text holds: of the counted ones, those without a flag."""
    return (own < TOP) & (twice[(own & np.uint64(len(twice) - 1)).astype(np.int64)] == 0)


def _often(docs: DataFrame, text_col: str, words: int, part: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, DataFrame]:
    """Sorted hashes that are in a part of more than HOT texts, HOT_MOST at most; and key, c of those in two texts at least."""

    def make() -> object:
        seen: set[int] = set()

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            kept, held = [], 0

            def counted() -> dict:
                keys, n = np.unique(np.concatenate(kept), return_counts=True)
                return {"key": keys.view(np.int64), "c": n}

            for own in shingles.sets(batch.column(0), words):
                name = xxhash.xxh3_64_intdigest(own)
                if name in seen:  # a copy
                    continue
                if len(seen) < 200_000:
                    seen.add(name)
                if len(own := part(own)):
                    kept.append(own)
                    held += len(own)
                if held > 1 << 20:
                    yield counted()
                    kept, held = [], 0
            if kept:
                yield counted()

        return step

    counts = map_arrow(docs.select(F.col(f"`{text_col}`")), make, struct("key long, c long")).groupBy("key").agg(F.sum("c").alias("c"))
    many = stored(counts.where("c > 1"), "join-counts")
    least = HOT
    while many.where(F.col("c") > least).count() > HOT_MOST:  # the order may be any; less of it makes regions larger only
        least *= 2
    keys = many.where(F.col("c") > least).select("key").collect()
    return np.sort(np.array([r["key"] for r in keys], dtype=np.int64).view(np.uint64)), many


_ENTRIES = struct("key long, part int, node long, n int, place int")
_REGIONS = struct("key long, large boolean, nodes longs, ns ints, places ints")


def in_order(own: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, int]:
    """A set's shingles in the global order, and how many of them are not frequent."""
    if not len(hot):
        return own, len(own)
    is_hot = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own
    cold = own[~is_hot]
    return np.concatenate([cold, own[is_hot]]), len(cold)


def entries(docs: DataFrame, text_col: str, words: int, percent: int, hot: np.ndarray, twice: np.ndarray, clashes: Clashes) -> DataFrame:
    """A row for each text and shingle of its window: key, node, n, place in the text's order, and for frequent shingles a
    part from 1 on (else 0) that their region is dealt out by. Copies within a task come once. Shingles that are counted and
    no other text holds have no row: nothing meets there."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, twice))

    def make() -> object:
        seen: set[int] = set()
        order, twice = shared.value

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            rows, held = [], 0

            def out() -> dict:
                keys, places, names, sizes, colds = zip(*rows)
                many = [len(k) for k in keys]
                place = np.concatenate(places)
                part = np.where(place >= np.repeat(colds, many), 1 + np.repeat(np.array(names, np.int64) % PARTS, many), 0)
                return {"key": np.concatenate(keys).view(np.int64), "part": part, "node": np.repeat(names, many), "n": np.repeat(sizes, many), "place": place}

            for own in shingles.sets(batch.column(0), words):
                n = len(own)
                if 100 * n < percent * (n + 1):  # links with its copies alone
                    continue
                node = _node(own, clashes)
                if node in seen:
                    continue
                if len(seen) < 100_000:
                    seen.add(node)
                front, cold = in_order(own, order)
                front = front[: window_size(n, percent)]
                place = np.flatnonzero(~alone(front, twice))
                front = front[place]
                rows.append((front, place, node, n, cold))
                held += len(front)
                if held > 200_000:
                    yield out()
                    rows, held = [], 0
            if rows:
                yield out()

        return step

    return map_arrow(docs.select(F.col(f"`{text_col}`")), make, _ENTRIES)


def regions(rows: DataFrame) -> DataFrame:
    """From entries: regions of two texts or more. A row is a region of at most REGION texts (in ascending order), or one
    text of a larger one, or of a part of a frequent shingle's region (which may turn out to hold it alone)."""
    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(lambda: None)
        held: tuple[np.ndarray, ...] | None = None
        open_large = None  # the (key, part) that is open and has more than REGION texts

        def out(x: tuple[np.ndarray, ...], begin: np.ndarray, large: bool) -> pa.RecordBatch:
            ends = pa.array(np.append(begin, len(x[0])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(c.astype(kind))) for c, kind in ((x[2], np.int64), (x[3], np.int32), (x[4], np.int32))]
            return pa.RecordBatch.from_arrays([pa.array(x[0][begin]), pa.array(np.full(len(begin), large)), *lists], names=_REGIONS.names)

        def work(x: tuple[np.ndarray, ...], over: bool) -> Iterator[pa.RecordBatch]:
            """Gives out what is complete; the last region is held back unless all is over."""
            nonlocal held, open_large
            held = None
            new = np.concatenate([[True], (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1]) | (x[2][1:] != x[2][:-1])])  # copies from other tasks
            x = tuple(c[new] for c in x)
            if open_large is not None:
                rest = int(np.argmin(np.append((x[0] == open_large[0]) & (x[1] == open_large[1]), False)))
                if rest:
                    yield out(tuple(c[:rest] for c in x), np.arange(rest), True)
                if rest == len(x[0]):
                    return
                x, open_large = tuple(c[rest:] for c in x), None
            begin = np.flatnonzero(np.concatenate([[True], (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])]))
            size = np.diff(np.append(begin, len(x[0])))
            done = len(begin) if over else len(begin) - 1
            is_large, is_small = (size > REGION) | (x[1][begin] > 0), (size > 1) & (size <= REGION) & (x[1][begin] == 0)
            is_large[done:] = is_small[done:] = False
            for kind, large in ((is_small, False), (is_large, True)):
                if kind.any():
                    own = np.repeat(kind, size)
                    rows = tuple(c[own] for c in x)
                    yield out(rows, np.arange(len(rows[0])) if large else np.cumsum(size[kind]) - size[kind], large)
            if not over:
                tail = tuple(c[begin[-1] :] for c in x)
                if len(tail[0]) > REGION:
                    yield out(tail, np.arange(len(tail[0])), True)
                    open_large = (tail[0][0], tail[1][0])
                else:
                    held = tail

        for batch in batches:
            cols = tuple(batch.column(i).to_numpy().astype(np.int64) for i in range(5))
            if len(cols[0]):
                yield from work(cols if held is None else tuple(np.concatenate([h, c]) for h, c in zip(held, cols)), False)
        if held is not None:
            yield from work(held, True)
        given_back()

    return dealt.mapInArrow(run, _REGIONS)


def members_of(found: DataFrame) -> DataFrame:
    """region, node, n, place: a row for each text of the regions; of small regions with the same texts, the first."""
    first = F.min_by(F.struct("key", "ns", "places"), F.col("key").bitwiseXOR(F.lit(-(1 << 63)))).alias("r")
    small = found.where("not large").groupBy("nodes").agg(first).select("r.key", "nodes", "r.ns", "r.places")
    rows = small.unionByName(found.where("large").select("key", "nodes", "ns", "places"))
    rows = rows.select("key", F.explode(F.arrays_zip("nodes", "ns", "places")).alias("m"))
    return rows.select(F.col("key").alias("region"), F.col("m.nodes").alias("node"), F.col("m.ns").alias("n"), F.col("m.places").alias("place"))


def full_sets(docs: DataFrame, text_col: str, words: int, nodes: DataFrame, clashes: Clashes) -> DataFrame:
    """node, items (the sorted hashes as bytes) of these nodes (a table of distinct nodes)."""

    def make() -> object:
        seen: set[int] = set()

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            rows = []
            for own in shingles.sets(batch.column(0), words):
                if len(own) and (node := _node(own, clashes)) not in seen:
                    if len(seen) < 100_000:
                        seen.add(node)
                    rows.append((node, own.tobytes()))
                if len(rows) >= 500:
                    yield dict(zip(("node", "items"), zip(*rows)))
                    rows = []
            if rows:
                yield dict(zip(("node", "items"), zip(*rows)))

        return step

    found = map_arrow(docs.select(F.col(f"`{text_col}`")), make, struct("node long, items binary"))
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS * 5 else nodes
    return stored(found.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "join-sets")


def shared_counts(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n, m of these pairs (distinct), and how many shingles they share. Only sets of the pairs' nodes are moved."""
    pairs = stored(pairs.select("a", "b"), "join-verify")
    of = lambda c, v: sets.select(F.col("node").alias(c), F.col("items").alias(v))
    if pairs.count() <= BROADCAST_ROWS:  # the sets are filtered in their scan, and one side of the sets is moved
        of_b = of("b", "y").join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
        joined = of("a", "x").join(F.broadcast(pairs), "a").join(of_b, "b")
    else:
        of_a, of_b = (of(c, v).join(pairs.select(c).distinct(), c, "left_semi") for c, v in (("a", "x"), ("b", "y")))
        joined = pairs.join(of_a, "a").join(of_b, "b")

    def make() -> object:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            rows = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                rows.append((len(p), len(q), int((both[1:] == both[:-1]).sum())))
            n, m, s = zip(*rows) if rows else ((), (), ())
            yield {"a": batch.column("a"), "b": batch.column("b"), "n": n, "m": m, "shared": s}

        return step

    return map_arrow(joined.select("a", "b", "x", "y"), make, struct("a long, b long, n long, m long, shared long"))


def _linked(percent: int) -> str:
    return f"100 * shared >= {percent} * (n + m - shared)"


def sketched(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sketches don't rule out."""
    pairs = stored(pairs.select("a", "b"), "join-pairs")
    of = lambda c, n, v: classes.select(F.col("node").alias(c), F.col("n").alias(n), F.col("sketch").alias(v))
    if pairs.count() <= BROADCAST_ROWS:
        of_b = of("b", "m", "y").join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
        joined = of("a", "n", "x").join(F.broadcast(pairs), "a").join(of_b, "b")
    else:
        joined = pairs.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b")

    def make() -> object:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            x, n, y, m = (batch.column(c).to_pylist() for c in ("x", "n", "y", "m"))
            kept = [i for i in range(len(x)) if may_link(x[i], n[i], y[i], m[i], percent)]
            yield {c: batch.column(c).take(pa.array(kept, pa.int64())) for c in ("a", "b")}

        return step

    return map_arrow(joined.select("a", "b", "x", "n", "y", "m"), make, struct("a long, b long"))


def _bounded(n: str, m: str, i: str, j: str, have: str, percent: int) -> str:
    """SQL: whether two texts may link by their sizes and what they may share beside and from the region's shingle on."""
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and (100 + {percent}) * ({have} + least({n} - {i}, {m} - {j}) - 1) >= {percent} * ({n} + {m})"


def _named(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """With the component of each text: its own number where it has no links yet."""
    if labels is None:
        return members.withColumn("component", F.col("node"))
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def to_pivots(members: DataFrame, labels: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a text and its region's pivot of this turn that may link and are not connected yet. Pivots are the
    first in one order of all texts, so that regions that overlap share them."""
    named, order = _named(members, labels), F.xxhash64("node", F.lit(f"pivot {turn}"))
    pivots = named.groupBy("region").agg(F.min_by(F.struct("node", "n", "place", "component"), order).alias("p"), F.min("component").alias("l"), F.max("component").alias("h")).where("l <> h")
    rows = named.join(pivots.select("region", "p"), "region").where("component <> p.component and " + _bounded("n", "p.n", "place", "p.place", "1", percent))
    return rows.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def across(members: DataFrame, labels: DataFrame | None, classes: DataFrame, sets: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """Distinct pairs (a, b) that may link and are not connected yet, of all regions."""
    named = _named(members, labels)
    sizes = named.groupBy("region").agg(F.count("*").alias("size"), F.min("component").alias("l"), F.max("component").alias("h")).where("l <> h").select("region", "size")
    mixed = stored(named.join(sizes, "region"), "join-mixed")
    small = _small_pairs(mixed.where(F.col("size") <= REGION), percent).distinct()
    pairs = sketched(small, classes, percent)
    large = mixed.where(F.col("size") > REGION)
    if large.isEmpty():
        return pairs
    # Regions of near copies hold much the same texts. Those whose first text in one order is the same are one cell.
    first = large.groupBy("region").agg(F.min_by("node", F.xxhash64("node")).alias("cell"))
    cells = large.join(first, "region").groupBy("cell", "node").agg(F.min("n").alias("n"), F.min("place").alias("place"), F.min("component").alias("component"))
    cells = stored(cells.withColumnRenamed("cell", "region").withColumn("have", F.lit(1)), "join-cells")
    return pairs.unionByName(_large_pairs(cells, classes, sets, hot, percent)).distinct()


def _small_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs across components of regions of at most REGION texts, within the bounds."""
    dealt = mixed.select("region", "node", "n", "place", "component").repartition("region").sortWithinPartitions("region", "node")

    def pairs(x: list[np.ndarray]) -> pa.RecordBatch:
        region, node, n, place, comp = x
        found = [(np.zeros(0, np.int64),) * 2]
        for d in range(1, REGION):
            i = np.flatnonzero((region[d:] == region[:-d]) & (comp[d:] != comp[:-d]))
            if not len(i) and not (region[d:] == region[:-d]).any():
                break
            j = i + d
            p, q = n[i], n[j]
            near = (100 * np.minimum(p, q) >= percent * np.maximum(p, q)) & ((100 + percent) * np.minimum(p - place[i], q - place[j]) >= percent * (p + q))
            found.append((node[i[near]], node[j[near]]))
        a, b = (np.concatenate(c) for c in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(lambda: None)
        held: list[np.ndarray] = []
        for batch in batches:
            x = [batch.column(i).to_numpy().astype(np.int64) for i in range(5)]
            x = [np.concatenate([h, c]) for h, c in zip(held, x)] if held else x
            if len(x[0]):
                at = int(np.searchsorted(x[0], x[0][-1]))  # the last region may go on
                yield pairs([c[:at] for c in x])
                held = [c[at:] for c in x]
        if held:
            yield pairs(held)
        given_back()

    return dealt.mapInArrow(run, struct("a long, b long"))


_CELL = ("region", "node", "n", "place", "have", "component")
#: SQL: whether the cells that a cell is divided into have few enough pairs (work, the sum of their sizes' squares).
_LESS = "(work <= 0.75 * size * size)"


def _large_pairs(cells: DataFrame, classes: DataFrame, sets: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """Pairs (a, b) of larger regions, across components, by cells of pivots, further shingles and blocks.

    A cell is done when it holds one component, or at most BLOCK texts, or can't be divided: then it is squares of blocks.
    Division leaves three quarters of a cell's pairs at most, so that there is an end, and no more rows than pairs.
    """
    radius = 1 - percent / 100 + 1e-9
    ready, turn = [], 0
    while True:
        order = F.xxhash64("node", F.lit(turn))
        sizes = cells.groupBy("region").agg(F.count("*").alias("size"), F.min_by("node", order).alias("p"), F.max_by("node", order).alias("q"), F.min("n").alias("least"), F.min("component").alias("l"), F.max("component").alias("h")).where("l <> h")
        sizes = stored(sizes.drop("l", "h"), "join-sizes")
        big = sizes.where(F.col("size") > BLOCK)
        ready.append(cells.join(sizes.where(F.col("size") <= BLOCK).select("region"), "region").withColumn("blocks", F.lit(1)))
        if big.isEmpty():
            break
        rows = stored(cells.join(big, "region"), "join-big")
        wanted = rows.select(F.col("node").alias("b"), F.explode(F.array("p", "q")).alias("a")).where("a <> b").distinct()
        far = stored(shared_counts(wanted, sets).select("a", "b", (1 - F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("d")), "join-distances")
        to = lambda c: far.select(F.col("a").alias(c), F.col("b").alias("node"), F.col("d").alias(f"d_{c}"))
        rows = rows.join(to("p"), ["p", "node"], "left").join(to("q"), ["q", "node"], "left").fillna(0.0, ["d_p", "d_q"])
        in_p = (F.col("d_p") <= F.col("d_q") + 2 * radius).alias("in_p")
        in_q = ((F.col("d_q") < F.col("d_p")) | (F.col("d_q") <= F.col("d_p") + 2 * radius)).alias("in_q")
        rows = stored(rows.select(*_CELL, "size", "least", in_p, in_q), "join-homes")
        work = F.count_if("in_p") * F.count_if("in_p") + F.count_if("in_q") * F.count_if("in_q")
        rows = rows.join(rows.groupBy("region").agg(work.cast("double").alias("work")), "region")
        side = F.explode(F.array_compact(F.array(F.when(F.col("in_p"), F.lit(0)), F.when(F.col("in_q"), F.lit(1)))))
        parts = rows.where(_LESS).withColumn("side", side).withColumn("region", F.xxhash64("region", F.lit(turn), "side"))
        rest = stored(rows.where(f"not {_LESS}").select(*_CELL, "size", "least"), "join-rest")  # the pivots are too far from nearly all
        further = F.ceil(percent * F.col("least") / 100) > F.col("have")
        dealt = stored(_by_next_shingle(rest.where(further), sets, hot, percent), "join-further")
        now = dealt.groupBy("whole", "size", "region").agg(F.count("*").alias("now")).where("now > 1")
        less = now.groupBy("whole", "size").agg(F.sum((F.col("now") * F.col("now")).cast("double")).alias("work")).where(_LESS).select("whole")
        less = stored(less, "join-less")
        dealt = dealt.join(less, "whole").join(now.select("region", "whole"), ["region", "whole"], "left_semi")
        stuck = rest.join(less.withColumnRenamed("whole", "region"), "region", "left_anti")
        ready.append(stored(stuck.select(*_CELL, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "join-stuck"))
        cells = stored(parts.select(*_CELL).unionByName(dealt.select(*_CELL)), "join-cells")
        turn += 1
    rows = ready[0].select(*_CELL, "blocks")
    for more in ready[1:]:
        rows = rows.unionByName(more.select(*_CELL, "blocks"))
    rows = rows.join(classes.select("node", "sketch"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A block meets itself and all others once: block i goes to every square (min, max) that has it.
    squares = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    squares = squares.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *_CELL, "sketch")
    return squares.groupBy("region", "i", "j").applyInArrow(lambda t: _square(t, percent), struct("a long, b long")).distinct()


def _by_next_shingle(rows: DataFrame, sets: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """Cells of region and a further shared shingle: the texts of each row's cell with each shingle of its window that is
    behind the cell's own, the window being longer by one for every shingle that a cell's texts share already."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)
    joined = rows.select(*_CELL, "size").join(sets, "node")

    def make() -> object:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            region, node, n, place, have, comp, size = (batch.column(c).to_numpy() for c in (*_CELL, "size"))
            for k, items in enumerate(batch.column("items")):
                own = in_order(np.frombuffer(items.as_buffer(), np.uint64), shared.value)[0]
                at = np.arange(place[k] + 1, min(n[k], window_size(int(n[k]), percent) + have[k]))
                key = shingles.mixed(own[at] ^ region[k : k + 1].view(np.uint64)).view(np.int64)
                same = lambda c, k=k, at=at: np.repeat(c[k], len(at))
                yield {"whole": same(region), "region": key, "node": same(node), "n": same(n), "place": at, "have": same(have + 1), "component": same(comp), "size": same(size)}

        return step

    return map_arrow(joined, make, struct("whole long, region long, node long, n int, place int, have int, component long, size long"))


def _square(t: pa.Table, percent: int) -> pa.Table:
    """Pairs of a square across components that neither sizes and places nor sketches rule out."""
    t = t.sort_by("n")
    i, j, own, node, comp, n, place, have = (t[c].to_numpy().astype(np.int64) for c in ("i", "j", "own", "node", "component", "n", "place", "have"))
    marks = t["sketch"].to_pylist()
    width = np.array([len(m) for m in marks])
    groups = {w: np.flatnonzero(width == w) for w in sorted(set(width.tolist()))}
    table = {w: np.stack([np.frombuffer(marks[k], np.uint8) for k in at]).astype(np.int16) for w, at in groups.items()}
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def meet(left: np.ndarray, x: np.ndarray, right: np.ndarray, y: np.ndarray, same: bool) -> None:
        step = max(1, 2_000_000 // max(1, len(right)))
        for at in range(0, len(left), step):
            p, q = left[at : at + step, None], right[None, :]
            may = (comp[p] != comp[q]) & ((i[p] == j[p]) | (own[p] != own[q])) & (percent * np.maximum(n[p], n[q]) <= 100 * np.minimum(n[p], n[q]))
            may &= (100 + percent) * (have[p] - 1 + np.minimum(n[p] - place[p], n[q] - place[q])) >= percent * (n[p] + n[q])
            if same:
                may &= p < q
            for r in np.flatnonzero(may.any(axis=1)):
                k, cols = left[at + r], np.flatnonzero(may[r])
                apart = np.abs(y[cols] - x[at + r]).sum(axis=1, dtype=np.int64)
                m = right[cols[apart * (100 + percent) <= (100 - percent) * (n[k] + n[right[cols]])]]
                a.append(np.minimum(node[k], node[m]))
                b.append(np.maximum(node[k], node[m]))

    for w, at in groups.items():
        meet(at, table[w], at, table[w], True)
        for times in (2, 4, 8, 16):  # sizes of linked texts differ by a factor of 100 / percent at most
            if times * w in groups and 100 * times <= 400 * 100 // percent:
                wide = table[times * w]
                meet(at, table[w], groups[times * w], np.minimum(wide.reshape(len(wide), times, w).sum(axis=1), 255).astype(np.int16), False)
    return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


class _Join:
    """What components and links begin with: nodes, regions' members, full sets."""

    def __init__(self, docs: DataFrame, profile: DataFrame, clashes: Clashes, text_col: str, words: int, percent: int) -> None:
        self.percent = percent
        self.hot, twice = frequent(docs, text_col, words, percent)
        self.classes = stored(profile.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "join-classes")
        found = stored(regions(entries(docs, text_col, words, percent, self.hot, twice, clashes)), "join-regions")
        self.members = stored(members_of(found), "join-members")
        self.sets = full_sets(docs, text_col, words, stored(self.members.select("node").distinct(), "join-nodes"), clashes)

    def links(self, pairs: DataFrame) -> DataFrame:
        return shared_counts(pairs, self.sets).where(_linked(self.percent))

    def rest(self, labels: DataFrame | None) -> DataFrame:
        return across(self.members, labels, self.classes, self.sets, self.hot, self.percent)


def join_classes(docs: DataFrame, profile: DataFrame, clashes: Clashes, text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """node, component for the nodes that have links with other nodes."""
    join, labels, turn = _Join(docs, profile, clashes, text_col, words, percent), None, 0
    while True:
        found = stored(sketched(to_pivots(join.members, labels, turn, percent), join.classes, percent), "join-to-pivots")
        tried = found.count()
        links = stored(join.links(found).select("a", "b"), "join-links")
        labels = components(links if labels is None else links.unionByName(_as_links(labels)))
        turn += 1
        if links.count() < WORTHWHILE * max(1, tried):
            break
    more = stored(join.links(join.rest(labels)).select("a", "b"), "join-links")
    return components(more.unionByName(_as_links(labels)))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per link between different texts (sets): a, b (the smallest doc_id of either's copies, null if all are null;
    a's node is the smaller), n, m (sizes), shared."""
    profile, clashes = profiles(docs, id_col, text_col, words)
    join = _Join(docs, profile, clashes, text_col, words, percent)
    links = stored(join.links(join.rest(None)), "join-links")
    named = profile.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    one, two = (named.select(F.col("node").alias(c), F.col("least").alias(f"_{c}")) for c in ("a", "b"))
    return links.join(one, "a").join(two, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "n", "m", "shared")


def _as_links(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    profile, clashes = profiles(docs, id_col, text_col, words)
    labels = join_classes(docs, profile, clashes, text_col, words, percent)
    smallest = profile.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    smallest = smallest.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = smallest.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = stored(smallest.join(named, "component").select("node", "component_id"), "join-named")
    out = profile.select("doc_id", "n", "node").join(of_node, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each component, those with its smallest id; all columns as they are.

    Rows with the same id are one document here, and rows with a null id stay.
    """
    found = jaccard_join(docs, id_col, text_col, words, percent)
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__boutlake_drop")).distinct()
    return docs.join(dropped, F.col(f"`{id_col}`").cast("long") == F.col("__boutlake_drop"), "left_anti")
