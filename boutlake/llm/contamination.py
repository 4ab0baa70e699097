"""Benchmark decontamination: Wu-Manber search of test strings in documents, word by word.

A test string (window) is a run of `size` consecutive words of a benchmark item, or all words of a shorter one. Symbols are
words, by a hash of their bytes; blocks are two words. For each length of windows there are
* a shift table: for a block, how far the search may move without missing an occurrence whose end lies between (the least
  distance from the block's place in any window to that window's end; the whole window less one word if no window has it);
* buckets: the windows whose last block has this slot (shift 0). A hash of the first block rules most of them out;
* the windows' letters, with which those that are left are compared directly. So no clash of hashes makes a result.
A text is searched in many stretches at once (numpy): each moves on by its own shift, up to the text's end, so that a
window is found wherever it lies. Positions that the shifts pass are never looked at.

Test strings are sent to the tasks: at most WINDOWS of them at once, each with its items. They are counted first; more are
searched in several passes over the documents, dealt by a hash of the window, and what the passes find is put together per
row. A row is known by its id and 128 bits of its text there, so that equal rows are told by how many there are.

Rows: null, empty and wordless texts have no words and no hits; texts of any length are searched whole; repeated rows are
rows of their own; a null or repeated doc_id stays as it is. Items without words have no windows; rows of one item_id are one
item; windows of a null item_id count as hits, but name no item. Empty tables give no rows or no hits. Only the ids and the
texts are read, so that columns of any other name play no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from ._common import map_arrow, stored, struct

#: Windows that are sent to the tasks at once.
WINDOWS = 100_000
#: Ends of windows that one stretch looks at, and comparisons that are made at once.
STRETCH, COMPARED = 512, 1 << 20

_INNER = np.zeros(256, bool)
_INNER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Words:
    """Words of texts that lie one behind the other: their letters, where each begins among these, hashes, words up to each
    text's end."""

    letters: np.ndarray
    at: np.ndarray
    hash: np.ndarray
    upto: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, ends: np.ndarray) -> Words:
        inner = _INNER[data]
        first, last = inner.copy(), inner.copy()
        first[1:] &= ~inner[:-1]
        last[:-1] &= ~inner[1:]
        edge = ends[(ends < len(data)) & (ends > 0)]  # texts touch: a word ends with its text
        first[edge] |= inner[edge]
        last[edge - 1] |= inner[edge - 1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        letters, at = _FOLD[data[inner]], np.concatenate([[0], np.cumsum(stops - starts)])
        return cls(letters, at, shingles._hashes(letters, at[:-1], np.diff(at)) if len(starts) else np.zeros(0, np.uint64), np.searchsorted(starts, ends))

    def spelled(self, i: int, j: int) -> bytes:
        return self.letters[self.at[i] : self.at[j]].tobytes()


def _block(hashes: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """A hash of the block that ends with this word (a block of one word where windows have no two)."""
    return hashes[end] if size == 1 else shingles.mixed(hashes[end - 1] * shingles._STEPS[0] + hashes[end] * shingles._STEPS[1])


class Table:
    """Windows of one length: shifts, buckets and the strings."""

    def __init__(self, size: int, windows: list[tuple[list[bytes], list[str]]]) -> None:
        self.size, self.items = size, [items for _, items in windows]
        letters = np.frombuffer(b"".join(b"".join(w) for w, _ in windows), np.uint8)
        self.long = np.array([[len(x) for x in w] for w, _ in windows], np.int64)
        at = np.concatenate([[0], np.cumsum(self.long)])
        hashes = shingles._hashes(letters, at[:-1], np.diff(at)).reshape(len(windows), size)
        block = min(2, size)
        slots = 1 << max(10, (8 * len(windows) * size).bit_length())
        self.mask, self.shift = np.uint64(slots - 1), np.full(slots, size - block + 1, np.uint8 if size < 256 else np.int64)
        rows = hashes.ravel()
        begin = np.arange(len(windows)) * size
        for k in range(block - 1, size):
            np.minimum.at(self.shift, (_block(rows, begin + k, size) & self.mask).astype(np.int64), size - 1 - k)
        slot = (_block(rows, begin + size - 1, size) & self.mask).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.order, self.slot = order, slot[order]
        self.head = _block(rows, begin + block - 1, size)[order]
        self.letters = [b"".join(w) for w, _ in windows]

    def search(self, x: Words) -> tuple[np.ndarray, np.ndarray]:
        """(last word, window) of all occurrences."""
        begins = np.concatenate([[0], x.upto[:-1]]) + self.size - 1
        n = np.maximum(0, -(-(x.upto - begins) // STRETCH))
        pos = np.repeat(begins, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
        stop = np.minimum(pos + STRETCH, np.repeat(x.upto, n))
        ends, slots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(pos):
            slot = (_block(x.hash, pos, self.size) & self.mask).astype(np.int64)
            shift = self.shift[slot].astype(np.int64)
            if not shift.all():
                ends.append(pos[shift == 0])
                slots.append(slot[shift == 0])
            pos = pos + np.maximum(shift, 1)
            pos, stop = pos[pos < stop], stop[pos < stop]
        return self._confirmed(x, np.concatenate(ends), np.concatenate(slots))

    def _confirmed(self, x: Words, ends: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.searchsorted(self.slot, slots), np.searchsorted(self.slot, slots, side="right")
        head = _block(x.hash, ends - self.size + min(2, self.size), self.size) if len(ends) else np.zeros(0, np.uint64)
        found: list[tuple[int, int]] = []
        upto = np.cumsum(high - low)
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + COMPARED, side="right")))
            many = (high - low)[at:to]
            end = np.repeat(np.arange(at, to), many)
            place = np.repeat(low[at:to], many) + np.arange(len(end)) - np.repeat(np.cumsum(many) - many, many)
            near = self.head[place] == head[end]
            end, window = ends[end[near]], self.order[place[near]]
            for k in range(self.size):
                word = end - self.size + 1 + k
                same = x.at[word + 1] - x.at[word] == self.long[window, k]
                end, window = end[same], window[same]
            found += [(e, w) for e, w in zip(end.tolist(), window.tolist()) if x.spelled(e - self.size + 1, e + 1) == self.letters[w]]
            at = to
        out = np.array(found, np.int64).reshape(-1, 2)
        return out[:, 0], out[:, 1]


def windows_of(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """window (words with spaces between), item: distinct."""

    def make() -> object:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            at = 0
            for data, ends in shingles.slices(batch.column(1)):
                x, begin = Words.of(data, ends), 0
                for end in x.upto.tolist():
                    item, at = batch.column(0)[at].as_py(), at + 1
                    words = [x.spelled(i, i + 1).decode() for i in range(begin, end)]
                    runs = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
                    yield {"window": runs, "item": [item] * len(runs)}
                    begin = end

        return step

    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`"))
    return map_arrow(rows, make, struct("window string, item string")).distinct()


def tables_of(rows: Iterable[tuple[str, str | None]]) -> list[Table]:
    """From windows and their items: a table for each length."""
    items: dict[str, list[str]] = defaultdict(list)
    for window, item in rows:
        items[window] += [] if item is None else [item]
    sizes: dict[int, list] = defaultdict(list)
    for window, own in sorted(items.items()):
        words = window.encode().split(b" ")
        sizes[len(words)].append((words, own))
    return [Table(size, windows) for size, windows in sorted(sizes.items())]


_FOUND = struct("doc_id long, name_1 long, name_2 long, n_words long, hits ints, items strings")


def _search(docs: DataFrame, id_col: str, text_col: str, tables: list[Table], named: bool) -> DataFrame:
    """doc_id, name_1, name_2 (a hash of the text where asked for), n_words, hits (words that are hit), items."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def make() -> object:
        tables = shared.value

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            at = 0
            for data, ends in shingles.slices(batch.column(1)):
                x = Words.of(data, ends)
                hit = np.zeros(len(x.hash) + 1, np.int64)
                items: dict[int, set[str]] = defaultdict(set)
                for table in tables:
                    end, window = table.search(x)
                    np.add.at(hit, end - table.size + 1, 1)
                    np.add.at(hit, end + 1, -1)
                    pairs = np.unique(np.searchsorted(x.upto, end, side="right") * len(table.items) + window)
                    for pair in pairs.tolist():
                        items[pair // len(table.items)].update(table.items[pair % len(table.items)])
                words = np.flatnonzero(np.cumsum(hit)[:-1] > 0)
                begins = np.concatenate([[0], x.upto[:-1]])
                cuts = np.searchsorted(words, np.append(begins, x.upto[-1:]))
                edges = [0, *ends.tolist()]
                names = [xxhash.xxh3_128_intdigest(data[p:q]) if named else 0 for p, q in zip(edges, edges[1:])]
                yield {
                    "doc_id": batch.column(0).slice(at, len(ends)), "name_1": [(n >> 64) - (1 << 63) for n in names], "name_2": [n % (1 << 64) - (1 << 63) for n in names], "n_words": x.upto - begins,
                    "hits": [words[p:q] - b for p, q, b in zip(cuts, cuts[1:], begins)], "items": [sorted(items.get(i, ())) for i in range(len(ends))],
                }
                at += len(ends)

        return step

    return map_arrow(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`")), make, _FOUND)


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """A row per row of docs: doc_id, n_words, hits (places of the words inside an occurrence, from 0), items (ids as strings
    of the items with windows that occur, sorted)."""
    windows = stored(windows_of(items, item_col, item_text_col, size), "contamination-windows")
    passes = max(1, -(-windows.count() // WINDOWS))
    own = F.pmod(F.xxhash64("window"), F.lit(passes))
    tables = (tables_of((r["window"], r["item"]) for r in windows.where(own == k).toLocalIterator()) for k in range(passes))
    if passes == 1:
        return _search(docs, id_col, text_col, next(tables), False).select("doc_id", "n_words", "hits", "items")
    parts = [_search(docs, id_col, text_col, t, True).withColumn("turn", F.lit(k)) for k, t in enumerate(tables)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.groupBy("doc_id", "name_1", "name_2", "turn").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("n_words", "hits", "items")])
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    rows = rows.groupBy("doc_id", "name_1", "name_2").agg(F.max("times").alias("times"), F.max("n_words").alias("n_words"), together("hits"), together("items"))
    return rows.select("doc_id", "n_words", "hits", "items", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.size("hits").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """The rows of docs without any hit, all columns as they are; rows of one id are one document, a null id stays."""
    bad = find(docs, items, id_col, text_col, item_col, item_text_col, size).where(F.size("hits") > 0).select(F.col("doc_id").alias("__boutlake_drop")).distinct()
    return docs.join(bad, F.col(f"`{id_col}`").cast("long") == F.col("__boutlake_drop"), "left_anti")
