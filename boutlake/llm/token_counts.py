"""Token counts by byte-pair merging with a heap and a linked list, without making any id.

A word begins as a list of symbols. A heap holds the adjacent pairs that have a rank; the pair of lowest rank (of
equal ones, the leftmost) is merged, which links its neighbours anew and pushes their pairs; entries that no longer
hold are skipped when popped. The count is the number of initial symbols minus the merges. Words come from the
tokenizer file's own normaliser and pattern, and a worker remembers the counts of the chunks it has met.

Rows: null and empty texts count 0 tokens and 0 bytes. Null and repeated doc_ids and repeated rows keep their rows, each
counted by its own text. Texts of any length are counted whole, a slice of texts (or one longer text) at a time. A text
with one of the tokenizer's special strings is counted without the memory of chunks. An empty table gives no rows. Only
the id and the text are read, so that columns of any other name play no part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from ._common import kept_in_worker, map_arrow, struct


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left after byte-pair merging."""
    n = len(symbols)
    if n < 2:
        return n
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapify(heap)
    after, before, merges = [*range(1, n), -1], [*range(-1, n - 1)], 0
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] is None or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = None
        merges += 1
        k = after[i] = after[j]
        after[j] = -1
        if k >= 0:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heappush(heap, (r, h))
    return n - merges


class MergeCounter(tokens.Encoder):
    """Takes the encoder's cuts and memory, and puts counts in the place of ids."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.vocabulary, self.suffix = set(model["vocab"]), model["end_of_word_suffix"] or ""
        self.split_special = re.compile("|".join(re.escape(s.decode()) for s in self.special)) if self.special else None

    def count(self, text: str) -> int:
        """Of a text without special strings."""
        total = 0
        if self.tok.normalizer is not None:
            text = self.tok.normalizer.normalize_str(text)
        for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(text):
            symbols = [*word]
            symbols[-1] += self.suffix
            total += merged_length([s for s in symbols if s in self.vocabulary], self.ranks)
        return total

    def values(self, new: list[str]) -> list[bytes]:
        return [self.count(c).to_bytes(8, "little") for c in new]

    def whole(self, text: str) -> np.ndarray:
        parts = self.split_special.split(text)
        return np.array([len(parts) - 1 + sum(self.count(p) for p in parts)], dtype=np.int64)

    def _gather(self, values: list[bytes], which: np.ndarray, chunk_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(values), dtype="<i8")[which])])
        return np.diff(total[chunk_ends], prepend=0), np.arange(1, len(chunk_ends) + 1)

    def _special(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        counts = [self.whole(x.as_py().decode())[0] for x in texts]
        return np.array(counts, dtype=np.int64), np.arange(1, len(counts) + 1)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit."""

    def make() -> object:
        counter = kept_in_worker(("counter", tokenizer), lambda: MergeCounter(tokenizer))

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            texts = batch.column(1)
            n = np.concatenate([np.zeros(0, np.int64), *(counts if len(counts) else np.zeros(len(ends), np.int64) for counts, ends in counter(texts))])
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield {"doc_id": batch.column(0), "n_bytes": sizes, "n_tokens": n, "over_limit": n > limit}

        return step

    return map_arrow(docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")), make, struct("doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
