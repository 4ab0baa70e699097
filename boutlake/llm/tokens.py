"""Encoding whole texts with the public tokenizers in Spark tasks.

The cost of encoding is in words that a worker has not met before, so a text is cut into chunks at places where no
token of the tokenizers' patterns can cross and where the rest of the text has no say in a chunk's ids. The cuts are
found for a whole Arrow batch at once with numpy, the distinct chunks with Arrow's dictionary encoding, and only those
that the worker does not remember go to the library. A text that holds one of the tokenizer's special strings goes to
the library whole.

Cuts are made only between ASCII characters of known kinds, and around ASCII white space whose neighbour can't be
white space of another kind:
  * before the last character of a run of white space that is followed by a word (a space goes with that word),
  * before a run of white space, and behind it if it does not end in a space,
  * between letters, digits and other signs, but not beside an apostrophe, which may begin a contraction.
"""

from __future__ import annotations

import itertools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._common import kept_in_worker

#: Chunks remembered in each of two generations: what was met since the last turnover, and what was met before it.
REMEMBERED = 300_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 6 << 20

#: Lead bytes of the characters outside ASCII that are white space in Unicode (and of many that are not).
_MAYBE_SPACE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)

_KIND = np.zeros(256, dtype=np.uint8)  # 0: other sign, 1: letter, 2: digit, 3: space, 4: apostrophe, 5: outside ASCII
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[*range(9, 14), 32]] = 3
_KIND[39] = 4
_KIND[128:] = 5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def encoder(path: str) -> Encoder:
    return kept_in_worker(("encoder", path), lambda: Encoder(path))


def chunk_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where chunks begin in the UTF-8 bytes of texts that lie one behind the other; text_starts: no empty texts."""
    kind = _KIND[data]
    lead = np.isin(data, _MAYBE_SPACE_LEADS)
    odd = lead.copy()
    odd[1:] |= lead[:-1]
    odd[2:] |= lead[:-2] & (data[:-2] >= 0xE0)
    space = kind == 3
    first, last = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    first[text_starts] = True
    last[text_starts[1:] - 1] = True
    last[-1] = True
    before_space, before_odd, before = np.zeros_like(space), np.zeros_like(odd), np.zeros_like(kind)
    before_space[1:], before_odd[1:], before[1:] = space[:-1], odd[:-1], kind[:-1]
    after_word = np.zeros_like(space)
    after_word[:-1] = ~space[1:] & ~odd[1:]
    cut = first | (space & ~before_space & ~before_odd) | (space & after_word & ~last)
    behind = ~space & ~odd & before_space
    behind[1:] &= data[:-1] != 32
    plain = (kind < 3) & (before < 3) & (kind != before)
    return np.flatnonzero(cut | behind | plain)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.folds = self.tok.normalizer is not None and self.tok.normalizer.normalize_str("A") == "a"
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def values(self, new: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(new, add_special_tokens=False)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _look_up(self, chunks: list[bytes]) -> list[bytes]:
        young, old = self.young, self.old
        found = [young.get(c) for c in chunks]
        missing = [i for i, f in enumerate(found) if f is None]
        new = []
        for i in missing:
            if (f := old.get(chunks[i])) is not None:
                found[i] = young[chunks[i]] = f
            else:
                new.append(i)
        if new:
            for i, v in zip(new, self.values([chunks[i].decode() for i in new])):
                found[i] = v
                if len(v) < 200:
                    young[chunks[i]] = v
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        return found

    def __call__(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For slices of the texts, in order: (ids of all its texts, end of each text's ids). Null counts as empty."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset :]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
            yield self._slice(texts.slice(at, to - at))
            at = to

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset :]
        size = np.diff(offsets)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if size.sum() else np.zeros(0, np.uint8)
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            return self._special(texts)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        if self.folds:
            data = _FOLD[data]
        begins = offsets[:-1] - offsets[0]
        starts = chunk_starts(data, begins[size > 0])
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = spans.dictionary_encode()
        values = self._look_up(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        return self._gather(values, which, np.searchsorted(starts, offsets[1:] - offsets[0]))

    def _gather(self, values: list[bytes], which: np.ndarray, chunk_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(values), dtype="<u4")
        lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        begin = np.cumsum(lengths) - lengths
        taken = lengths[which]
        total = np.concatenate([[0], np.cumsum(taken)])
        place = np.repeat(begin[which] - total[:-1], taken) + np.arange(total[-1])
        return flat[place], total[chunk_ends]

    def _special(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for x in texts:
            raw = x.as_py()
            if any(s in raw for s in self.special):
                parts.append(self.whole(raw.decode()))
            else:
                parts.append(self._slice(pa.array([raw], pa.large_binary()))[0])
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])


def per_text(ids: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    for a, b in itertools.pairwise([0, *ends.tolist()]):
        yield ids[a:b]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def token_file(name: str) -> str:
    """The place of a public tokenizer's file; it is never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)
