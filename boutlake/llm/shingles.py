"""Sets of word shingles as sorted 64-bit hashes, made with numpy for many texts at once.

A word's hash mixes its length and then its bytes, eight at a time, each time by a bijection of 64 bits; words of more
than LONG bytes go to xxh3. A shingle's hash mixes the hashes of its words with a factor for each place. So two different
shingles share a hash only by chance, once in 2 ** 64 pairs; no sum over the letters can cancel out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once, of several texts or of one longer text.
SLICE_BYTES = 1 << 20
SEED, LONG = 20_240_229, 32

_STEPS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)  # masks of the first n bytes


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, where each text ends) of stretches of whole texts of some SLICE_BYTES, or of one longer text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset :]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def words_in(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of texts that lie one behind the other, and how many words there are up to each text's end."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inner = ~((data == 32) | (data - np.uint8(9) < np.uint8(5)))
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~inner[:-1]
    last[:-1] &= ~inner[1:]
    edge = ends[(ends < len(data)) & (ends > 0)]  # texts touch: a word ends with its text
    first[edge] |= inner[edge]
    last[edge - 1] |= inner[edge - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    folded = data + ((data - np.uint8(65) < np.uint8(26)).view(np.uint8) << np.uint8(5))  # A-Z count as a-z
    return _hashes(folded, starts, stops - starts), np.searchsorted(starts, ends)


def _hashes(letters: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each word: of its length and all of its bytes, eight at a time; of long words by xxh3."""
    eight = np.ndarray(len(letters) + 1, dtype="<u8", buffer=np.append(letters, np.zeros(8, np.uint8)), strides=(1,))  # unaligned
    out = size.astype(np.uint64) * _STEPS[63] + np.uint64(SEED)
    for done in range(0, LONG, 8):
        more = slice(None) if not done else np.flatnonzero(size > done)
        if done and not len(more):
            break
        out[more] = mixed(out[more] ^ (eight[at[more] + done] & _FIRST[np.minimum(size[more] - done, 8)]))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(letters[at[i] : at[i] + size[i]], SEED)
    return out


def sets(texts: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: runs of `words` words, or its whole sequence if that is
    shorter; none without words. Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Null counts as empty. A text of any
    length is worked on whole; what is held is some 30 bytes a word besides the text."""
    for data, ends in slices(texts):
        word, upto = words_in(data, ends)
        runs = np.zeros(max(0, len(word) - words + 1), dtype=np.uint64)
        for k in range(words):
            runs += word[k : k + len(runs)] * _STEPS[k]
        runs = mixed(runs)
        begin = 0
        for end in upto.tolist():
            n = end - begin
            if n >= words:
                own = np.sort(runs[begin : end - words + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif n:
                yield mixed((word[begin:end] * _STEPS[:n]).sum(keepdims=True) + _STEPS[words + n])
            else:
                yield np.zeros(0, dtype=np.uint64)
            begin = end
