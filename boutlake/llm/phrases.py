"""Phrase collocation mining: best-first branch-and-bound growth of word sequences.

A phrase of two or three words that occurs `least` times is scored by its weakest cut: floor(10**6 a a / (l r)), a, l and r
being the occurrences of the phrase, of its first and of its remaining words. A phrase grows from its prefix. Counts of
prefixes bound what grows from them: with a <= f(p) and r >= a, no phrase that begins with p and its first word x scores more
than 10**6 f(p) / f(x), and by the last cut none that ends in s and its last word z more than 10**6 f(s) / f(z).

1. Words are counted. A single word's bound is 10**6, the best score there is, so that these nodes come first: all pairs of
   words that occur `least` times are counted, and their scores are exact. Most pairs are rare, so they are counted by
   a hash of 64 bits first, and by their letters only where the hash occurs `least` times.
2. Each language has a bar, at first the score that `2 * top` of its pairs reach. The frontier, i.e. the pairs whose bound is
   at least the bar, is expanded: only three-word phrases whose prefix and whose suffix may still reach the bar are counted,
   and those around a pair that reaches it, which settle whether it survives (a longer phrase may replace it).
3. A language with `top` survivors at or above its bar is settled, ties included: all that has not been counted is below.
   For the others the bar goes down (8, 32, ... times `top` pairs, then 0), and only what that adds to the frontier is
   counted.

Counting is numpy within tasks, on stretches of some 2 MB, then sums per phrase with map-side partials, so a hot phrase is
a row per task. Tasks know the frontier by a table of flags with a bounded number of slots: two phrases in one slot mean
that too much is counted, never too little. Scores are decimals of 38 digits: occurrences up to 10**15 are exact.

Rows: null text is empty, null language is `und` (and one with rows of that name); empty texts give nothing; repeated rows
count each time; texts of any length are taken whole (cut where no phrase can cross, so memory is bounded unless a piece
itself is longer than a stretch); an empty table gives no rows. Only the two columns are read, so that others of any name
play no part. Ties at the end of a language's list go by a, then by phrase.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from ._common import BROADCAST_ROWS, begun, flag_table, given_back, small_batches, stored, struct

#: Bytes of text that are counted at once.
STRETCH = 2 << 20
#: Flags: frequent; now and in earlier rounds: may begin, may end a phrase that reaches the bar, reaches it itself.
KNOWN, BEGIN, END, REACH, OLD = 1, 2, 4, 8, 3

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_COUNTS = struct("lang string, phrase string, c long, h long")
_HASHED = struct("h long, c long")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(bytes, where each text ends, its language) of some STRETCH bytes; longer texts are cut at the end of a piece."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
        table = pa.Table.from_batches(held)
        langs = table.column(0).fill_null("und").to_pylist()
        texts = table.column(1).cast(pa.large_binary()).fill_null(b"").combine_chunks()
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at, ends = int(ends[0]), ends[1:]
        while len(ends) and at < ends[-1]:
            to = int(min(at + STRETCH, ends[-1]))
            text = int(np.searchsorted(ends, to))  # the text that `to` is in, or ends
            while to < ends[text] and _KIND[data[to]] != 2:
                more = np.flatnonzero(_KIND[data[to : min(to + STRETCH, ends[text])]] == 2)
                to = to + int(more[0]) if len(more) else int(min(to + STRETCH, ends[text]))
            first = int(np.searchsorted(ends, at, side="right"))
            last = int(np.searchsorted(ends, to))
            yield data[at:to], np.minimum(ends[first : last + 1], to) - at, langs[first : last + 1]
            at = to

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= STRETCH:
            yield from cut(held)
            held, size = [], 0
    if held:
        yield from cut(held)


class _Words:
    """The words of a stretch: `name` numbers the distinct pairs of a language and a word, `piece` the pieces."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, langs: list[str]) -> None:
        kind = _KIND[data]
        inner = kind == 0
        first, last = inner.copy(), inner.copy()
        first[1:] &= ~inner[:-1]
        last[:-1] &= ~inner[1:]
        edge = ends[(ends < len(data)) & (ends > 0)]  # texts touch: a word ends with its text
        first[edge] |= inner[edge]
        last[edge - 1] |= inner[edge - 1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        text = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(starts, ends), prepend=0))
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[starts] + text
        offsets = np.concatenate([[0], np.cumsum(stops - starts)])
        letters = pa.py_buffer(_FOLD[data[inner]])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), letters]).dictionary_encode()
        ids = words.indices.to_numpy().astype(np.int64)
        codes: dict[str, int] = {}
        lang = np.array([codes.setdefault(x, len(codes)) for x in langs], np.int64)
        distinct = len(words.dictionary)
        keys = lang[text] * distinct + ids
        if distinct * len(codes) <= max(1 << 22, 4 * len(keys)):
            times = np.bincount(keys, minlength=distinct * len(codes))
            present = np.flatnonzero(times)
            self.name = (np.cumsum(times > 0) - 1)[keys]
            self.times = times[present]
        else:
            present, self.name, self.times = np.unique(keys, return_inverse=True, return_counts=True)
        self.lang = pa.array([*codes], pa.string()).take(pa.array(present // max(1, distinct)))
        self.word = words.dictionary.take(pa.array(present % max(1, distinct))).cast(pa.large_string())
        at, spelled = np.frombuffer(words.dictionary.buffers()[1], np.int64, distinct + 1), words.dictionary.buffers()[2]
        spelled = np.frombuffer(spelled, np.uint8) if spelled is not None and spelled.size else np.zeros(0, np.uint8)
        hashes = shingles._hashes(spelled, at[:-1], np.diff(at)) if distinct else np.zeros(0, np.uint64)
        codes_h = np.array([hash_of(x) for x in codes], np.uint64)
        self.hash = shingles.mixed(hashes[present % max(1, distinct)] + codes_h[present // max(1, distinct)]) if len(present) else hashes

    def next_to(self, k: int) -> np.ndarray:
        """Whether k words from here on are of one piece."""
        return self.piece[k - 1 :] == self.piece[: len(self.piece) - k + 1] if len(self.piece) >= k else np.zeros(0, bool)


def hash_of(text: str) -> np.uint64:
    letters = np.frombuffer(text.encode(), np.uint8)
    return shingles._hashes(letters, np.array([0]), np.array([len(letters)]))[0] if len(letters) else np.uint64(0)


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return shingles.mixed(a * shingles._STEPS[0] + b * shingles._STEPS[1])


def _slots(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The flags of these hashes."""
    return known[(hashes & np.uint64(len(known) - 1)).astype(np.int64)]


def _words(x: _Words, known: None) -> pa.RecordBatch:
    """A row for each word, and one with the phrase '' and all words of a language."""
    every = pc.unique(x.lang)
    totals = [int(x.times[pc.equal(x.lang, v).to_numpy(zero_copy_only=False)].sum()) for v in every]
    spelled = pa.concat_arrays([x.word, pa.array([""] * len(every), pa.large_string())])
    return _rows(pa.concat_arrays([x.lang, every]), spelled, np.append(x.times, totals), np.append(x.hash, np.zeros(len(every), np.uint64)))


def _pair_places(x: _Words, known: np.ndarray) -> np.ndarray:
    """Where pairs of frequent words begin."""
    often = (_slots(known, x.hash) & KNOWN > 0)[x.name]
    return np.flatnonzero(x.next_to(2) & often[:-1] & often[1:]) if len(often) > 1 else np.zeros(0, np.int64)


def _hashed_pairs(x: _Words, known: np.ndarray) -> pa.RecordBatch:
    """h, c of the pairs of frequent words."""
    at = _pair_places(x, known)
    h, times = np.unique(_pair_hash(x.hash[x.name[at]], x.hash[x.name[at + 1]]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times, pa.int64())], names=_HASHED.names)


def _pairs(x: _Words, known: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """The pairs whose words and whose hash are frequent."""
    at = _pair_places(x, known[0])
    often = _slots(known[1], _pair_hash(x.hash[x.name[at]], x.hash[x.name[at + 1]])) & KNOWN > 0
    at = at[often]
    keys, times = np.unique(x.name[at] * len(x.word) + x.name[at + 1], return_counts=True)
    names = [keys // max(1, len(x.word)), keys % max(1, len(x.word))]
    return _rows(x.lang.take(pa.array(names[0])), _spelled(x, names), times, _pair_hash(x.hash[names[0]], x.hash[names[1]]))


def _triples(x: _Words, known: np.ndarray) -> pa.RecordBatch:
    """The phrases of three words that the flags ask for (h: of the first pair)."""
    pair = _slots(known, _pair_hash(x.hash[x.name[:-1]], x.hash[x.name[1:]]))
    one, two = pair[:-1], pair[1:]
    at = np.flatnonzero(x.next_to(3) & _counts_as(one, two, 0) & ~_counts_as(one, two, OLD)) if len(pair) > 1 else np.zeros(0, np.int64)
    pairs, place = np.unique(x.name[at] * len(x.word) + x.name[at + 1], return_inverse=True)
    triples, times = np.unique(place * len(x.word) + x.name[at + 2], return_counts=True)
    pairs, last = pairs[triples // max(1, len(x.word))], triples % max(1, len(x.word))
    names = [pairs // max(1, len(x.word)), pairs % max(1, len(x.word)), last]
    return _rows(x.lang.take(pa.array(names[0])), _spelled(x, names), times, _pair_hash(x.hash[names[0]], x.hash[names[1]]))


def _spelled(x: _Words, names: list[np.ndarray]) -> pa.Array:
    return pc.binary_join_element_wise(*[x.word.take(pa.array(n)) for n in names], pa.scalar(" ", pa.large_string()))


def _rows(lang: pa.Array, phrase: pa.Array, times: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(times, pa.int64()), pa.array(hashes.view(np.int64))], names=_COUNTS.names)


def _counts_as(one: np.ndarray, two: np.ndarray, shift: int) -> np.ndarray:
    """Whether a phrase of these pairs is to be counted: both ends may reach the bar, or it settles a pair that does."""
    begin, reach_1 = one & (BEGIN << shift) > 0, one & (REACH << shift) > 0
    end, reach_2 = two & (END << shift) > 0, two & (REACH << shift) > 0
    return (one & two & KNOWN > 0) & ((begin & end) | reach_1 | reach_2)


def _counted(texts: DataFrame, tally: Callable[[_Words, object], pa.RecordBatch], known: object, schema: T.StructType) -> DataFrame:
    """What the tally gives for each stretch of rows of lang and text."""
    spark = texts.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(lambda: None)
        for data, ends, langs in _stretches(batches):
            x = _Words(data, ends, langs)
            if len(x.name):
                yield tally(x, shared.value)
        given_back()

    return texts.mapInArrow(run, schema)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("c").alias("c"), F.max("h").alias("h"))


def count_words(texts: DataFrame) -> DataFrame:
    """lang, phrase, c, h of words, and of '' for all words of a language."""
    return _summed(_counted(texts, _words, None, _COUNTS))


def count_pairs(texts: DataFrame, known: np.ndarray, least: int) -> DataFrame:
    """The same of pairs of words flagged as frequent that occur `least` times."""
    hashed = _counted(texts, _hashed_pairs, known, _HASHED).groupBy("h").agg(F.sum("c").alias("c"))
    often = stored(hashed.where(F.col("c") >= least).select("h", F.lit(KNOWN).alias("flags")), "phrases-hashes")
    return _summed(_counted(texts, _pairs, (known, flag_table(often, often.count())), _COUNTS)).where(F.col("c") >= least)


def count_triples(texts: DataFrame, known: np.ndarray, least: int) -> DataFrame:
    """The same of phrases of three words that the flags of pairs ask for."""
    return _summed(_counted(texts, _triples, known, _COUNTS)).where(F.col("c") >= least)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def score(a: str, left: str, right: str) -> Column:
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    return F.call_function("div", wide(a) * F.lit(1_000_000) * wide(a), wide(left) * wide(right))


def _scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, h, l, r, score of all pairs of words."""
    one, two = (words.select("lang", F.col("phrase").alias(k), F.col("c").alias(c)) for k, c in (("one", "l"), ("two", "r")))
    if words.count() <= BROADCAST_ROWS:
        one, two = F.broadcast(one), F.broadcast(two)
    parts = F.split("phrase", " ", 2)
    rows = pairs.select("lang", "phrase", F.col("c").alias("a"), "h", parts[0].alias("one"), parts[1].alias("two"))
    return rows.join(one, ["lang", "one"]).join(two, ["lang", "two"]).select("lang", "phrase", "a", "h", "l", "r", score("a", "l", "r").alias("score"))


def _bars(pairs: DataFrame, reach: int) -> DataFrame:
    """lang, bar: the best score that so many of a language's pairs reach, 0 where there are fewer. A language has at most
    10**6 + 1 scores."""
    at = pairs.groupBy("lang", "score").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    return at.withColumn("upto", upto).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= reach, F.col("score"))), F.lit(0)).alias("bar"))


def _flags(pairs: DataFrame, bars: DataFrame, shift: int) -> DataFrame:
    """With the flags of this bar: may begin, may end a phrase that reaches it, reaches it."""
    bound = lambda c: F.expr(f"(cast(a as decimal(38,0)) * 1000000) div {c} >= bar")
    on = lambda c, flag: F.when(c, F.lit(flag << shift)).otherwise(0)
    flags = on(bound("l"), BEGIN).bitwiseOR(on(bound("r"), END)).bitwiseOR(on(F.col("score") >= F.col("bar"), REACH)).bitwiseOR(F.lit(KNOWN))
    return pairs.join(bars, "lang").select("h", flags.cast("int").alias("flags"))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, share: int = 50, top: int = 2_000) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n (words of the language), score: each language's first `top` phrases of two or
    three words. A phrase goes if a longer one that holds it has `share` percent of its occurrences."""
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    counted = stored(count_words(texts).where((F.col("c") >= least) | (F.col("phrase") == "")), "phrases-words")
    words, totals = counted.where("phrase <> ''"), counted.where("phrase = ''").select("lang", F.col("c").alias("n"))
    known = flag_table(words.select("h", F.lit(KNOWN).alias("flags")), words.count())
    pairs = stored(count_pairs(texts, known, least), "phrases-counts")
    pairs = stored(_scored_pairs(pairs, words), "phrases-pairs")
    n_pairs, reach, longer, old = pairs.count(), 2 * top, None, None
    bars = stored(_bars(pairs, reach), "phrases-bars")
    while True:
        flags = _flags(pairs, _small(bars), 0)
        if old is not None:
            flags = flags.unionByName(_flags(pairs, _small(old), OLD))
        found = stored(count_triples(texts, flag_table(flags, n_pairs), least), "phrases-longer")
        longer = found if longer is None else longer.unionByName(found)
        alive = stored(_alive(pairs, longer, bars, share), "phrases-alive")
        enough = alive.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= top).select("lang", F.lit(True).alias("enough"))
        state = stored(bars.join(enough, "lang", "left").withColumn("open", F.col("enough").isNull() & (F.col("bar") > 0)), "phrases-state")
        if state.where("open").isEmpty():
            break
        reach *= 4
        lower = _bars(pairs, reach).withColumnRenamed("bar", "lower")
        old = bars
        bars = stored(state.join(lower, "lang").select("lang", F.when(F.col("open"), F.least("lower", "bar")).otherwise(F.col("bar")).alias("bar")), "phrases-bars")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    rows = alive.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)  # at most 64 * top rows go on
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(_small(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _alive(pairs: DataFrame, longer: DataFrame, bars: DataFrame, share: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases that reach their language's bar and are not replaced by a longer one."""
    parts = F.split("phrase", " ", 3)
    named = longer.select("lang", "phrase", F.col("c").alias("a"), F.concat_ws(" ", parts[0], parts[1]).alias("head"), F.concat_ws(" ", parts[1], parts[2]).alias("tail"))
    heads = pairs.select("lang", F.col("phrase").alias("head"), F.col("a").alias("f_head"), F.col("l").alias("f_first"))
    tails = pairs.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("f_tail"), F.col("r").alias("f_last"))
    triples = named.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    triples = triples.withColumn("s1", score("a", "f_first", "f_tail")).withColumn("s2", score("a", "f_head", "f_last"))
    weak = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    triples = triples.select("lang", "phrase", "a", weak("f_first", "f_head").alias("l"), weak("f_tail", "f_last").alias("r"), weak("s1", "s2").alias("score"))
    inside = named.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    limits = _small(bars)
    reaching = pairs.drop("h").join(limits, "lang").where("score >= bar").drop("bar")
    kept = reaching.join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")
    return kept.unionByName(triples.join(limits, "lang").where("score >= bar").drop("bar"))
