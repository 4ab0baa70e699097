"""Toxicity: a learned lexicon as a trie, met by Levenshtein automata, and scores of context windows.

Lexicon: words, and stems of words (a stem stands for any word that begins with it), that labelled toxic texts hold far
more often than others by a likelihood-ratio test over distinct texts. Of these: few terms that cover the toxic texts,
which may be stems, and all words whose misspellings toxic texts hold more often too, or no text holds. So a stem
doesn't stand in for the misspellings of its words. It is fitted on at most `max_labelled` labelled rows, as are the
weights below; everything else reads all texts.

Matching: the terms form a trie. A word is read by the product of the trie with Levenshtein automata of 0 errors (terms
under 6 letters), 1 error (6 to 8) or 2 (9 or more). Its states, sets of (trie node, errors), are made when first met and
kept (a bounded number), so that a word costs a look-up a letter and most words end after a few. Stems match at 0 errors.

Scores: a hit is quoted if a quotation mark stands open before it or a word of reporting stands in the window of six
words before it, else bare. Hits bare, quoted and misspelled, distinct terms, hits per hundred words and the most bare
hits in one window go into a logistic regression.

Rows: null and empty texts have no hits and get the score of such texts. Null ids count as rows outside the labels.
Rows with the same id, and repeated rows, are scored each by their own text; labels of a repeated id count each time.
Texts of any length are scored whole. An empty table gives no rows; without labelled rows of both kinds, the lexicon is
empty and the score is the share of toxic labels (0 without labels). Only the id and the text are read (drop_toxic hands
all columns on as they are), so that columns of any other name play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import dotless, given_back, kept_in_worker, map_arrow, small_batches, struct

#: Labelled rows that a model is fitted on at most, taken in the order of a hash of their id.
MAX_LABELLED = 8_000
#: Letters of a stem, least and most, and the least number of toxic texts for a term.
STEM, MOST_STEM, LEAST_TEXTS = 4, 9, 4
WINDOW = 6
REJECT = 0.7

_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»"}
#: Words of reporting. Fixed values.
_REPORTING = frozenset("said says wrote called quoted quote quoting reported word slur term dit écrit sagte schrieb dijo escribió".split())


def errors_for(term: str) -> int:
    return 0 if term.endswith("*") or len(term) < 6 else 1 if len(term) < 9 else 2


class Matcher:
    """The terms' trie in product with Levenshtein automata, determinised step by step."""

    #: Words known to match nothing that are kept; beyond that, their memory begins anew. Words that match are few.
    WORDS = 150_000
    #: States that are kept; beyond that, they are made anew.
    STATES = 30_000
    #: Words known to match that are kept.
    HITS = 50_000

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.most = [0]
        self.term: list[tuple[int, int] | None] = [None]  # (number of the term, errors it may have)
        self.stem: list[int | None] = [None]
        for n, term in enumerate(terms):
            node, k = 0, errors_for(term)
            for c in term.removesuffix("*"):
                self.most[node] = max(self.most[node], k)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                    self.term.append(None)
                    self.stem.append(None)
                node = self.children[node][c]
            self.most[node] = max(self.most[node], k)
            if term.endswith("*"):
                self.stem[node] = n
            else:
                self.term[node] = (n, k)
        self._begin_anew()
        self.hits: dict[str, tuple[int, int]] = {}
        self.clean: set[str] = set()

    def _begin_anew(self) -> None:
        self.states: list[dict[int, int]] = []
        self.known: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.stems: list[int | None] = []  # by state: the stem that is complete there
        self.begin = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """With what is reached by leaving out letters of terms."""
        todo = [*nodes.items()]
        while todo:
            node, e = todo.pop()
            if nodes.get(node) == e and e < self.most[node]:
                for child in self.children[node].values():
                    if e + 1 <= self.most[child] and nodes.get(child, 99) > e + 1:
                        nodes[child] = e + 1
                        todo.append((child, e + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(nodes)
            self.moves.append({})
            self.stems.append(next((self.stem[n] for n, e in nodes.items() if e == 0 and self.stem[n] is not None), None))
        return self.known[key]

    def _move(self, state: int, letter: str) -> int:
        out: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.most[node] and out.get(node, 99) > e:
                out[node] = e

        for node, e in self.states[state].items():
            reach(node, e + 1)
            for c, child in self.children[node].items():
                reach(child, e if c == letter else e + 1)
        return self._state(out) if out else -1

    def hits_in(self, words: set[str]) -> set[str]:
        """Those of the words that match."""
        new = words - self.clean
        if not new:
            return new
        found = {w for w in new if w in self.hits or self.match(w)}
        if len(self.clean) > self.WORDS:
            self.clean = set()
        self.clean |= new - found
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """(number of the term, errors), the fewest errors first; a stem that begins the word counts as 0 errors."""
        if word in self.hits:
            return self.hits[word]
        if len(self.states) > self.STATES:
            self._begin_anew()
        state, stem, moves = self.begin, None, self.moves
        for c in word:
            after = moves[state].get(c)
            if after is None:
                after = moves[state][c] = self._move(state, c)
            state = after
            if state < 0:
                break
            if stem is None:
                stem = self.stems[state]
        found = [(e, self.term[n][0]) for n, e in self.states[state].items() if self.term[n] and e <= self.term[n][1]] if state >= 0 else []
        if stem is not None:
            found.append((0, stem))
        if not found:
            return None
        e, term = min(found)
        if len(self.hits) > self.HITS:
            self.hits = {}
        self.hits[word] = (term, e)
        return term, e


class Settings(NamedTuple):
    """cover: terms that a toxic text is to have in the lexicon, where it has them; ratio: the least likelihood ratio
    (2 ln) of a term; share: how many times more often toxic texts hold it than clean ones, at least. The defaults were
    taken by `compare_settings`, among rows that aren't held out."""

    cover: int = 2
    ratio: float = 20.0
    share: float = 6.0


FEATURES = ("bare", "quoted", "misspelled", "terms", "density", "window")


def features(text: str | None, matcher: Matcher) -> list[float]:
    folded = (text or "").lower()
    hits = matcher.hits_in(set(_WORD.findall(folded)))
    if not hits:
        return [0.0] * len(FEATURES)
    bare, quoted, misspelled, terms, places, n = 0, 0, 0, set(), [], 0
    opened, read, recent = "", 0, []
    for n, m in enumerate(_WORD.finditer(folded), 1):
        for c in folded[read : m.start()]:
            if c == opened:
                opened = ""
            elif not opened and c in _QUOTES:
                opened = _QUOTES[c]
            elif c == "\n":
                opened = ""
        read, word = m.end(), m[0]
        if word in hits:
            term, e = matcher.match(word)
            terms.add(term)
            misspelled += e > 0
            if opened or any(w in _REPORTING for w in recent):
                quoted += 1
            else:
                bare += 1
                places.append(n)
        recent = [*recent[1 - WINDOW :], word]
    window = max((sum(p <= q < p + WINDOW for q in places[i : i + WINDOW]) for i, p in enumerate(places)), default=0)
    return [math.log1p(bare), math.log1p(quoted), math.log1p(misspelled), float(len(terms)), min(10.0, 100 * (bare + quoted) / n), float(window)]


def _terms_of(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:k] + "*" for w in words for k in range(STEM, min(len(w), MOST_STEM + 1))}


def _counts(rows: DataFrame, only: frozenset[str] | None) -> dict[str, int]:
    """In how many of these texts each term stands (of those given), added up in each task and then by Spark."""

    def make() -> object:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            found: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                terms = _terms_of(text)
                found.update(terms & only if only is not None else terms)
            yield {"term": [*found], "n": [*found.values()]}

        return step

    counted = map_arrow(rows.select("text"), make, struct("term string, n long")).groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counted.where(F.col("n") >= (1 if only is not None else LEAST_TEXTS)).collect()}


def _terms_within(rows: DataFrame, good: list[str]) -> list[list[str]]:
    """For each of these texts (a bounded sample) the good terms that it holds."""
    known = rows.sparkSession.sparkContext.broadcast(frozenset(good))

    def make() -> object:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            yield {"terms": ["\n".join(sorted(_terms_of(t) & known.value)) for t in batch.column(0).to_pylist()]}

        return step

    return [r["terms"].split("\n") if r["terms"] else [] for r in map_arrow(rows.select("text"), make, struct("terms string")).collect()]


def _ratio(a: int, n: int, b: int, m: int) -> float:
    """Twice the log likelihood ratio of two shares a / n and b / m, negative if the first is lower."""

    def part(x: float, of: float) -> float:
        return x * math.log(x / of) if x else 0.0

    both = (a + b) / (n + m)
    g = 2 * (part(a, n * both) + part(n - a, n * (1 - both)) + part(b, m * both) + part(m - b, m * (1 - both)))
    return g if a * m > b * n else -g


def good_terms(toxic: dict[str, int], n: int, clean: dict[str, int], m: int, settings: Settings = Settings()) -> dict[str, float]:
    """Terms over the threshold with their ratio."""
    score = {t: _ratio(a, n, clean.get(t, 0), m) for t, a in toxic.items()}
    return {t: s for t, s in score.items() if s >= settings.ratio and clean.get(t, 0) * n * settings.share <= toxic[t] * m}


def choose_terms(texts: list[list[str]], score: dict[str, float], cover: int = Settings().cover) -> list[str]:
    """Of the good terms of each toxic text, few that give every text `cover` terms if it has as many: the one that helps
    most texts first, then the higher ratio, then the shorter. So copies of one text don't bring in all of its words."""
    need, holders = [cover] * len(texts), {}
    for i, terms in enumerate(texts):
        for t in terms:
            holders.setdefault(t, set()).add(i)
    chosen: list[str] = []
    while holders:
        best = max(holders, key=lambda t: (len(holders[t]), score[t], -len(t), t))
        if len(holders[best]) < LEAST_TEXTS:
            break
        chosen.append(best)
        done = set()
        for i in holders.pop(best):
            need[i] -= 1
            if not need[i]:
                done.add(i)
        stem = best.removesuffix("*") if best.endswith("*") else None
        for t in [*holders]:
            if stem is not None and t.startswith(stem):  # a chosen stem stands for what it begins
                del holders[t]
            else:
                holders[t] -= done
                if not holders[t]:
                    del holders[t]
    return sorted(chosen)


def _misspelled(rows: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many of these texts each of the words stands misspelled, with what the automata allow."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def make() -> object:
        matcher = _matcher(shared.value)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            found: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                hits = [matcher.match(w) for w in matcher.hits_in(set(_WORD.findall((text or "").lower())))]
                found.update({shared.value[term] for term, e in hits if e})
            yield {"term": [*found], "n": [*found.values()]}

        return step

    counted = map_arrow(rows.select("text"), make, struct("term string, n long")).groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counted.collect()}


def sure_words(words: list[str], hit: dict[str, int], n: int, false: dict[str, int], m: int, share: float = Settings().share) -> list[str]:
    """Of the good words those whose misspellings pass for them: no word of clean texts, by the share of good_terms. hit,
    false: in how many toxic (of n) and clean (of m) texts they stand misspelled."""
    return [w for w in words if false.get(w, 0) * n * share <= hit.get(w, 0) * m]


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton's method; the first weight is the intercept, which the ridge leaves alone."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, hold = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(rows: DataFrame, terms: list[str]) -> DataFrame:
    """The rows' own columns but text, and the features."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def make() -> object:
        matcher = _matcher(shared.value)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            found = np.array([features(t.as_py(), matcher) for t in batch.column("text")]).reshape(-1, len(FEATURES))
            yield {f.name: batch.column(f.name) for f in kept} | {n: found[:, i] for i, n in enumerate(FEATURES)}

        return step

    schema = struct(", ".join(f"{n} double" for n in FEATURES))
    for f in reversed(kept):
        schema.fields.insert(0, f)
        schema.names.insert(0, f.name)
    return map_arrow(rows, make, schema)


def _matcher(terms: list[str]) -> Matcher:
    return kept_in_worker(("matcher", *terms), lambda: Matcher(terms))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, settings: Settings = Settings()) -> tuple[list[str], np.ndarray]:
    """(terms, weights), from labelled rows that aren't held out."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    chosen = marked.where(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id", "toxic").limit(max_labelled)
    rows = _at_most(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "_id"), max_labelled).select("toxic", "text").persist()
    distinct = rows.dropDuplicates(["toxic", "text"]).persist()
    try:
        sizes = {r["toxic"]: r["n"] for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n, m = sizes.get(1, 0), sizes.get(0, 0)
        if not n or not m:
            return [], np.array([30.0 if n else -30.0, *[0.0] * len(FEATURES)])
        bad, fine = distinct.where("toxic = 1"), distinct.where("toxic = 0")
        toxic = _counts(bad, None)
        good = good_terms(toxic, n, _counts(fine, frozenset(toxic)), m, settings)
        words = sorted(t for t in good if not t.endswith("*"))
        sure = sure_words(words, _misspelled(bad, words), n, _misspelled(fine, words), m, settings.share) if words else []
        terms = sorted({*choose_terms(_terms_within(bad, [*good]), good, settings.cover), *sure})
        table = np.array([[*r] for r in _featured(rows, terms).collect()], dtype=float)
        return terms, fit_weights(table[:, 1:], table[:, 0])
    finally:
        distinct.unpersist()
        rows.unpersist()


def _at_most(rows: DataFrame, most: int) -> DataFrame:
    """The rows (_id, toxic, text), of which ids that repeat may make more than there are labels: then the first `most` in the
    order of a hash of all three."""
    if rows.limit(most + 1).count() <= most:
        return rows
    return rows.orderBy(F.xxhash64("_id", "toxic", "text"), "_id", "toxic", "text").limit(most)


def fit_locally(rows: list[tuple[int, str]], settings: Settings = Settings()) -> tuple[list[str], np.ndarray]:
    """What `fit` makes of a bounded sample of (toxic, text), without Spark: for comparing settings, and for tests."""
    bad, fine = ([_terms_of(t) for t in dict.fromkeys(t for y, t in rows if y == z)] for z in (1, 0))
    toxic = {t: k for t, k in Counter(t for s in bad for t in s).items() if k >= LEAST_TEXTS}
    good = good_terms(toxic, len(bad), Counter(t for s in fine for t in s if t in toxic), len(fine), settings)
    words = sorted(t for t in good if not t.endswith("*"))
    matcher = Matcher(words)

    def misspelled(texts: list[set[str]]) -> Counter[str]:
        found: Counter[str] = Counter()
        for s in texts:
            hits = [matcher.match(w) for w in matcher.hits_in({w for w in s if not w.endswith("*")})]
            found.update({words[term] for term, e in hits if e})
        return found

    sure = sure_words(words, misspelled(bad), len(bad), misspelled(fine), len(fine), settings.share)
    terms = sorted({*choose_terms([sorted(s & good.keys()) for s in bad], good, settings.cover), *sure})
    matcher = Matcher(terms)
    return terms, fit_weights(np.array([features(t, matcher) for _, t in rows]), np.array([y for y, _ in rows], dtype=float))


def predict(text: str | None, matcher: Matcher, weights: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(weights[0] + np.array(features(text, matcher)) @ weights[1:], -30, 30))))


def compare_settings(docs: DataFrame, labels: DataFrame, grid: list[Settings], folds: int = 3, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, reject: float = REJECT) -> list[tuple[Settings, int, int, int, int]]:
    """For each settings (them, toxic texts, those caught, clean texts, those rejected), each text judged by a model of
    the other folds. Only labelled rows that aren't held out are read, of which max_labelled at most go to the driver."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    chosen = marked.where(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id", "toxic").limit(max_labelled)
    fold = F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.lit(folds))  # copies of a text are in one fold
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "_id")
    rows = [(r["fold"], r["toxic"], r["text"] or "") for r in _at_most(rows, max_labelled).select(fold.alias("fold"), "toxic", "text").collect()]
    out = []
    for settings in grid:
        n, hit = Counter(y for _, y, _ in rows), Counter()
        for k in range(folds):
            terms, weights = fit_locally([(y, t) for f, y, t in rows if f != k], settings)
            matcher = Matcher(terms)
            hit.update(y for f, y, t in rows if f == k and predict(t, matcher, weights) >= reject)
        out.append((settings, n[1], hit[1], n[0], hit[0]))
    return out


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, reject: float = REJECT) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, and the features."""
    terms, weights = fit(docs, labels, id_col, text_col, max_labelled)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    z = F.lit(float(weights[0]))
    for n, w in zip(FEATURES, weights[1:]):
        z = z + F.lit(float(w)) * F.col(n)
    scored = _featured(rows, terms).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"), *FEATURES)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of docs that the model doesn't reject, all columns as they are."""
    terms, weights = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((terms, weights))
    where, names = docs.columns.index(text_col), docs.columns
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = shared.value
        matcher = _matcher(terms)
        for batch in batches:
            x = np.array([features(t.as_py(), matcher) for t in batch.column(where)]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield batch.filter(pa.array(p < reject)).rename_columns(names)
        del matcher
        given_back()

    return dotless(docs).mapInArrow(run, docs.schema)
