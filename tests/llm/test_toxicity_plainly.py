"""Scores of toxicity worked out anew: distances by the textbook table, quotation and windows by rule, no automata."""

import functools
import math
import random
import re

from pyspark.sql import functions as F

from boutlake.llm import toxicity

QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»"}
REPORTING = set("said says wrote called quoted quote quoting reported word slur term dit écrit sagte schrieb dijo escribió".split())


@functools.cache
def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def allowed(term):
    return 0 if len(term) < 6 else 1 if len(term) < 9 else 2


def hit(word, terms):
    """(errors, number of the term) of the nearest term, a stem that begins the word as one without errors."""
    found = [(e, n) for n, t in enumerate(terms) if not t.endswith("*") and abs(len(t) - len(word)) <= 2 and (e := distance(word, t)) <= allowed(t)]
    stems = [(len(t), n) for n, t in enumerate(terms) if t.endswith("*") and word.startswith(t[:-1])]
    if stems:
        found.append((0, min(stems)[1]))
    return min(found, default=None)


def plain_features(text, terms):
    folded = (text or "").lower()
    bare = quoted = misspelled = n = 0
    seen, places, before, opened, at = set(), [], [], None, 0
    for n, m in enumerate(re.finditer(r"[^\W\d_]+", folded), 1):
        for c in folded[at : m.start()]:
            if c == "\n" or (opened and c == opened):
                opened = None
            elif opened is None and c in QUOTES:
                opened = QUOTES[c]
        at = m.end()
        found = hit(m[0], terms)
        if found:
            seen.add(found[1])
            misspelled += found[0] > 0
            if opened or REPORTING & set(before[-6:]):
                quoted += 1
            else:
                bare += 1
                places.append(n)
        before.append(m[0])
    if not seen:
        return [0.0] * 6
    window = max((sum(p <= q < p + 6 for q in places) for p in places), default=0)
    return [math.log1p(bare), math.log1p(quoted), math.log1p(misspelled), float(len(seen)), min(10.0, 100 * (bare + quoted) / n), float(window)]


def test_scores_of_every_text(spark):
    rnd = random.Random(31)
    plain = [f"{a}{b}{c}" for a in ("ban", "tel", "mor") for b in ("ora", "ite", "usi") for c in ("n", "st", "la", "rem")]
    bad = ["vilest", "grumblor", "zurkenthal", "mog", "krastig", "fliveropal"]

    def text(toxic):
        words = [rnd.choice(plain) for _ in range(rnd.randint(3, 40))]
        for _ in range(rnd.randint(1, 4) if toxic else 0):
            w = rnd.choice(bad)
            k = rnd.randrange(len(w))
            w = rnd.choice([w, w, w[:k] + w[k + 1 :], w[:k] + "q" + w[k:], w[:k] + "x" + w[k + 1 :], w + "ness"])
            words.insert(rnd.randrange(len(words) + 1), rnd.choice(["{}", "{}", '"{}"', "he said {}", "«{} », {}", "7{}_\n{}"]).replace("{}", w))
        return " ".join(words)

    rows = [(i, text(i % 3 == 0)) for i in range(700)] + [(9_000, None), (9_001, ""), (9_002, '" vilest mog\n mog'), (None, "vilest vilest")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(700)], "doc_id long, toxic int")
    terms, weights = toxicity.fit(docs, labels)
    assert {t.removesuffix("*")[:4] for t in terms} & {b[:4] for b in bad} and any(not t.endswith("*") and len(t) >= 6 for t in terms)
    found = toxicity.score(docs, labels)
    misspelled = 0
    texts = {(i, t) for i, t in rows}
    got = found.join(docs.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["doc_id"], r["text"]) in texts
        own = plain_features(r["text"], terms)
        misspelled += own[2] > 0
        assert [r[n] for n in toxicity.FEATURES] == own, (r["text"], terms)
        z = weights[0] + sum(w * x for w, x in zip(weights[1:], own))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.7)
    assert misspelled > 10
