"""Phrase mining, decontamination and centroid clustering against brute force, with odd rows in the tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlake.llm import _common, centroids, contamination, phrases

from .test_text_operators import fold


def brute_phrases(rows, least, share, top):
    counts = collections.defaultdict(collections.Counter)
    totals = collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", fold(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) > len(p) and (q[:-1] == p or q[1:] == p) and b >= least and 100 * b >= share * a for q, b in f.items()):
                continue
            s, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def phrase_rows(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(8)] + ["É", "é", "x\x00", "\xa0", "A", "a", "日本"]
    rows = []
    for _ in range(90):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(rnd.randint(0, 60)))
        rows.append((rnd.choice(["en", "en", "en", "de", None, "und"]), text))
    rows += [("en", "the very same words here")] * 7 + [("fr", "b b b b b b")] * 3 + [("en", None), (None, ""), (None, None), ("zz", " . "), ("de", "w1 " * 4_000)]
    return rows


@pytest.mark.parametrize(("top", "stretch", "slots"), [(3, 8 << 20, 1 << 24), (5, 40, 1 << 16), (2_000, 400, 1 << 16)])
def test_phrases(spark, monkeypatch, top, stretch, slots):
    monkeypatch.setattr(phrases, "STRETCH", stretch)
    monkeypatch.setattr(_common, "SLOTS", slots)
    rows = phrase_rows(top)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "lang string, text string, phrase string, c int, h string").repartition(3)
    found = phrases.mine(df, least=3, top=top)
    assert sorted(tuple(r) for r in found.collect()) == brute_phrases(rows, 3, 50, top)
    assert [(c, t) for c, t in found.dtypes] == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *[(c, "bigint") for c in ("a", "l", "r", "n", "score")]]
    assert phrases.mine(df.where("false")).count() == 0


def test_phrases_need_several_rounds(spark, monkeypatch):
    """The best pairs fall to a longer phrase that scores low, so that the first bar leaves too few."""
    rows = [("en", f"p{i} q{i} the") for i in range(12) for _ in range(5)] + [("en", f"k{i} m{i // 2}.") for i in range(12) for _ in range(4 + i)]
    bars = []
    held = phrases._alive
    monkeypatch.setattr(phrases, "_alive", lambda pairs, longer, b, share: (bars.append({r["lang"]: r["bar"] for r in b.collect()}), held(pairs, longer, b, share))[1])
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.mine(df, least=3, top=5).collect()) == brute_phrases(rows, 3, 50, 5)
    assert len(bars) > 1 and all(x["en"] > y["en"] for x, y in zip(bars, bars[1:]))


def test_phrase_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000, 3_000_000_001, 3_000_000_002)], "a long, l long, r long")
    assert df.select(phrases.score("a", "l", "r").alias("s")).first()["s"] == 10**6 * 3_000_000_000**2 // (3_000_000_001 * 3_000_000_002)


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items, size=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = _WORD.findall(fold(text))
        for i in range(max(1, len(words) - size + 1)) if words else ():
            windows[tuple(words[i : i + size])].add(item)
    out = []
    for doc, text in docs:
        words = _WORD.findall(fold(text))
        hit, names = set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(words) - k + 1):
                if (own := windows.get(tuple(words[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    names |= own - {None}
        ids = sorted(map(str, names))
        out.append((doc, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def contamination_rows():
    rnd = random.Random(3)
    vocabulary = ["ab", "ba", "abab", "é", "7", "x" * 40, "q", "w", "ß日"]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, say(rnd.choice([3, 9, 10, 11, 25, 40]))) for i in range(40)] + [(3, "another text for three, long enough to have more than one window of words in it"), (None, "a null item of ten words or so that has windows too")]
    items += [(50, None), (51, ""), (52, " .,!"), (53, "lone"), (54, "one two"), (55, items[5][1]), (56, "z " * 12), (57, items[4][1].upper())]
    docs = []
    for i in range(60):
        parts = [say(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            parts.append(rnd.choice(items)[1] or "")
            parts.append(say(rnd.randint(0, 9)))
        docs.append((i, rnd.choice([" ", ", ", "\n", "\x00"]).join(parts)))
    docs += [(70, None), (71, ""), (72, "..."), (73, "Lone"), (74, "one-two"), (75, "onetwo"), (76, "z." * 3_000), (None, items[3][1]), (None, items[3][1]), (5, docs[5][1]), (77, "x " * 600 + items[6][1])]
    docs += [(78, items[40][1][:-1]), (79, " ".join([items[4][1]] * 300))]
    return docs, items


@pytest.mark.parametrize(("windows", "stretch"), [(100_000, 512), (250, 7)])
def test_contamination(spark, monkeypatch, windows, stretch):
    monkeypatch.setattr(contamination, "WINDOWS", windows)
    monkeypatch.setattr(contamination, "STRETCH", stretch)
    docs, items = contamination_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, window string, hits int").repartition(3)
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, item string").repartition(2)
    found = contamination.digest(contamination.find(df, bench))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_hits(docs, items)
    clean = contamination.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    bad = {r[0] for r in brute_hits(docs, items) if r[5] and r[0] is not None}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _ in docs if i not in bad)
    none = contamination.digest(contamination.find(df, bench.where("false"))).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)
    assert contamination.find(df.where("false"), bench).count() == 0


def test_shifts_skip_and_miss_nothing():
    """Texts that share no words with the windows are passed by in steps of a window less one."""
    rnd = np.random.default_rng(1)
    table = contamination.Table(10, [([f"p{k}{j}".encode() for j in range(10)], [str(k)]) for k in range(50)])
    assert (table.shift == 9).mean() > 0.85 and (table.shift == 0).sum() >= 40
    body = [f"t{i}" for i in rnd.integers(0, 1_000, 5_000)]
    body[100:110] = [f"p7{j}" for j in range(10)]
    body[109:119] = [f"p9{j}" for j in range(10)]
    data = np.frombuffer(" ".join(body).encode(), np.uint8)
    end, window = table.search(contamination.Words.of(data, np.array([len(data)])))
    assert [(e, table.items[w]) for e, w in sorted(zip(end.tolist(), window.tolist()))] == [(118, ["9"])]


def brute_centroids(rows, k, rounds, size):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    name = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~"
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [near(v) for _, v in kept]
    sums = collections.Counter()
    for d, j in last:
        sums[j] += d
    return sorted(((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last)), key=str)


@pytest.mark.parametrize(("n", "k", "size", "scale"), [(400, 12, 6, 1.0), (60, 40, 4, 3e5), (9, 20, 3, 1.0)])
def test_centroids(spark, n, k, size, scale):
    rnd = np.random.default_rng(n)
    rows = [(i, (rnd.normal(size=size) * scale / 9 + rnd.integers(0, 4, size) * scale).tolist()) for i in range(n)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (1_000, [0.0] * size)] + [(2_000 + i, rows[7][1]) for i in range(10)]
    rows += [(3_000, None), (3_001, []), (3_002, [1.0] * (size + 1)), (3_003, [None] * size), (3_004, [float("nan")] * size), (3_005, [float("inf"), *[0.0] * (size - 1)])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, v int").repartition(3)
    state, c = centroids.cluster(df, k=k, size=size)
    found = sorted((tuple(r) for r in centroids.digest(state, c).collect()), key=str)
    assert found == brute_centroids(rows, k, 5, size)
    assert centroids.digest(*centroids.cluster(df.where("false"), k=k, size=size)).count() == 0


def test_loosening_holds_and_is_less_than_the_drift():
    rnd = np.random.default_rng(2)
    less = 0
    for _ in range(400):
        o, c, move = rnd.normal(size=5) * 4, rnd.normal(size=5) * 4, rnd.normal(size=5) * rnd.choice([0.01, 0.5, 3])
        radius = float(rnd.choice([0.0, 0.3, 2.0]))
        bound, drift = centroids.loosening(o, radius, c, c + move), np.linalg.norm(move)
        x = rnd.normal(size=(300, 5))
        x = o + x / np.linalg.norm(x, axis=1)[:, None] * radius * rnd.uniform(0, 1, (300, 1)) ** 0.2
        nearer = np.linalg.norm(x - c, axis=1) - np.linalg.norm(x - c - move, axis=1)
        assert nearer.max() <= bound + 1e-9 and bound <= drift * (1 + 1e-6)
        less += bound < 0.9 * drift
    assert less > 200
    assert centroids.loosening(np.zeros(2), 1.0, np.ones(2), np.ones(2)) == 0.0


def test_bounds_spare_most_vectors():
    """In later rounds only few vectors are measured against all centroids, and none is misplaced."""
    rnd = np.random.default_rng(5)
    true = rnd.integers(-2_000, 2_000, (8, 16))
    x = (true[rnd.integers(0, 8, 3_000)] + rnd.normal(size=(3_000, 16)) * 60).astype(np.int64)
    c = np.concatenate([true + 40, true[:2] + 300]).astype(np.int64)
    cluster, upper, lower = centroids.nearest_two(x, c)
    upper, lower, measured = upper * (1 + centroids.SLACK), lower * (1 - centroids.SLACK), []
    for _ in range(4):
        new = np.array([np.floor(x[cluster == j].mean(axis=0)) if (cluster == j).any() else c[j] for j in range(len(c))], np.int64)
        radius = {j: float(upper[cluster == j].max()) for j in range(len(c)) if (cluster == j).any()}
        cluster, upper, lower, n = centroids.reassigned(x, cluster, upper, lower, centroids.Moved(c, new, radius))
        assert (cluster == centroids.squared(x, new).argmin(axis=1)).all()
        measured.append(n)
        c = new
    assert measured[-1] < 300


def test_vectors_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(df, size=2)


def test_op13_over_whole_table(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").agg(F.count("*")).first()[0]
    from boutlake.llm import queries

    found = queries.op13_centroids(spark, data)
    assert found.count() == rows and found.select("inertia").distinct().count() == 1
