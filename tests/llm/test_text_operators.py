"""Dedup, join, mixing, tokens, packing, secrets and toxicity against brute force, with odd rows in the tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from boutlake.llm import exact_dedup, mixing, ngram_join, packing, secrets, shingles, token_counts, token_files, tokens, toxicity
from boutlake.llm._common import stored

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = [None, "", " ", "\n\n", "a", "A", "a b", "a  B\tc", "x" * 5_000, "word " * 3_000, "é ́x  İ ΣΑΣ", "<|endoftext|> a  <|endoftext|>", "don't  'S  12ab 日本 語\xa0 \xa0x", "a\x1cb", " a", "a "]


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))


@pytest.fixture(scope="module")
def docs(spark, data):
    """Driver rows, near and exact copies of them, odd texts, null and repeated ids, and columns that clash with own names."""
    rnd = random.Random(5)
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(60).collect()]
    for t in texts[:25]:
        words = t.split(" ")
        for _ in range(rnd.randint(0, 3)):
            near = [*words]
            for _ in range(max(1, len(words) // 60)):
                near[rnd.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    texts += texts[:10] + [t.upper() for t in texts[:5]] + ODD + ODD[:6]
    rows = [(i, t, f"s{i % 3}", "k", i, "r", 0) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, "k", 0, "r", 0), (None, "nothing like it here at all", "s1", "k", 0, "r", 0), (3, texts[3], "s0", "k", 0, "r", 0)]
    schema = "doc_id long, text string, source string, key string, node long, _row string, copy int"
    return stored(spark.createDataFrame(rows, schema).repartition(5), "test-docs")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_exact_groups(docs):
    groups = collections.defaultdict(list)
    for i, t in rows_of(docs):
        groups[fold(t)].append(i)
    expected = []
    for body, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        expected += [(i, best, len(ids), hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    found = exact_dedup.exact_groups(docs, bucket_bytes=3_000).collect()
    key = lambda t: str(t)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=key) == sorted(expected, key=key)
    assert sum(r["kept"] for r in found) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_drop_copies(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [fold(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({fold(t) for _, t in rows_of(docs)})
    ties = docs.sparkSession.createDataFrame([(7, "Same", i) for i in range(9)] + [(None, "same", 0)], "doc_id long, text string, extra int")
    stay = {tuple(exact_dedup.drop_copies(ties.repartition(n)).collect()) for n in (1, 2, 5)}
    assert len(stay) == 1 and len(*stay) == 1 and next(iter(*stay))["doc_id"] == 7


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[find(i)] = min(ident, least.get(find(i), ident))
    return sorted(((ident, len(sets[i]), least.get(find(i)) if sets[i] else ident) for i, (ident, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("percent", "region", "block"), [(80, 48, 512), (50, 2, 12), (80, 3, 8)])
def test_jaccard_join(docs, monkeypatch, percent, region, block):
    monkeypatch.setattr(ngram_join, "REGION", region)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    found = ngram_join.jaccard_join(docs, percent=percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == brute_components(rows_of(docs), percent)


@pytest.mark.parametrize(("percent", "region", "block"), [(80, 48, 512), (80, 2, 12)])
def test_all_links_inside_components_too(docs, monkeypatch, percent, region, block):
    monkeypatch.setattr(ngram_join, "REGION", region)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    least = {}
    for ident, text in rows_of(docs):
        own = frozenset(shingle_set(text))
        if own:
            least[own] = min([i for i in (ident, least.get(own)) if i is not None], default=None)
    sets, links = [*least], []
    for j, y in enumerate(sets):
        for x in sets[:j]:
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                links.append((*sorted([(str(least[x]), len(x)), (str(least[y]), len(y))]), both))
    found = ngram_join.jaccard_links(docs, percent=percent).collect()
    assert sorted((*sorted([(str(r["a"]), r["n"]), (str(r["b"]), r["m"])]), r["shared"]) for r in found) == sorted(links)
    joined = {s for link in links for s in link[:2]}
    assert len(links) > len(joined) / 2  # some groups have more links than a tree


def test_one_of_each(docs):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    named = {i: c for i, _, c in brute_components(rows_of(docs), 80)}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in named.items() if i is None or i == c}


def test_words_are_compared_whole(spark):
    """Two words of 1,024 letters whose letters' sums agree in any polynomial modulo 2 ** 64, and long words that differ at one place."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1_024))
    texts = [thue, thue.translate(str.maketrans("ab", "ba")), "w" * 40, "w" * 39 + "x", "w" * 32, "w" * 33, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_join(df).collect()) == [(i, i) for i in range(len(texts))]


def test_clashing_numbers_are_told_apart():
    own = np.arange(7, dtype=np.uint64)
    first = ngram_join._node(own, ())
    second = ngram_join._node(own, (frozenset([first]),))
    third = ngram_join._node(own, (frozenset([first]), frozenset([second])))
    assert len({first, second, third}) == 3
    assert ngram_join._node(own, (frozenset([5]), frozenset([first]))) == first  # only sets that clashed take another number


def test_shingles_are_those_of_words():
    import pyarrow as pa

    texts = ["a b c d e f", "A b  c\nd e f", "a b", "b a", "", None, " x"]
    found = [set(s.tolist()) for s in shingles.sets(pa.array(texts))]
    assert found[0] == found[1] and len(found[0]) == 2
    assert len(found[2]) == 1 and found[2] != found[3]
    assert not found[4] and not found[5] and len(found[6]) == 1


def test_sketches_never_rule_out_links():
    rnd = np.random.default_rng(0)
    for _ in range(300):
        n = int(rnd.integers(4, 3_000))
        x = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: len(x) - int(rnd.integers(0, max(1, len(x) // 5)))], rnd.integers(0, 1 << 63, int(rnd.integers(0, max(1, n // 8))), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            assert ngram_join.may_link(ngram_join.sketch(x), len(x), ngram_join.sketch(y), len(y), 80)


def test_mixing_draws_poisson_counts(spark, docs):
    big = spark.range(6_000).selectExpr("id as doc_id", "concat('t', id) as text", "case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' else null end as source")
    weights = {"a": 3.0, "b": 1.0}
    out = mixing.mix(big, weights=weights, budget=8_000)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"a", "b"} and abs(n["a"] - 6_000) < 300 and abs(n["b"] - 2_000) < 180
    again = mixing.mix(big.repartition(7), weights=weights, budget=8_000)
    assert sorted(r["shuffle_key"] for r in out.collect()) == sorted(r["shuffle_key"] for r in again.collect())
    counts = collections.Counter(r["doc_id"] for r in out.where("source = 'a'").collect())
    share = sum(c == 3 for c in counts.values()) / 2_000
    assert abs(share - 0.224) < 0.03  # P(X = 3) of mean 3
    order = [r["shuffle_key"] for r in mixing.mix(docs).collect()]
    assert order == sorted(order)


def test_mixing_keeps_clashing_columns_and_splits_null_ids(spark):
    rows = [(None, f"t{i}", "a", i, "k") for i in range(2_000)] + [(1, "t", "a", 7, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Copy int, shuffle_key string")
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "copy_", "shuffle_key_"]
    found = out.collect()
    assert {r["text"]: r["Copy"] for r in found}.items() <= {r[1]: r[3] for r in rows}.items() and {r["shuffle_key"] for r in found} == {"k"}
    share = len({r["text"] for r in found}) / len(rows)
    assert abs(share - 0.632) < 0.05  # drawn row by row: 1 - 1 / e of them have a copy


def test_mixing_of_large_means(spark):
    few = spark.createDataFrame([(1, "t", "a"), (2, "u", "a")], "doc_id long, text string, source string")
    n = mixing.mix(few, budget=4_000).count()
    assert abs(n - 4_000) < 320


def test_encoder_is_the_librarys():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    signs = [*"ab1. '\n\t\xa0é\x85　́-X’", "'s", "  "]
    texts = ODD + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 25))) for _ in range(3_000)]
    for name in (BYTES, WORDS):
        path = tokens.token_file(name)
        own = [x.tolist() for ids, ends in tokens.Encoder(path)(pa.array(texts)) for x in tokens.per_text(ids, ends)]
        assert own == [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    path = tokens.token_file(BYTES)
    tok = Tokenizer.from_file(path)
    found = token_files.read_token_files(spark, token_files.write_token_files(docs, path)).collect()
    assert len(found) == docs.count()
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    said = collections.Counter((i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in rows_of(docs))
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in found) == said
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in found)
    whole = sorted(bytes(r["ids"]) for r in found if r["doc_id"] == 3)
    folder = token_files.write_token_files(docs.repartition(2), path)
    assert sorted(x.astype("<u4").tobytes() for x in token_files.read_ids(spark, folder, 3)) == whole and len(whole) == 2
    assert sorted(x.astype("<u4").tobytes() for x in token_files.read_ids(spark, folder, 3, 2, 5)) == sorted(x[8:20] for x in whole)
    again = {(r["start"], r["doc_id"], r["ids_crc32"]) for r in token_files.read_token_files(spark, folder).collect()}
    assert again == {(r["start"], r["doc_id"], r["ids_crc32"]) for r in found}  # ties have a defined order


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1_000, dtype=np.uint64).astype(np.uint32)
    packed = token_files.pack(ids, width)
    assert len(packed) == -(-1_000 * width // 8)
    for a, b in ((0, 1_000), (0, 0), (17, 18), (501, 999), (999, 1_000)):
        assert (token_files.unpack(packed, width, a, b) == ids[a:b]).all()


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = tokens.token_file(WORDS)
    tok = Tokenizer.from_file(path)
    said = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows_of(docs)]
    found = token_counts.count_tokens(docs, path, limit=100).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found), key=str) == sorted(said, key=str)
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in found)


def test_merging_takes_the_leftmost_of_equal_pairs():
    ranks = {("a", "a"): 0, ("aa", "a"): 1, ("b", "c"): 2}
    assert token_counts.merged_length([*"aaabc"], ranks) == 2
    assert token_counts.merged_length([*"aaaa"], ranks) == 2
    assert token_counts.merged_length(["a"], ranks) == 1


def test_packing(docs):
    from tokenizers import Tokenizer

    path, capacity = tokens.token_file(WORDS), 64
    tok = Tokenizer.from_file(path)
    found = packing.pack_documents(docs, path, capacity=capacity, keep_ids=True).collect()
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    whole = collections.Counter((i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows_of(docs))
    pieces = collections.Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"]), r["ids_crc32"]) for r in found)
    expected = collections.Counter()
    for (i, raw), n in whole.items():
        for k in range(-(-len(raw) // (4 * capacity))):
            cut = raw[4 * capacity * k : 4 * capacity * (k + 1)]
            expected[(i, k, capacity * k, cut, zlib.crc32(cut))] += n
    assert pieces == expected
    total = sum(r["length"] for r in found)
    assert len(sequences) <= -(-total // capacity) * 1.05 + 1


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(3)
    for _ in range(50):
        lengths = [rnd.randint(1, 50) for _ in range(rnd.randint(1, 200))]
        rooms: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(50 - n)
        runs = packing.plan(collections.Counter(lengths), 50)
        assert max(s + -(-c // e) for _, _, c, s, e, _ in runs) == len(rooms)


def test_secrets_and_their_ledger(spark):
    key = "AKIA" + "Z9" * 9
    texts = [
        None, "", "no such thing", 'api_key = "abcdef"; Secret: xyz', f"{key} token:abc password='longer/value+1='", "f" * 23 + " " + "0a" * 20,
        "ſecret=abcdef TOKEN=abcdef", "passwd=secret=abcdefgh", f"x{key}", "eyJ0123456789.abcdefghij.klmnopqrst",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[3], texts[4]])], "doc_id long, text string")
    ledger = secrets.new_ledger(spark)
    first = secrets.digest(secrets.scan(docs.where("doc_id < 5"), ledger)).collect()
    n = spark.read.parquet(ledger).count()
    assert n == 4 and len(first) == 5  # null and empty are one blob
    found = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs, ledger)).collect()}
    assert spark.read.parquet(ledger).count() == len({t or "" for t in texts}) and len(found) == 12
    secrets.scan(docs, ledger, rule_version="2").count()
    assert spark.read.parquet(ledger).count() == 2 * len({t or "" for t in texts})
    base = [("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    for i, t in enumerate([*texts, texts[3], texts[4]]):
        spans = [(m.start(), k, m.end(), name) for k, (name, rule, group, least) in enumerate(base) for m in rule.finditer(t or "") if len(m[group]) >= least]
        said = ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(spans))
        assert found[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [found[i][f"n_{n}"] for n in ("assign", "access", "hex")] == [sum(x[3] == n for x in spans) for n in ("assign", "access", "hex")]
        assert set(said.split(",")) - {""} <= set(found[i]["spans"].split(","))
    assert found[9]["spans"].startswith("jwt:0:")


def test_secrets_in_linear_time():
    import time

    old = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    rnd = random.Random(9)
    for _ in range(4_000):
        text = "".join(rnd.choice(["eyJ", "abcdefgh", "x", ".", ".", " ", "0123456789", "é"]) for _ in range(rnd.randint(0, 14)))
        assert [(s, e) for s, k, e in secrets.findings(text) if k == 3] == [m.span() for m in old.finditer(text)], text
    began = time.time()
    for text in ("eyJ" * 3_400_000, "eyJ." * 2_500_000, "secret " * 1_400_000, "AKIA" * 2_500_000, "-----BEGIN " * 900_000 + "PRIVATE KEY-----"):
        secrets.findings(text)
    assert time.time() - began < 60


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automata_find_what_brute_force_finds():
    terms = ["trash", "idiot*", "worthless", "pathetic", "disgusting", "scum"]
    matcher = toxicity.Matcher(terms)
    rnd = random.Random(2)
    words = ["idiots", "trasch", "worthles", "wothless", "pathetc", "ptahetic", "disgustign", "dsgustig", "scums", "", "a"]
    for _ in range(3_000):
        w = [*rnd.choice(terms).removesuffix("*")]
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "t", "s"])
        words.append("".join(w))
    for w in words:
        near = [(distance(w, t), i) for i, t in enumerate(terms) if not t.endswith("*") and distance(w, t) <= toxicity.errors_for(t)]
        near += [(0, i) for i, t in enumerate(terms) if t.endswith("*") and w.startswith(t[:-1])]
        assert matcher.match(w) == (min(near)[::-1] if near else None), w


def test_quotation_is_told_from_abuse():
    matcher = toxicity.Matcher(["idiot", "worthless"])
    bare, quoted = (toxicity.features(t, matcher) for t in ("you idiot, so worthless", 'they wrote "you idiot" in it'))
    assert bare[0] > 0 and bare[1] == 0 and quoted[0] == 0 and quoted[1] > 0
    assert toxicity.features("", matcher) == toxicity.features(None, matcher) == [0.0] * len(toxicity.FEATURES)
    assert toxicity.features("a wortless thing", matcher)[2] > 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic", "score").collect()
    hit = sum(r["predicted"] == r["toxic"] for r in scored) / len(scored)
    caught = [r["predicted"] for r in scored if r["toxic"] == 1]
    false = [r["predicted"] for r in scored if r["toxic"] == 0]
    assert hit > 0.97 and sum(caught) / len(caught) > 0.85 and sum(false) / len(false) < 0.01
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_misspelled_copies_of_learnt_terms(spark):
    rnd = random.Random(4)
    learnt = {"worthless": "wxrthless", "disgusting": "dqsgustng", "pathetic": "pxthetic", "stupid": "stqpid", "clowns": "xlowns"}
    plain = lambda: ["".join(rnd.choice("aeioklmr") for _ in range(rnd.randint(2, 6))) for _ in range(30)]
    abuse = [" ".join([*plain(), *learnt]) for _ in range(40)]
    texts = abuse + [" ".join(plain()) for _ in range(160)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < len(abuse))) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    terms, _ = toxicity.fit(docs, labels)
    matcher = toxicity.Matcher(terms)
    for word, wrong in learnt.items():
        assert word in terms and matcher.match(wrong) is not None and matcher.match(wrong)[1] > 0, wrong
    assert not matcher.hits_in({w for t in texts[len(abuse) :] for w in t.split()})
    wrong = [(i, re.sub("|".join(learnt), lambda m: learnt[m[0]], t)) for i, t in enumerate(texts)]
    scored = toxicity.score(docs.unionByName(spark.createDataFrame([(1_000 + i, t) for i, t in wrong], docs.schema)), labels).collect()
    assert {r["doc_id"]: r["predicted"] for r in scored if r["doc_id"] >= 1_000} == {1_000 + i: int(i < len(abuse)) for i, _ in wrong}


def test_toxicity_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, labels).count() == docs.count()
    assert toxicity.score(docs, labels.where("false")).select("predicted").distinct().collect()[0][0] == 0
    assert toxicity.drop_toxic(docs, labels.where("false")).columns == docs.columns


def test_empty_tables(spark, empty):
    path = tokens.token_file(WORDS)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    assert ngram_join.jaccard_join(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert token_files.read_token_files(spark, token_files.write_token_files(empty, path)).count() == 0
    assert token_counts.count_tokens(empty, path).count() == 0
    assert packing.pack_documents(empty, path).count() == 0
    assert secrets.digest(secrets.scan(empty, secrets.new_ledger(spark))).count() == 0


def test_toxicity_against_a_fit_without_spark(spark):
    """Terms, weights and scores of every row against those made of plain lists."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    fitted = [(r["toxic"], texts[r["doc_id"]] or "") for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["doc_id"] in texts]
    terms, weights = toxicity.fit_locally(fitted)
    found, other = toxicity.fit(docs, labels)
    assert found == terms and terms and np.allclose(weights, other, atol=1e-6)
    matcher = toxicity.Matcher(terms)
    for r in toxicity.score(docs, labels).collect():
        assert abs(r["score"] - toxicity.predict(texts[r["doc_id"]], matcher, weights)) < 1e-6
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7)
