"""Shared boilerplate, rates of millions, ledgers of several steps, labels that repeat, and columns with dots in their names."""

import random

import pytest
from pyspark.sql import functions as F

from boutlake.llm import centroids, chat, contamination, exact_dedup, mixing, neighbours, ngram_join, packing, phrases, secrets, token_counts, token_files, tokens, toxicity

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def boilerplate(n, own, shared):
    footer = [f"s{i}" for i in range(shared)]
    return [(k, " ".join([*[f"o{k}x{j}" for j in range(own)], *footer])) for k in range(n)]


def test_boilerplate_is_no_hot_key_and_makes_no_pairs(spark, monkeypatch):
    """Texts that share most of their words, but too few to be linked: their windows are split and bounded."""
    rows = boilerplate(1_500, 15, 89)  # 85 of 115 shingles shared
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hot, twice = ngram_join.frequent(df, "text", 5, 80)
    assert len(hot) == 85
    found = ngram_join.entries(df, "text", 5, 80, hot, twice, ())
    assert found.groupBy("key", "part").count().agg(F.max("count")).first()[0] <= 64
    verified = []
    held = ngram_join.shared_counts
    monkeypatch.setattr(ngram_join, "shared_counts", lambda pairs, sets: (verified.append(pairs.count()), held(pairs, sets))[1])
    out = ngram_join.jaccard_join(df)
    assert out.where("component_id <> doc_id").count() == 0 and sum(verified) <= 3_000


def test_frequent_shingles_of_windows_are_all_counted(spark):
    """No shingle of a window is frequent and yet held for rare, whatever its hash."""
    rnd = random.Random(8)
    footers = [[f"f{k}w{i}" for i in range(rnd.randint(20, 80))] for k in range(5)]
    rows = [(i, " ".join([f"o{i}x{j}" for j in range(rnd.randint(0, 30))] + rnd.choice(footers) + rnd.choice(footers))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hot, twice = ngram_join.frequent(df, "text", 5, 80)
    cold = ngram_join.entries(df, "text", 5, 80, hot, twice, ()).where("part = 0")
    assert cold.groupBy("key").agg(F.countDistinct("node").alias("n")).agg(F.max("n")).first()[0] <= ngram_join.HOT


def test_a_rate_of_millions(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None)], "doc_id long, text string, source string")
    out = mixing.mix(df, weights={"x": 1.0, "y": 1e-6}, budget=2e6)
    n = {r["doc_id"]: (r["n"], r["d"], r["least"], r["most"]) for r in out.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.min("copy").alias("least"), F.max("copy").alias("most")).collect()}
    size, distinct, least, most = n[1]
    assert abs(size - 2e6) < 1e4 and distinct == size and (least, most) == (0, size - 1) and set(n) <= {1, 2}


def test_ledger_in_steps(spark):
    rows = [(1, "a", "password = hunter22"), (1, "b", "nothing"), (2, "a", "password = hunter22"), (3, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, v string, text string")
    ledger = secrets.new_ledger(spark)
    secrets.record(df.where("doc_id = 1"), ledger)
    count = lambda path: spark.read.schema(secrets.LEDGER).parquet(path).count()
    assert count(ledger) == 2
    found = secrets.scan(df, ledger, version_col="v").collect()
    assert sorted((r["doc_id"], r["version"], len(r["kinds"])) for r in found) == [(1, "a", 1), (1, "b", 0), (2, "a", 1), (3, "a", 0)]
    assert count(ledger) == 3  # the blank text is new, no other
    secrets.record(df, ledger, rule_version="2")
    assert count(ledger) == 6
    secrets.record(df, ledger, rule_version="2")
    assert count(secrets.compacted(spark, ledger)) == 6
    assert secrets.findings_of(df, secrets.compacted(spark, ledger)).count() == 4


def test_labels_that_repeat_are_bounded(spark):
    docs = spark.createDataFrame([(2, f"text {i}") for i in range(300)] + [(3, "toxic badword"), (5, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 0), (3, 1), (5, 0)], "doc_id long, toxic int")
    seen = []
    held = toxicity._at_most
    try:
        toxicity._at_most = lambda rows, most: (seen.append(out := held(rows, most)), out)[1]
        toxicity.fit(docs, labels, max_labelled=20)
    finally:
        toxicity._at_most = held
    assert seen[0].count() <= 20


@pytest.fixture(scope="module")
def dotted(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["ab", "cd", "ef", "gh", "token: abcdef123"]) for _ in range(30)), f"s{i % 2}", "en", [float(i), 1.0 + i % 3]) for i in range(12)]
    return spark.createDataFrame([*rows, rows[3]], "`doc.id` long, `the.text` string, `a.source` string, `its.lang` string, `a.vector` array<double>")


def test_names_with_dots(spark, dotted):
    n, at = dotted.count(), {"id_col": "doc.id", "text_col": "the.text"}
    items = spark.createDataFrame([(1, "ab cd ef")], "`item.id` long, `item.text` string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    assert ngram_join.jaccard_join(dotted, **at).count() == n
    assert ngram_join.one_of_each(dotted, **at).columns == dotted.columns
    assert set(dotted.columns) <= set(mixing.mix(dotted, source_col="a.source", id_col="doc.id").columns)
    assert token_files.read_token_files(spark, token_files.write_token_files(dotted, tokens.token_file(BYTES), end_id=0, **at)).count() == n
    assert exact_dedup.exact_groups(dotted, **at).count() == n
    assert exact_dedup.drop_copies(dotted, **at).columns == dotted.columns
    assert token_counts.count_tokens(dotted, tokens.token_file(WORDS), **at).count() == n
    assert neighbours.nearest(dotted, F.col("`doc.id`") % 5 == 0, 2, id_col="doc.id", vector_col="a.vector").count() == 6
    assert packing.pack_documents(dotted, tokens.token_file(WORDS), capacity=64, end_id=1, **at).count() >= n
    assert secrets.scan(dotted, secrets.new_ledger(spark), **at).count() == n
    assert toxicity.score(dotted, labels, **at).count() == n
    assert toxicity.drop_toxic(dotted, labels, **at).columns == dotted.columns
    assert phrases.mine(dotted, text_col="the.text", lang_col="its.lang", least=2).count() > 0
    found = contamination.find(dotted, items, id_col="doc.id", text_col="the.text", item_col="item.id", item_text_col="item.text")
    assert found.count() == n
    state, _ = centroids.cluster(dotted, k=3, size=2, id_col="doc.id", vec_col="a.vector")
    assert state.count() == n
    turns = dotted.withColumn("conv_id", F.col("`doc.id`")).withColumn("turn", F.lit(0)).withColumn("role", F.lit("user")).withColumn("text", F.col("`the.text`"))
    assert chat.read_back(chat.format_conversations(turns)).count() == 12


def test_pipeline_of_odd_rows(spark, data):
    """Nulls, blanks, long and repeated texts, repeated rows and ids, and columns with the stages' own names."""
    import corpus_pipeline

    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(30)]
    long = " ".join(rnd.choice(words) for _ in range(30_000))
    texts += [None, "", None, " ", texts[0], texts[1].upper(), long, long + " more", *[f"{texts[2]} {texts[3]} {texts[4]} {texts[5]} {x}" for x in ("a", "b")]]
    rows = [(10_000 + i, t, rnd.choice(["s0", "s1", None]), "x", i, "y", 0.5, "z") for i, t in enumerate(texts)]
    rows += [rows[0], (None, "a null id", "s0", "x", 0, "y", 0.5, "z"), (None, None, None, None, None, None, None, None), (10_001, "another text for this id", "s1", "x", 0, "y", 0.5, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy string, shuffle_key int, _row string, `a.score` double, node string").repartition(3)
    docs, seen = df, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = ngram_join.stored(stage(spark, docs, data), "odd-stage")
        seen[name] = [r.asDict() for r in docs.collect()]
        assert name == "best-fit packing" or docs.columns == df.columns
    assert len(seen["toxicity"]) == len(rows)  # nothing like a toxic text is in here
    fold = lambda r: "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
    assert sorted(map(fold, seen["exact dedup"])) == sorted({fold({"text": r[1]}) for r in rows})
    near = {fold(r) for r in seen["n-gram Jaccard join"]}
    gone = {fold(r) for r in seen["exact dedup"]} - near
    assert long + " more" in gone and long in near and len(gone) == 2
    mixed, packed = seen["mixing sources"], seen["best-fit packing"]
    assert {fold(r) for r in mixed} <= near and sum(r["piece"] == 0 for r in packed) == len(mixed)
    per = {}
    for r in packed:
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in per.values():
        ends = [0, *[o + n for o, n in sorted(parts)]]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("false"), data).count() == 0
