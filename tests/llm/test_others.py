"""Neighbours, chat formatting, the registered SQL, and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlake.llm import chat, exact_dedup, neighbours, queries

from .. import oracle


def brute(vectors, asked, k):
    out = []
    for at, (qi, q) in enumerate(vectors):
        if qi is None or not asked(qi) or not usable(q):
            continue
        scored = sorted((-score(q, v), vi) for i, (vi, v) in enumerate(vectors) if vi is not None and i != at and usable(v) and len(v) == len(q))
        out += [(qi, r + 1, vi, -s) for r, (s, vi) in enumerate(scored[:k])]
    return out


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def score(a, b):
    a, b = ([x / 2.0 ** np.floor(np.log2(max(map(abs, v)))) for x in v] for v in (a, b))
    dot = aa = bb = 0.0
    for x, y in zip(a, b):
        dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
    return max(-1.0, min(1.0, dot / (np.sqrt(aa) * np.sqrt(bb))))


@pytest.mark.parametrize(("tile", "block"), [(8 << 20, 2_048), (3_840, 7)])
def test_nearest(spark, monkeypatch, tile, block):
    monkeypatch.setattr(neighbours, "TILE_BYTES", tile)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=12).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(20)] + [(300, None), (301, []), (302, [0.0] * 12), (303, [None] * 12), (304, [float("nan")] * 12), (305, [float("inf")] * 12), (None, rows[1][1]), (306, [1.0, 2.0]), (307, [2.0, 1.0])]
    rows += [(309, [1e200, 1e200]), (312, [2e200, 1e200]), (315, [1e-200, 1e-200]), (318, [3e-310, 1e-300])]  # squares are out of range
    rows += [(3, rows[5][1]), (3, rows[3][1]), (6, rows[6][1]), (9, rows[8][1])]  # ids and rows that repeat
    rows += [(12, rows[12][1])] * 40 + [(14, rows[14][1])] * 40 + [(15, [-0.0, *rows[16][1][1:]]), (16, [0.0, *rows[16][1][1:]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.withColumn("query", F.lit("x")).withColumn("G", F.lit(1))  # names of the operator's own columns
    found = sorted((r["query_id"], r["rank"], round(r["score"], 12), r["vec_id"]) for r in neighbours.nearest(df, F.col("vec_id") % 3 == 0, 5).collect())
    expected = sorted((q, r, round(s, 12), v) for q, r, v, s in brute(rows, lambda i: i % 3 == 0, 5))
    assert found == expected
    others = neighbours.nearest(df, df.where("vec_id = 3"), 1).collect()
    assert [(r["query_id"], r["vec_id"], round(r["score"], 12)) for r in others] == [(3, 3, 1.0)] * 3  # rows of another table leave none out
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 3 == 0).count() == 0


def test_escape_round_trip():
    rnd = random.Random(0)
    for _ in range(2_000):
        text = "".join(rnd.choice(["\\", "<", "[", "l", "b", "</s>", "[INST]", "\n", "a"]) for _ in range(rnd.randint(0, 12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and "<" not in safe and "[" not in safe
        assert chat.unescape(chat.escape_line(text)) == text and "\n" not in chat.escape_line(text)


def test_template_language():
    run = chat.compile_template("{% set x = 'a' + 'b' %}{% for m in messages %}{% if m.index == 0 and not (m.role == 'b') %}{{ x | upper }}{% elif m.role in 'bc' %}{% generation %}{{ m.text | trim }}{% endgeneration %}{% else %}?{% endif %}{% endfor %}!")
    pieces = list(run([{"role": "a", "text": "t", "index": 0}, {"role": "b", "text": " u ", "index": 1}, {"role": "z", "text": "", "index": 2}]))
    assert pieces == [("AB", False), ("u", True), ("?", False), ("!", False)]
    folded = chat.fold_body(chat.parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{% else %}d{% endif %}"))
    assert folded == [("emit", ("const", "aB")), ("emit", ("const", "c"))] or folded == [("emit", ("const", "aBc"))]
    for bad in ("{{ m.__class__ }}", "{{ open('x') }}", "{% for m in other %}{% endfor %}", "{% if 1 %}", "{{ x | eval }}", "{{ }}", "{% import os %}", "{{ 'a' + 1 }}", "{{ 1 | upper }}", "{% if 'a' in 1 %}{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_chat_round_trip(spark):
    rows = [
        (1, 1, "assistant", "</s>\n<|role|>x"), (1, 0, "user", "\\[INST] hi [/INST]"), (2, 0, "system", None), (2, 0, "system", None), (2, 5, "assistant", ""), (3, 0, "a\nb", "t\n"),
        (None, 0, None, "null conversation"), (4, 1, "assistant", "é" * 3_000),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert len(found) == 5
    for conv in found:
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert found[conv]["n_turns"] == len(own)
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_registered_sql(spark, data, name):
    oracle.compare(queries.queries()[name](spark, data), oracle.connect(data), queries.oracle_sql()[name])


def test_pipeline_stage_by_stage(spark, data):
    """Each stage's own rule is tested against brute force elsewhere; here they are chained, and each result holds its rule."""
    import corpus_pipeline

    from .test_text_operators import brute_components, fold

    docs = spark.read.parquet(f"{data}/documents.parquet").limit(120)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        docs = exact_dedup.stored(docs, "test-stage")
        seen[name] = docs
        assert name == "best-fit packing" or docs.columns == columns
    texts = [fold(r["text"]) for r in seen["exact dedup"].collect()]
    assert sorted(texts) == sorted({fold(r["text"]) for r in seen["toxicity"].collect()})
    before = [(r["doc_id"], r["text"]) for r in seen["exact dedup"].collect()]
    kept = {r["doc_id"] for r in seen["n-gram Jaccard join"].collect()}
    assert kept == {i for i, _, c in brute_components(before, 80) if i == c}
    assert {r["doc_id"] for r in seen["mixing sources"].collect()} <= kept
    packed = seen["best-fit packing"].collect()
    assert sum(r["piece"] == 0 for r in packed) == seen["mixing sources"].count()
