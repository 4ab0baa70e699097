"""The queries of this subpackage: each operator over its whole table, cut down to the digest that the tests compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, contamination, exact_dedup, mixing, neighbours, ngram_join, packing, phrases, secrets
from . import token_counts, token_files, tokens, toxicity
from ._common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(documents(spark, sf_dir), words=5, percent=80)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "text", "source", "copy", "shuffle_key")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(documents(spark, sf_dir), tokens.token_file("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(spark, path, with_ids=False)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokens.token_file("word_bpe_49k.json"), limit=2048)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokens.token_file("word_bpe_49k.json"), capacity=4096, end_id=1)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans over one ledger: of the texts of an even length first, then of all, of which the second reads what is new."""
    docs, ledger = documents(spark, sf_dir), secrets.new_ledger(spark)
    secrets.record(docs.where(F.length("text") % 2 == 0), ledger)
    return secrets.digest(secrets.scan(docs, ledger))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), reject=0.7)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(documents(spark, sf_dir))


def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digest(contamination.find(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(*centroids.cluster(documents(spark, sf_dir, "embeddings")))


_OP2_SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS size, sqrt(count(*)::DOUBLE) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, round((SELECT sum(size) FROM sizes)::DOUBLE * weight / (SELECT round(sum(weight), 6) FROM sizes) / size, 9) AS rate FROM sizes),
cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
steps AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
draws AS (SELECT d.doc_id, d.text, d.source, len(list_filter(s.cs, lambda c: c <= ('0x' || substr(md5('42|' || d.doc_id || '|1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)) AS n
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source),
copies AS (SELECT doc_id, text, source, unnest(range(n))::INTEGER AS copy FROM draws)
SELECT doc_id, text, source, copy, md5('42|' || doc_id || '|copy|' || copy) AS shuffle_key FROM copies
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4_SQL = f"""
WITH folded AS (SELECT doc_id, sha256({_FOLD}) AS text_sha256, {_FOLD} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM folded WINDOW w AS (PARTITION BY body)
"""

_OP9_SQL = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, length(text) + 3 * length(text) - length(replace(text, chr(92), '')) - length(replace(text, '<', '')) - length(replace(text, '[', '')) AS n,
  length(role) + 4 * length(role) - length(replace(role, chr(92), '')) - length(replace(role, '<', '')) - length(replace(role, '[', '')) - length(replace(role, chr(10), '')) AS r FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' THEN 14 + n + 5 ELSE 8 + r + 8 + n + 9 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


_OP11_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_FOLD}, '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM documents),
runs AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM pieces),
spots AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM runs, (VALUES (1), (2), (3)) t(k)),
f AS MATERIALIZED (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS c FROM spots GROUP BY ALL),
totals AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND c >= 10),
cuts AS (SELECT lang, phrase, k, a, cut, array_to_string(ws[1:cut], ' ') AS first, array_to_string(ws[cut + 1:], ' ') AS rest
  FROM candidates, (VALUES (1), (2)) t(cut) WHERE cut < k),
scored AS (SELECT c.lang, c.phrase, c.k, c.a, x.c AS l, y.c AS r, cut, ((1000000::HUGEINT * a * a) // (x.c::HUGEINT * y.c))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM candidates WHERE k = 3),
most AS (SELECT lang, phrase, max(a) AS most FROM longer GROUP BY ALL),
ranked AS (SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
  FROM weakest w LEFT JOIN most m ON m.lang = w.lang AND m.phrase = w.phrase WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

_OP12_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
cut AS (SELECT item_id, ws, least(len(ws), 10) AS size FROM items WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item_id, size, array_to_string(ws[i : i + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM cut)),
texts AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS ws FROM documents),
spots AS (SELECT id, i, size, array_to_string(ws[i : i + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM texts, (SELECT DISTINCT size FROM wins))),
found AS MATERIALIZED (SELECT s.id, s.i, s.size, w.item_id FROM spots s JOIN wins w ON w.size = s.size AND w.win = s.win),
hits AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT id, unnest(range(i, i + size)) AS place FROM found) GROUP BY id),
named AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT id, item_id::VARCHAR AS item FROM found) GROUP BY id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM texts LEFT JOIN hits USING (id) LEFT JOIN named USING (id)
"""


def _op13_sql() -> str:
    """Six assignments and five moves, a table each."""
    parts = ["""WITH kept AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
vs AS MATERIALIZED (SELECT id, unnest(v) AS x, unnest(range(64)) AS d FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, id FROM kept QUALIFY c < 40),
m0 AS MATERIALIZED (SELECT c, d, x FROM c0 JOIN vs USING (id))"""]
    for k in range(6):
        parts.append(f"""e{k} AS (SELECT id, c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS dist FROM vs v JOIN m{k} m USING (d) GROUP BY id, c),
a{k} AS MATERIALIZED (SELECT id, c, dist FROM e{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, c) = 1)""")
        if k < 5:
            parts.append(f"""s{k} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{k} JOIN vs USING (id) GROUP BY c, d),
m{k + 1} AS MATERIALIZED (SELECT m.c, m.d, CASE WHEN n IS NULL THEN m.x ELSE ((s - ((s % n) + n) % n) / n)::BIGINT END AS x FROM m{k} m LEFT JOIN s{k} USING (c, d))""")
    return ",\n".join(parts) + """,
names AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM m5 GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, dist AS distance, (sum(dist) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(dist) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a5 JOIN kept USING (id) JOIN names USING (c)"""


def queries() -> dict[str, Query]:
    own = (
        op1_ngram_join, op2_mixing, op3_token_files, op4_exact_dedup, op5_token_counts, op6_neighbours, op7_packing, op8_secrets,
        op9_chat, op10_toxicity, op11_phrases, op12_contamination, op13_centroids,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": _OP2_SQL, "op4_exact_dedup": _OP4_SQL, "op9_chat": _OP9_SQL,
        "op11_phrases": _OP11_SQL, "op12_contamination": _OP12_SQL, "op13_centroids": _op13_sql(),
    }
