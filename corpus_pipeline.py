"""A corpus pipeline: toxic documents go, copies and near copies go, sources are mixed to weights, texts are packed.

Each stage takes what its predecessor kept, written as Parquet and read again. The last one returns the plan of the
training sequences: one row per piece of a document, and a document repeated by the mix is as many documents.

Rows: null and empty texts are documents like others (equal to one another, so that one of them stays; with a length of the
end id alone when packed), texts of any length are taken whole. A null doc_id stays where an id alone would decide: it is no
reason to go in the n-gram join, and it draws by its columns in the mix. Of rows that repeat, one stays. Labels for a doc_id
that repeats mark all of its rows. A null source is a source of its own. Columns besides doc_id, text and source are carried
through all stages but the last, whatever their names; an empty table gives no rows in any stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlake.llm import exact_dedup, mixing, ngram_join, packing, tokens, toxicity
from boutlake.llm._common import documents, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return toxicity.drop_toxic(docs, documents(spark, sf_dir, "labels"), reject=0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more on five words, the one with the smallest doc_id stays."""
    return ngram_join.one_of_each(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated towards weights by the square root of the sources' sizes, in a global random order."""
    return mixing.mix(docs, seed=42).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, tokens.token_file("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The model, the join and the tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
