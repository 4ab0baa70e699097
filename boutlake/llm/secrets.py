"""Secret scans with an incremental ledger of blobs.

A text is a version of a path (here: a document), and its content address is the sha256 of its bytes. The ledger is a
folder of Parquet files with one row per blob and rule version that was ever scanned, findings or none. A scan takes
the blobs that the ledger lacks for this rule version, each once however many versions hold it, appends what it found,
and joins the ledger back to all versions. A later scan with the same rules reads only what is new; new rules scan all
blobs once.

Base rules, each leftmost and non-overlapping; matches that are too short are dropped after they were matched:
assign, access, hex. Added rules: jwt (three dotted base64url parts) and pem (the header of a private key).

Rows: null text counts as empty, which is a blob like others and has no findings; null and repeated doc_ids and repeated
rows keep their rows (one blob). Texts of any length are scanned whole, in time linear in their length. An empty table
gives no rows and writes no findings. Only the id and the text are read, so that columns of any other name play no part.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, map_arrow, shared_dir, struct

RULE_VERSION = "1"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem")

#: Words that an assign match holds, without case: a text without any of them has no such match.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ANY_CASE = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_ASSIGN = re.compile("(?:" + "|".join([*map(_ANY_CASE, _WORDS[:4]), _ANY_CASE("api") + "_?" + _ANY_CASE("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A run of 24 is found wherever a longest run of 24 or more is; likewise for access keys, whose runs begin at their first AKIA.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Three runs of base64url signs with dots between. It begins at the start of a run only, so that no sign is read over and over.
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{11,}+)\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")

LEDGER = struct("blob string, rule_version string, kinds ints, starts longs, ends longs")


def findings(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) in code points, ordered."""
    folded = text.lower()
    out = []
    if any(w in folded for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        out += [(start, 3, end) for start, end in _jwts(text)]
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), 4, m.end()) for m in _PEM.finditer(text)]
    return sorted(out)


def _jwts(text: str) -> Iterator[tuple[int, int]]:
    """Spans of eyJ and 8 signs more, a dot, 8 signs or more, a dot, 8 signs or more; in time linear in the text."""
    at = 0
    while m := _DOTTED.search(text, at):
        start = text.find("eyJ", m.start(1), m.end(1) - 8)
        if start >= 0:
            yield start, m.end()
        at = m.end() if start >= 0 else m.end(1)


def _scan(version: str) -> object:
    def make() -> object:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            found = [findings(x.as_py()) for x in batch.column(1)]
            yield {
                "blob": batch.column(0), "rule_version": [version] * len(found), "kinds": [[k for _, k, _ in f] for f in found],
                "starts": [[s for s, _, _ in f] for f in found], "ends": [[e for _, _, e in f] for f in found],
            }

        return step

    return make


def new_ledger(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/boutlake/ledger-{uuid.uuid4().hex}"
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def _book(spark: SparkSession, ledger: str, rule_version: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == rule_version)


def _blob(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def record(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION, text_col: str = "text") -> None:
    """Scans the blobs of these versions that the ledger lacks for these rules, each once, and appends them.

    Known blobs are left out before texts are moved where the ledger is counted to be small; beyond that by a join.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    known = _book(versions.sparkSession, ledger, rule_version).select("blob")
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    rows = versions.select(_blob(text).alias("blob"), text.alias("text"))
    unseen = rows.join(known, "blob", "left_anti").dropDuplicates(["blob"])
    map_arrow(unseen, _scan(rule_version), LEDGER).write.mode("append").parquet(ledger)


def findings_of(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text", version_col: str | None = None) -> DataFrame:
    """doc_id (the path), version (null without a column for it), blob, kinds, starts, ends of all versions that the ledger
    knows the blob of."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    version = F.lit(None).cast("string") if version_col is None else F.col(f"`{version_col}`").cast("string")
    rows = versions.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), version.alias("version"), _blob(text).alias("blob"))
    book = _book(versions.sparkSession, ledger, rule_version).drop("rule_version").dropDuplicates(["blob"])
    return rows.join(book, "blob").select("doc_id", "version", "blob", "kinds", "starts", "ends")


def scan(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text", version_col: str | None = None) -> DataFrame:
    """Records the unseen blobs of these versions, and returns the findings of all of them."""
    record(versions, ledger, rule_version, text_col)
    return findings_of(versions, ledger, rule_version, id_col, text_col, version_col)


def compacted(spark: SparkSession, ledger: str) -> str:
    """A new ledger with each blob and rule version of the old one once, in few files: scans append, so that a ledger that is
    scanned often has many small ones. The old one is left as it is."""
    path = f"{shared_dir(spark)}/boutlake/ledger-{uuid.uuid4().hex}"
    spark.read.schema(LEDGER).parquet(ledger).dropDuplicates(["blob", "rule_version"]).write.parquet(path)
    return path


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def make() -> object:
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            out: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for kinds, starts, ends in zip(*(batch.column(n).to_pylist() for n in ("kinds", "starts", "ends"))):
                said = [(k, f"{KINDS[k]}:{s}:{e}") for k, s, e in zip(kinds, starts, ends)]
                base = ",".join(x for k, x in said if k < len(BASE))
                row = (*(kinds.count(k) for k in range(len(BASE))), hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in said))
                for n, v in zip(out, row):
                    out[n].append(v)
            yield {"doc_id": batch.column("doc_id")} | out

        return step

    return map_arrow(found.select("doc_id", "kinds", "starts", "ends"), make, struct("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))
