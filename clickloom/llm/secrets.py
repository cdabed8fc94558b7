"""Secrets in text, and weak candidates that count only beside their complementary parts.

Certain kinds (assignments, access identifiers, hexadecimal runs) are found by
pattern.  Weak candidates - user names, mixed tokens, endpoints - are linked by
an interval join: parts are dealt out by document and scope cell, and a weak
candidate is reported only if its complement lies within ``SCOPE`` characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import materialize, prepared, table
from clickloom.plans.registry import Query

#: Parts of one credential lie this many characters apart at most.
SCOPE = 200
#: Kinds in the order of the listing.
KINDS = ["assign", "access", "hex", "identifier", "mixed", "endpoint"]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
_IDENTIFIER = re.compile(r"""\b(?:user(?:_?name)?|login|client_?id|access_?key(?:_?id)?|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""", re.I | re.A)
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}")
_ENDPOINT = re.compile(r"""\bhttps?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\s"'<>]*|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?""", re.I | re.A)
#: An assignment or identifier needs one of these words, in either case.
_WORDS = re.compile("pass|secret|token|api|user|login|client|access|account", re.I | re.A)

#: What each weak kind needs nearby: one of every listed group.
NEEDS = {"identifier": [["assign", "hex", "mixed"]], "mixed": [["access", "identifier"]], "endpoint": [["access", "identifier"], ["assign", "hex", "mixed"]]}

FOUND = "doc_id long, n_assign long, n_access long, n_hex long, parts array<struct<start:int,kind:int,end:int>>"


def parts_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all certain and weak parts, ascending."""
    out = []
    if _WORDS.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        out += [(m.start(), 3, m.end()) for m in _IDENTIFIER.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if out:  # weak parts alone are never reported
        out += [(m.start(), 4, m.end()) for m in _MIXED.finditer(text)]
        out += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    return sorted(out)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        parts = [parts_of(x) for x in batch["text"].to_pylist()]
        counts = [[sum(p[1] == k for p in row) for row in parts] for k in range(3)]
        lists = pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in row] for row in parts], kind)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in counts), lists], ["doc_id", "n_assign", "n_access", "n_hex", "parts"])


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts (row, start, kind, end) that have all their complements within the scope.

    Parts that touch or overlap are 0 characters apart, so a complement inside
    a weak part, or around it, counts.  An interval join: a weak part stands in
    every cell of ``scope`` characters that it reaches into, a near part in
    those and one more at either end, so two parts within the scope share a
    cell; they meet in the first one they share only.
    """
    width = max(scope, 1)
    first, last = F.floor(F.col("start") / width), F.floor(F.col("end") / width)
    weak = parts.where(F.col("kind") >= 3).select("row", "start", "kind", "end", first.alias("first"), F.explode(F.sequence(first, last)).alias("cell"))
    near = parts.select("row", (first - 1).alias("near_first"), F.explode(F.sequence(first - 1, last + 1)).alias("cell"), F.col("start").alias("near_start"), F.col("end").alias("near_end"), F.col("kind").alias("near_kind"))
    gap = F.greatest(F.col("start") - F.col("near_end"), F.col("near_start") - F.col("end"))
    pairs = weak.join(near, ["row", "cell"]).where((F.col("cell") == F.greatest("first", "near_first")) & (gap <= scope))
    has = lambda kinds: F.max(F.col("near_kind").isin([KINDS.index(k) for k in kinds]))
    enough = F.lit(False)
    for kind, groups in NEEDS.items():
        needed = F.col("kind") == KINDS.index(kind)
        for i, _ in enumerate(groups):
            needed = needed & F.col(f"{kind}_{i}")
        enough = enough | needed
    flags = [has(g).alias(f"{kind}_{i}") for kind, groups in NEEDS.items() for i, g in enumerate(groups)]
    return pairs.groupBy("row", "start", "kind", "end").agg(*flags).where(enough).select("row", "start", "kind", "end")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id, counts by certain kind, ``base`` and ``spans`` as lists (start, kind, end).

    Positions are code points.  A null text is empty and has no spans; rows
    that repeat are kept and searched each for itself.
    """
    found = materialize(prepared(docs).mapInArrow(_find, FOUND).withColumn("row", F.monotonically_increasing_id()), "secrets")
    parts = found.where(F.size("parts") > 1).select("row", F.explode("parts").alias("p")).select("row", "p.*")
    linked = link_parts(parts, scope).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    base = F.filter("parts", lambda p: p["kind"] < 3)
    return found.join(linked, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", base.alias("base"),
        F.array_sort(F.concat(base, F.coalesce("linked", F.filter("parts", lambda p: F.lit(False))))).alias("spans"),
    )


def listing(spans: str):
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", F.get(kinds, p["kind"]), p["start"], p["end"])), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listing("base"), 256).alias("base_sha256"), listing("spans").alias("spans"))


QUERIES: dict[str, tuple[Query, str | None]] = {"op9_secrets": (op9_secrets, None)}
