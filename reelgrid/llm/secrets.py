"""Secrets in project files, scanned once per distinct content.

Works on stored versions of project files: ``path``, ``version`` and ``content`` (settings, manifests,
prompts, notes). Content is addressed by its SHA-256; a ledger remembers which (content, rule version)
pairs have been scanned, so a later run scans only what is new.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written_once
from .batches import slices, texts_of
from .spans import Span, free

RULE_VERSION = "2026-1"
BASE_KINDS = ["assign", "access", "hex"]

# Shapes of the base kinds.
_ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("passw", "secret", "token", "api")
LEAST_VALUE = 6

#: Further kinds: a literal that must occur, and the shape.
MORE_KINDS = {
    "private_key": ("PRIVATE KEY-----", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")),
    "github": ("gh", re.compile(r"\bgh[opsur]_[A-Za-z0-9]{36,}")),
    "slack": ("xox", re.compile(r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}")),
    "google": ("AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}")),
    "stripe": ("k_live_", re.compile(r"\b[rs]k_live_[A-Za-z0-9]{16,}")),
    "web_token": ("eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "url_password": ("://", re.compile(r"://[^\s/:@]+:[^\s/@]+@")),
}
KINDS = [*BASE_KINDS, *MORE_KINDS]
FINDINGS = "array<struct<kind:string,start:bigint,end:bigint>>"


class Scan(NamedTuple):
    """``findings``: path, version, blob, findings, one row per input row. ``ledger``: blob, rule_version, findings."""

    findings: DataFrame
    ledger: DataFrame


def scan_files(files: DataFrame, ledger: DataFrame | None = None) -> Scan:
    """Findings of every file version, and the ledger to pass to the next run.

    ``blob`` is the SHA-256 of the content. Only contents that the ledger lacks under RULE_VERSION are
    scanned, once each; findings reach all paths and versions by a join on ``blob``.

    Null content counts as empty, null paths and versions are kept, rows that repeat a path and version
    give one result each (also with different contents), other columns are ignored, and empty input gives
    empty tables. Texts move once, to meet the chosen row of their blob; ledger, keys and findings are small.
    """
    source = files.select("path", "version", F.coalesce("content", F.lit("")).alias("content"))
    source = source.withColumn("blob", F.unhex(F.sha2("content", 256)))
    keys = written_once(source.select("path", "version", "blob"))
    seen = None if ledger is None else ledger.where(F.col("rule_version") == RULE_VERSION)
    blobs = keys.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    if seen is not None:
        blobs = blobs.join(seen.select("blob"), "blob", "left_anti")
    chosen = blobs.select(F.col("at.path").alias("_path"), F.col("at.version").alias("_version"), F.col("blob").alias("_blob"))
    # By blob as well: contents that share a path and version are not paired with each other.
    same = F.col("path").eqNullSafe(F.col("_path")) & F.col("version").eqNullSafe(F.col("_version"))
    unseen = source.join(chosen, same & (F.col("blob") == F.col("_blob"))).select("blob", "content")
    scanned = written_once(unseen.mapInArrow(_scan, f"blob binary, rule_version string, findings {FINDINGS}"))
    new = scanned.dropDuplicates(["blob"])  # rows that repeat path, version and content
    known = new if seen is None else new.unionByName(seen.select(*new.columns))
    hits = known.where(F.size("findings") > 0).select("blob", "findings")
    none = F.expr(f"CAST(array() AS {FINDINGS})")
    joined = keys.join(hits, "blob", "left").select(
        "path", "version", "blob", F.coalesce("findings", none).alias("findings")
    )
    full = new if ledger is None else new.unionByName(ledger.select(*new.columns))
    return Scan(joined, full)


def joined_spans(findings: Column, kinds: list[str] | None = None) -> Column:
    """``kind:start:end`` of the findings (of some kinds), comma-joined in their order."""
    if kinds is not None:
        findings = F.filter(findings, lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _scan(batches):
    for batch in slices(batches, 1):
        rows = []
        for blob, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            rows.append({"blob": blob, "rule_version": RULE_VERSION, "findings": _findings(text)})
        yield pa.RecordBatch.from_pylist(rows, _LEDGER)


_LEDGER = pa.schema(
    [
        ("blob", pa.binary()),
        ("rule_version", pa.string()),
        ("findings", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def _findings(text: str) -> list[dict]:
    base = base_spans(text)
    more: list[Span] = []
    for kind, (literal, shape) in MORE_KINDS.items():
        if literal in text:
            for m in shape.finditer(text):
                more.append((kind, m.start(), _key_end(text, m.end()) if kind == "private_key" else m.end()))
    rank = {k: i for i, k in enumerate(KINDS)}
    spans = sorted(base + free(more, []), key=lambda x: (x[1], rank[x[0]], x[2]))
    return [{"kind": k, "start": s, "end": e} for k, s, e in spans]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _key_end(text: str, at: int) -> int:
    """End of a key block: after its end line, else of its header."""
    end = text.find("-----END ", at)
    stop = text.find("-----", end + 9) if end >= 0 else -1
    return stop + 5 if stop >= 0 else at
