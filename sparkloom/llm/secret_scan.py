"""Secret scan with linking of credentials that come in parts.

Base findings (assignments, access identifiers, long hex) stand alone. A weak part says little alone: an endpoint, a
user or client name that is set, a random-looking string of forty letters and digits. Parts and findings of a document
are joined by interval: a weak part is reported when, in its scope (the paragraph, and at most scope_chars away), parts
of complementary kinds begin: an identifier and a secret, or an endpoint with both. The join is one pass over the
parts in order of position, so it makes no pairs.

Null and empty texts have no findings; overlapping findings of different kinds are all kept, but a weak part that
overlaps a base finding is no part of its own; repeated rows and rows without a doc_id are scanned like others; other
columns are not read. Whole texts are scanned, very long ones one at a time, in time that grows with their length.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.common import small_batches, text_blocks

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

ENDPOINT = re.compile(r"(?:https?|ftp|s3|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>|]{4,}", re.A)
IDENTIFIER = re.compile(r"""(?:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})""", re.I | re.A)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])", re.A)

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "endpoint", "identifier", "random")
#: What a finding is part of a credential as.
ROLE = {"assign": "secret", "hex": "secret", "random": "secret", "access": "id", "identifier": "id", "endpoint": "where"}
#: Roles that must begin near a weak part of a role before it is reported.
NEEDS = {"secret": ("id",), "id": ("secret",), "where": ("id", "secret")}


def base_findings(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def weak_parts(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if "://" in text else []
    found += [(m.start(), m.end(), "identifier") for m in IDENTIFIER.finditer(text)] if re.search("user|login|client|account|access", text, re.I) else []
    if found or base:
        found += [(m.start(), m.end(), "random") for m in RANDOM.finditer(text) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    taken: list[list[int]] = []  # base findings, joined where they overlap
    for a, b, _ in sorted(base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])

    def overlaps(a: int, b: int) -> bool:
        i = bisect.bisect_left(taken, [b, -1])
        return i > 0 and a < taken[i - 1][1]

    return [(a, b, k) for a, b, k in found if not overlaps(a, b)]


def linked(text: str, base: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], scope_chars: int) -> list[tuple[int, int, str]]:
    """The weak parts in whose scope parts of all roles that they need begin."""
    starts: dict[str, list[int]] = {"id": [], "secret": [], "where": []}
    for a, _, k in base + weak:
        starts[ROLE[k]].append(a)
    for v in starts.values():
        v.sort()
    out = []
    for a, b, k in weak:
        low = max(0, a - scope_chars)
        low = max(low, text.rfind("\n\n", low, a) + 1)
        end = text.find("\n\n", b, b + scope_chars)
        high = b + scope_chars if end < 0 else end
        if all((i := bisect.bisect_left(starts[r], low)) < len(starts[r]) and starts[r][i] < high for r in NEEDS[ROLE[k]]):
            out.append((a, b, k))
    return out


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan(docs: DataFrame, scope_chars: int = 300) -> DataFrame:
    """Findings of each row of docs (doc_id, text): counts and a digest of the base ones, spans of all."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches, "doc_id", "text"):
            rows = []
            for text in texts:
                base = base_findings(text) if text else []
                more = linked(text, base, weak, scope_chars) if text and (weak := weak_parts(text, base)) else []
                n = [sum(k == x for _, _, x in base) for k in BASE]
                rows.append((*n, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(base + more), len(more)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
