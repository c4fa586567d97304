"""Secret scans with multipart credential linking.

Strong spans (assignments, access identifiers, long hex) are reported on sight.
Weak candidates (opaque identifiers, mixed-alphabet secrets, endpoints) mean
little alone: they are reported only where a complementary part stands apart from
them in the same scope, however far, found by an interval join over the scope's
parts. A scope ends at a blank line. All offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The strong patterns, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
# The weak patterns, by the part of a credential they may be.
WEAK = {
    "identifier": re.compile(
        r"\b(?:client|account|user|tenant|app|project)[_-]?id\x20*[:=]\x20*[\"']?[A-Za-z0-9._-]{6,}"
        r"|\b(?:ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}\b",
        re.IGNORECASE | re.ASCII,
    ),
    "key": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40}={0,2}(?![A-Za-z0-9+/=_-])", re.ASCII),
    "endpoint": re.compile(
        r"\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}"
        r"|\b(?:host|endpoint|server)\x20*[:=]\x20*[\"']?[a-z0-9.-]+\.[a-z]{2,}(?::\d+)?",
        re.IGNORECASE | re.ASCII,
    ),
}
KINDS = ["assign", "access", "hex", *WEAK]
#: The role that each kind plays in a credential of several parts.
ROLE = {"assign": "key", "access": "identifier", "hex": "key", "identifier": "identifier", "key": "key", "endpoint": "endpoint"}
#: Which roles complete a weak candidate of a role.
COMPLEMENT = {"identifier": ("key",), "key": ("identifier", "endpoint"), "endpoint": ("key",)}
_SCOPE = re.compile(r"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)")
_ORDER = {k: i for i, k in enumerate(KINDS)}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Strong spans, leftmost and non-overlapping within each kind. An
    assignment whose value is short is passed over as a whole. The other two
    kinds are runs, so asking for their least length finds the same runs."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]]))


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)


def linked_spans(text: str, strong: list[Span]) -> list[Span]:
    """Weak candidates completed by a complementary part of the same scope that
    doesn't overlap them. Of each role in a scope the first end and the last
    start tell whether some part stands before or behind a candidate."""
    weak = [(k, *m.span()) for k, rx in WEAK.items() for m in rx.finditer(text) if k != "key" or _mixed(m.group())]
    if not weak:
        return []
    taken = sorted((a, b) for _, a, b in strong)
    # Strong spans may lie in each other: what counts is the furthest end so far.
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    weak = [s for s in weak if not ((i := bisect.bisect_left(starts, s[2])) and ends[i - 1] > s[1])]
    blank = [m.start() for m in _SCOPE.finditer(text)]
    parts: dict[tuple[int, str], tuple[int, int]] = {}
    for kind, a, b in [*strong, *weak]:
        place = bisect.bisect_right(blank, a), ROLE[kind]
        first, last = parts.get(place, (b, a))
        parts[place] = min(first, b), max(last, a)
    out = []
    for kind, a, b in weak:
        scope = bisect.bisect_right(blank, a)
        near = [parts[scope, role] for role in COMPLEMENT[ROLE[kind]] if (scope, role) in parts]
        if any(first <= a or last >= b for first, last in near):
            out.append((kind, a, b))
    return out


def scan_text(text: str) -> list[Span]:
    """All spans of a text by start, then kind as listed."""
    strong = base_spans(text)
    return sorted([*strong, *linked_spans(text, strong)], key=lambda s: (s[1], _ORDER[s[0]]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """``text`` with each run of overlapping spans replaced by ``mask``."""
    out, done = [], 0
    for _, a, b in spans:
        if a >= done:
            out += [text[done:a], mask]
        done = max(done, b)
    return "".join([*out, text[done:]])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for each row.

    A null or empty text has no spans. Rows are judged alone, so repeated rows
    repeat their result; other columns are ignored, an empty table stays empty.
    """
    kind = "array<struct<kind:string,start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [scan_text(t.as_py() or "") for t in batch.column("text")]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, struct)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {kind}")


def digest(scanned: DataFrame) -> DataFrame:
    """The counts and joined forms of ``scan``'s rows, one for each. Without
    spans counts are 0 and the joined forms those of no text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    base = F.filter("spans", lambda s: s.kind.isin(KINDS[:3]))
    return scanned.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span of ``text`` masked and ``n_chars``, if
    there, brought up to date. Rows without spans, null and empty texts are
    unchanged, repeated rows stay repeated, and all columns stay, whatever their
    names; an empty table stays empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = batch.column("text").to_pylist()
            sizes = batch.column("n_chars").to_pylist() if "n_chars" in names else None
            for i, t in enumerate(texts):
                if t and (spans := scan_text(t)):
                    texts[i] = redact(t, spans)
                    if sizes:
                        sizes[i] = len(texts[i])
            new = {"text": texts} | ({"n_chars": sizes} if sizes else {})
            columns = [pa.array(new[c], batch.schema.field(c).type) if c in new else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
