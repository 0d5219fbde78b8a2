"""Secret scans: patterns that stand for themselves, and parts of credentials that count only together."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Kinds of spans in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
MIN_VALUE, MIN_ACCESS = 12, 18

# Weak parts: too common to report alone.
_WEAK_ID = re.compile(r"(?<!secret)(?<!secret[_-])(?:client|account|user|app|key|access)[_-]?(?:id|name|key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{4,})", re.I | re.A)
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])", re.A)
_WEAK_ENDPOINT = re.compile(r"(?:https?|wss|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@/-]{4,}|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.amazonaws\.com", re.A)

# Parts meet inside a stretch of lines without a blank line, where at most so many characters lie between them.
SCOPE_CHARS = 2_000
_BREAK = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches that do not overlap, each kind by itself; those that are too short are left out."""
    found = [
        (*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE
    ] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return found


def _looks_random(value: str) -> bool:
    """Mixed letters and digits: a word or a number alone is no secret."""
    digits = sum(c.isdigit() for c in value)
    return 1 <= digits < len(value) and len(set(value)) >= 10 and any(c.isupper() for c in value) and any(c.islower() for c in value)


class _Meeting:
    """Whether a span has one of given spans near it: no blank line and at most ``SCOPE_CHARS`` characters between."""

    def __init__(self, spans: list[tuple[int, int]], edges: list[int], length: int) -> None:
        spans = sorted(spans)
        self.begins, self.edges, self.length = [a for a, _ in spans], edges, length
        self.reach = list(accumulate((b for _, b in spans), max))

    def __call__(self, a: int, b: int) -> bool:
        scope = bisect_right(self.edges, a)
        first = self.edges[scope - 1] if scope else 0
        last = self.edges[scope] if scope < len(self.edges) else self.length
        before = bisect_left(self.begins, min(b + SCOPE_CHARS + 1, last))
        return before > 0 and self.reach[before - 1] >= max(a - SCOPE_CHARS, first + 1)


def _outside(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a stretch overlaps none of the spans."""
    spans = sorted(spans)
    begins, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def free(a: int, b: int) -> bool:
        before = bisect_left(begins, b)
        return not before or reach[before - 1] <= a

    return free


def linked_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts near which a part stands that completes them.

    An identifier or an endpoint needs a secret near it, a secret needs an identifier or an endpoint. Near means
    anywhere in the text with no blank line and at most ``SCOPE_CHARS`` characters between the two.
    Strong identifiers (``access``) and strong secrets (``assign``, ``hex``) complete weak parts and are not listed
    again; a weak part that overlaps a base span is left out, and so is a value inside an identifier or an endpoint.
    """
    free = _outside([(a, b) for a, b, _ in base])
    # Complementary parts are different strings: what lies in an identifier or an endpoint is no secret of its own.
    named = [(*m.span(), "linked_id") for m in _WEAK_ID.finditer(text)] + [(*m.span(), "linked_endpoint") for m in _WEAK_ENDPOINT.finditer(text)]
    apart = _outside([(a, b) for a, b, _ in named])
    weak = [x for x in named if free(x[0], x[1])]
    weak += [(*m.span(), "linked_secret") for m in _WEAK_SECRET.finditer(text) if _looks_random(m[0]) and free(*m.span()) and apart(*m.span())]
    if not weak:
        return []
    edges = [m.end() for m in _BREAK.finditer(text)]
    names = [(a, b) for a, b, k in base if k == "access"] + [(a, b) for a, b, k in weak if k != "linked_secret"]
    secrets = [(a, b) for a, b, k in base if k != "access"] + [(a, b) for a, b, k in weak if k == "linked_secret"]
    by_name, by_secret = (_Meeting(spans, edges, len(text)) for spans in (names, secrets))
    return [x for x in weak if (by_name if x[2] == "linked_secret" else by_secret)(x[0], x[1])]


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + linked_spans(text, base), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SPANS = "array<struct<start: long, end: long, kind: string>>"


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (start, end, kind; code points, end exclusive) of every row.

    Base spans are always listed. Parts of credentials that prove nothing alone (names and ids, random-looking words,
    addresses) are joined by their distance and listed where a complementary part stands in the same stretch of lines
    without a blank line, at most ``SCOPE_CHARS`` characters away. Null or empty text: no spans. Repeated
    rows are scanned each; other columns are not looked at. Texts are independent of each other, so there is no
    shuffle, and a text is read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t)] for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(found, kind)], names=["doc_id", "spans"])

    source = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"))
    return source.mapInArrow(run, f"doc_id {source.schema['d'].dataType.simpleString()}, spans {SPANS}")


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with a mark in place of every stretch that a span covers."""
    out, at, end = [], 0, 0
    for a, b, _ in sorted(spans):
        if a >= end:
            out += [text[at:a], mark]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows with a mark in place of every span of ``scan_secrets``; a null text stays null."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            field = batch.schema.field(place)
            clean = [t if t is None else redacted(t, scan(t), mark) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, field, pa.array(clean, field.type))

    return docs.mapInArrow(run, docs.schema)
