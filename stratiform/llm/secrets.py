"""Secret scan: fixed patterns, and sliding-window entropy per character class.

Candidates are runs of key characters. Inside a candidate, each class (hexadecimal, base64,
letters of one case with digits) gets a window of fixed width that moves by one character;
counts of characters and the sum of c*log2(c) are updated for the one that enters and the one
that leaves, so each step costs the same. Windows above the class's threshold that hold digits and letters (both cases for
base64, digits and letters in turn for one case) join to spans of kind `entropy`. What the
allow list matches is taken out of a span; the rest stays if it still has such a window.

Cases: null text is an empty text (no spans, digest of the empty string); an empty table
gives no rows; repeated rows and doc_ids stay rows of their own; equal starts are ordered by
the kinds as listed in KINDS; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from .textops import portions

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGIT, _LOW, _UP = re.compile(r"[0-9]"), re.compile(r"[a-z]"), re.compile(r"[A-Z]")
#: class: (characters, window width, bits a character)
CLASSES = {
    "hex": (frozenset("0123456789abcdefABCDEF"), 20, 3.0),
    "base64": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 20, 3.8),
    "lower": (frozenset("0123456789abcdefghijklmnopqrstuvwxyz"), 20, 3.6),
    "upper": (frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 20, 3.6),
}
#: Strings that look random but are no secrets: UUIDs, placeholders, runs of one character, alphabets.
ALLOW = (r"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-zA-Z])", r"(?i)(example|sample|placeholder|changeme|dummy|your[_-])", r"(.)\1{7,}", r"(?i)(0123456789|abcdefghij)")
#: Changes between digits and letters in a key of one case, at least: words with a number at the end have fewer.
_TURN, TURNS = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"), 3
_CLOG = [0.0, 0.0] + [n * log2(n) for n in range(2, 65)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the three fixed patterns: leftmost, non-overlapping per kind; matches that are too short are dropped."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of 24 or more is a maximal run: same matches as runs of any length with the short ones dropped
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def entropy_windows(s: str, chars: frozenset, width: int, bits: float) -> Iterator[tuple[int, int]]:
    """Merged ranges of s covered by windows inside runs of chars with at least `bits` of entropy."""
    count: dict[str, int] = {}
    total, run, begin, end = 0.0, 0, -1, -1
    least = log2(width) - bits
    for i, c in enumerate(s):
        if c not in chars:
            count.clear()
            total, run = 0.0, 0
            continue
        n = count.get(c, 0) + 1
        count[c] = n
        total += _CLOG[n] - _CLOG[n - 1]
        run += 1
        if run > width:
            old = s[i - width]
            n = count[old] - 1
            count[old] = n
            total += _CLOG[n] - _CLOG[n + 1]
        if run >= width and total / width <= least + 1e-9:
            if i - width + 1 > end:
                if end >= 0:
                    yield begin, end
                begin = i - width + 1
            end = i + 1
    if end >= 0:
        yield begin, end


def class_windows(s: str) -> Iterator[tuple[int, int]]:
    """Ranges of s that look like a key of one of the classes."""
    for name, (chars, width, bits) in CLASSES.items():
        for a, b in entropy_windows(s, chars, width, bits):
            part = s[a:b]
            if not _DIGIT.search(part):
                continue
            low, up = _LOW.search(part), _UP.search(part)
            if (low and up) if name == "base64" else (low or up) if name == "hex" else len(_TURN.findall(part)) >= TURNS:
                yield a, b


def merged(found: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def entropy_spans(text: str, allow: Iterable[re.Pattern]) -> list[tuple[str, int, int]]:
    out = []
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        if not (_DIGIT.search(s) and (_LOW.search(s) or _UP.search(s))):
            continue
        found = merged(class_windows(s))
        allowed = merged(x.span() for p in allow for x in p.finditer(s)) if found else []
        for a, b in found:
            rest, at = [], a
            for x, y in allowed:
                if x < b and y > at:
                    rest.append((at, x))
                    at = y
            rest = [(x, y) for x, y in [*rest, (at, b)] if x < y]
            if rest == [(a, b)] or any(True for _ in class_windows("".join([s[x:y] for x, y in rest]))):
                out += [("entropy", m.start() + x, m.start() + y) for x, y in rest]
    return out


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each maximal union of spans replaced by the mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1:]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(p) for p in allow]
        for batch in batches:
            for part in portions(batch, 1):
                rows = []
                for text in part.column(1).to_pylist():
                    base = base_spans(text or "")
                    every = base + entropy_spans(text or "", patterns)
                    n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                    rows.append((*n, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(every)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame, allow: tuple[str, ...] = ALLOW, length_column: str | None = None) -> DataFrame:
    """The rows, all columns, with every span of every text replaced by a mark; the column
    named length_column gets the new number of characters where the text changed."""
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")
    size_at = docs.columns.index(length_column) if length_column else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(p) for p in allow]
        for batch in batches:
            for part in portions(batch, at):
                old = part.column(at).to_pylist()
                new = [redact(t, spans) if t and (spans := base_spans(t) + entropy_spans(t, patterns)) else t for t in old]
                columns = list(part.columns)
                columns[at] = pa.array(new, columns[at].type)
                if size_at is not None:
                    sizes = columns[size_at].to_pylist()
                    columns[size_at] = pa.array([len(n) if n is not o else s for o, n, s in zip(old, new, sizes, strict=True)], columns[size_at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
