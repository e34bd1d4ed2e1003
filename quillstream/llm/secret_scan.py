"""Secret scans: base patterns, and an assignment-aware lexer on top of them.

Base spans are three fixed patterns.  The lexer reads source and configuration syntax into pairs of a name and a
literal: a scan finds targets (``name =``, ``"name":``, ``export NAME=``, ``name =>``, ``name: type =``, XML-like
attributes), and from each an expression is read token by token: strings with escapes and prefixes, triple-quoted
strings, block scalars of YAML, parentheses, ``+`` and adjacent strings, lines that go on, comments between parts,
and names.  A name stands for the literals last assigned to it; one that nothing was assigned to, a call and a
subscript are no literals.  Each literal is scored by how sensitive the target name is, its length, its mix of
characters and its entropy.  Literals over the threshold that base spans don't cover wholly are added as spans of
kind ``literal``.

All scanning is on the UTF-8 bytes of a whole text; offsets are then counted in code points.  A text without a
keyword, an assignment operator or a long hex run costs a few substring searches.

Defined results: null and empty texts have no spans; every input row has one output row, repeated rows too.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import ship, slices

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: Parts of names that make a literal sensitive, with their weight.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "api_key": 1.0, "access_key": 1.0, "private_key": 1.0, "auth": 0.7, "credential": 0.9, "bearer": 0.8,
    "client_secret": 1.0, "signing": 0.7, "session": 0.5, "key": 0.4,
}
#: Literals scoring this much or more are reported.
THRESHOLD = 0.6
NAME = rb"[A-Za-z_][\w.\-]*+"
TYPED = rb"""(?:[ \t]*+=[ \t]*+(?=["'])|[ \t]++=[ \t]++(?=[^\s=>]))"""
LEX = re.compile(
    rb"""(?<![\w.\-])(?:"(?P<qname>%b)"|'(?P<sname>%b)'|(?P<name>%b))""" % (NAME, NAME, NAME)
    # a declared type after a colon, or a second word before the sign: either may be the name
    + rb"""(?:(?:[ \t]*+:[ \t]*+|[ \t]++)(?P<also>[A-Za-z_&*\[][\w.\-&*\[\]<>|?]*+)%b|[ \t]*+(?::=|=>|[:=](?![=:]))[ \t]*+)""" % TYPED,
    re.ASCII,
)
#: What may stand between the parts of an expression: on a line, and inside parentheses or after a sign.
BLANK = re.compile(rb"(?:[ \t]++|\\\r?\n)*+")
WIDE_BLANK = re.compile(rb"(?:\s++|\\\r?\n|#[^\n]*+|//[^\n]*+)*+")
#: The bytes that blanks, within a line and beyond it, and strings start with.
BLANK_AT, WIDE_AT, STRING_AT = frozenset(b" \t\\"), frozenset(b" \t\n\v\f\r\\#/"), frozenset(b"\"'`rRbBuUfF")
PREFIX = re.compile(rb"(?:[rRbBuUfF]{1,2}(?=[\"']))?+")
QUOTED = re.compile(rb""""(?:[^"\n\\]|\\[^\n])*+"|'(?:[^'\n\\]|\\[^\n])*+'|`[^`\n]*+`""")
BARE = re.compile(rb"""[^\s"'`,;(){}\[\]<>]++""")
WORD = re.compile(rb"[A-Za-z_][\w.]*+", re.ASCII)
JOINS = re.compile(rb"[ \t]*+\+(?![+=])|[(\[]")
BLOCK_MARK = re.compile(rb"[|>][-+0-9]*+[ \t]*+(?:#[^\n]*+)?\r?\n")
LINE = re.compile(rb"([ \t]*+)([^\n]*+)(?:\n|\Z)")
_HEXMAP = np.zeros(256, dtype=bool)
_HEXMAP[list(b"0123456789abcdef")] = True


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def base_spans(data: bytes) -> list[Span]:
    """Spans of the fixed patterns, in bytes."""
    out = []
    low = data.lower()
    if any(k in low for k in KEYWORDS):
        out += [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(1) - m.start(1) >= MIN_ASSIGN]
    if b"AKIA" in data:
        out += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= MIN_ACCESS]
    if len(data) >= MIN_HEX:
        # every run of 16 hits a multiple of 8 followed by 8 hex bytes
        flags = _HEXMAP[np.frombuffer(data, dtype=np.uint8)]
        whole = len(data) // 8 * 8
        if flags[:whole].reshape(-1, 8).all(axis=1).any():
            out += [Span(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    return out


def sensitivity(name: str) -> float:
    """How much a target name says that its value is secret, 0 to 1."""
    snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).replace("-", "_").replace(".", "_").lower()
    words = f"_{snake}_"
    return max((w for part, w in SENSITIVE.items() if f"_{part}_" in words or (len(part) > 5 and part in words)), default=0.0)


def literal_score(name_weight: float, literal: bytes) -> float:
    """Weight of the name times how random the literal looks."""
    n = len(literal)
    if n < MIN_ASSIGN or b" " in literal or literal.startswith((b"http://", b"https://", b"$", b"<", b"{")):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(bool(re.search(p, literal)) for p in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[^A-Za-z0-9]"))
    return name_weight * min(1.0, entropy / 3.0) * (1.0 if kinds >= 2 else 0.4)


class Value(NamedTuple):
    """The literals of an expression, where they are, and where it ends."""

    text: bytes
    spans: list[tuple[int, int]]
    end: int


Constants = dict[bytes, tuple[bytes, list[tuple[int, int]]]]


def block_scalar(data: bytes, at: int, line_start: int) -> Value:
    """The lines from ``at`` on that are indented more than the line of the name; blank lines are part of it."""
    base = len(data[line_start:at]) - len(data[line_start:at].lstrip(b" \t-"))
    spans: list[tuple[int, int]] = []
    while at < len(data) and (m := LINE.match(data, at)):
        if m[2].strip() and len(m[1]) <= base:
            break
        if body := m[2].rstrip():
            spans.append((m.start(2), m.start(2) + len(body)))
        at = m.end()
    return Value(b"".join(data[a:b] for a, b in spans), spans, at)


def string_at(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(start, end) of the inside of a quoted string at a position, and where the string ends."""
    if at >= len(data) or data[at] not in STRING_AT:
        return None
    at = PREFIX.match(data, at).end()
    for quotes in (b'"""', b"'''"):
        if data.startswith(quotes, at) and (end := data.find(quotes, at + 3)) >= 0:
            return at + 3, end, end + 3
    m = QUOTED.match(data, at)
    return (m.start() + 1, m.end() - 1, m.end()) if m else None


def after_blank(data: bytes, at: int, wide: bool) -> int:
    """The position after the blanks that stand at a position."""
    if at >= len(data) or data[at] not in (WIDE_AT if wide else BLANK_AT):
        return at
    return (WIDE_BLANK if wide else BLANK).match(data, at).end()


def expression(data: bytes, at: int, constants: Constants) -> Value:
    """The literals of the expression that begins at a position."""
    parts: list[bytes] = []
    spans: list[tuple[int, int]] = []
    depth, after_sign, end = 0, False, at
    while True:
        at = after_blank(data, at, depth > 0 or after_sign)
        if data.startswith(b"(", at) and (after_sign or not parts):
            depth, at = depth + 1, at + 1
            continue
        if found := string_at(data, at):
            parts.append(data[found[0] : found[1]])
            spans.append(found[:2])
            at = end = found[2]
        elif (not parts or after_sign) and (m := BARE.match(data, at)):
            word = WORD.match(data, at)
            joined = word and JOINS.match(data, word.end())
            if word and word[0] in constants and (joined or word.end() == m.end()):
                at = end = word.end()
                value, known = constants[word[0]]
                parts.append(value)
                spans += known
            elif word and (joined or after_sign):  # a name without a value, a call or a subscript
                at = end = word.end()
                parts.append(b"")
            else:
                at = end = m.end()
                parts.append(m[0])
                spans.append(m.span())
        else:
            break
        at = after_blank(data, at, depth > 0)
        while depth and data.startswith(b")", at):
            depth, at = depth - 1, at + 1
            end = at
            at = after_blank(data, at, depth > 0)
        after_sign = data.startswith(b"+", at) and not data.startswith((b"++", b"+="), at)
        if after_sign:
            at += 1
        elif not string_at(data, at):
            break
    return Value(b"".join(parts), spans, max(end, at if not parts else end))


def lexed_spans(data: bytes) -> list[Span]:
    """Spans of the literals whose target, or a name they flow to, is sensitive."""
    constants: Constants = {}
    out = []
    end = 0
    while m := LEX.search(data, end):
        names = [n for n in m.group("qname", "sname", "name", "also") if n]
        if mark := BLOCK_MARK.match(data, m.end()):
            value = block_scalar(data, mark.end(), data.rfind(b"\n", 0, m.start()) + 1)
        else:
            value = expression(data, m.end(), constants)
        end = max(value.end, m.end())
        if not value.spans:
            for n in names:
                constants.pop(n, None)
            continue
        for n in names:
            constants[n] = value.text, value.spans
        if len(value.text) < MIN_ASSIGN:  # scores nothing, whatever its name
            continue
        if (w := max(sensitivity(n.decode()) for n in names)) and literal_score(w, value.text) >= THRESHOLD:
            out += [Span(a, 3, b) for a, b in value.spans if b > a]
    return out


def uncovered(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that the union of the base spans doesn't cover wholly."""
    joined_up: list[list[int]] = []
    for s in sorted(base):
        if joined_up and s.start <= joined_up[-1][1]:
            joined_up[-1][1] = max(joined_up[-1][1], s.end)
        else:
            joined_up.append([s.start, s.end])
    starts = [a for a, _ in joined_up]

    def covered(s: Span) -> bool:
        i = bisect.bisect_right(starts, s.start) - 1
        return i >= 0 and s.end <= joined_up[i][1]

    return [s for s in spans if not covered(s)]


def scan(data: bytes) -> list[Span]:
    """All spans of a text's UTF-8 bytes, in code points, by start and kind."""
    base = base_spans(data)
    extra = []
    if b"=" in data or b":" in data:
        extra = uncovered(list(dict.fromkeys(lexed_spans(data))), base)
    spans = base + extra
    if spans and not data.isascii():
        starts = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
        at = lambda i: int(starts[i - 1]) if i else 0
        spans = [Span(at(s.start), s.kind, at(s.end)) for s in spans]
    return sorted(spans)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1, 8 << 20):
            found = [scan(x.as_buffer().to_pybytes()) if x.is_valid else [] for x in batch.column(1).cast(pa.binary())]
            base = [joined([s for s in f if s.kind < 3]) for f in found]
            counts = [pa.array([sum(s.kind == k for s in f) for f in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(base), pa.array([joined(f) for f in found])],
                names=["id", "n_assign", "n_access", "n_hex", "n_literal", "base", "spans"],
            )


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, n_literal, base (spans of the fixed patterns), spans (all)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_rows, "id long, n_assign long, n_access long, n_hex long, n_literal long, base string, spans string")
    return out.withColumnRenamed("id", id_col)


def op5_secret_scan(docs: DataFrame) -> DataFrame:
    return secret_scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans")
