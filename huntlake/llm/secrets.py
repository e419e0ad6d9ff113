"""Operator 1: secret scan of whole texts.

One Aho-Corasick pass finds the keywords (every spelling of the case-insensitive
ones, and the fixed token prefixes); a regular expression is then tried only at
the position of a hit. Tokens that embed a checksum are kept only if it agrees:
the last six characters of a token are the CRC-32 of the characters before, in
base 62. Hexadecimal runs have no keyword, so they come from one linear search.

Scan and span positions count code points; the end is exclusive. A null or empty
text has no spans. A repeated row is scanned and returned as often as it comes.
Input columns other than the id and the text are not read. Each text is scanned
alone in a map task: nothing is shuffled and no text meets another.
"""

from __future__ import annotations

import itertools
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]

# FIXED VALUES: keywords, token prefixes and patterns of the scanned formats
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_PREFIX = "AKIA"
CHECKED_PREFIXES = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
CHECKED = re.compile(r"[a-z]{3}_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_automaton = None


def keyword_automaton() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for word in ASSIGN_WORDS:
            for spelling in itertools.product(*[(c, c.upper()) if c.isalpha() else (c,) for c in word]):
                _automaton.add_word("".join(spelling), ("assign", len(word)))
        _automaton.add_word(ACCESS_PREFIX, ("access", len(ACCESS_PREFIX)))
        for prefix, kind in CHECKED_PREFIXES.items():
            _automaton.add_word(prefix, (kind, len(prefix)))
        _automaton.make_automaton()
    return _automaton


def base62_crc(body: str) -> str:
    """CRC-32 of the body in six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then in the order of KINDS."""
    if not text:
        return []
    found, free = [], {"assign": 0, "access": 0}
    for last, (kind, length) in keyword_automaton().iter(text):
        start = last - length + 1
        if kind in free:
            if start < free[kind]:
                continue  # inside the match before it
            if m := (ASSIGN if kind == "assign" else ACCESS).match(text, start):
                free[kind] = m.end()
                if (len(m[2]) >= 12) if kind == "assign" else (m.end() - start >= 18):
                    found.append((kind, start, m.end()))
        elif (m := CHECKED.match(text, start)) and base62_crc(m[1]) == m[2] and not (start and text[start - 1].isalnum()):
            found.append((kind, start, m.end()))
    found += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row of ``docs``."""

    def scan(batches):
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, SCHEMA)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every maximal run of covered characters replaced by the mark."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a > at or not out:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in the text and its length column brought up to date; all rows and columns stay."""
    names, at = docs.columns, docs.columns.index(text_col)
    size_at = names.index(size_col) if size_col in names else None

    def clean(batches):
        for batch in batches:
            old = batch.column(at)
            new = pa.array([redact(t.as_py()) for t in old], pa.string())
            columns = [new if i == at else c for i, c in enumerate(batch.columns)]
            if size_at is not None:
                columns[size_at] = pa.array([n if a.as_py() == b.as_py() else len(b.as_py()) for n, a, b in
                                             zip(columns[size_at].to_pylist(), old, new)], columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(clean, docs.schema)


def secret_digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans and the list of all spans, from ``scan_secrets``."""
    def listed(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kinds(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of_kinds(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return scanned.select("doc_id", *counts, F.sha2(listed(of_kinds(*BASE_KINDS)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
