"""Operator 8: secret scan.

An Aho-Corasick automaton over all keywords finds the places worth a look in one pass over
the lower-cased text; only there an anchored regular expression is tried, and tokens that
carry a checksum must pass it. Hexadecimal runs have no keyword and are found by one search
for long runs. A kind's matches are leftmost and do not overlap; those that are too short
are dropped afterwards.

Kinds, in order: ``assign`` (a named value), ``access`` (access key ids), ``hex`` (long
hexadecimal runs), ``github`` and ``npm`` (prefix, 30 base-62 characters, 6 base-62 digits
of their CRC-32). Offsets are code points, ends exclusive.

One pass, no shuffle. Edge cases: a null or empty text has no spans; each repeated row is
scanned on its own; a text's length only bounds the time, linearly; other columns (of any
name) are dropped by ``scan`` and kept by ``redact``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3  # the first three are the base kinds
SPAN = "array<struct<kind:string,start:int,end:int>>"

# Patterns and keywords (fixed values).
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_KEYWORDS = {
    "password": 0, "passwd": 0, "secret": 0, "token": 0, "api_key": 0, "apikey": 0,
    "akia": 1,
    "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3,
    "npm_": 4,
}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def base62_crc(body: str) -> str:
    """CRC-32 of the body as six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        out = _DIGITS[d] + out
    return out


def _checked(m: re.Match) -> bool:
    return base62_crc(m[1]) == m[2]


_TRY = {
    0: (_ASSIGN, lambda m: len(m[1]) >= 6),
    1: (_ACCESS, lambda m: m.end() - m.start() >= 20),
    3: (_GITHUB, _checked),
    4: (_NPM, _checked),
}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        a.add_word(word, (kind, len(word) - 1))
    a.make_automaton()
    return a


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, by start, then kind."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # some capitals grow when lowered; positions must not move
        low = text.translate(_ASCII_LOWER)
    out, free = [], [0] * len(KINDS)
    for last, (kind, back) in _automaton().iter(low):
        start = last - back
        if start < free[kind]:
            continue
        pattern, valid = _TRY[kind]
        m = pattern.match(text, start)
        if m:
            free[kind] = m.end()
            if valid(m):
                out.append((start, kind, m.end()))
    out.extend((m.start(), 2, m.end()) for m in _HEX.finditer(text))
    out.sort()
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def scan(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t.as_py()) for t in batch.column(1)]
            base = [[s for s in f if s[1] < BASE] for f in found]
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(BASE)]
            sha = [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha), pa.array([_joined(f) for f in found], pa.string())],
                                             names=["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text")).mapInArrow(
        run, f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("key", key)


def hide(text: str | None, mark: str) -> str | None:
    """The text with every secret (overlapping spans as one) replaced by ``mark``."""
    spans = find(text)
    if not spans:
        return text
    out, done, end = [], 0, -1
    for s, _, e in spans:
        if s < end:  # overlaps the span before
            end = max(end, e)
            continue
        if end >= 0:
            out.append(mark)
            done = end
        out.append(text[done:s])
        end = e
    out += [mark, text[end:]]
    return "".join(out)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with the secrets of ``text_col`` replaced; every other column unchanged."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def hidden(texts):
        return texts.map(lambda t: hide(t, mark))

    return docs.withColumn(text_col, hidden(F.col(text_col)))
