"""Secrets in whole texts: keyword automaton, anchored expressions near its hits, checksums.

One Aho-Corasick pass over a text finds every keyword of every kind. An
expression is tried only at a hit, anchored there, so ordinary text costs one
automaton step per character. A hexadecimal run has no keyword: any run that is
long enough covers a multiple of the least length, so only these characters are
looked at, and a run is measured only from there. Tokens that embed a checksum
are spans only if it is right.

Offsets are code points, the end exclusive. Matches of a kind are the leftmost
non-overlapping ones; one that fails its kind's least length is dropped after
it has used up its text.

Defined cases: a null text is empty; repeated rows are scanned each; a kind
whose keyword never occurs has no span; an empty table gives an empty result;
texts of any length are scanned whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Kinds in the order in which they are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm")

# Keywords, in lower case, and the kind that each one starts.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
}

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")

LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = frozenset("0123456789abcdef")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def checksum62(text: str) -> str:
    """CRC-32 of an ASCII text in base 62, six digits."""
    n, out = zlib.crc32(text.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def _hex_spans(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for at in range(LEAST_HEX - 1, len(text), LEAST_HEX):
        if at < done or text[at] not in _HEX:
            continue
        start = at
        while start > 0 and text[start - 1] in _HEX:
            start -= 1
        done = HEX.match(text, at).end()
        if done - start >= LEAST_HEX:
            yield start, done


def spans_of(text: str, keywords: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every secret, sorted."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = text.translate(_ASCII_LOWER)
    found = [(s, 2, e) for s, e in _hex_spans(text)]
    free = dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - size, kind) for end, (size, kind) in keywords.iter(low))
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            good = m and len(m[2]) >= LEAST_VALUE
        elif kind == "access":
            m = ACCESS.match(text, start)
            good = m and len(m[0]) >= LEAST_ACCESS
        else:
            m = (GITHUB if kind == "github" else NPM).match(text, start)
            good = m and checksum62(m[1]) == m[2]
        if m:
            free[kind] = m.end()
        if good:
            found.append((start, KINDS.index(kind), m.end()))
    return sorted(found)


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): ``spans`` is an array of (kind, start, end) by start, then kind."""
    kind_of = dict(documents.dtypes)[id_col]

    def scan(batches):
        keywords = automaton()
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            spans = [
                [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(text.as_py() or "", keywords)]
                for text in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], ["id", "spans"])

    scanned = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        scan, f"id {kind_of}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )
    return scanned.withColumnRenamed("id", id_col)


def redact(documents: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns, every text with its secrets replaced by ``mark``; overlapping spans become one mark."""
    names = documents.columns

    def clean(batches):
        keywords = automaton()
        for batch in batches:
            out = []
            for item in batch.column(0):
                text, parts, done = item.as_py(), [], 0
                spans = [] if text is None else spans_of(text, keywords)
                for start, _, end in spans:
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                out.append(text if not spans else "".join([*parts, text[done:]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[1:]], batch.schema.names)

    others = [c for c in names if c != text_col]
    schema = documents.select(text_col, *others).schema
    return documents.select(text_col, *others).mapInArrow(clean, schema).select(*names)
