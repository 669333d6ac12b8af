"""Secret scans: an Aho-Corasick automaton finds keywords, patterns are tried only at its hits, checksums decide on tokens that embed one.

Everything runs on UTF-8 bytes, as all keywords and patterns are ASCII; offsets become code points only for spans found.
Two automata share the work: one over the text with A-Z lower-cased finds the keywords, the other over the text with
every byte reduced to "hex digit or not" finds HEX_LEAST hex digits in a row.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameweave.llm.columns import in_batches

# The kinds, their keywords and patterns.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB_KEYS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: 1 for a hex digit, 0 for another byte.
_IS_HEX = bytes(i in b"0123456789abcdef" for i in range(256))


def checksum62(secret: bytes) -> bytes:
    """The CRC-32 of a token's random part as six base-62 digits, which the token carries at its end."""
    n, out = zlib.crc32(secret), b""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d : d + 1] + out
    return out


@cache
def _automata():
    import ahocorasick

    words, runs = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, keys in (("assign", ASSIGN_KEYS), ("access", ("akia",)), ("github", GITHUB_KEYS), ("npm", ("npm_",))):
        for k in keys:
            words.add_word(k, (kind, len(k)))
    runs.add_word("\x01" * HEX_LEAST, HEX_LEAST)
    words.make_automaton()
    runs.make_automaton()
    return words, runs


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= ASSIGN_LEAST
    if kind == "access":
        return len(m[0]) >= ACCESS_LEAST
    return checksum62(m[1]) == m[2]


_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}


def byte_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all valid spans, leftmost and without overlap within a kind.

    A match begins with a keyword, so trying the pattern at the keyword hits in order of their starts, and skipping those
    inside the last match of the kind, finds what a search through the whole text finds. A match that fails its check
    still takes its place.
    """
    words, runs = _automata()
    found, free = [], dict.fromkeys(KINDS, 0)
    for last, (kind, n) in words.iter(raw.lower().decode("latin-1")):
        at = last - n + 1
        if at >= free[kind] and (m := _PATTERNS[kind].match(raw, at)):
            free[kind] = m.end()
            if _valid(kind, m):
                found.append((at, m.end(), kind))
    if b"\x01" * HEX_LEAST in (flags := raw.translate(_IS_HEX)):
        free_hex = 0
        for last, n in runs.iter(flags.decode("latin-1")):
            if last >= free_hex:
                m = HEX.match(raw, last - n + 1)
                free_hex = m.end() + 1
                found.append((m.start(), m.end(), "hex"))
    return found


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """byte_spans with offsets in code points, by start and then kind as listed."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = byte_spans(raw)
    if found and len(raw) != len(text):
        cuts = sorted({x for s, e, _ in found for x in (s, e)})
        points, at, n = [], 0, 0
        for c in cuts:
            n += sum(b & 0xC0 != 0x80 for b in raw[at:c]) if c - at < 64 else len(raw[at:c].decode("utf-8", "surrogatepass"))
            at = c
            points.append(n)
        found = [(points[bisect_left(cuts, s)], points[bisect_left(cuts, e)], k) for s, e, k in found]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


SCAN = "array<struct<start:long,end:long,kind:string>>"


def scan(text: Column) -> Column:
    """The spans of secrets in a text, by start and kind; none in a null."""

    @F.arrow_udf(SCAN)
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for b in batches:
            yield pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in spans(x)] for x in b.to_pylist()], kind)

    return f(text)


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, how many spans of each base kind, their digest, and all spans.

    Null and empty texts have no spans and the digest of the empty string; very long ones are scanned whole. Spans that begin together
    stand in the order of KINDS. Repeated rows get equal rows, an empty table gives none, other columns aren't read.
    """
    rows = in_batches(docs).select("doc_id", scan(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["kind"].isin("github", "npm"))).cast("long").alias("n_checked"),
    )


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by the mask; overlapping spans become one. Nulls stay null."""

    @F.arrow_udf("string")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = []
            for x in b.to_pylist():
                parts, at = [], 0
                for s, e, _ in spans(x):
                    if e > at:
                        parts += [x[at:s], mask] if s >= at else []
                        at = e
                out.append(x if x is None else "".join([*parts, x[at:]]))
            yield pa.array(out, pa.string())

    return in_batches(docs).withColumn("text", f(F.col("text")))
