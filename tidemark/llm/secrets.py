"""Secret scans (operator 6): fixed patterns, and strings that a token vocabulary can't compress.

Ordinary text takes few tokens for its length. A random key or password is cut into tokens of one or two characters, so its ratio of
characters to tokens is low. Candidates are long runs of key characters with a letter, what is left of them without known parts at
either end, and their long parts between separators, so that a path before a key doesn't hide it. Digests of known lengths, UUIDs
and identifiers (words that compress well, numbers and short parts joined by - _ / =) are left out before the ratio is taken.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import fresh

SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
#: The patterns of the base scan, in the order in which kinds are listed, with the group and length that a match needs.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
BASE_KINDS = tuple(k[0] for k in KINDS)
ORDER = (*BASE_KINDS, "dense")
#: Runs of at least 16 hex characters, found without trying every letter of ordinary words twice.
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
_UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
_SHORT = re.compile(r"(?:[0-9]*|[A-Za-z]{1,3}[0-9]{1,4})\Z")
_LETTERS = re.compile(r"(?:[A-Z]?[a-z]*|[A-Z]*)\Z")
_PART = re.compile(r"[A-Za-z0-9]+")
#: Letters that are an abbreviation whatever their tokens, and the least length of a candidate.
_FEW, _LEAST = 4, 16


class _Ratio:
    def __init__(self, vocabulary: str, pattern: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, s: str) -> float:
        return len(s) / len(self.encoding.encode_ordinary(s))


def is_known(part: str, ratio, most: float) -> bool:
    """A part between separators that is a digest of a usual length, a number, a short name, or a word that compresses well."""
    if _SHORT.match(part) or (len(part) in _DIGEST_LENGTHS and _DIGEST.match(part)):
        return True
    return bool(_LETTERS.match(part)) and (len(part) <= _FEW or ratio(part) >= most)


def dense(s: str, ratio, most: float) -> list[tuple[int, int]]:
    """The spans of a run of key characters that the vocabulary can't compress; the widest one that is known to be such."""
    spans, at = [], 0
    for m in _UUID.finditer(s):
        spans += _dense(s, at, m.start(), ratio, most)
        at = m.end()
    return spans + _dense(s, at, len(s), ratio, most)


def _dense(s: str, start: int, end: int, ratio, most: float) -> list[tuple[int, int]]:
    def hard(a: int, b: int) -> bool:
        return b - a >= _LEAST and any(c.isalpha() for c in s[a:b]) and ratio(s[a:b]) < most

    if end - start < _LEAST:
        return []
    unknown = [m.span() for m in _PART.finditer(s, start, end) if not is_known(m[0], ratio, most)]
    if not unknown:
        return []
    if hard(start, end):
        return [(start, end)]
    core = unknown[0][0], unknown[-1][1]
    return [core] if hard(*core) else [x for x in unknown if hard(*x)]


def scan(text: str, ratio, most: float) -> list[dict]:
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        if pattern is HEX:
            pattern = _LONG_HEX
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, m.end(), kind))
    for m in _CANDIDATE.finditer(text):
        found += [(m.start() + a, len(KINDS), m.start() + b, "dense") for a, b in dense(m[0], ratio, most)]
    return [{"kind": kind, "start": start, "end": end} for start, _, end, kind in sorted(found)]


def secret_spans(docs: DataFrame, vocabulary: str, pattern: str, *, text_col: str = "text", most_chars_per_token: float = 2.0, out: str = "secrets") -> DataFrame:
    """docs with a column ``out``: an array of (kind, start, end) in code points, end exclusive, by start and then kind.

    vocabulary: a tiktoken file that every executor has; pattern: its split pattern. Null and empty texts have no spans; repeated
    rows each get theirs; a column of docs called ``out`` is replaced. Spans of different kinds may overlap.
    """
    made: list[_Ratio] = []

    @F.arrow_udf(SPANS)
    def find(column: pa.Array) -> pa.Array:
        if not made:
            made.append(_Ratio(vocabulary, pattern))
        return pa.array([scan(t.as_py() or "", made[0], most_chars_per_token) for t in column], _ARROW)

    return docs.withColumn(out, find(F.col(text_col)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, vocabulary: str, pattern: str, *, text_col: str = "text", mask: str = "[SECRET]", **params) -> DataFrame:
    """docs with every secret in the text replaced by mask; overlapping spans give one mask. Other rows and columns stay."""
    out = fresh(docs, "secrets")
    found = secret_spans(docs, vocabulary, pattern, text_col=text_col, out=out, **params)

    @F.arrow_udf(StringType())
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        done = []
        for t, ss in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            if t is not None and ss:
                parts, at = [], 0
                for s in ss:
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], mask]
                    at = max(at, s["end"])
                t = "".join([*parts, t[at:]])
            done.append(t)
        return pa.array(done, pa.string())

    return found.withColumn(text_col, F.when(F.size(out) > 0, cut(F.col(text_col), F.col(out))).otherwise(F.col(text_col))).drop(out)
