"""Secret scans: fixed patterns, and a token-efficiency test for the rest.

A string that a byte-pair vocabulary cannot compress (few characters a token) is
likely random. Digests and identifiers, which are random-looking but public, are
left out before the test; an identifier is one whose words the vocabulary compresses.
A string that passes is tested again in parts between its separators, as words of a
path or a name would hide a secret beside them.

Defined results: a null text counts as empty and has no spans; repeated rows each
give a row; other columns of the input are ignored, whatever they are called; an empty
table gives none; candidates of any length are tokenised whole; of spans with one start
the kinds come in the order of ``KINDS``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: The parts of a candidate, first those that may hold other separators.
PARTS = (re.compile(r"[^/=]+"), re.compile(r"[^_=-]+"))
PIECES = re.compile(r"[^/+_=-]+")
LEAST = 20
RUNS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Lengths in hex digits of MD5, SHA-1, Tiger, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
KINDS = ("assign", "access", "hex", "random")

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string,"
    " spans string, n_random long"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; kinds index ``KINDS``.

    The match of ``assign`` is taken first and its length tested afterwards, as a
    failing match still uses up its characters. Runs of the other two kinds are
    maximal, so that their length can be part of the pattern.
    """
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_public(candidate: str) -> bool:
    """Digests, UUIDs and plain numbers."""
    if candidate.isdigit() or UUID.fullmatch(candidate):
        return True
    return len(candidate) in DIGEST_LENGTHS and bool(ALL_HEX.fullmatch(candidate))


def is_identifier(candidate: str, test: TokenEfficiency, max_ratio: float) -> bool:
    """Long runs of one kind, the words among which the vocabulary compresses."""
    if len(candidate) < 3.5 * sum(1 for _ in RUNS.finditer(candidate)):
        return False
    words = LETTERS.findall(candidate)
    return not words or sum(map(len, words)) > max_ratio * sum(test.tokens(w) for w in words)


class TokenEfficiency:
    """Characters a token under a tiktoken vocabulary."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def tokens(self, candidate: str) -> int:
        return len(self.encoding.encode_ordinary(candidate))

    def ratio(self, candidate: str) -> float:
        return len(candidate) / max(1, self.tokens(candidate))


def is_random(candidate: str, test: TokenEfficiency, max_ratio: float) -> bool:
    return test.ratio(candidate) <= max_ratio and not is_identifier(candidate, test, max_ratio)


def random_spans(candidate: str, test: TokenEfficiency, max_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of what is random: the whole, else parts between separators, else
    neighbouring pieces that are random each."""
    if is_public(candidate):
        return []
    if is_random(candidate, test, max_ratio):
        return [(0, len(candidate))]
    found, settled = [], bytearray(len(candidate))
    for pattern in PARTS:
        for m in pattern.finditer(candidate):
            a, b = m.span()
            if b - a >= LEAST and not any(settled[a:b]):
                public = is_public(m[0])
                if not public and is_random(m[0], test, max_ratio):
                    found.append((a, b))
                elif not public:
                    continue
                settled[a:b] = b"\1" * (b - a)
    groups, last = [], False
    for m in PIECES.finditer(candidate):
        a, b = m.span()
        low = not any(settled[a:b]) and not is_public(m[0]) and test.ratio(m[0]) <= max_ratio
        if low and last:
            groups[-1] = (groups[-1][0], b)
        elif low:
            groups.append((a, b))
        last = low
    found += [(a, b) for a, b in groups if b - a >= LEAST and not is_public(candidate[a:b]) and is_random(candidate[a:b], test, max_ratio)]
    return sorted(found)


def all_spans(text: str, test: TokenEfficiency, max_ratio: float) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))

    def covered(start: int, end: int) -> bool:
        """Whether a span of the fixed patterns holds all of it."""
        i = bisect_right(starts, start)
        return i > 0 and ends[i - 1] >= end

    more = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if not covered(start, end):
            found = random_spans(m[0], test, max_ratio)
            more += [(start + a, 3, start + b) for a, b in found if not covered(start + a, start + b)]
    return sorted(base + more)


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.tiktoken",
    max_ratio: float = 2.2,
) -> DataFrame:
    """One row per document with its spans (code points, end exclusive)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = TokenEfficiency(vocabulary)
        names = [x.split()[0] for x in SCHEMA.split(",")]
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = all_spans(text or "", test, max_ratio)
                base = [x for x in spans if x[1] < 3]
                n = [sum(1 for x in spans if x[1] == k) for k in range(4)]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((doc_id, *n[:3], digest, joined(spans), n[3]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names
            )

    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return chosen.mapInArrow(scan, SCHEMA)


def redact_secrets(
    docs: DataFrame,
    text_col: str = "text",
    mark: str = "[SECRET]",
    vocabulary: str = "byte_bpe_50k.tiktoken",
    max_ratio: float = 2.2,
) -> DataFrame:
    """The same rows and columns, with every found span replaced by ``mark``.

    Overlapping spans are replaced once. A null text stays null, and a text
    without spans is untouched.
    """
    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = TokenEfficiency(vocabulary)
        for batch in slices(batches):
            texts = []
            for text in batch.column(at).to_pylist():
                end, parts = 0, []
                for start, _, stop in all_spans(text or "", test, max_ratio):
                    if start >= end:
                        parts += [text[end:start], mark]
                    end = max(end, stop)
                texts.append("".join([*parts, text[end:]]) if parts else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(clean, schema)
