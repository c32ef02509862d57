"""Format-preserving pseudonyms for personal data.

Values that pass their own check (card numbers the Luhn sum, addresses and dates
their ranges) are numbers of a finite set. A keyed Feistel network over that set,
walked until it stays inside, permutes them: equal values get equal pseudonyms in
every document, different values different ones, and each pseudonym is valid in the
same format. Holders of the key can reverse it.

Found: payment cards (13 to 19 digits, single spaces or hyphens allowed), North
American telephone numbers with an area code, international ones that begin with a
plus sign (8 to 15 digits), social security numbers, IPv4 addresses, ISO and d/m/y or
d.m.y dates from 1900 to 2099 (m/d/y where the day is over 12), and e-mail addresses,
whose local part and first domain label are permuted letter by letter and digit by
digit within their class. Numbers that fail their check stay.

Not sought, as nothing tells them from other numbers: ten digits in a row without a
plus sign, numbers without an area code, dates with two digits of the year or with
names of months. A value within a longer run of letters or digits is none.

Values are delimited before any is permuted, so a value has one pseudonym in every
context and every way of writing it: cards, telephone and social security numbers by their
digits, e-mail addresses without regard to case, dates by the day. Dates are permuted among
those whose day (1 to 9, 10 to 12, 13 to 31) and month (1 to 9, 10 to 12) are alike, so that
each fits every way of writing it. Any pseudonym but an IPv4 address is as long as its
value; of an international number the first two digits, most of its country code, stay.

Groups of digits between single spaces are read from left to right, at each group the
shortest card first, then a telephone number of 3, 3 and 4 digits. All groups of a card
but its last have four digits or more, unless the card is all that stands there. Beside
other digits a pseudonym could be read in another way than its value was, so texts are
restored by the places of the pseudonyms (``new_spans``), not by a second search.

Defined results: a null text stays null and an empty one empty, without values; repeated
rows each give a row, with the same pseudonyms; other columns are ignored, whatever they
are called; an empty table gives no rows; texts of any length are read whole. A text
without places (null or empty) is restored as it is.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "card", "ssn", "phone", "ip", "date")
PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
    |(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<date>(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]))
    |(?P<phone>(?<![\w.+-])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\w-])
        |(?<![\w.+-])(?:\+?1[ .-])?\d{3}[ ]\d{3}[.-]\d{4}(?![\w-])
        |(?<![\w.+-])\+1\d{10}(?![\w-])
        |(?<![\w.+-])\+[2-9]\d{0,2}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,12})){1,6}(?![\w-]))""",
    re.X | re.A,
)
#: Groups of digits; only spaces in a run border a value.
RUN = re.compile(r"(?<![\w.-])\d(?:[ -]?\d)*(?![\w-])", re.A)
GROUP = re.compile(r"\d+(?:-\d+)*")
ROUNDS = 10
YEARS = range(1900, 2100)
#: Days and months that dates keep to: as wide as before, and not read as the other field.
DAY_BANDS, MONTH_BANDS = (range(1, 10), range(10, 13), range(13, 32)), (range(1, 10), range(10, 13))


class Permuter:
    """A keyed permutation of range(n) for each n and kind."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.of = functools.lru_cache(100_000)(self.of)

    def round(self, kind: str, n: int, i: int, value: int) -> int:
        said = f"{kind}|{n}|{i}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=32).digest(), "big")

    def feistel(self, x: int, n: int, kind: str, back: bool = False) -> int:
        """One pass over a * b >= n pairs; odd rounds change the left, even ones the right half."""
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2 == 0:
                left = (left + sign * self.round(kind, n, i, right)) % a
            else:
                right = (right + sign * self.round(kind, n, i, left)) % b
        return left * b + right

    def of(self, x: int, n: int, kind: str, back: bool = False) -> int:
        """The image of x, walked along its cycle until it lies in range(n)."""
        if n < 2:
            return x
        x = self.feistel(x, n, kind, back)
        while x >= n:
            x = self.feistel(x, n, kind, back)
        return x


def luhn_digit(digits: str) -> str:
    """The check digit that ``digits`` need."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return str(-total % 10)


def fill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def digits_of(value: str) -> str:
    return re.sub(r"\D", "", value)


def is_card(value: str) -> bool:
    digits = digits_of(value)
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn_digit(digits[:-1]) == digits[-1]


def card(value: str, p: Permuter, back: bool) -> str:
    digits = digits_of(value)
    n = len(digits) - 1
    # The n repeats of one digit that a valid number may not be are walked past.
    x = int(digits[:-1])
    while True:
        x = p.of(x, 10**n, "card", back)
        body = str(x).zfill(n)
        new = body + luhn_digit(body)
        if len(set(new)) > 1:
            return fill(value, new)


def is_ssn(value: str) -> bool:
    area, group, serial = map(int, value.split("-"))
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def ssn(value: str, p: Permuter, back: bool) -> str:
    x = int(digits_of(value))
    while True:
        x = p.of(x, 10**9, "ssn", back)
        new = fill(value, str(x).zfill(9))
        if is_ssn(new):
            return new


def is_phone(value: str) -> bool:
    digits = digits_of(value)
    return value[0] != "+" or digits[0] == "1" or 8 <= len(digits) <= 15


def phone(value: str, p: Permuter, back: bool) -> str:
    """Numbers whose area and exchange begin with 2 to 9 stay among their like."""
    digits = digits_of(value)
    if value[0] == "+" and digits[0] != "1":
        head, n = digits[:2], len(digits) - 2
        return fill(value, head + str(p.of(int(digits[2:]), 10**n, f"phone:{head}", back)).zfill(n))
    real = lambda d: d[0] >= "2" and d[3] >= "2"
    own = new = digits[-10:]
    while True:
        new = str(p.of(int(new), 10**10, "phone", back)).zfill(10)
        if real(new) == real(own):
            return fill(value, digits[:-10] + new)


def is_ip(value: str) -> bool:
    return all(int(x) < 256 and (len(x) == 1 or x[0] != "0") for x in value.split("."))


def ip(value: str, p: Permuter, back: bool) -> str:
    x = p.of(int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def date_fields(value: str) -> tuple[str, str]:
    """The sign between the fields, and their order."""
    sep = next(c for c in value if not c.isdigit())
    if sep == "-":
        return sep, "ymd"
    return sep, "mdy" if int(value.split(sep)[1]) > 12 else "dmy"


def is_date(value: str) -> bool:
    sep, order = date_fields(value)
    at = dict(zip(order, map(int, value.split(sep)), strict=True))
    return at["y"] in YEARS and day_exists(at["y"], at["m"], at["d"])


def day_exists(year: int, month: int, day: int) -> bool:
    try:
        return bool(datetime.date(year, month, day))
    except ValueError:
        return False


def date(value: str, p: Permuter, back: bool) -> str:
    sep, order = date_fields(value)
    parts = dict(zip(order, value.split(sep), strict=True))
    at = {k: int(v) for k, v in parts.items()}
    days = next(band for band in DAY_BANDS if at["d"] in band)
    months = next(band for band in MONTH_BANDS if at["m"] in band)
    n = len(YEARS) * len(months) * len(days)
    x = ((at["y"] - YEARS[0]) * len(months) + at["m"] - months[0]) * len(days) + at["d"] - days[0]
    while True:  # days that a month does not have are walked past
        x = p.of(x, n, f"date:{days[0]}:{months[0]}", back)
        rest, d = divmod(x, len(days))
        y, m = divmod(rest, len(months))
        at = {"y": YEARS[y], "m": months[m], "d": days[d]}
        if day_exists(at["y"], at["m"], at["d"]):
            return sep.join(str(at[k]).zfill(len(parts[k])) for k in order)


def email(value: str, p: Permuter, back: bool) -> str:
    local, _, domain = value.partition("@")
    first, _, rest = domain.partition(".")
    return f"{spelling(local, p, back)}@{spelling(first, p, back)}.{rest}"


def spelling(word: str, p: Permuter, back: bool) -> str:
    """Permutes all words of the same shape, in lower case; letters keep their case, digits and signs their place."""
    low = word.lower()
    bases = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in low]
    starts = ["a" if c.isalpha() else "0" for c in low]
    x = 0
    for c, base, start in zip(low, bases, starts, strict=True):
        x = x * base + (ord(c) - ord(start) if base > 1 else 0)
    shape = "".join(s if b > 1 else c for c, s, b in zip(low, starts, bases, strict=True))
    x = p.of(x, math.prod(bases), f"word:{shape}", back)
    out = []
    for c, base, start in zip(reversed(word), reversed(bases), reversed(starts), strict=True):
        x, d = divmod(x, base)
        new = chr(ord(start) + d) if base > 1 else c
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out))


#: By kind: whether a match is a value, and what makes its pseudonym.
CHECKS = {"email": lambda value: True, "card": is_card, "ssn": is_ssn, "phone": is_phone, "ip": is_ip, "date": is_date}
MAKERS = {"email": email, "card": card, "ssn": ssn, "phone": phone, "ip": ip, "date": date}

Spans = list[tuple[str, int, int]]


def value_at(run: str, groups: list[tuple[int, int]], i: int) -> tuple[str, int] | None:
    """(kind, last group) of the value that begins at group i."""
    sizes = []
    for j in range(i, len(groups)):
        sizes += map(len, run[groups[j][0] : groups[j][1]].split("-"))
        if sum(sizes) > 19 or min(sizes[:-1], default=4) < 4:
            break
        if is_card(run[groups[i][0] : groups[j][1]]):
            return "card", j
    if [len(x) for a, b in groups[i : i + 3] if (x := run[a:b]).isdigit()] == [3, 3, 4]:
        return "phone", i + 2
    return None


def values_of_run(run: str) -> Spans:
    groups, found, i = [m.span() for m in GROUP.finditer(run)], [], 0
    while i < len(groups):
        hit = value_at(run, groups, i)
        if hit:
            found.append((hit[0], groups[i][0], groups[hit[1]][1]))
        i = hit[1] + 1 if hit else i + 1
    return found or ([("card", 0, len(run))] if is_card(run) else [])


def find_values(text: str) -> Spans:
    """(kind, start, end) of every value, by start."""
    if not re.search(r"\d|@", text):
        return []
    found, rest, end = [], [], 0
    for m in PATTERN.finditer(text):
        if CHECKS[m.lastgroup](m[0]):
            found.append((m.lastgroup, m.start(), m.end()))
        rest += [text[end : m.start()], "\0" * len(m[0])]  # no part of a card
        end = m.end()
    for m in RUN.finditer("".join([*rest, text[end:]])):
        if len(m[0]) >= 12:
            found += [(kind, m.start() + a, m.start() + b) for kind, a, b in values_of_run(m[0])]
    return sorted(found, key=lambda x: x[1])


def replace_values(text: str, spans: Spans, p: Permuter, back: bool = False) -> tuple[str, Spans]:
    """The text with other values at ``spans``, and where these are in it."""
    parts, moved, end, size = [], [], 0, 0
    for kind, a, b in spans:
        new = MAKERS[kind](text[a:b], p, back)
        size += a - end
        moved.append((kind, size, size + len(new)))
        parts += [text[end:a], new]
        size, end = size + len(new), b
    return "".join([*parts, text[end:]]), moved


def written(spans: Spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def read(spans: str | None) -> Spans:
    fields = [x.split(":") for x in (spans or "").split(",") if x]
    return [(kind, int(a), int(b)) for kind, a, b in fields]


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_<kind>, spans (of the given text) and new_spans (of
    the text with pseudonyms) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permuter(key)
        for batch in batches:
            texts, spans, places, counts = [], [], [], {k: [] for k in KINDS}
            for text in batch.column(1).to_pylist():
                found = find_values(text or "")
                new, moved = replace_values(text or "", found, p)
                texts.append(None if text is None else new)
                spans.append(written(found))
                places.append(written(moved))
                for k in KINDS:
                    counts[k].append(sum(1 for x in found if x[0] == k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), *(pa.array(counts[k], pa.int64()) for k in KINDS),
                 pa.array(spans, pa.string()), pa.array(places, pa.string())],
                ["doc_id", "text", *(f"n_{k}" for k in KINDS), "spans", "new_spans"],
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return chosen.mapInArrow(run, f"doc_id long, text string, {counts}, spans string, new_spans string")


def restore(
    made: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "new_spans"
) -> DataFrame:
    """doc_id and text of every row as before ``pseudonymise`` with the same key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permuter(key)
        for batch in batches:
            texts = [
                None if text is None else replace_values(text, read(spans), p, back=True)[0]
                for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    chosen = made.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(spans_col).cast("string").alias("spans"),
    )
    return chosen.mapInArrow(run, "doc_id long, text string")
