"""PackBits: a byte's run or a stretch of bytes behind each count, one row of pixels at a time."""

from __future__ import annotations

import numpy as np

LONGEST = 128


def decode(data: bytes) -> bytes:
    """The bytes of a packed stretch; a count without its bytes is an error."""
    out, at, end = [], 0, len(data)
    while at < end:
        n = data[at]
        at += 1
        if n < 128:  # n + 1 bytes as they are
            if at + n >= end:
                raise ValueError("PackBits data ends too early")
            out.append(data[at : at + n + 1])
            at += n + 1
        elif n > 128:  # 257 - n times the next byte; 128 says nothing
            if at >= end:
                raise ValueError("PackBits data ends too early")
            out.append(data[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


def encode(row: bytes) -> bytes:
    """Runs of three and more as runs, all else as it is."""
    if not row:
        return b""
    raw = np.frombuffer(row, np.uint8)
    begins = np.flatnonzero(np.append(True, raw[1:] != raw[:-1]))
    lengths = np.diff(np.append(begins, len(raw)))
    out, plain = [], 0

    def literal(lo: int, hi: int) -> None:
        for at in range(lo, hi, LONGEST):
            part = row[at : min(at + LONGEST, hi)]
            out.append(bytes([len(part) - 1]) + part)

    for begin, n in zip(begins[lengths >= 3].tolist(), lengths[lengths >= 3].tolist(), strict=True):
        literal(plain, begin)
        for at in range(0, n, LONGEST):
            part = min(LONGEST, n - at)
            out.append(bytes([257 - part if part > 1 else 0, raw[begin]]))
        plain = begin + n
    literal(plain, len(row))
    return b"".join(out)
