"""LZW of TIFF tiles, vectorised.

Codes are 9 to 12 bits wide, high bits first, and widen one code early. As a stream may
clear its table anywhere, the encoder cuts data into lanes that begin with a clear code
and encodes the lanes of many tiles in lockstep, a byte of each at a time. The decoder
reads the codes between two clear codes at once, since their widths follow from their
number, and copies strings by following each byte to the literal it comes from.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format.
CLEAR, END, FIRST, LAST = 256, 257, 258, 4094
LANE = 8192  # bytes
SLOTS = 8192  # of a lane's hash table, twice the codes it can hold; shorter lanes have fewer
LANES = 1024  # encoded in lockstep, with tables of 64 KB each at most


def widths() -> np.ndarray:
    """The width of the k-th code after a clear code, from k = 0; the last is kept on."""
    k = np.arange(LAST - FIRST + 2)
    return np.select([k < 512 - FIRST, k < 1024 - FIRST, k < 2048 - FIRST], [9, 10, 11], 12)


WIDTHS = widths()
OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)])


def encode_many(parts: list[bytes]) -> list[bytes]:
    """Each part as a stream of its own."""
    data = [np.frombuffer(p, np.uint8) for p in parts]
    lanes = [(i, lo) for i, d in enumerate(data) for lo in range(0, len(d), LANE)]
    if not lanes:
        return [pack(np.array([CLEAR, END]), np.array([9, 9])) for _ in parts]
    size = np.array([min(LANE, len(data[i]) - lo) for i, lo in lanes])
    order = np.argsort(-size, kind="stable")  # lanes that end early stand last
    size = size[order]
    lanes = [lanes[k] for k in order]
    streams: list[list] = [[] for _ in parts]
    for at in range(0, len(lanes), LANES):
        group, own = lanes[at : at + LANES], size[at : at + LANES]
        text = np.zeros((own[0], len(group)), np.uint8)
        for k, (i, lo) in enumerate(group):
            text[: own[k], k] = data[i][lo : lo + LANE]
        codes, n_codes = lockstep(text, own)
        for k, (i, lo) in enumerate(group):
            streams[i].append((lo, codes[: n_codes[k], k].copy()))  # no view, which would hold the whole group's
    out = []
    for stream in streams:
        every = np.concatenate([np.concatenate([[CLEAR], c]) for _, c in sorted(stream, key=lambda x: x[0])] + [[END]] if stream else [[CLEAR, END]])
        out.append(pack(every, widths_of(every)))
    return out


def widths_of(codes: np.ndarray) -> np.ndarray:
    """The width of each code of a stream; a clear code has that of its place in the run before it."""
    starts = np.flatnonzero(codes == CLEAR) + 1
    place = np.arange(len(codes)) - np.concatenate([[0], starts])[np.searchsorted(starts, np.arange(len(codes)), "right")]
    return WIDTHS[place]


def lockstep(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, lane) and their number for each lane, without the clear code before them."""
    n = text.shape[1]
    slots = min(SLOTS, 2 << (len(text) - 1).bit_length())
    table = np.full(n * slots, -1, np.int64)  # key << 12 | code
    base = np.arange(n) * slots
    word = text[0].astype(np.int64)
    following = np.full(n, FIRST)
    out = np.zeros((len(text) + len(text) // 2048 + 2, n), np.int16)
    count = np.zeros(n, np.int64)
    lane = np.arange(n)
    for t in range(1, int(size[0])):
        m = int(np.searchsorted(-size, -t))  # lanes longer than t
        byte = text[t, :m]
        key = (word[:m] << 8) | byte
        slot = ((key * 40503) >> 3) & (slots - 1)
        at = table[base[:m] + slot]
        known = (at >> 12) == key
        open_ = np.flatnonzero((at >= 0) & ~known)
        while len(open_):  # other keys stand there: try the next slots
            slot[open_] = (slot[open_] + 1) & (slots - 1)
            at[open_] = table[base[open_] + slot[open_]]
            known[open_] = (at[open_] >> 12) == key[open_]
            open_ = open_[(at[open_] >= 0) & ~known[open_]]
        new = np.flatnonzero(~known)
        out[count[new], new] = word[new]
        count[new] += 1
        table[base[new] + slot[new]] = (key[new] << 12) | following[new]
        following[new] += 1
        word[:m] = np.where(known, at & 4095, byte)
        full = new[following[new] == LAST]
        if len(full):
            out[count[full], full] = CLEAR
            count[full] += 1
            following[full] = FIRST
            table.reshape(n, slots)[full] = -1
    out[count, lane] = word
    return out, count + 1


def pack(codes: np.ndarray, width: np.ndarray) -> bytes:
    """Codes as a bit stream, high bits first."""
    bits = ((codes[:, None].astype(np.int64) << (12 - width)[:, None]) >> np.arange(11, -1, -1)) & 1
    keep = np.arange(12) < width[:, None]
    return np.packbits(bits[keep].astype(np.uint8)).tobytes()


def decode(data: bytes) -> bytes:
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    n_bits, at = 8 * len(data), 0
    runs: list[np.ndarray] = []
    ended = False
    while not ended and at + 9 <= n_bits:
        place = at + OFFSETS[:-1]
        width = WIDTHS
        fits = int(np.searchsorted(place + width, n_bits, "right"))
        place, width = place[:fits], width[:fits]
        i = place >> 3
        word = (raw[i] << np.uint32(16)) | (raw[i + 1] << np.uint32(8)) | raw[i + 2]
        codes = (word >> (24 - (place & 7) - width).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(marks[0]) if len(marks) else len(codes)
        runs.append(codes[:stop].astype(np.int64))
        ended = not len(marks) or codes[stop] == END
        at += int(OFFSETS[min(stop + 1, len(OFFSETS) - 1)])
    return expand([r for r in runs if len(r)])


def expand(runs: list[np.ndarray]) -> bytes:
    """The bytes of runs of codes, each with a table of its own."""
    if not runs:
        return b""
    codes = np.concatenate(runs)
    first = np.repeat(np.cumsum([0, *map(len, runs[:-1])]), [len(r) for r in runs])
    token = np.arange(len(codes))
    literal = codes < CLEAR
    # Code FIRST + j is the string of the run's j-th token and one byte more.
    parent = np.where(literal, token, first + codes - FIRST)
    if (parent[~literal] >= token[~literal]).any() or (codes[token == first] >= CLEAR).any():
        raise ValueError("broken LZW data")
    length, up = np.where(literal, 0, 1), parent.copy()
    while True:
        further = up[up]
        length = length + np.where(up != token, length[up], 0)
        if (further == up).all():
            break
        up = further
    length = length + 1
    start = np.concatenate([[0], np.cumsum(length)])
    owner = np.repeat(token, length)
    byte = np.arange(start[-1])
    source = np.where(literal[owner], byte, start[parent[owner]] + byte - start[owner])
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    return codes[owner[source]].astype(np.uint8).tobytes()
