"""JPEG tiles in NumPy: baseline is written and read, progressive read.

Encoding is vectorised over all blocks of a tile, entropy codes included. Decoding reads
the entropy codes in one loop over symbols, of which a tile has far fewer than pixels,
and does everything else at once. A progressive stream has several scans, each of some
coefficients of some components, or of one more bit of them (see ``progressive.py``).
Tables may come apart from the data, as in TIFF files.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: luminance quantisation at quality 50, in rows, and the
# usual luminance Huffman tables: codes of each length from 1 to 16, and symbols.
QUANTUM = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = bytes(range(12))
AC_LENGTHS = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125)
AC_SYMBOLS = bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
SOI, EOI, SOF0, SOF1, SOF2, DHT, DQT, SOS, DRI = 0xD8, 0xD9, 0xC0, 0xC1, 0xC2, 0xC4, 0xDB, 0xDA, 0xDD


def zigzag() -> np.ndarray:
    """The places of a block, in rows, in the order in which they are written."""
    y, x = np.divmod(np.arange(64), 8)
    along = np.where((x + y) % 2, y, x)
    return np.lexsort((along, x + y))


def cosines() -> np.ndarray:
    k, i = np.arange(8)[:, None], np.arange(8)[None, :]
    return (np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * i + 1) * k * np.pi / 16)).astype(np.float32)


ZIGZAG, DCT = zigzag(), cosines()


def quantum_of(quality: int) -> np.ndarray:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(QUANTUM) * scale + 50) // 100, 1, 255).astype(np.uint8)


def canonical(lengths, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(lengths, 1):
        for symbol in symbols[at : at + n]:
            out.append((symbol, code, length))
            code += 1
        at += n
        code <<= 1
    return out


def by_symbol(lengths, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, c, n in canonical(lengths, symbols):
        code[symbol], size[symbol] = c, n
    return code, size


def to_ycc(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(np.float32) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.stack([y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128], -1)


def from_ycc(ycc: np.ndarray) -> np.ndarray:
    y, cb, cr = (ycc[..., k].astype(np.float32) for k in range(3))
    cb, cr = cb - 128, cr - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def category(values: np.ndarray) -> np.ndarray:
    """Bits of the absolute value."""
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def encode(pixels: np.ndarray, quality: int = 90) -> bytes:
    """(h, w, samples) of bytes, 1 or 3 samples, as a stream with its tables; three samples are
    taken for RGB and stored as YCbCr without subsampling."""
    h, w, samples = pixels.shape
    image = to_ycc(pixels) if samples == 3 else pixels.astype(np.float32)
    image = np.pad(image, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    down, across = image.shape[0] // 8, image.shape[1] // 8
    blocks = image.reshape(down, 8, across, 8, samples).transpose(0, 2, 4, 1, 3).reshape(-1, 8, 8)
    quantum = quantum_of(quality)
    coded = np.rint((DCT @ blocks @ DCT.T).reshape(-1, 64) / quantum).astype(np.int64)[:, ZIGZAG]
    head = b"\xff\xd8" + segment(DQT, b"\0" + quantum[ZIGZAG].tobytes())
    parts = b"".join(struct.pack(">BBB", k + 1, 0x11, 0) for k in range(samples))
    head += segment(SOF0, struct.pack(">BHHB", 8, h, w, samples) + parts)
    for kind, lengths, symbols in ((0x00, DC_LENGTHS, DC_SYMBOLS), (0x10, AC_LENGTHS, AC_SYMBOLS)):
        head += segment(DHT, bytes([kind, *lengths]) + symbols)
    head += segment(SOS, bytes([samples]) + b"".join(bytes([k + 1, 0]) for k in range(samples)) + b"\0\x3f\0")
    return head + entropy(coded, samples).replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def entropy(coded: np.ndarray, samples: int) -> bytes:
    """The bit stream of blocks in zigzag order, components in turn."""
    dc_code, dc_size = by_symbol(DC_LENGTHS, DC_SYMBOLS)
    ac_code, ac_size = by_symbol(AC_LENGTHS, AC_SYMBOLS)
    dc = coded[:, 0].reshape(-1, samples)
    dc = np.diff(dc, axis=0, prepend=np.zeros((1, samples), np.int64)).ravel()
    block, k = np.nonzero(coded[:, 1:])
    k = k + 1
    ac = coded[block, k]
    before = np.where(np.concatenate([[True], block[1:] != block[:-1]])[: len(k)], 0, np.concatenate([[0], k[:-1]])[: len(k)])
    run = k - before - 1
    last = np.zeros(len(coded), np.int64)
    np.maximum.at(last, block, k)
    ends = np.flatnonzero(last < 63)
    skips = np.repeat(np.arange(len(k)), run // 16)
    # (place, code, length) of DC, long runs, AC and ends of blocks, then in order of place.
    items = []
    n = category(dc)
    items.append((np.arange(len(dc)) * 1024, (dc_code[n] << n) | (np.where(dc < 0, dc - 1, dc) & ((1 << n) - 1)), dc_size[n] + n))
    items.append((block[skips] * 1024 + k[skips] * 16, np.full(len(skips), ac_code[0xF0]), np.full(len(skips), ac_size[0xF0])))
    n = category(ac)
    symbol = (run % 16) << 4 | n
    items.append((block * 1024 + k * 16 + 8, (ac_code[symbol] << n) | (np.where(ac < 0, ac - 1, ac) & ((1 << n) - 1)), ac_size[symbol] + n))
    items.append((ends * 1024 + 1023, np.full(len(ends), ac_code[0]), np.full(len(ends), ac_size[0])))
    place, code, size = (np.concatenate(x) for x in zip(*items, strict=True))
    order = np.argsort(place, kind="stable")
    code, size = code[order], size[order]
    bits = ((code[:, None] << (32 - size)[:, None]) >> np.arange(31, -1, -1)) & 1
    bits = bits[np.arange(32) < size[:, None]].astype(np.uint8)
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


@functools.lru_cache(64)
def lookup(lengths: bytes, symbols: bytes) -> list[int]:
    """symbol << 5 | length for each 16 bits that follow; 0 for no code."""
    out = np.zeros(1 << 16, np.int64)
    for symbol, code, n in canonical(lengths, symbols):
        out[code << (16 - n) : (code + 1) << (16 - n)] = symbol << 5 | n
    return out.tolist()


@dataclass(frozen=True)
class Scan:
    """A scan of a progressive stream: its components' tables, the coefficients and the bits that it
    has, and its entropy-coded data."""

    tables: dict[int, int]
    first: int
    last: int
    above: int  # the bit that was read before, 0 in the first scan of these coefficients
    low: int  # the bit that this scan goes down to
    huffman: dict[int, list[int]]
    restart: int
    data: bytes


def entropy_end(data: bytes, at: int) -> int:
    """Where the next marker is that ends a scan."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return len(data)
        if data[at + 1] and data[at + 1] != 0xFF and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 1 if data[at + 1] == 0xFF else 2


class Stream:
    """Tables, frame and scan of one stream, and of the tables that came before it."""

    def __init__(self):
        self.quantum, self.huffman, self.restart, self.frame, self.scan = {}, {}, 0, None, None
        self.progressive, self.scans, self.ended = False, [], False

    def read(self, data: bytes) -> Stream:
        at = 2
        while at + 2 <= len(data):
            if data[at] != 0xFF:
                raise ValueError("broken JPEG data")
            marker = data[at + 1]
            if marker in (0xFF, SOI) or 0xD0 <= marker <= 0xD7:
                at += 1 if marker == 0xFF else 2
                continue
            if marker == EOI:
                self.ended = True
                break
            if at + 4 > len(data):
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == DQT:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    self.quantum[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                    body = body[1 + n :]
            elif marker == DHT:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = lookup(bytes(body[1:17]), bytes(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker in (SOF0, SOF1, SOF2):
                self.progressive = marker == SOF2
                h, w, n = struct.unpack_from(">HHB", body, 1)
                self.frame = (h, w, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)])
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise NotImplementedError("only baseline and progressive JPEG are read")
            elif marker == DRI:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == SOS:
                tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                if not self.progressive:
                    self.scan = (tables, data[at:])
                    break
                end = entropy_end(data, at)
                self.scans.append(Scan(tables, *body[-3:-1], body[-1] >> 4, body[-1] & 15, dict(self.huffman), self.restart, data[at:end]))
                at = end
        return self


def decode(data: bytes, tables: bytes | None = None) -> np.ndarray:
    """(h, w, samples) of bytes, as stored: YCbCr is not turned to RGB."""
    s = Stream()
    if tables:
        s.read(tables)
    s.read(data)
    if s.frame is None or not (s.scan or s.scans):
        raise ValueError("JPEG data without a frame or a scan")
    h, w, parts = s.frame
    high, wide = max(v for _, _, v, _ in parts), max(x for _, x, _, _ in parts)
    down, across = -(-h // (8 * high)), -(-w // (8 * wide))
    if len(parts) == 1:  # blocks of a single component stand in rows, whatever its factors
        parts, high, wide = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
        down, across = -(-h // 8), -(-w // 8)
    if s.progressive and not s.ended:
        raise ValueError("JPEG data ends too early")  # scans may be missing, which would not show
    if s.progressive:
        from .progressive import gathered

        coded = gathered(s.scans, parts, h, w, high, wide)
    else:
        coded = coefficients(s, parts, down * across)
    planes = []
    for (_, x, v, q), c in zip(parts, coded, strict=True):
        flat = np.zeros((len(c), 64), np.float32)
        flat[:, ZIGZAG] = c * s.quantum[q]
        blocks = DCT.T @ flat.reshape(-1, 8, 8) @ DCT
        plane = blocks.reshape(down, across, v, x, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * x * 8)
        plane = np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)
        planes.append(plane.repeat(high // v, 0).repeat(wide // x, 1)[:h, :w])
    return np.stack(planes, -1)


def coefficients(s: Stream, parts: list, n_units: int) -> list[np.ndarray]:
    """The quantised blocks of each component, in zigzag order."""
    tables, raw = s.scan
    plan = [(p, s.huffman[tables[i] >> 4], s.huffman[0x10 | tables[i] & 15]) for p, (i, x, v, _) in enumerate(parts) for _ in range(x * v)]
    out = [[0] * (64 * n_units * x * v) for _, x, v, _ in parts]
    at = [0] * len(parts)
    unit = 0
    for piece in pieces(raw):
        if unit == n_units:
            break
        bytes_ = np.frombuffer(piece.replace(b"\xff\0", b"\xff") + b"\xff" * 8, np.uint8).astype(np.uint32)
        words = ((bytes_[:-3] << 24) | (bytes_[1:-2] << 16) | (bytes_[2:-1] << 8) | bytes_[3:]).tolist()
        stop = n_units if not s.restart else min(n_units, unit + s.restart)
        last, bit, limit = [0] * len(parts), 0, 8 * (len(bytes_) - 4)
        while unit < stop:
            for p, dc, ac in plan:
                if bit > limit:
                    raise ValueError("JPEG data ends too early")
                block, place = out[p], at[p]
                hit = dc[(words[bit >> 3] >> (16 - (bit & 7))) & 0xFFFF]
                bit += hit & 31
                n = hit >> 5
                if n:
                    v = (words[bit >> 3] >> (32 - n - (bit & 7))) & ((1 << n) - 1)
                    bit += n
                    last[p] += v if v >> (n - 1) else v - (1 << n) + 1
                block[place] = last[p]
                k = 1
                while k < 64:
                    hit = ac[(words[bit >> 3] >> (16 - (bit & 7))) & 0xFFFF]
                    if not hit:
                        raise ValueError("broken JPEG data")
                    bit += hit & 31
                    n = hit >> 5 & 15
                    if not n:
                        if hit >> 9 != 15:
                            break
                        k += 16
                        continue
                    k += hit >> 9
                    v = (words[bit >> 3] >> (32 - n - (bit & 7))) & ((1 << n) - 1)
                    bit += n
                    if k < 64:
                        block[place + k] = v if v >> (n - 1) else v - (1 << n) + 1
                    k += 1
                at[p] = place + 64
            unit += 1
    if unit < n_units:
        raise ValueError("JPEG data ends too early")
    return [np.array(x, np.float32).reshape(-1, 64) for x in out]


def pieces(raw: bytes):
    """Entropy-coded data between restart marks, up to the next other marker."""
    begin = at = 0
    while True:
        at = raw.find(b"\xff", at)
        if at < 0 or at + 1 >= len(raw):
            yield raw[begin:]
            return
        mark = raw[at + 1]
        if mark and mark != 0xFF:
            yield raw[begin:at]
            if not 0xD0 <= mark <= 0xD7:
                return
            begin = at + 2
        at += 2 if mark != 0xFF else 1
