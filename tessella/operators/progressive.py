"""The scans of a progressive JPEG stream.

A coefficient comes in by its high bits first and then one bit a scan; scans of the first
coefficient (DC) may hold several components in turns, those of the others (AC) one, of a
band of coefficients. Ends of bands may run over many blocks.
"""

from __future__ import annotations

import numpy as np

from .jpeg import Scan, pieces


class Bits:
    """The bits of a stretch without restart marks."""

    def __init__(self, piece: bytes):
        raw = np.frombuffer(piece.replace(b"\xff\0", b"\xff") + b"\xff" * 8, np.uint8).astype(np.uint32)
        self.words = ((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]).tolist()
        self.at, self.limit = 0, 8 * (len(raw) - 4)

    def symbol(self, table: list[int]) -> int:
        if self.at > self.limit:
            raise ValueError("JPEG data ends too early")
        hit = table[(self.words[self.at >> 3] >> (16 - (self.at & 7))) & 0xFFFF]
        if not hit:
            raise ValueError("broken JPEG data")
        self.at += hit & 31
        return hit >> 5

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.at > self.limit:
            raise ValueError("JPEG data ends too early")
        v = (self.words[self.at >> 3] >> (32 - n - (self.at & 7))) & ((1 << n) - 1)
        self.at += n
        return v

    def number(self, n: int) -> int:
        """A number of n bits, of which those that begin with 0 are negative."""
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def first_dc(bits: Bits, block: list[int], at: int, table: list[int], last: int, low: int) -> int:
    last += bits.number(bits.symbol(table))
    block[at] = last << low
    return last


def first_ac(bits: Bits, block: list[int], at: int, table: list[int], s: Scan, ended: int) -> int:
    """The band of a block; returns for how many blocks more it has ended."""
    if ended:
        return ended - 1
    k = s.first
    while k <= s.last:
        run, n = divmod(bits.symbol(table), 16)
        if not n:
            if run < 15:
                return (1 << run) + bits.take(run) - 1
            k += 16
            continue
        k += run
        block[at + min(k, 63)] = bits.number(n) << s.low
        k += 1
    return 0


def later_ac(bits: Bits, block: list[int], at: int, table: list[int], s: Scan, ended: int) -> int:
    """One bit more of a band: of what is not 0 yet a bit each, and what becomes 1 or -1 now."""
    one, k = 1 << s.low, s.first

    def more(i: int) -> None:
        if bits.take(1) and not abs(block[i]) & one:
            block[i] += one if block[i] > 0 else -one

    if not ended:
        while k <= s.last:
            run, n = divmod(bits.symbol(table), 16)
            new = 0
            if n:
                new = one if bits.take(1) else -one
            elif run < 15:
                ended = (1 << run) + bits.take(run)
                break
            while k <= s.last:
                if block[at + k]:
                    more(at + k)
                elif run:
                    run -= 1
                else:
                    if new:
                        block[at + k] = new
                    k += 1
                    break
                k += 1
    if not ended:
        return 0
    for i in range(at + k, at + s.last + 1):
        if block[i]:
            more(i)
    return ended - 1


def units_of(s: Scan, parts: list, h: int, w: int, high: int, wide: int) -> list[list[tuple[int, int]]]:
    """(component, place) of the blocks of every unit, in the order of the scan."""
    down, across = -(-h // (8 * high)), -(-w // (8 * wide))
    chosen = [p for p, part in enumerate(parts) if part[0] in s.tables]
    if len(chosen) == 1:  # its own blocks in rows, without those that fill up a unit
        p = chosen[0]
        _, x, v, _ = parts[p]
        rows, columns = -(-(-(-h * v // high)) // 8), -(-(-(-w * x // wide)) // 8)
        return [[(p, (r * across * x + c) * 64)] for r in range(rows) for c in range(columns)]
    return [
        [(p, ((r * v + i) * across * x + c * x + j) * 64) for p in chosen for _, x, v, _ in [parts[p]] for i in range(v) for j in range(x)]
        for r in range(down) for c in range(across)
    ]


def gathered(scans: list[Scan], parts: list, h: int, w: int, high: int, wide: int) -> list[np.ndarray]:
    """The quantised blocks of each component after all scans, in zigzag order, unit by unit."""
    down, across = -(-h // (8 * high)), -(-w // (8 * wide))
    blocks = [[0] * (64 * down * v * across * x) for _, x, v, _ in parts]
    for s in scans:
        units = units_of(s, parts, h, w, high, wide)
        tables = {p: (s.huffman.get(s.tables[part[0]] >> 4), s.huffman.get(0x10 | s.tables[part[0]] & 15)) for p, part in enumerate(parts) if part[0] in s.tables}
        step = s.restart or len(units)
        begin = 0
        for piece in pieces(s.data):
            if begin >= len(units):
                break
            bits, last, ended = Bits(piece), [0] * len(parts), 0
            for unit in units[begin : begin + step]:
                for p, at in unit:
                    dc, ac = tables[p]
                    if s.first:
                        ended = (later_ac if s.above else first_ac)(bits, blocks[p], at, ac, s, ended)
                    elif s.above:
                        blocks[p][at] |= bits.take(1) << s.low
                    else:
                        last[p] = first_dc(bits, blocks[p], at, dc, last[p], s.low)
            begin += step
        if begin < len(units):
            raise ValueError("JPEG data ends too early")
    out = []
    for b, (_, x, v, _) in zip(blocks, parts, strict=True):
        whole = np.array(b, np.float32).reshape(down, v, across, x, 64)
        out.append(whole.transpose(0, 2, 1, 3, 4).reshape(-1, 64))
    return out
