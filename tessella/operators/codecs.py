"""Tile codecs: none, LZW, JPEG, Deflate, PackBits; predictors; samples of less than a byte and of 12 bits.

Blocks hold pixels of whole bytes: samples of 1 to 8 bits are of the type uint8, and those of
9 to 15 bits uint16, from the least value up. Data that ends before its block does is an
error, whatever its codec; what comes after the block is left alone.
"""

from __future__ import annotations

import zlib

import numpy as np

from . import jpeg, lzw, packbits

# Fixed values of the TIFF format.
NONE, LZW, JPEG, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 7, 8, 32946, 32773
NAMES = {"Uncompressed": NONE, "LZW": LZW, "JPEG": JPEG, "Deflate": DEFLATE, "PackBits": PACKBITS}
GREY_FROM_WHITE, GREY, RGB, YCC = 0, 1, 2, 6
PLAIN, HORIZONTAL, FLOATING = 1, 2, 3


def decompress(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == LZW:
        return lzw.decode(data)
    if compression in (DEFLATE, DEFLATE_OLD):
        stream = zlib.decompressobj()
        return stream.decompress(data)  # as far as it goes; what it lacks shows in its length
    if compression == PACKBITS:
        return packbits.decode(data)
    raise NotImplementedError(f"TIFF compression {compression}")


def compress_many(raw: list[bytes], compression: int, row: int) -> list[bytes]:
    """Blocks whose rows have so many bytes each."""
    if compression == NONE:
        return raw
    if compression == LZW:
        return lzw.encode_many(raw)
    if compression == DEFLATE:
        return [zlib.compress(r, 6) for r in raw]
    if compression == PACKBITS:
        return [b"".join(packbits.encode(r[at : at + row]) for at in range(0, len(r), row)) for r in raw]
    raise NotImplementedError(f"TIFF compression {compression}")


def container(kind: str, bits: int) -> str:
    """The type of a block's pixels: the next of whole bytes."""
    if bits in (8, 16, 32, 64):
        return f"{kind}{bits}"
    if kind != "uint" or not 0 < bits < 16:
        raise NotImplementedError(f"samples of {bits} bits, {kind}")
    return "uint8" if bits < 8 else "uint16"


def packed(values: np.ndarray, bits: int) -> bytes:
    """Rows of numbers in so many bits each, the first in the highest; every row fills its last byte."""
    high = np.arange(bits - 1, -1, -1, dtype=values.dtype)
    each = (values[..., None] >> high) & 1
    return np.packbits(each.reshape(len(values), -1).astype(np.uint8), axis=1).tobytes()


def unpacked(data: bytes, rows: int, n: int, bits: int) -> np.ndarray:
    """``packed`` backwards: rows of n numbers."""
    raw = np.frombuffer(data, np.uint8).reshape(rows, -1)
    each = np.unpackbits(raw, axis=1, count=n * bits).reshape(rows, n, bits)
    out = np.zeros((rows, n), np.uint8 if bits <= 8 else np.uint16)
    for k in range(bits):
        out = (out << 1) | each[:, :, k]
    return out


def byte_planes(block: np.ndarray) -> bytes:
    """The floating-point predictor: a row's highest bytes first, then the next ones, as differences
    of the byte ``samples`` before."""
    h, w, samples = block.shape
    size = block.dtype.itemsize
    raw = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(h, w * samples, size).transpose(0, 2, 1).reshape(h, -1)
    out = raw.copy()
    out[:, samples:] -= raw[:, :-samples]
    return out.tobytes()


def from_byte_planes(raw: bytes, h: int, w: int, samples: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    sums = np.frombuffer(raw, np.uint8).reshape(h, -1, samples)
    planes = np.cumsum(sums, axis=1, dtype=np.uint8).reshape(h, size, w * samples)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.dtype(dtype).newbyteorder(">")).reshape(h, w, samples).astype(dtype)


def encode_blocks(blocks: list[np.ndarray], compression: int, quality: int = 90, predictor: int = PLAIN, bits: int | None = None) -> list[bytes]:
    """Full tiles (h, w, samples) of one type, compressed, with big-endian numbers, of ``bits`` bits
    where given."""
    if compression == JPEG:
        if any(b.dtype != np.uint8 for b in blocks):
            raise ValueError("JPEG tiles need pixels of 8 bits")
        return [jpeg.encode(b, quality) for b in blocks]
    return compress_many([raw_block(b, predictor, bits) for b in blocks], compression, row_bytes(blocks[0], bits) if blocks else 1)


def row_bytes(block: np.ndarray, bits: int | None) -> int:
    return -(-block.shape[1] * block.shape[2] * (bits or 8 * block.dtype.itemsize) // 8)


def raw_block(block: np.ndarray, predictor: int, bits: int | None) -> bytes:
    if bits and bits != 8 * block.dtype.itemsize:
        if predictor != PLAIN:
            raise ValueError("samples that are no whole bytes have no predictor")
        if int(block.max(initial=0)) >> bits:
            raise ValueError(f"a pixel does not fit {bits} bits")
        return packed(block.reshape(len(block), -1), bits)
    if predictor == FLOATING:
        if block.dtype.kind != "f":
            raise ValueError("predictor 3 is for floating-point numbers")
        return byte_planes(block)
    if predictor == HORIZONTAL:  # differences of the bits, whatever they stand for
        block = np.ascontiguousarray(block).view(f"u{block.dtype.itemsize}")
        block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
    elif predictor != PLAIN:
        raise ValueError(f"TIFF predictor {predictor}")
    return block.astype(block.dtype.newbyteorder(">")).tobytes()


def decode_block(
    data: bytes, compression: int, predictor: int, dtype: str, h: int, w: int, samples: int, big: bool,
    photometric: int = GREY, tables: bytes | None = None, bits: int | None = None,
) -> np.ndarray:
    """(h, w, samples) of one strip or tile, in native byte order. No data at all is a block that
    the file leaves out, of zeros."""
    kind = np.dtype(dtype)
    if not data:
        return np.zeros((h, w, samples), kind)
    if compression == JPEG:
        block = jpeg.decode(data, tables)
        if photometric == YCC and samples == 3:
            block = jpeg.from_ycc(block)
        if block.shape[0] < h or block.shape[1] < w or block.shape[2] != samples:
            raise ValueError(f"a block of {h} x {w} x {samples} pixels has {block.shape}")
        return block[:h, :w]
    bits = bits or 8 * kind.itemsize
    need = h * -(-w * samples * bits // 8)
    raw = decompress(data, compression)
    if len(raw) < need:
        raise ValueError(f"a block of {need} bytes ends after {len(raw)}")
    raw = raw[:need]
    if bits != 8 * kind.itemsize:
        if predictor != PLAIN:
            raise NotImplementedError(f"predictor {predictor} of samples of {bits} bits")
        return unpacked(raw, h, w * samples, bits).reshape(h, w, samples).astype(kind)
    if predictor == FLOATING:
        return from_byte_planes(raw, h, w, samples, dtype)
    block = np.frombuffer(raw, kind.newbyteorder(">" if big else "<")).reshape(h, w, samples).astype(kind)
    if predictor == HORIZONTAL:
        whole = np.dtype(f"u{kind.itemsize}")
        block = np.cumsum(block.view(whole), axis=1, dtype=whole).view(kind)
    elif predictor != PLAIN:
        raise NotImplementedError(f"TIFF predictor {predictor}")
    return block
