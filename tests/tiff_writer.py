"""A small TIFF writer of its own, so that the engine's reader is not tested by its own sink."""

import struct
import zlib

import numpy as np


def write_tiff(path, pages, order="<", big=False, tile=None, rows_per_strip=None, deflate=False, predictor=1, jpeg=False, texts=None):
    """pages: (array of h x w or h x w x samples, description or None)."""
    word, inline = ("Q", 8) if big else ("I", 4)
    out = bytearray(struct.pack(order + "2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, 0) if big
                    else struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 8 if big else 4
    for pixels, description in pages:
        pixels = pixels if pixels.ndim == 3 else pixels[:, :, None]
        h, w, samples = pixels.shape
        th, tw = (tile, tile) if tile else (rows_per_strip or h, w)
        offsets, counts = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                part = pixels[y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                data = part.astype(part.dtype.newbyteorder(order)).tobytes()
                data = zlib.compress(data) if deflate else data
                if jpeg:
                    from tessella.operators.jpeg import encode

                    data = encode(part, 95)
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [pixels.dtype.itemsize * 8] * samples), (259, "H", [7 if jpeg else 8 if deflate else 1]),
                (262, "H", [6 if jpeg and samples == 3 else 2 if samples == 3 else 1]), (277, "H", [samples]), (284, "H", [1]), (317, "H", [predictor]),
                (339, "H", [{"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]] * samples), (315, "s", b"SENTINEL-ARTIST\0")]
        tags += [(k, "s", v.encode() + b"\0") for k, v in (texts or {}).items() if k != 315]
        tags += [(322, "I", [tw]), (323, "I", [th]), (324, word, offsets), (325, word, counts)] if tile else [
            (273, word, offsets), (278, "I", [th]), (279, word, counts)]
        if description is not None:
            tags.append((270, "s", description.encode() + b"\0"))
        entries = b""
        for tag, letter, value in sorted(tags):
            data = value if letter == "s" else struct.pack(f"{order}{len(value)}{letter}", *value)
            kind = {"s": 2, "H": 3, "I": 4, "Q": 16}[letter]
            if len(data) > inline:
                at = len(out)
                out += data
                data = struct.pack(order + word, at)
            entries += struct.pack(order + "HH" + word, tag, kind, len(value)) + data.ljust(inline, b"\0")
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries
        link = len(out)
        out += struct.pack(order + word, 0)
    with open(path, "wb") as f:
        f.write(out)
