"""Regular grids of tiles and their reduced levels.

Tiles are rows (path, series, level, c, ty, tx, h, w, height, width, dtype, data),
h x w pixels of an image of height x width. Blocks are the same with y0, x0 for ty, tx.

Blocks are cut where they lie, at the borders of squares of 2^span x 2^span tiles, and a
shuffle gathers the parts of each square, a bounded number of pixels; the square gives its
tiles and, as its edges lie on even places, its own share of the next ``span`` levels. So
the pixels of a level are shuffled only once in ``span`` levels, and those in between never.
A filter that reaches over a square's edges gets a rim of pixels with it, which its
neighbours' blocks are cut for too: 2^span - 1 pixels wide, so that the rim of each level
in between comes with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILES = (
    "path string, series int, level int, c int, ty long, tx long, h long, w long, height long, width long,"
    " dtype string, data binary"
)
KEY = ["path", "series", "level", "c", "ty", "tx"]
NAMES = [x.split()[0] for x in TILES.split(",")]
HELD = 8 << 20  # bytes of finished tiles that a task holds
LEAST = 256  # the longer side of the last level, at most


BLOCK_KINDS = TILES.replace("ty long, tx long", "ty long, tx long, y0 long, x0 long")
METHODS = ("simple", "area", "binomial")
#: Bytes and number of parts that a task gathers before it hands them on; small parts are more row than pixels.
CUT_BYTES = 16 << 20
CUT_ROWS = 4096


def met_by(start: int, n: int, whole: int, edge: int, halo: int) -> range:
    """The squares along one side whose stretch, rim included, a block has part in."""
    last = -(-whole // edge) - 1
    return range(max(0, (start - halo) // edge), min(last, -(-(start + n + halo) // edge) - 1) + 1)


def cut_parts(blocks: DataFrame, edge: int, halo: int = 0) -> DataFrame:
    """The parts of blocks that fall into each square (ty, tx), rim included; without a rim, every
    pixel once."""
    names = [x.split()[0] for x in BLOCK_KINDS.split(",")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*rows, strict=True), BLOCK_KINDS.split(","), strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for lo in range(0, len(batch), 64):
                for *own, y0, x0, h, w, height, width, dtype, data in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                    block = np.frombuffer(data, dtype).reshape(h, w)
                    for sy in met_by(y0, h, height, edge, halo):
                        a, b = max(y0, sy * edge - halo), min(y0 + h, (sy + 1) * edge + halo)
                        for sx in met_by(x0, w, width, edge, halo):
                            c, d = max(x0, sx * edge - halo), min(x0 + w, (sx + 1) * edge + halo)
                            part = block[a - y0 : b - y0, c - x0 : d - x0]
                            rows.append((*own, sy, sx, a, c, *part.shape, height, width, dtype, data if part.size == block.size else part.tobytes()))
                            held += part.nbytes
                            if held > CUT_BYTES or len(rows) >= CUT_ROWS:
                                yield out(rows)
                                rows, held = [], 0
        if rows:
            yield out(rows)

    chosen = blocks.select(*KEY[:4], *(F.col(n).cast("long").alias(n) for n in ("y0", "x0", "h", "w", "height", "width")), "dtype", "data")
    return chosen.mapInArrow(run, BLOCK_KINDS)


def squares(blocks: DataFrame, size: int, span: int, method: str, first: int, last: int, least: int = LEAST) -> DataFrame:
    """Tiles of the blocks' own level + k for k from ``first`` to ``last``, at most ``span``,
    as far as images have levels."""
    if size < 2 or size % 2:
        raise ValueError("the tile size is an even number")
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    edge = size << span
    halo = (1 << last) - 1 if method == "binomial" else 0

    def cut(key: tuple, parts: list[tuple]) -> list[tuple]:
        *own, level, c, sy, sx = key
        _, _, _, _, height, width, dtype, _ = parts[0]
        whole = height, width
        top, left = max(0, sy * edge - halo), max(0, sx * edge - halo)
        pixels = np.zeros((min((sy + 1) * edge + halo, height) - top, min((sx + 1) * edge + halo, width) - left), dtype)
        for y0, x0, h, w, _, _, _, data in parts:
            pixels[y0 - top : y0 - top + h, x0 - left : x0 - left + w] = np.frombuffer(data, pixels.dtype).reshape(h, w)
        rows = []
        for k in range(last + 1):
            if k and k >= level_count(*whole, least):
                break
            if k >= first:
                grid = 1 << (span - k)
                for ty in range(sy * grid, min((sy + 1) * grid, -(-height // size))):
                    for tx in range(sx * grid, min((sx + 1) * grid, -(-width // size))):
                        y, x = ty * size, tx * size
                        tile = pixels[y - top : min(y + size, height) - top, x - left : min(x + size, width) - left]
                        rows.append((*own, level + k, c, ty, tx, *tile.shape, height, width, dtype, tile.tobytes()))
            if k < last:
                if method == "binomial":
                    pixels, top, left = smoothed(pixels, top, left, height, width)
                else:
                    pixels, top, left = halved(pixels, method), top // 2, left // 2
                height, width = (height + 1) // 2, (width + 1) // 2
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their keys; a square is cut when the next one begins."""
        now, parts, out, held = None, [], [], 0
        for batch in batches:
            for lo in range(0, len(batch), 256):
                rows = zip(*(x.to_pylist() for x in batch.slice(lo, 256).columns), strict=True)
                for row in rows:
                    key = row[: len(KEY)]
                    if key != now and parts:
                        made, parts = cut(now, parts), []
                        out += made
                        held += sum(len(x[-1]) for x in made)
                        if held > HELD or len(out) >= 4096:
                            yield tile_batch(out)
                            out, held = [], 0
                    now = key
                    parts.append(row[len(KEY) :])
        if parts:
            out += cut(now, parts)
        yield tile_batch(out)

    met = cut_parts(blocks, edge, halo).select(*KEY, "y0", "x0", "h", "w", "height", "width", "dtype", "data")
    return met.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, TILES)


def tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, TILES.split(","), strict=True)], NAMES)


def retile(blocks: DataFrame, size: int = 512) -> DataFrame:
    """Blocks cut to a grid of size x size tiles, cut at the borders."""
    return squares(blocks, size, 0, "simple", 0, 0)


def as_blocks(tiles: DataFrame, size: int) -> DataFrame:
    place = {"ty": (F.col("ty") * size).alias("y0"), "tx": (F.col("tx") * size).alias("x0")}
    return tiles.select(*(place.get(n, F.col(n)) for n in NAMES))


def halved(pixels: np.ndarray, method: str) -> np.ndarray:
    """Every second pixel ('simple') or means of 2 x 2 ('area'); odd edges stand alone."""
    if method == "simple":
        return pixels[::2, ::2]
    if method != "area":
        raise ValueError("method is simple or area")
    h, w = pixels.shape
    padded = np.pad(pixels.astype(np.float64), ((0, h % 2), (0, w % 2)), mode="edge")
    mean = padded.reshape((h + 1) // 2, 2, (w + 1) // 2, 2).mean((1, 3))
    return (mean if pixels.dtype.kind == "f" else np.floor(mean + 0.5)).astype(pixels.dtype)


#: What a pixel of the next level takes of four, from the one before its pair on.
TAPS = (1 / 8, 3 / 8, 3 / 8, 1 / 8)


def taps(values: np.ndarray, begin: int, whole: int) -> tuple[np.ndarray, int]:
    """Along the first axis: the next level of ``whole`` values, as far as those from ``begin`` on tell
    it, and where it begins. Beyond the image its last values go on."""
    end = begin + len(values)
    lo = 0 if begin == 0 else (begin + 2) // 2
    hi = (whole + 1) // 2 if end == whole else (end - 1) // 2
    at = 2 * np.arange(lo, hi)
    return sum(t * values[np.clip(at + d, 0, whole - 1) - begin] for t, d in zip(TAPS, (-1, 0, 1, 2), strict=True)), lo


def smoothed(pixels: np.ndarray, top: int, left: int, height: int, width: int) -> tuple[np.ndarray, int, int]:
    """The next level of part of an image by a binomial filter of 4 x 4 pixels, as far as the part
    tells it, and where that begins."""
    rows, top = taps(pixels.astype(np.float64), top, height)
    both, left = taps(rows.T, left, width)
    return (both.T if pixels.dtype.kind == "f" else np.floor(both.T + 0.5)).astype(pixels.dtype), top, left


def reduced(tiles: DataFrame, size: int = 512, method: str = "simple") -> DataFrame:
    """The next level of every image, by one shuffle of 2 x 2 tiles."""
    return squares(as_blocks(tiles, size), size, 1, method, 1, 1, least=1)


def level_count(height: int, width: int, least: int = LEAST) -> int:
    """Levels until the longer side is at most ``least``."""
    n = 1
    while max(height, width) > least:
        height, width, n = (height + 1) // 2, (width + 1) // 2, n + 1
    return n


def pyramid(blocks: DataFrame, size: int, method: str, levels: int, write, span: int = 2) -> DataFrame:
    """Tiles of all levels of all images, ``levels`` being the most that one has. ``write``
    writes a DataFrame and reads it back; each step starts from what the last one wrote."""
    tiles = write(squares(blocks, size, span, method, 0, min(span, levels - 1)))
    out, done = tiles, min(span, levels - 1)
    while done < levels - 1:
        step = min(span, levels - 1 - done)
        above = tiles.where((F.col("level") == done) & (levels_of(F.col("height"), F.col("width")) > 1))
        tiles = write(squares(as_blocks(above, size), size, span, method, 1, step))
        out, done = out.unionByName(tiles), done + step
    return out


def blocks_of_arrays(df: DataFrame, path, y0, height, array: str, h: int, w: int, dtype: str) -> DataFrame:
    """Blocks of h x w pixels, at the left border, from numbers in an array column."""
    at = {"path": path.cast("string"), "y0": y0.cast("long"), "height": height.cast("long"), "v": F.col(array)}
    fixed = {"series": F.lit(0), "level": F.lit(0), "c": F.lit(0), "x0": F.lit(0).cast("long"), "h": F.lit(h).cast("long"), "w": F.lit(w).cast("long"),
             "width": F.lit(w).cast("long"), "dtype": F.lit(dtype)}

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["data"] = [np.asarray(v, dtype).tobytes() for v in frame["v"]]
            yield frame[order]

    order = [{"ty": "y0", "tx": "x0"}.get(n, n) for n in NAMES]
    chosen = df.select(*(c.alias(n) for n, c in {**at, **fixed}.items()))
    return chosen.mapInPandas(pack, TILES.replace("ty long, tx long", "y0 long, x0 long"))


def pixels_of(blocks: DataFrame) -> DataFrame:
    """(path, series, level, c, y, x, v) of every pixel of blocks, v as a double."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                *_, y0, x0, width, dtype, data = (c.to_pylist() for c in part.columns)
                v = [np.frombuffer(d, k).astype(np.float64) for d, k in zip(data, dtype, strict=True)]
                each = np.repeat(np.arange(len(v)), [len(x) for x in v])
                i = np.concatenate([np.arange(len(x)) for x in v])
                y, x = np.divmod(i, np.array(width)[each])
                own = part.select(["path", "series", "level", "c"]).take(pa.array(each))
                places = [pa.array(np.array(y0)[each] + y), pa.array(np.array(x0)[each] + x), pa.array(np.concatenate(v))]
                yield pa.RecordBatch.from_arrays([*own.columns, *places], ["path", "series", "level", "c", "y", "x", "v"])

    chosen = blocks.select("path", "series", "level", "c", *(F.col(n).cast("long") for n in ("y0", "x0", "w")), "dtype", "data")
    return chosen.mapInArrow(unpack, "path string, series int, level int, c int, y long, x long, v double")


def levels_of(height, width, least: int = LEAST):
    """``level_count`` as a column."""
    longer = F.greatest(height, width).cast("long")
    halves = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.ceil(longer / F.pow(F.lit(2.0), k)))
    return (F.size(F.filter(halves, lambda x: x > least)) + 1).cast("int")


def level_sizes(height, width):
    """'width height' of every reduced level."""
    at = lambda n, k: F.ceil(n / F.pow(F.lit(2.0), k)).cast("string")
    steps = F.when(levels_of(height, width) > 1, F.sequence(F.lit(1), levels_of(height, width) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.concat_ws(" ", at(width, k), at(height, k)))
