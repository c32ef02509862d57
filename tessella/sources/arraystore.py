"""Stores of chunked arrays: a folder an array, with JSON that describes it and a file a chunk.

The layout is the public one of Zarr's version 2: ``.zgroup`` beside the arrays, ``.zarray`` with
shape, chunks, type, fill value and compressor in each, and chunks called by their places
(0/3/0/2/1 or 0.3.0.2.1). A pyramid has an array a level, called 0, 1 and so on, of five
dimensions (t, c, z, y, x). Chunks at the borders are full ones; a chunk without a file is all
fill value.

Which chunks there are follows from the shapes, so that no folder is listed: Spark makes a
row a chunk, filters them, and only then tasks open files.
"""

from __future__ import annotations

import gzip
import json
import os
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pyramid import NAMES, TILES
from .files import filesystem, spread

#: Of a chunk, before it is read.
PLACES = ("level", "c", "ty", "tx")


def read_json(path: str) -> dict | None:
    files, at = filesystem(path)
    if not files.get_file_info(at).is_file:
        return None
    with files.open_input_stream(at, compression=None) as file:
        return json.loads(file.read())


def write_json(path: str, value: dict) -> None:
    files, at = filesystem(path)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    with files.open_output_stream(at, compression=None) as file:
        file.write(json.dumps(value, indent=1).encode())


def is_store(path: str) -> bool:
    return any(read_json(f"{path}/{n}") is not None for n in (".zgroup", ".zarray"))


def described(path: str) -> dict:
    """The description of an array, or an error for what is not read."""
    found = read_json(f"{path}/.zarray")
    if found is None:
        raise FileNotFoundError(f"{path}/.zarray")
    coder = (found.get("compressor") or {}).get("id")
    if found["zarr_format"] != 2 or found.get("filters") or found.get("order", "C") != "C" or coder not in (None, "zlib", "gzip"):
        raise NotImplementedError(f"arrays of version {found['zarr_format']}, order {found.get('order')}, filters {found.get('filters')}, compressor {coder}")
    if len(found["shape"]) < 2:
        raise ValueError(f"{path} has less than two dimensions")
    return found


def levels_of_store(path: str) -> list[str]:
    """The arrays of a store: itself, or those called 0, 1 and so on."""
    if read_json(f"{path}/.zarray") is not None:
        return [path]
    out = []
    while read_json(f"{path}/{len(out)}/.zarray") is not None:
        out.append(f"{path}/{len(out)}")
    if not out:
        raise FileNotFoundError(f"{path}/0/.zarray")
    return out


def chunk_bytes(data: bytes, coder: str | None) -> bytes:
    return zlib.decompress(data) if coder == "zlib" else gzip.decompress(data) if coder == "gzip" else data


def read_store(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """The chunks of a store as tiles, cut at the image's borders; ``c`` counts all dimensions before
    y and x. ``where`` is a condition on level, c, ty and tx: other chunks are not opened."""
    arrays = [described(p) for p in levels_of_store(path)]
    parts = []
    for level, a in enumerate(arrays):
        (*outer, h, w), (*steps, ch, cw) = a["shape"], a["chunks"]
        if any(n != 1 for n in steps):
            raise NotImplementedError("chunks of several planes")
        down, across = -(-h // ch), -(-w // cw)
        n = int(np.prod(outer, dtype=np.int64)) * down * across
        at = F.col("id")
        parts.append(spark.range(n).select(
            F.lit(level).alias("level"), F.floor(at / (down * across)).cast("int").alias("c"), (F.floor(at / across) % down).cast("long").alias("ty"), (at % across).alias("tx")))
    chosen = reduce(DataFrame.unionAll, parts)
    chosen = chosen.where(where) if where else chosen
    names = levels_of_store(path)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, 0, r.level, r.c, r.ty, r.tx, *chunk(names[r.level], arrays[r.level], r.c, r.ty, r.tx)) for r in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=NAMES)

    return spread(chosen, 32, *PLACES).mapInPandas(read, TILES)


def key_of(a: dict, c: int, ty: int, tx: int) -> str:
    outer = a["shape"][:-2]
    places = [int(x) for x in np.unravel_index(c, outer)] if outer else []
    return a.get("dimension_separator", ".").join(map(str, (*places, ty, tx)))


def chunk(path: str, a: dict, c: int, ty: int, tx: int) -> tuple:
    """h, w, height, width, dtype and pixels of a chunk."""
    (*_, height, width), (*_, ch, cw) = a["shape"], a["chunks"]
    kind = np.dtype(a["dtype"])
    files, at = filesystem(f"{path}/{key_of(a, c, ty, tx)}")
    if files.get_file_info(at).is_file:
        with files.open_input_stream(at, compression=None) as file:
            raw = chunk_bytes(file.read(), (a.get("compressor") or {}).get("id"))
        if len(raw) != ch * cw * kind.itemsize:
            raise ValueError(f"{at} has {len(raw)} bytes of {ch * cw * kind.itemsize}")
        pixels = np.frombuffer(raw, kind).reshape(ch, cw)
    else:
        fill = a.get("fill_value")
        pixels = np.full((ch, cw), 0 if fill is None else float(fill) if kind.kind == "f" else fill, kind)  # "NaN" and "Infinity" are texts
    pixels = pixels[: height - ty * ch, : width - tx * cw].astype(kind.newbyteorder("="))
    return (*pixels.shape, height, width, pixels.dtype.name, pixels.tobytes())


def write_store(tiles: DataFrame, folder: str, size: int, compressor: str | None = "zlib", separator: str = "/", fill: int = 0) -> None:
    """Writes the tiles of every image, all of one size, as a store in a folder of its own, called by the
    image's path. Tiles that hold nothing but ``fill`` get no file; a repeated task writes the
    same files again."""
    if compressor not in (None, "zlib", "gzip"):
        raise ValueError("compressor is zlib, gzip or none")
    shapes = tiles.groupBy("path", "level").agg(*(F.max(n).alias(n) for n in ("height", "width", "dtype", "c")))

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                kind = np.dtype(r.dtype)
                write_json(f"{folder}/{r.path}/{r.level}/.zarray", {
                    "zarr_format": 2, "shape": [1, int(r.c) + 1, 1, int(r.height), int(r.width)], "chunks": [1, 1, 1, size, size], "dtype": kind.newbyteorder("<").str,
                    "compressor": compressor and {"id": compressor, "level": 5}, "fill_value": fill, "order": "C", "filters": None, "dimension_separator": separator,
                })
                if r.level == 0:
                    write_json(f"{folder}/{r.path}/.zgroup", {"zarr_format": 2})
            yield frame[["path"]]

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                kind = np.dtype(r.dtype).newbyteorder("<")
                pixels = np.full((size, size), fill, kind)
                pixels[: r.h, : r.w] = np.frombuffer(r.data, r.dtype).reshape(r.h, r.w)
                if (pixels == fill).all():
                    continue
                raw = pixels.tobytes()
                raw = zlib.compress(raw, 5) if compressor == "zlib" else gzip.compress(raw, 5, mtime=0) if compressor == "gzip" else raw
                files, at = filesystem(f"{folder}/{r.path}/{r.level}/" + separator.join(map(str, (0, r.c, 0, r.ty, r.tx))))
                files.create_dir(at.rpartition("/")[0], recursive=True)
                with files.open_output_stream(at, compression=None) as out:
                    out.write(raw)
            yield frame[["path"]]

    for df in (shapes.mapInPandas(describe, "path string"), tiles.mapInPandas(put, "path string")):
        df.write.format("noop").mode("overwrite").save()


def open_store(spark: SparkSession, source) -> DataFrame:
    """The tiles of a store: an array store or a ``TileStore`` by path, or a DataFrame of tiles."""
    if isinstance(source, DataFrame):
        if missing := set(NAMES) - set(source.columns):
            raise ValueError(f"tiles lack {', '.join(sorted(missing))}")
        return source.select(*NAMES)
    if not isinstance(source, (str, os.PathLike)):
        raise ValueError("a store is a path or a DataFrame of tiles")
    path = os.fspath(source).rstrip("/")
    if is_store(path):
        return read_store(spark, path)
    files, at = filesystem(path)
    if files.get_file_info(f"{at}/tiles").type.value:
        return spark.read.parquet(f"{path}/tiles").select(*NAMES)
    raise ValueError(f"{path} is no store")
