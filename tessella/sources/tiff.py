"""TIFF structure and pixels as DataFrames.

``read_pages`` gives one row an image directory, without pixels; ``read_blocks``
reads the strips or tiles of chosen pages by byte range, so that a job on metadata
never touches pixels and one on a series reads only that. Both take a DataFrame of
paths and scale with files and blocks. Files open through pyarrow's file systems.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.codecs import container, decode_block
from .files import filesystem, spread

# Fixed values of the TIFF format: sizes of field types, their struct letters, and tags.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
TAGS = {
    254: "NewSubfileType", 256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression",
    262: "PhotometricInterpretation", 270: "ImageDescription", 273: "StripOffsets", 277: "SamplesPerPixel",
    278: "RowsPerStrip", 279: "StripByteCounts", 282: "XResolution", 283: "YResolution", 284: "PlanarConfiguration",
    296: "ResolutionUnit", 305: "Software", 306: "DateTime", 315: "Artist", 316: "HostComputer", 317: "Predictor",
    322: "TileWidth", 323: "TileLength", 324: "TileOffsets", 325: "TileByteCounts", 330: "SubIFDs", 339: "SampleFormat",
}
KINDS = {1: "uint", 2: "int", 3: "float"}
PAGES = (
    "path string, series int, level int, page int, ifd_offset long, dtype string, shaped array<long>, width long,"
    " height long, samples int, tags map<string,string>, block_w long, block_h long, tiled boolean,"
    " offsets array<long>, byte_counts array<long>, compression int, predictor int, planar_config int, big_endian boolean,"
    " photometric int, jpeg_tables binary, bits int"
)
BLOCKS = (
    "path string, series int, level int, c int, y0 long, x0 long, h long, w long, height long, width long,"
    " dtype string, data binary"
)


def open_file(path: str):
    files, at = filesystem(path)
    return files.open_input_file(at)


class Directories:
    """Walks the directories of one open TIFF, classic or BigTIFF, of either byte order."""

    def __init__(self, file):
        self.file = file
        head = self.at(0, 16)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF file")
        self.order = "<" if head[:2] == b"II" else ">"
        version = self.unpack("H", head[2:4])
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        self.big = version == 43
        self.first = self.unpack("Q", head[8:16]) if self.big else self.unpack("I", head[4:8])

    def at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def unpack(self, letters: str, data: bytes):
        return struct.unpack(self.order + letters, data)[0]

    def read(self, offset: int) -> tuple[dict[int, object], int]:
        """Tag values of the directory at offset, and where the next one is."""
        count, entry, inline, letter = (8, 20, 8, "Q") if self.big else (2, 12, 4, "I")
        n = self.unpack("Q" if self.big else "H", self.at(offset, count))
        raw = self.at(offset + count, n * entry + inline)
        tags = {}
        for i in range(n):
            e = raw[i * entry : (i + 1) * entry]
            tag, kind = struct.unpack(self.order + "HH", e[:4])
            number = self.unpack(letter, e[4 : 4 + inline])
            size = SIZES.get(kind, 1) * number
            data = e[-inline:][:size] if size <= inline else self.at(self.unpack(letter, e[-inline:]), size)
            tags[tag] = self.value(kind, number, data)
        return tags, self.unpack(letter, raw[n * entry :])

    def value(self, kind: int, number: int, data: bytes):
        if kind == 2:
            return data.split(b"\0")[0].decode("utf-8", "replace")
        if kind in (5, 10):
            parts = struct.unpack(self.order + ("I" if kind == 5 else "i") * 2 * number, data)
            return [f"{a}/{b}" for a, b in zip(parts[::2], parts[1::2], strict=True)]
        if kind in LETTERS:
            return list(struct.unpack(self.order + LETTERS[kind] * number, data))
        return data

    def chain(self, offset: int) -> Iterator[tuple[int, dict]]:
        seen = set()
        while offset and offset not in seen:
            seen.add(offset)
            tags, following = self.read(offset)
            yield offset, tags
            offset = following


def page_row(offset: int, tags: dict, big_endian: bool) -> dict:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    w, h = one(256), one(257)
    bits, kind, samples = one(258, 1), KINDS.get(one(339, 1), "uint"), one(277, 1)
    try:
        dtype = container(kind, bits)
    except NotImplementedError:  # what only reading the pixels refuses
        dtype = f"{kind}{bits}"
    tiled = 322 in tags
    text = lambda v: v if isinstance(v, str) else None if isinstance(v, bytes) else ",".join(map(str, v))
    return {
        "ifd_offset": offset, "dtype": dtype, "width": w, "height": h, "samples": samples,
        "shaped": [1, 1, h, w] + ([samples] if samples > 1 else []),
        "tags": {TAGS.get(k, str(k)): t for k, v in tags.items() if k not in (273, 279, 324, 325) and (t := text(v)) is not None},
        "block_w": one(322, w), "block_h": one(323, min(one(278, h), h)), "tiled": tiled,
        "offsets": tags.get(324 if tiled else 273, []), "byte_counts": tags.get(325 if tiled else 279, []),
        "compression": one(259, 1), "predictor": one(317, 1), "planar_config": one(284, 1), "big_endian": big_endian,
        "photometric": one(262, 1), "jpeg_tables": tags.get(347), "bits": bits,
    }


def grouped(rows: list[dict], subs: list[list[dict]]) -> list[dict]:
    """Series, level and page of each directory.

    Directories of equal size and type form a group, in file order. A group with as
    many pages as the first, of the same type and proportions and smaller by halves,
    is a reduced level of it; any other group is a series of its own. SubIFDs are
    the levels of the page that holds them.
    """
    groups: dict[tuple, list[int]] = {}
    for i, r in enumerate(rows):
        groups.setdefault((r["width"], r["height"], r["dtype"], r["samples"]), []).append(i)
    out, series, level = [], 0, 0
    keys = list(groups)
    for key in keys:
        main = keys[0]
        ratio = main[0] / key[0]
        near = abs(main[1] / key[1] - ratio) <= 0.1 * ratio
        halvings = math.log2(ratio)
        near = near and round(halvings) >= 1 and abs(halvings - round(halvings)) < 0.1
        if key != main and key[2:] == main[2:] and len(groups[key]) == len(groups[main]) and near:
            level += 1
            place = (0, level)
        else:
            place = (series, 0)
            series += 1
        for page, i in enumerate(groups[key]):
            out.append(rows[i] | {"series": place[0], "level": place[1], "page": page})
            out += [s | {"series": place[0], "level": k, "page": page} for k, s in enumerate(subs[i], 1)]
    return out


def pages_of(path: str) -> list[dict]:
    with open_file(path) as file:
        d = Directories(file)
        rows, subs = [], []
        for offset, tags in d.chain(d.first):
            rows.append(page_row(offset, tags, d.order == ">"))
            subs.append([page_row(o, d.read(o)[0], d.order == ">") for o in tags.get(330, [])])
    return [{"path": path} | r for r in grouped(rows, subs)] if rows else []



def read_pages(images: DataFrame, path_col: str = "path") -> DataFrame:
    """The pages of every file, a task for each of them where there are enough tasks; a
    file that is no TIFF fails the job."""
    names = images.sparkSession.createDataFrame([], PAGES).columns

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                yield pd.DataFrame(pages_of(path), columns=names)

    return spread(images.select(F.col(path_col).alias("path")).distinct(), 1, "path").mapInPandas(scan, PAGES)


def read_blocks(pages: DataFrame) -> DataFrame:
    """Decoded strips and tiles of the pages, one row a block and channel. Bytes are
    little-endian rows of pixels, cut to the image. A planar page's samples and an
    interleaved page's samples both become channels."""
    at = F.posexplode(F.arrays_zip("offsets", "byte_counts")).alias("block", "range")
    per = ["path", "series", "level", "page", "dtype", "width", "height", "samples", "block_w", "block_h", "tiled",
           "compression", "predictor", "planar_config", "big_endian", "photometric", "jpeg_tables", "bits"]
    ranges = pages.select(*per, at).select(*per, "block", "range.offsets", "range.byte_counts")
    names = pages.sparkSession.createDataFrame([], BLOCKS).columns

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, part in frame.groupby("path", sort=False):
                with open_file(path) as file:
                    for r in part.itertuples(index=False):
                        yield pd.DataFrame(decoded(file, r), columns=names)

    # One block a row, spread over tasks whatever the number of files.
    return spread(ranges, 32, "path", "page", "block").mapInPandas(decode, BLOCKS)


def decoded(file, r) -> list[tuple]:
    across, down = -(-r.width // r.block_w), -(-r.height // r.block_h)
    plane, block = divmod(r.block, across * down) if r.planar_config == 2 else (0, r.block)
    y0, x0 = block // across * r.block_h, block % across * r.block_w
    h, w = min(r.block_h, r.height - y0), min(r.block_w, r.width - x0)
    samples = 1 if r.planar_config == 2 else r.samples
    file.seek(r.offsets)
    data = file.read(r.byte_counts)
    if len(data) < r.byte_counts:
        raise ValueError(f"{r.path} ends within block {r.block} of page {r.page}")
    pixels = decode_block(
        data, r.compression, r.predictor, r.dtype, r.block_h if r.tiled else h, r.block_w, samples, r.big_endian, r.photometric, r.jpeg_tables, r.bits
    )[:h, :w]
    first = r.page * r.samples + plane
    return [
        (r.path, r.series, r.level, first + k, y0, x0, h, w, r.height, r.width, r.dtype, pixels[:, :, k].tobytes())
        for k in range(samples)
    ]


CHOSEN = ("series", "level", "page")


class TiffPages(DataSource):
    """spark.read.format("tiff_pages").load(path): the pages of one file or, with commas,
    several. Filters are left to Spark."""

    @classmethod
    def name(cls) -> str:
        return "tiff_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema):
        return TiffPagesReader(self.options["path"].split(","), {})


class TiffPagesReader(DataSourceReader):
    def __init__(self, paths: list[str], wanted: dict[str, set[int]]):
        self.paths, self.wanted = paths, wanted

    def rows(self, path: str) -> list[dict]:
        return [r for r in pages_of(path) if all(r[k] in v for k, v in self.wanted.items())]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        for row in self.rows(partition.value):
            yield tuple(row[n] for n in names_of(PAGES))


class TiffBlocks(TiffPages):
    """spark.read.format("tiff_blocks").load(path): decoded strips and tiles, an Arrow batch a block.

    Options ``series``, ``level`` and ``page``, numbers with commas, say which are read, so that
    no other bytes are. Filters of a load are left to Spark, as it keeps those that are pushed
    into a source for the load's next result. ``blocks`` says how many a task reads."""

    @classmethod
    def name(cls) -> str:
        return "tiff_blocks"

    def schema(self) -> str:
        return BLOCKS.replace("c int", "c int, page int")

    def reader(self, schema):
        wanted = {k: {int(x) for x in self.options[k].split(",")} for k in CHOSEN if self.options.get(k)}
        return TiffBlocksReader(self.options["path"].split(","), wanted, int(self.options.get("blocks", 64)), schema)


class TiffBlocksReader(TiffPagesReader):
    def __init__(self, paths: list[str], wanted: dict[str, set[int]], step: int, schema: StructType):
        super().__init__(paths, wanted)
        self.step, self.schema = step, to_arrow_schema(schema)

    def partitions(self):
        """Directories are read on the driver, a few kilobytes a file; offsets stay out of the partitions."""
        return [
            InputPartition((p, r["ifd_offset"], r["series"], r["level"], r["page"], lo))
            for p in self.paths for r in self.rows(p) for lo in range(0, len(r["offsets"]), self.step)
        ]

    def read(self, partition):
        if partition is None:  # what Spark asks for where there are no partitions
            return
        path, ifd, series, level, page, lo = partition.value
        with open_file(path) as file:
            d = Directories(file)
            row = page_row(ifd, d.read(ifd)[0], d.order == ">") | {"path": path, "series": series, "level": level, "page": page}
            ranges = list(zip(row.pop("offsets"), row.pop("byte_counts"), strict=True))
            for block, (offset, count) in enumerate(ranges[lo : lo + self.step], lo):
                found = decoded(file, SimpleNamespace(**row, block=block, offsets=offset, byte_counts=count))
                columns = zip(*((*x[:4], page, *x[4:]) for x in found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def names_of(schema: str) -> list[str]:
    return [x.strip().split(" ", 1)[0] for x in schema.replace("map<string,string>", "map").split(",")]
