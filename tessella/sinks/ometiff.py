"""Pyramidal OME-TIFF files.

Tasks compress tiles into segment files of the shared folder and say where each tile
lies. A file's layout follows from the lengths alone: header, directories, then the tiles
of one segment after another. Sums over the lengths give every tile its place, and the
sizes of directories theirs, so that header, directories and pieces of segments are byte
ranges that any number of tasks write, of one file or of many. They are put together
under a temporary name and moved, so that a failed job leaves nothing half done.

Reduced levels hang as SubIFDs on the full-size page of their channel; the OME-XML is the
description of the first page. Numbers are big-endian, as the document says. A file that
may pass 4 GiB becomes a BigTIFF.

``tiles.write.format("ome_tiff")`` is the same for one write of Spark: its tasks compress
tiles, and its commit, a single process, lays the files out and copies the segments.
"""

from __future__ import annotations

import struct
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.codecs import JPEG, NAMES, PLAIN, RGB, YCC, encode_blocks
from ..operators.pyramid import TILES
from ..sources.files import Ranges, filesystem, remove_folder, shared_folder

INDEX = (
    "path string, series int, segment string, offset long, length long, level int, c int, ty long, tx long, height long,"
    " width long, dtype string, samples int"
)
COLUMNS = [x.split()[0] for x in INDEX.split(", ")]
KEY = ["path", "series"]
CLASSIC_LIMIT = (1 << 32) - (1 << 24)
#: Bytes of tiles that a task compresses at once.
CHUNK_BYTES = 8 << 20
#: Bytes of a range that a task writes at once, at most but for a directory.
PART_BYTES = 64 << 20
MOST_TASKS = 20_000


@dataclass(frozen=True)
class Form:
    """How tiles are stored: the compression's name, the side of a tile, JPEG's quality, the
    predictor, the bits of a sample where they are not those of its type, and whether the
    file is a BigTIFF whatever its size."""

    compression: str
    size: int
    quality: int = 90
    predictor: int = PLAIN
    bits: int | None = None
    big: bool = False

    def __post_init__(self):
        if self.compression not in NAMES:
            raise ValueError(f"compression is one of {', '.join(NAMES)}")
        if self.code == JPEG and (self.predictor != PLAIN or self.bits):
            raise ValueError("JPEG tiles have no predictor, and 8 bits")

    @property
    def code(self) -> int:
        return NAMES[self.compression]


def interleaved(tiles: DataFrame) -> DataFrame:
    """Tiles of three channels as one of three samples, channel c of every three first."""
    def merge(key, part):
        part = part.sort_values("c")
        one = part.iloc[0]
        if len(part) != 3:
            raise ValueError("interleaved output needs channels in threes")
        pixels = np.stack([np.frombuffer(d, one["dtype"]).reshape(one.h, one.w) for d in part["data"]], -1)
        one = one.copy()
        one["c"], one["data"], one["samples"] = one.c // 3, pixels.tobytes(), 3
        return pd.DataFrame([one])

    by = ["path", "series", "level", F.expr("c div 3").alias("three"), "ty", "tx"]
    return tiles.withColumn("samples", F.lit(1)).groupBy(*by).applyInPandas(merge, TILES + ", samples int")


class Segment:
    """A new file of compressed tiles in a folder; made when the first tile comes."""

    def __init__(self, folder: str, form: Form):
        self.files, self.root = filesystem(folder)
        self.name, self.form, self.at, self.out = uuid.uuid4().hex, form, 0, None  # a repeated task writes another file
        self.path = f"{folder}/{self.name}"

    def add(self, tiles: pd.DataFrame) -> pd.DataFrame:
        """Writes tiles; returns their index."""
        form, rows = self.form, []
        widest = max((np.dtype(k).itemsize for k in tiles["dtype"].unique()), default=1) * int(tiles["samples"].max() if len(tiles) else 1)
        step = max(1, CHUNK_BYTES // (form.size * form.size * widest))
        for lo in range(0, len(tiles), step):
            part = list(tiles.iloc[lo : lo + step].itertuples(index=False))
            blocks = []
            for r in part:
                tile = np.frombuffer(r.data, r.dtype).reshape(r.h, r.w, r.samples)
                # Lossy tiles go on as they end, so that nothing rings at the border.
                beyond = {"mode": "edge"} if form.code == JPEG else {"mode": "constant"}
                blocks.append(np.pad(tile, ((0, form.size - r.h), (0, form.size - r.w), (0, 0)), **beyond))
            if self.out is None:
                self.files.create_dir(self.root, recursive=True)
                self.out = self.files.open_output_stream(f"{self.root}/{self.name}", compression=None)
            for r, data in zip(part, encode_blocks(blocks, form.code, form.quality, form.predictor, form.bits), strict=True):
                self.out.write(data)
                rows.append((r.path, r.series, self.path, self.at, len(data), r.level, r.c, r.ty, r.tx, r.height, r.width, r.dtype, r.samples))
                self.at += len(data)
        return pd.DataFrame(rows, columns=COLUMNS)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def write_segments(
    tiles: DataFrame, folder: str, compression: str, size: int, rgb: bool = False, quality: int = 90, predictor: int = PLAIN, bits: int | None = None,
) -> DataFrame:
    """Compresses tiles to segment files in ``folder``; returns the index."""
    form = Form(compression, size, quality, predictor, bits)

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in map(str.split, INDEX.split(","))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment(folder, form)
        try:
            for part in few_bytes(batches):
                yield pa.RecordBatch.from_pandas(segment.add(part.to_pandas()), schema, preserve_index=False)
        finally:
            segment.close()

    made = interleaved(tiles) if rgb else tiles.withColumn("samples", F.lit(1))
    return made.mapInArrow(write, INDEX)


def few_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about CHUNK_BYTES, so that no more of them become Python's at once."""
    for batch in batches:
        rows = max(1, CHUNK_BYTES * len(batch) // max(1, batch.nbytes))
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


class Layout:
    """Sizes and bytes of directories of a classic TIFF or a BigTIFF, big-endian."""

    def __init__(self, big: bool):
        self.big = big
        self.word, self.inline = ("Q", 8) if big else ("I", 4)

    def header(self, first: int) -> bytes:
        head = struct.pack(">2sHHHQ", b"MM", 43, 8, 0, first) if self.big else struct.pack(">2sHI", b"MM", 42, first)
        return head.ljust(FIRST, b"\0")

    def values(self, letter: str, value) -> tuple[int, int, bytes]:
        if letter == "s":
            return 2, len(value) + 1, value + b"\0"
        letter = self.word if letter == "o" else letter
        return {"H": 3, "I": 4, "Q": 16}[letter], len(value), np.asarray(value, "u8").astype({"H": ">u2", "I": ">u4", "Q": ">u8"}[letter]).tobytes()

    def directory(self, tags: list[tuple[int, str, object]], at: int, following: int) -> bytes:
        """A directory that lies at ``at``, with its long values behind it, in multiples of 8 bytes."""
        entries, behind = [], b""
        start = at + (8 if self.big else 2) + len(tags) * (20 if self.big else 12) + self.inline
        pad = -start % 8
        for tag, letter, value in sorted(tags, key=lambda x: x[0]):
            kind, number, data = self.values(letter, value)
            if len(data) > self.inline:
                place = start + pad + len(behind)
                behind += data + b"\0" * (-len(data) % 8)
                data = struct.pack(">" + self.word, place)
            entries.append(struct.pack(">HH" + self.word, tag, kind, number) + data.ljust(self.inline, b"\0"))
        head = struct.pack(">Q" if self.big else ">H", len(entries))
        out = head + b"".join(entries) + struct.pack(">" + self.word, following) + b"\0" * pad + behind
        return out + b"\0" * (-(at + len(out)) % 8)


#: Where the first directory lies, behind the header.
FIRST = 16


def page_tags(page, form: Form, offsets, lengths, reduced: bool, xml: bytes | None, subs) -> list:
    """Tags of a page whose tiles, in order, have these places and lengths."""
    kind, samples = np.dtype(page.dtype), int(page.samples)
    photometric = 1 if samples == 1 else YCC if form.code == JPEG else RGB
    tags = [
        (254, "I", [1 if reduced else 0]), (256, "I", [page.width]), (257, "I", [page.height]),
        (258, "H", [form.bits or kind.itemsize * 8] * samples), (259, "H", [form.code]), (262, "H", [photometric]), (277, "H", [samples]),
        (284, "H", [1]), (322, "I", [form.size]), (323, "I", [form.size]), (324, "o", offsets),
        (325, "o", lengths), (339, "H", [{"u": 1, "i": 2, "f": 3}[kind.kind]] * samples),
    ]
    if form.predictor != PLAIN:
        tags.append((317, "H", [form.predictor]))
    if photometric == YCC:
        tags.append((530, "H", [1, 1]))
    if xml is not None:
        tags.append((270, "s", xml))
    if len(subs):
        tags.append((330, "o", subs))
    return tags


#: Of every page: where its directory lies, the next page's, its reduced levels', where the
#: image's tiles begin, and the bytes of the whole file.
PLAN = "at long, following long, subs array<long>, data long, big boolean, size long, reduced boolean, first boolean"


def planned(pages: pd.DataFrame, form: Form, xml_bytes: int) -> pd.DataFrame:
    """The PLAN of an image's pages (c, level, n_tiles, n_bytes, height, width, dtype, samples)."""
    pages = pages.sort_values(["c", "level"], kind="stable").reset_index(drop=True)
    layout = Layout(form.big or int(pages["n_bytes"].sum()) + 96 * int(pages["n_tiles"].sum()) + xml_bytes > CLASSIC_LIMIT)
    lowest = pages.groupby("c")["level"].transform("min")
    reduced = (pages["level"] != lowest).tolist()
    n_subs = pages.groupby("c")["level"].transform("size") - 1
    at, ends = [], FIRST
    for i, p in enumerate(pages.itertuples(index=False)):  # sizes do not depend on places
        none = np.zeros(p.n_tiles, np.int64)
        tags = page_tags(p, form, none, none, reduced[i], b"x" * xml_bytes if i == 0 else None, [] if reduced[i] else [0] * int(n_subs[i]))
        at.append(ends)
        ends += len(layout.directory(tags, ends, 0))
    mains = [a for a, r in zip(at, reduced, strict=True) if not r]
    after = dict(zip(mains, [*mains[1:], 0], strict=True))
    subs = [[a for a, q, r in zip(at, pages["c"], reduced, strict=True) if r and q == c] for c in pages["c"]]
    return pages.assign(
        at=at, following=[after.get(a, 0) for a in at], subs=[[] if r else s for r, s in zip(reduced, subs, strict=True)], data=ends, big=layout.big,
        size=ends + int(pages["n_bytes"].sum()), reduced=reduced, first=[i == 0 for i in range(len(pages))],
    )


def directory_of(page, form: Form, offsets: np.ndarray, lengths: np.ndarray, xml: str | None) -> bytes:
    """The bytes of a planned page's directory; the first one's with the header before them."""
    layout = Layout(bool(page.big))
    tags = page_tags(page, form, offsets + page.data, lengths, bool(page.reduced), xml.encode() if page.first else None, page.subs)
    out = layout.directory(tags, int(page.at), int(page.following))
    return layout.header(FIRST) + out if page.first else out


def placed(index: DataFrame) -> DataFrame:
    """index with ``place``, the bytes of its image's tiles before it: those of a segment stay together."""
    before = (Window.unboundedPreceding, -1)
    own = Window.partitionBy(*KEY, "segment").orderBy("offset").rowsBetween(*before)
    rows = index.withColumn("inner", F.coalesce(F.sum("length").over(own), F.lit(0)))
    sums = index.groupBy(*KEY, "segment").agg(F.sum("length").alias("n"))
    base = sums.select(*KEY, "segment", F.coalesce(F.sum("n").over(Window.partitionBy(*KEY).orderBy("segment").rowsBetween(*before)), F.lit(0)).alias("base"))
    return rows.join(base, [*KEY, "segment"]).withColumn("place", F.col("base") + F.col("inner")).drop("base")


def write_images(
    index: DataFrame, documents: DataFrame, compression: str, size: int, predictor: int = PLAIN, bits: int | None = None, part_bytes: int = PART_BYTES,
    part_rows: int = 4, big: bool = False,
) -> DataFrame:
    """Writes every image: ``index`` from ``write_segments``, and one (path, series, xml, output)
    row an image. Returns path, series, output and ``finished``, the second at which each was
    there, once all are.

    A task writes ``part_rows`` ranges, a directory or up to ``part_bytes`` of tiles each."""
    spark, form = index.sparkSession, Form(compression, size, predictor=predictor, bits=bits, big=big)
    folder = shared_folder(spark)
    mark = uuid.uuid4().hex

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    try:
        rows = keep(placed(index), "placed")
        page = rows.groupBy(*KEY, "c", "level").agg(
            *(F.first(n).alias(n) for n in ("height", "width", "dtype", "samples")), F.count("*").alias("n_tiles"), F.sum("length").alias("n_bytes"),
            F.sort_array(F.collect_list(F.struct("ty", "tx", "place", "length"))).alias("tiles"),
        )
        page = keep(page.select(*KEY, "c", "level", "height", "width", "dtype", "samples", "n_tiles", "n_bytes", "tiles.place", "tiles.length"), "pages")
        own = documents.select(*KEY, "xml", "output")

        def plan(pages: pd.DataFrame) -> pd.DataFrame:
            return planned(pages, form, int(pages["xml_bytes"].iloc[0]))

        summary = [n for n in page.columns if n not in ("place", "length")]
        schema = ", ".join(f"{n} {t}" for n, t in page.select(*summary).dtypes) + f", output string, xml_bytes int, {PLAN}"
        # One row a page, a few hundred an image; offsets stay behind.
        plans = page.select(*summary).join(own.select(*KEY, "output", F.octet_length("xml").alias("xml_bytes")), KEY)
        plans = keep(plans.groupBy(*KEY).applyInPandas(plan, schema), "plans")

        images = plans.where("first").select(*KEY, "output", "data", "size")
        n_pages, n_images, n_bytes = plans.agg(F.count("*"), F.count_if("first"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
        # Tasks of about part_rows rows; fixed, as adaptive execution would join those of few bytes.
        tasks = lambda n: max(1, min(MOST_TASKS, -(-n // part_rows)))
        ranges = rows.groupBy(*KEY, "segment", (F.col("offset") - F.col("inner")).alias("run")).agg(
            F.min("offset").alias("lo"), F.max(F.col("offset") + F.col("length")).alias("hi"), F.min("place").alias("place"))
        ranges = ranges.where("hi > lo").withColumn("begin", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(part_bytes))))
        ranges = ranges.join(images, KEY).select(
            "output", "size", (F.col("data") + F.col("place") + F.col("begin") - F.col("lo")).alias("at"), "segment", "begin",
            F.least(F.col("begin") + part_bytes, "hi").alias("stop"),
        )
        copied = ranges.repartition(tasks(n_images + n_bytes // part_bytes), "output", "at").mapInPandas(lambda frames: copy_ranges(frames, mark), "output string, n long")
        listed = plans.join(page.select(*KEY, "c", "level", "place", "length"), [*KEY, "c", "level"])
        listed = listed.join(own.select(*KEY, "xml", F.lit(True).alias("first")), [*KEY, "first"], "left")  # its document, for the first page alone
        listed = listed.repartition(tasks(n_pages), "output", "at").mapInPandas(lambda frames: put_directories(frames, form, mark), "output string, n long")
        written = keep(copied.unionAll(listed), "written").groupBy("output").agg(F.sum("n").alias("n"))
        whole = own.drop("xml").join(images.select("output", "size"), "output", "left").join(written, "output", "left")  # no tiles are an error
        moved = whole.repartition(tasks(part_rows * n_images), "output").mapInPandas(lambda frames: joined(frames, mark), "path string, series int, output string, finished double")
        moved.write.parquet(f"{folder}-outputs")  # of a short row an image, which stays
        return spark.read.parquet(f"{folder}-outputs")
    except BaseException:
        for r in documents.select("output").toLocalIterator():
            Ranges(r.output, mark).drop()
        raise
    finally:
        remove_folder(spark, folder)


def copy_ranges(frames: Iterator[pd.DataFrame], mark: str) -> Iterator[pd.DataFrame]:
    """Copies pieces of segments to their places in the outputs."""
    for frame in frames:
        for r in frame.itertuples(index=False):
            with Ranges(r.output, mark).at(int(r.at)) as out:
                copy_stretch(r.segment, int(r.begin), int(r.stop), out)
        yield pd.DataFrame({"output": frame["output"], "n": frame["stop"] - frame["begin"]})


def copy_stretch(segment: str, lo: int, hi: int, out) -> None:
    files, name = filesystem(segment)
    with files.open_input_file(name) as source:
        source.seek(lo)
        while lo < hi and (chunk := source.read(min(8 << 20, hi - lo))):
            out.write(chunk)
            lo += len(chunk)
    if lo < hi:
        raise OSError(f"{segment} ends too early")


def put_directories(frames: Iterator[pd.DataFrame], form: Form, mark: str) -> Iterator[pd.DataFrame]:
    for frame in frames:
        sizes = []
        for page in frame.itertuples(index=False):
            data = directory_of(page, form, np.asarray(page.place, np.int64), np.asarray(page.length, np.int64), page.xml)
            with Ranges(page.output, mark).at(0 if page.first else int(page.at)) as out:
                out.write(data)
            sizes.append(len(data))
        yield pd.DataFrame({"output": frame["output"], "n": sizes})


def joined(frames: Iterator[pd.DataFrame], mark: str) -> Iterator[pd.DataFrame]:
    """Moves files of which every byte was written to their names."""
    for frame in frames:
        for r in frame.itertuples(index=False):
            if r.n != r.size:
                raise OSError(f"{r.output} has {r.n} of {r.size} bytes")
            Ranges(r.output, mark).commit(int(r.size))
        yield frame[[*KEY, "output"]].assign(finished=time.time())


@dataclass
class Written(WriterCommitMessage):
    """What a task of the sink wrote: the index of its segment, as an Arrow stream."""

    index: bytes


class OmeTiff(DataSource):
    """tiles.write.format("ome_tiff").mode("append").save(folder): every image of the tiles as
    <name>.ome.tif in the folder, <name> being its path without folders and end, and its series
    if that is not 0. Option ``document`` is the OME-XML of all of them, or ``documents`` the
    Parquet of (path, series, xml, output) rows; ``compression``, ``tile_size``, ``quality``,
    ``predictor`` and ``bits`` are as in ``write_segments``. Files that exist are an error but in
    the mode "overwrite". Either all images are there in the end, or none is, and no other file.

    The commit is one process: use ``write_images`` for many images or very large ones."""

    @classmethod
    def name(cls) -> str:
        return "ome_tiff"

    def writer(self, schema, overwrite: bool):
        return OmeTiffWriter(dict(self.options), overwrite)


class OmeTiffWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        get = {k.lower(): v for k, v in options.items()}.get
        bits = get("bits")
        self.form = Form(get("compression", "LZW"), int(get("tile_size", 512)), int(get("quality", 90)), int(get("predictor", PLAIN)), int(bits) if bits else None)
        self.folder, self.document, self.documents = get("path").rstrip("/"), get("document", "<OME/>"), get("documents")
        self.overwrite, self.mark = overwrite, uuid.uuid4().hex
        self.staging = f"{self.folder}/_segments-{self.mark}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        segment, found = Segment(self.staging, self.form), []
        try:
            for part in few_bytes(batches):
                frame = part.to_pandas()
                found.append(segment.add(frame if "samples" in frame else frame.assign(samples=1)))
        finally:
            segment.close()
        index = pa.Table.from_pandas(pd.concat(found) if found else pd.DataFrame(columns=COLUMNS), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as out:
            out.write_table(index)
        return Written(sink.getvalue().to_pybytes())

    def named(self, path: str, series: int) -> tuple[str, str]:
        """The document and the output of an image."""
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0] + (f".series{series}" if series else "")
        return self.document, f"{self.folder}/{stem}.ome.tif"

    def commit(self, messages: list[Written | None]) -> None:
        tables = [pa.ipc.open_stream(m.index).read_pandas() for m in messages if m]
        tables = [t for t in tables if len(t)]
        index = pd.concat(tables, ignore_index=True) if tables else pd.DataFrame(columns=COLUMNS)
        given = {}
        if self.documents:
            files, at = filesystem(self.documents)
            given = {(r["path"], r["series"]): (r["xml"], r["output"]) for r in pq.read_table(at, filesystem=files).to_pylist()}
        images = {key: (given[key] if self.documents else self.named(*key), part) for key, part in index.groupby(KEY, sort=True)}
        outputs = [output for (_, output), _ in images.values()]
        if len(set(outputs)) < len(outputs):
            raise ValueError("two images have the same output")
        if not self.overwrite and (there := [o for o in outputs if (lambda f: f[0].get_file_info(f[1]).type.value != 0)(filesystem(o))]):
            raise FileExistsError(there[0])
        sizes = [self.put(part, xml, output) for (xml, output), part in images.values()]
        for output, size in zip(outputs, sizes, strict=True):
            Ranges(output, self.mark).commit(size)
        self.clean()

    def put(self, index: pd.DataFrame, xml: str, output: str) -> int:
        """Writes an image under its temporary name, segments side by side; returns its size."""
        index = index.sort_values(["segment", "offset"], kind="stable")
        index = index.assign(place=index["length"].cumsum() - index["length"])
        by = index.groupby(["c", "level"], sort=True)
        pages = by.agg(height=("height", "first"), width=("width", "first"), dtype=("dtype", "first"), samples=("samples", "first"),
                       n_tiles=("length", "size"), n_bytes=("length", "sum")).reset_index()
        plan = planned(pages, self.form, len(xml.encode()))
        for page in plan.itertuples(index=False):
            own = by.get_group((page.c, page.level)).sort_values(["ty", "tx"])
            with Ranges(output, self.mark).at(0 if page.first else int(page.at)) as out:
                out.write(directory_of(page, self.form, own["place"].to_numpy(), own["length"].to_numpy(), xml))
        run = index["segment"].ne(index["segment"].shift()) | index["offset"].ne((index["offset"] + index["length"]).shift())
        runs = index.assign(end=index["offset"] + index["length"]).groupby(run.cumsum()).agg(
            segment=("segment", "first"), lo=("offset", "first"), hi=("end", "last"), place=("place", "first"))
        data = int(plan["data"].iloc[0])

        def copy(r) -> None:
            with Ranges(output, self.mark).at(data + int(r.place)) as out:
                copy_stretch(r.segment, int(r.lo), int(r.hi), out)

        with ThreadPoolExecutor(8) as pool:
            list(pool.map(copy, runs.itertuples(index=False)))
        return int(plan["size"].iloc[0])

    def clean(self) -> None:
        files, at = filesystem(self.staging)
        if files.get_file_info(at).type.value:
            files.delete_dir(at)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing stays: neither segments, of failed tasks either, nor temporary files."""
        files, at = filesystem(self.folder)
        for info in files.get_file_info(fs.FileSelector(at, allow_not_found=True, recursive=True)):
            if self.mark in info.base_name and info.is_file:
                files.delete_file(info.path)
        self.clean()
